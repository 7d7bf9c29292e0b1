"""freshet: an incremental SQL analytics engine on Spark."""
