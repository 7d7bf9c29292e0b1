"""Registered queries: one for each operator and function, with the same result in DuckDB SQL where SQL can say it."""
