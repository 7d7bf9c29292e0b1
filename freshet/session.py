"""Session settings the engine relies on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that decide results. All can be set on a running session.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.timeType.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, wherever they run. Done once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="freshet-")) / package.name), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
    return configure(spark)


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("freshet")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
