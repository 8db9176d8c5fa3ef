"""Session settings and tables written to cut lineage.

Everything that must survive the loss of an executor is written to the folder that
``spark.checkpoint.dir`` names; only where that setting is absent (tests, a laptop) a
folder of this process is used and removed at its end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench: UTC, Arrow, adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


#: Shuffle files are of no use once a written table stands; this setting removes them when its job ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Written:
    """Tables of one operator run, written to the shared folder; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/skein/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        out = df.write.mode("errorifexists").option("compression", "zstd")
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, name: str = "") -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these, which the operator's result still reads."""
        fs, path = self._path()
        for s in fs.listStatus(path):
            if s.getPath().getName() not in names:
                fs.delete(s.getPath(), True)
