"""Session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def get_session(app: str = "veldspar", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing (local tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veldspar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder and read it back.

    The files outlive executors, so what follows never recomputes what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_apart(df: DataFrame, label: str, part: Column) -> tuple[DataFrame, list[DataFrame]]:
    """``written``, and the same rows as a table for each value of the whole number ``part``, which ``emptied`` takes one by one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.withColumn("apart", part.cast("int")).write.partitionBy("apart").option("compression", "zstd").parquet(path)
    whole = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, apart int").parquet(path)
    found = sorted(r.apart for r in whole.select("apart").distinct().collect())
    whole = whole.drop("apart")
    return whole, [spark.read.schema(whole.schema).parquet(f"{path}/apart={i}") for i in found] or [whole]


def emptied(df: DataFrame) -> None:
    """Replace a table of ``written`` that nothing reads any more by one without rows."""
    path = df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else None
    if path:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends; what follows must read written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
