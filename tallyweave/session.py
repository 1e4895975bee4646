"""Session defaults, lineage cutting, and columns that are computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app: str = "tallyweave", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session with the settings the jobs assume; a cluster may override all of them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    session runs in this process alone (tests, a laptop) a local folder is made, once per
    application; on a cluster an unset folder is an error, for executors would each write
    to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/tallyweave"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tallyweave-")
    return _LOCAL_DIRS[app]


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, computes the plan once, survives lost
    executors, and gives the next join a real size statistic.
    """
    return cut_path(df, label)[0]


def cut_path(df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
    """As ``cut``, with the folder written, for tables that are read together with others."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_intermediate(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this application; returns how many.

    To be called when the results that read them are written.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def many(df: DataFrame) -> DataFrame:
    """``df``, which grows with the input, never to be sent whole to driver and executors.

    Spark takes the rows that a generator has multiplied for as many as there were before
    it, so it would broadcast tables that are many times over its limit. A broadcast
    table with a text among its keys takes 64 MB of the driver however small it is.
    """
    return df.hint("merge")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once however often later steps name it.

    A projection is copied into every filter and column that reads it; a generator is not.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made)
