"""Session helpers. A cluster's own settings always win over the defaults here."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "tidecast", cpus: str | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter builds it."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only in a local session (tests) a temporary folder is made where that is unset. On a cluster
    each executor would write to its own disk there, so it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tidecast-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, stem: str) -> str:
    """New, never used path below the shared folder."""
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


#: Rows of one task behind a shuffle.
PART_ROWS = 500_000


def parts(df, rows: int = PART_ROWS) -> int:
    """Partitions for a shuffle of as many rows as ``df`` has, which grow with the input: the session's
    own number at least. ``df`` should be a table as read, whose rows are counted from its footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df, n: int, *keys: str):
    """``df`` by ``keys`` in ``n`` partitions, where its rows need more than the session's number that
    Spark's own shuffles have; else as it is."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialise(df, stem: str):
    """Cut the lineage with a written table, which survives lost executors."""
    path = fresh_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
