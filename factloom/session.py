"""Session helpers: a local builder for tests and a lineage cut that survives executor loss."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "factloom") -> SparkSession:
    """Session for tests and the local bench. Cluster jobs bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session whose executor is the driver itself gets one of its own where none is set."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


#: Rows of one file of a written table. A scan makes a task of a file or of few, so a table that packs well is still read by many tasks.
FILE_ROWS = 100_000


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Unlike a cached frame it survives lost executors, and unlike an RDD checkpoint its last
    stage runs once, its columns can be pruned, and its true size is known to the next join.
    ``options`` go to the writer. With ``maxRecordsPerFile=FILE_ROWS`` a table is read by many tasks however well it packs: tasks of a scan
    are cut by bytes, and millions of alike texts may be a few megabytes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is sorted and merged.

    The planner takes the size of Parquet files for that of their rows. Paths and names compress by far more than ten to one, so a
    side of millions of rows may pass for a small one and be gathered in the driver; both sides of such a join grow with the input.
    """
    return df.hint("merge")
