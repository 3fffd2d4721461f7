"""A session with the settings the engine is tuned for; a cluster's own settings win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of an Arrow batch: texts can be long, and a worker holds several forms of a batch at a time.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 19}


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session in rows and bytes; bounds that are lower stay."""
    for key, most in ARROW.items():
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def session(master: str | None = None, **more: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer", "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        conf |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
    builder = SparkSession.builder.appName("quillon")
    if master:
        builder = builder.master(master)
    for k, v in (conf | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only where all run on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or tempfile.mkdtemp(prefix="quillon-")).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, so no executor's loss costs what made it; see forget."""
    path = f"{shared_folder(df.sparkSession)}/quillon-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it."""
    for df in tables:
        if path := getattr(df, "_quillon_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
