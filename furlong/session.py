"""Session helpers: a local session for tests, the shared work folder, worker import path."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("furlong")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a batch that a Python worker gets at a time; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed, and bound what they are sent at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in paths if p]])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent on one machine (tests) a temporary folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-furlong-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_RUN = uuid.uuid4().hex
_used: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, in a folder of this process."""
    top = f"{shared_dir(spark)}/furlong/{_RUN}"
    if top not in _used:
        if not _used:
            atexit.register(clear)
        _used.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def clear() -> None:
    """Delete this process's intermediate tables. Results that are read from them are gone too; called by itself at the end of
    the process, if the session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for top in list(_used):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _used.discard(top)


#: Rows that a task of a count by many keys gets.
TASK_ROWS = 500_000


def parts(rows: int) -> int:
    """Partitions for so many narrow rows: their number grows with the input, so that a task does not."""
    return max(1, -(-rows // TASK_ROWS))


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
