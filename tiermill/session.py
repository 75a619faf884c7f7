"""Session settings the engine relies on."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every transform assumes. UTC makes date truncation
# repeatable; forceOptimizeSkewedJoin lets AQE split a hot join key even when
# the split costs one more exchange in front of the next aggregation.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tiermill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@functools.cache
def _local_root() -> str:
    """One folder for this process, removed when it ends."""
    root = tempfile.mkdtemp(prefix="tiermill-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, for tables and checkpoints.

    The cluster names the root in ``spark.checkpoint.dir``. Only a local
    master, where driver and executors share one disk, may fall back to a
    temporary folder; elsewhere a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The size of the files is known when the reading plan is made, so Spark
    broadcasts a small table and shuffles a large one, without a hint and
    without moving the other side first. The lineage ends at the files.
    ``options`` go to the writer.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def brief_shuffles(*sessions: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    before = [spark.conf.get(SHUFFLES_GO, None) for spark in sessions]
    for spark in sessions:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        for spark, value in reversed(list(zip(sessions, before, strict=True))):
            if value is None:
                spark.conf.unset(SHUFFLES_GO)
            else:
                spark.conf.set(SHUFFLES_GO, value)


_ONCE: dict[tuple[str, str], str] = {}


def stored_once(spark: SparkSession, key: str, write: Callable[[str], None]) -> str:
    """Path of a table that this application writes at its first use, as a scheduled run would, and then only reads."""
    mark = (spark.sparkContext.applicationId, key)
    path = _ONCE.get(mark)
    if path is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return path
    path = shared_dir(spark, key.split(":")[0])
    write(path)
    _ONCE[mark] = path
    return path
