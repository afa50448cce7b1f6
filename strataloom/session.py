"""Session settings and the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``conf`` adds to it."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _written.append(path)
    block = _block.get()
    if block is not None:
        block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: folders of all tables that materialize wrote and nothing deleted
_written: list[str] = []
#: those of the innermost block of scratch; each thread has its own
_block: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread materializes within the block are deleted at its end: for steps whose result is written before."""
    mine: list[str] = []
    before = _block.set(mine)
    try:
        yield
    finally:
        _block.reset(before)
        _delete(spark, mine)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote in any thread, once no DataFrame reads them any more."""
    _delete(spark, list(_written))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        with contextlib.suppress(ValueError):  # swept before
            _written.remove(path)
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
