"""Session settings and the shared scratch folder."""

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Paths written, by nested block; the first list is that of the process.
_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=([],))
#: The bucketed table that lies at a path.
_tables: dict[str, str] = {}


def local_session(cpus="*", partitions=8, app="tastegraph", memory="16g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # TCP between tasks and their Python workers waits up to 40 ms for each answer.
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may leave it out; it gets a folder of its own
    that is deleted when the process ends. On a cluster of several machines the
    folder must be named with the scheme of a store that all of them reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    one_machine = spark.sparkContext.master.startswith("local")
    if named:
        if not one_machine and named.startswith("file:"):
            raise ValueError("spark.checkpoint.dir is on one machine's disk: " + named)
        return named
    if not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="tastegraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder, noted for the block that asks for it."""
    path = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
    _blocks.get()[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one path of the scratch folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what the current block, or the process outside any block, has written.

    To be called once no DataFrame built on it is needed any more.
    """
    written = _blocks.get()[-1]
    while written:
        path = written.pop()
        if path in _tables:
            spark.sql(f"drop table if exists {_tables.pop(path)}")
        drop_path(spark, path)


@contextmanager
def temporary_scratch(spark: SparkSession):
    """Delete at the end what was written to the scratch folder inside the block.

    Every block has its own list, kept per thread of control, so jobs that run
    side by side leave each other's files alone.
    """
    token = _blocks.set((*_blocks.get(), []))
    try:
        yield
    finally:
        drop_scratch(spark)
        _blocks.reset(token)


#: Frees the shuffle files of a statement when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Free the shuffle files behind a table that is written inside the block."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before) if before else spark.conf.unset(_FREE_SHUFFLES)


def materialise(df: DataFrame, name: str, with_path: bool = False):
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives later
    plans a column-pruned scan with known size. The shuffle files behind ``df``
    are freed once it is written. ``with_path`` also returns the path, for a
    caller that drops the table itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return (table, path) if with_path else table


def bucketed(df: DataFrame, name: str, columns: list[str], buckets: int) -> DataFrame:
    """Write ``df`` to the scratch folder in buckets of ``columns`` and read it back.

    A join by these columns takes the table as it lies and shuffles the other side
    alone. The table has a name of its own until the scratch folder is dropped.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _tables[path] = f"{name}_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).option("path", path).format(
            "parquet"
        ).saveAsTable(_tables[path])
    return spark.table(_tables[path])
