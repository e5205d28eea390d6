"""Session helpers: local test sessions and durable cuts of lineage."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def local_session(cores: int | str = 8, app: str = "panelmill", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary one only in one local process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif re.fullmatch(r"local(\[.*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelmill-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


class Scope:
    """Owner of the tables that ``durable`` writes while it is the innermost one.

    ``with scope():`` around a query and its action deletes them afterwards.
    Tables written outside any scope belong to the process and are deleted
    when it ends in an orderly way.
    """

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def own(self, spark: SparkSession, path: str) -> None:
        self.paths.append((spark, path))

    def close(self) -> None:
        while self.paths:
            spark, path = self.paths.pop()
            try:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except (OSError, Py4JError, AttributeError):
                pass  # the session has stopped; the folder's owner cleans it


_PROCESS = Scope()
_INNERMOST: ContextVar[Scope] = ContextVar("scope", default=_PROCESS)
atexit.register(_PROCESS.close)


@contextmanager
def scope() -> Iterator[Scope]:
    """A scope for the tables of one action."""
    own = Scope()
    token = _INNERMOST.set(own)
    try:
        yield own
    finally:
        _INNERMOST.reset(token)
        own.close()


def owned(spark: SparkSession, path: str) -> str:
    """Give a path in the checkpoint folder to the innermost scope."""
    _INNERMOST.get().own(spark, path)
    return path


def side_by_side(tasks: Sequence[Callable[[], T]], workers: int = 4) -> list[T]:
    """Results of independent driver tasks, up to ``workers`` of them at a time.

    Each runs in a thread whose tables belong to the caller's scope. Spark
    fills its cores from the jobs of all threads, so many short jobs in a row,
    as iterative fits make them, leave fewer cores idle. The first error is raised.
    """
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        started = [pool.submit(copy_context().run, task) for task in tasks]
        return [s.result() for s in started]


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go, which else stay until the driver happens to collect its garbage.

    For use after a large table is stored, whose own shuffles are several times as large.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Held by tasks that run side by side during steps over whole tables, whose shuffles would else lie on the disk together.
LARGE = threading.RLock()


@contextmanager
def large_step(spark: SparkSession) -> Iterator[None]:
    """A step over a whole table: one at a time, and its shuffle files go at its end."""
    with LARGE:
        yield
        release_shuffles(spark)


def stored_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, stored; the tables and shuffles that it came from are deleted."""
    outer = _INNERMOST.get()
    with scope() as own:
        kept = durable(make())
        outer.own(*own.paths.pop())
    release_shuffles(kept.sparkSession)
    return kept


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The table survives the loss of executors, is pruned by the columns a later
    pass needs, and has a known size, from which Spark chooses its joins. It
    belongs to the innermost ``scope``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = owned(spark, f"{spark.sparkContext.getCheckpointDir()}/panelmill-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
