"""Helpers that several operators share: checkpoints, documents, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words: blank, and TAB to CR.
WORD_SPACE = r"[\x20\x09-\x0D]+"


#: What Python workers get at a time while results are cut, as `slices` deals it. Spark's own limits, 10,000 rows and 64 MB, let whole partitions of texts stand beside the heap in several copies.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches to Python workers hold 4 MB or so, however many rows that is; then the session's limit holds again."""
    name, most = _BATCH
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode, where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cellwright-")
    sc.setCheckpointDir(named)


_TWICE: ContextVar[bool] = ContextVar("twice", default=False)


@contextlib.contextmanager
def kept_twice() -> Iterator[None]:
    """Within it, what `cut` gets lies on the disks of two executors in place of a shared folder of scheme file.

    There Hadoop, without its native library, starts a process for each file and each checksum file that it
    creates (chmod), dozens of thousands where small tables are cut in hundreds of partitions. In other
    stores, and with fewer than two executors, the shared folder stays.
    """
    token = _TWICE.set(True)
    try:
        yield
    finally:
        _TWICE.reset(token)


def executors(spark: SparkSession) -> int:
    return spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is among them


def cut(df: DataFrame, free: bool = False, large: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that lost executors cost no recomputation.

    Within `kept_twice` it may lie on two executors' disks instead, unless it is large, as a table that grows with the texts' length.
    free: also remove the shuffle files that this wrote, which nothing reads any more; the driver's garbage
    collection would get to them late. Only for a df that is used for nothing else.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    twice = _TWICE.get() and not large and folder.startswith("file:") and executors(df.sparkSession) > 1
    with small_batches(df.sparkSession):
        out = df.localCheckpoint(eager=True, storageLevel=StorageLevel.DISK_ONLY_2) if twice else df.checkpoint(eager=True)
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if free and cleaner.isDefined():
        for number in _shuffles(df._jdf.queryExecution().executedPlan()):
            cleaner.get().doCleanupShuffle(number, False)
    return out


def _shuffles(plan) -> Iterator[int]:
    """The numbers of the shuffles that the stages of an executed adaptive plan wrote."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                yield node.shuffleId()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle and checkpoint files that nothing refers to any more; it learns of them by the driver's garbage collection, which otherwise may take half an hour."""
    spark.range(1).count()  # the scheduler refers to the last job until the next
    with contextlib.suppress(Py4JError):  # and events that wait for a listener to those that ended
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def give_back() -> None:
    """Return to the system what Arrow and the C library have been given back: a worker lives on between tasks, and would hold it beside the heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about `most` bytes of text (column number `text`), so that Python holds little at once. What a batch took is given back after it."""
    for batch in batches:
        start, n = 0, batch.num_rows
        if n == 0:
            continue
        size = batch.column(text).nbytes
        step = n if size <= most else max(1, int(n * most / size))
        while start < n:
            end = min(n, start + step)
            while end - start > 1 and batch.column(text).slice(start, end - start).nbytes > 2 * most:
                end = start + (end - start) // 2
            yield batch.slice(start, end - start)
            start = end
        if size > most >> 2:
            give_back()
    give_back()


def running_total(df: DataFrame, keys: list[str], value: str, order: list[str], out: str, rows_each: int = 50_000) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same keys that come before.

    A window over the keys alone would put a hot key in one task. The rows of a key are dealt by
    hash over buckets of about `rows_each` rows; a window runs in each bucket, and the buckets'
    totals, a small table, are summed up across buckets. The order is by bucket, then `order`.
    """
    from pyspark.sql import Window

    n = max(1, -(-df.count() // rows_each))
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(n)).cast("int")
    df = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__total"))
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("__base", F.coalesce(F.sum("__total").over(across), F.lit(0))).drop("__total")
    base = base.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), "__base")
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(base, same)
    return joined.withColumn(out, F.col("__local") + F.col("__base")).drop("__bucket", "__b", "__base", "__local", *[f"__k{i}" for i in range(len(keys))])
