"""Longest-processing-time sharding: groups that must stay together go to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut, running_total

#: The schedule is broadcast up to this size, and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20


def _shared_out(loads: list[int], size: int, many: int) -> list[int]:
    """How many of `many` items of one size each shard gets if one after another goes to the least-loaded (ties: smaller number).

    The j-th item of shard k is served at load loads[k] + j * size; taken are the `many` least. The
    load of the last is found by halving.
    """
    lo, hi = min(loads), max(max(loads), (sum(loads) + many * size) // len(loads)) + size
    while lo < hi:
        mid = (lo + hi) // 2
        if sum((mid - x) // size + 1 for x in loads if x <= mid) >= many:
            hi = mid
        else:
            lo = mid + 1
    below = [max(0, (lo - 1 - x) // size + 1) for x in loads]
    rest = many - sum(below)
    for k, x in enumerate(loads):
        if rest and x <= lo and (lo - x) % size == 0:
            below[k] += 1
            rest -= 1
    return below


def longest_first(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, how many go to each shard) for classes of (size, how many groups have it), largest first.

    Every group goes to the least-loaded shard (ties: smaller number), which the heap yields. Many
    groups of one size are served at once, with the same outcome.
    """
    heap = [(0, k) for k in range(shards)]
    for size, many in sorted(classes, reverse=True):
        own = [0] * shards
        if many <= 4 * shards:
            for _ in range(many):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                own[k] += 1
        else:
            loads = [x for x, _ in sorted(heap, key=lambda x: x[1])]
            own = _shared_out(loads, size, many)
            heap = [(x + n * size, k) for k, (x, n) in enumerate(zip(loads, own, strict=True))]
            heapq.heapify(heap)
        yield size, own


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): all rows of equal text share a shard, and the shards' sizes are nearly equal.

    A group is the rows of one text (by 64-bit hash: a collision only keeps two texts together).
    Every group is scheduled by its own size, longest first, each to the least-loaded shard. The
    driver holds the table of (size, number of groups) only: n different sizes take n * n / 2
    bytes at least, so that is below 250,000 rows for 30 GB and 15 million for 100 TB. Groups of one size are
    interchangeable: they are numbered by hash, and the schedule says which numbers go where.
    Slots number a shard's rows from 0 without a gap.

    A null text has size 1, like an empty one, checksum 0, and is in the group of the empty text.
    Texts of any length count whole. Repeated rows are rows of their own; null ids are allowed; extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = cut(docs.select(docs[id_col].alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__group")))
    groups = cut(rows.groupBy("__group").agg(F.sum("size").alias("__bytes"), F.lit(1).cast("long").alias("__one")))
    classes = groups.groupBy("__bytes").agg(F.count("*").alias("many")).toArrow()
    plan = list(longest_first(zip(classes["__bytes"].to_pylist(), classes["many"].to_pylist(), strict=True), shards))
    ends = pa.array([list(accumulate(own)) for _, own in plan], pa.list_(pa.int64()))
    schedule = spark.createDataFrame(pa.table({"__size": pa.array([s for s, _ in plan], pa.int64()), "__ends": ends}))
    if len(plan) * shards * 8 <= BROADCAST_BYTES:
        schedule = F.broadcast(schedule)
    numbered = running_total(groups, ["__bytes"], "__one", ["__group"], "__number")
    shard = F.size(F.filter("__ends", lambda x: x <= F.col("__number")))
    homes = numbered.join(schedule, F.col("__bytes") == F.col("__size")).select(F.col("__group").alias("__of"), shard.alias("shard"))
    placed = rows.join(homes, F.col("__group") == F.col("__of")).select(id_col, "size", "text_crc32", "__group", "shard", F.lit(1).cast("long").alias("__one"))
    return running_total(placed, ["shard"], "__one", [id_col, "__group"], "slot").drop("__one", "__group")
