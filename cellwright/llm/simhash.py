"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut, partitions, slices
from cellwright.llm.graph import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Adding bits of so many shingles at a time keeps the bit matrix in the cache.
_BLOCK = 8192
#: _SPREAD[byte value] holds the byte's eight bits, lowest first.
_SPREAD = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if n == 0:
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            votes[8 * byte : 8 * byte + 8] += np.bincount(part[:, byte], minlength=256) @ _SPREAD
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist()))


def fingerprint(text: str | bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles (0 if it has no word), as a signed integer."""
    if isinstance(text, str):
        text = text.encode()
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]
        hashes = [digest(line[s:e], seed) for s, e in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    value = _majority(np.array(hashes, np.uint64))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, text_hash long, fp long) for each row. A null text counts as empty; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            values = [fingerprint(x, width) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], [id_col, "text_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias(id_col), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, text_hash long, fp long")


def _slots(fp: Column) -> Column:
    """The two 32-bit segments of a fingerprint as slots of one table: the segment's number above its value."""
    low = F.lit((1 << 32) - 1).cast("long")
    return F.array(fp.bitwiseAND(low), F.shiftrightunsigned(fp, 32) + F.lit(1 << 32).cast("long"))


def _probes(slot: Column) -> Column:
    """The slots within one bit of a segment, itself first. Of two segments that differ in a bit, the one that has it set probes the other: half the ball is enough."""
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    return F.concat(F.array(slot), F.transform(F.filter(bits, lambda x: slot.bitwiseAND(x) != 0), lambda x: slot - x))


def _stars(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (a) within two bits without a pair for each: whatever lies within one bit of a word is linked to the least of it."""
    from pyspark.sql import Window

    near = [0, *(x - (1 << 64) if x >> 63 else x for x in (1 << i for i in range(64)))]
    words = F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in near]), lambda x: x.bitwiseXOR(F.col("a"))))
    return prints.select("a", words.alias("word")).withColumn("b", F.min("a").over(Window.partitionBy("word"))).filter("a <> b").select("a", "b")


def links(prints: DataFrame, fp: str = "fp", crowd: int = 64) -> DataFrame:
    """Edges (a, b) among distinct fingerprints; its components are those of "2 or fewer differing bits".

    Multi-index hashing with two 32-bit segments. Of two bits that differ at most one falls into some
    segment, so a probe of the slots within one bit of each segment fetches the other fingerprint from
    the table that is keyed by (segment, value); the complete distance is verified.

    A slot that holds more than `crowd` fingerprints, as a family of near copies makes it, is split:
    whatever probes it is set aside, and among those whole words take the segment's place (see
    `_stars`: 65 rows a fingerprint, no pairs). So every link counts, and no slot costs its square.

    Both joins are told to sort: Spark sizes an exploded table by the rows before the explode, and would
    broadcast the probes, 17 and more times that, through the driver.
    """
    spark = prints.sparkSession
    parts = partitions(spark)
    # dealt anew before rows are multiplied: adaptive execution sizes tasks by what they read
    own = prints.select(F.col(fp).alias("a")).repartition(parts, "a")
    table = own.select(F.col("a").alias("b"), F.explode(_slots(F.col("a"))).alias("slot"))
    sizes = table.groupBy("slot").agg(F.count("*").alias("n"))
    held = table.hint("merge").join(sizes.filter(F.col("n") <= crowd).select("slot"), "slot").select("slot", "b")
    fetched = held.union(sizes.filter(F.col("n") > crowd).select("slot", F.lit(None).cast("long")))
    asked = own.select("a", F.explode(F.flatten(F.transform(_slots(F.col("a")), _probes))).alias("slot"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    found = cut(asked.hint("merge").join(fetched, "slot").filter(F.col("b").isNull() | near).select("a", "b"))
    stars = _stars(found.filter("b is null").select("a").distinct().repartition(parts, "a"))
    return found.filter("b is not null").union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, text_hash, fp long, component_id): rows whose fingerprints are linked, directly or through others, share the smallest id.

    Nulls: a null text counts as empty, and a text without words has fingerprint 0, linked like
    any other. A null id is kept and never is the smallest unless all ids of a group are null
    (then component_id is null). Repeated rows stay, one result row each. Texts are read whole,
    however long. An empty table gives an empty result; extra columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = connected_components(links(distinct))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, prints["fp"] == named["__fp"]).select(id_col, "text_hash", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each component that `groups` finds: the one of the smallest id (of several such rows, that of the smallest text hash).

    All columns stay. Which rows remain is found among (id, text hash) pairs; the texts are
    shuffled once, in a semi join by that pair. Rows with a null id are kept, whatever they hold.
    """
    found = cut(groups(docs.filter(docs[id_col].isNotNull()), id_col, text_col, width).filter(F.col(id_col) == F.col("component_id")))
    first = found.groupBy("component_id").agg(F.min("text_hash").alias("__hash"), F.count("*").alias("__rows"))
    whole = docs.filter(docs[id_col].isNotNull()).withColumn("__hash", F.xxhash64(docs[text_col].cast("string")))
    kept = whole.join(first.select(F.col("component_id").alias(id_col), "__hash"), [id_col, "__hash"], "left_semi")
    if first.filter("__rows > 1").head(1):
        kept = kept.dropDuplicates([id_col, "__hash"])
    return kept.drop("__hash").select(*docs.columns).unionByName(docs.filter(docs[id_col].isNull()))
