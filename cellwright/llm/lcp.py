"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import partitions

#: Slots of each of the two sketches of a fingerprint; each slot is a byte, 0 where no phrase falls.
SLOTS = 64
#: Levels of phrases that a fingerprint holds: of about 12 and of about 40 characters.
LEVELS = (2, 3)
#: Code points that are parsed at a time, so that arrays stay in the cache.
BLOCK = 1 << 18
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that scatters bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_STEP = _U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _PLACE = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    _CHARS = _mix(np.arange(1 << 16, dtype=np.uint64) + _STEP)


def _toss_table(n: int) -> np.ndarray:
    """[left, own] -> 2 * (lowest bit in which they differ) + own's bit there."""
    left, own = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    low = (left ^ own) & -(left ^ own)
    return np.where(low > 0, 2 * np.bitwise_count(np.maximum(low, 1) - 1).astype(np.int64) + ((own & low) > 0), 0).astype(np.uint8)


_SECOND, _THIRD = _toss_table(128), _toss_table(16)


def _left(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(labels)
    out[1:] = labels[:-1]
    out[first] = labels[first] ^ 1  # a document's first symbol is tossed against one that differs in its lowest bit
    return out


def parse(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (phrase names, their documents) of symbol sequences laid end to end; doc: each symbol's document, ascending.

    Runs of one symbol become one symbol. Three rounds of deterministic coin tossing give each
    symbol a label below 8 that differs from its neighbours' and depends on three symbols to the left
    only; phrases begin at local maxima of the labels. So equal stretches of text are cut alike,
    wherever they stand, but for a few symbols at their ends. A phrase's name is a hash of its symbols.
    """
    n = len(symbols)
    if n == 0:
        return symbols, doc
    with np.errstate(over="ignore"):
        new = np.ones(n, bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        if len(at) < n:
            run = np.diff(at, append=n).astype(np.uint64)
            symbols, doc, n = symbols[at], doc[at], len(at)
            long = np.flatnonzero(run > 1)
            symbols[long] = _mix(symbols[long] + run[long] * _STEP)
        first = np.ones(n, bool)
        first[1:] = doc[1:] != doc[:-1]
        first = np.flatnonzero(first)
        differ = np.empty_like(symbols)
        np.bitwise_xor(symbols[1:], symbols[:-1], out=differ[1:])
        differ[first] = _U(1)
        differ &= ~differ + _U(1)
        label = (2 * np.bitwise_count(differ - _U(1)) + ((symbols & differ) != 0)).astype(np.uint8)
        label = _SECOND[_left(label, first), label]
        label = _THIRD[_left(label, first), label]
        up = np.ones(n, bool)
        np.greater(label[1:], label[:-1], out=up[1:])
        up[first] = True
        down = np.ones(n, bool)
        np.greater(label[:-1], label[1:], out=down[:-1])
        down[first[1:] - 1] = True
        top = up & down
        top[first] = True
        starts = np.flatnonzero(top)
        length = np.diff(starts, append=n)
        place = np.arange(n) - np.repeat(starts, length)
        names = np.add.reduceat(_mix(symbols + _PLACE[place & 255] + (place >> 8).astype(np.uint64)), starts)
        return _mix(names + length.astype(np.uint64) * _STEP), doc[starts]


def sketches(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text: a row of 2 * SLOTS bytes."""
    out = np.zeros((len(texts), 2, SLOTS), np.uint8)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        points = np.frombuffer("".join(texts[begin:end]).encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(end - begin), [len(x) for x in texts[begin:end]])
        with np.errstate(over="ignore"):
            symbols = _CHARS[points] if not len(points) or points.max() < 1 << 16 else _mix(points.astype(np.uint64) + _STEP)
            for level in range(1, LEVELS[-1] + 1):
                symbols, doc = parse(symbols, doc)
                if level in LEVELS:
                    value = _mix(symbols + _U(level) * _STEP)
                    least = np.full((end - begin) * SLOTS, ~_U(0))
                    np.minimum.at(least, doc * SLOTS + (value & _U(SLOTS - 1)).astype(np.int64), value)
                    byte = np.where(least == ~_U(0), _U(0), _mix(least) % _U(255) + _U(1)).astype(np.uint8)
                    out[begin:end, LEVELS.index(level)] = byte.reshape(-1, SLOTS)
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of common phrases (Jaccard, the mean of both levels), from 0 to 1; 1 for two empty texts, 0 for one."""
    same = ((a == b) & (a > 0)).sum(2)
    either = ((a > 0) | (b > 0)).sum(2)
    share = np.where(either > 0, same / np.maximum(either, 1), 1.0)
    by_chance = 1 / 255
    return np.clip((share - by_chance) / (1 - by_chance), 0, 1).mean(1)


def edited(text: str, after: str) -> str:
    """text, its last third replaced by as much of the start of the next text (or all of it)."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def in_order(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, tail, id_col, text) so that each bucket's rows, sorted by (tail, id descending), are followed by the next document.

    The ids are cut into `buckets` ranges by approximate quantiles, and the first document of
    each range is dealt to the range before it too, marked as tail (the first of all to the last
    range). So no task sees more than its range, and no text moves more than once but for
    those few.
    """
    key = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), key.alias("key"))
    shares = ",".join(repr(i / buckets) for i in range(1, buckets))
    bounds = keyed.agg(F.expr(f"percentile_approx(key, array({shares}), {max(10000, 20 * buckets)})")).first()[0] if buckets > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    if bounds:
        table, n = F.expr(f"array({','.join(f'cast({x} as bigint)' for x in bounds)})"), len(bounds)
        halve = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(table, ((a["lo"] + a["hi"]) / 2).cast("int")) > F.col("key"), F.struct((((a["lo"] + a["hi"]) / 2).cast("int") + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).cast("int").alias("hi")))
        bucket = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda a: a["lo"])
    else:
        bucket = F.lit(0)
    keyed = keyed.withColumn("bucket", bucket)
    tops = sorted(tuple(r) for r in keyed.groupBy("bucket").agg(F.max("key")).collect())  # `buckets` rows at most
    spark = docs.sparkSession
    before = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]
    joined = keyed.join(F.broadcast(spark.createDataFrame(before, "top long, before int")), F.col("key") == F.col("top"), "left")
    own, also = F.struct("bucket", F.lit(False).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    dealt = joined.select(id_col, "key", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("to"))
    return dealt.select("to.bucket", "to.tail", "key", F.xxhash64("text").alias("hash"), id_col, "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The next document is that of the next smaller id; after the last comes the first. A null text
    counts as empty, a null id as the smallest; rows of equal id follow each other by the hash of
    their text; a single row is its own next. Equal texts have equal fingerprints; the empty text's is all
    zeros, like itself to 1 and like any other to 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    ordered = in_order(docs, id_col, text_col, min(4 * parts, 20_000))
    sorted_ = ordered.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), "hash")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answer(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """rows: (bucket, tail, id, text), each but the last with its successor behind it."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        prints = sketches([r[3] for r in rows])
        texts = [edited(rows[i][3], rows[i + 1][3]) for i in own]
        changed = sketches(texts)
        mine, following = prints[own], prints[[i + 1 for i in own]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], id_type),
                pa.array([len(rows[i][3]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in texts]),
                pa.array([x.tobytes().hex() for x in mine], pa.string()),
                pa.array([x.tobytes().hex() for x in changed], pa.string()),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, following)),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(2).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                more = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                held += more
                size += sum(len(r[3]) for r in more)
                if size > 4 * BLOCK and len(held) > 1:
                    yield answer(held, id_type)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield answer(held, id_type)

    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_.select("bucket", "tail", id_col, "text").mapInArrow(run, schema)
