"""Language-model scoring with a weighted back-off automaton over words, pairs and triples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut, partitions, slices

#: Bytes of text that are counted and answered together.
SLICE = 8 << 20
_U = np.uint64
#: Names of the start and the end of a text; no word holds white space.
_START, _END = xxhash.xxh64_intdigest(b"\t"), xxhash.xxh64_intdigest(b"\n")


def _packed(a: np.ndarray) -> bytes:
    """An array byte by byte of its elements, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Names of histories, each followed by a word; the last bit is left free."""
    x = history * _U(0x9E3779B97F4A7C15) + word
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x & ~_U(1)


class Slice:
    """Some texts as one row of tokens: `word` (names), `first` (whether a text begins), `train` (whether it is learnt from), `sizes`."""

    def __init__(self, words: bytes, at: bytes, sizes: bytes, held: Iterable[bool]) -> None:
        self.words, self.at, self.sizes = _unpacked(words, np.uint64), _unpacked(at, np.uint32), _unpacked(sizes, np.int64)
        self.word = self.words[self.at]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(len(self.at), bool)
        self.first[self.begins] = True
        self.train = np.repeat(~np.fromiter(held, bool, len(self.sizes)), self.sizes)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.first] = _START
        self.pair = _joined(before, self.word)

    def triples(self, live: np.ndarray) -> np.ndarray:
        """Names of the pair before, where it is `live`, followed by the word."""
        at = np.flatnonzero(live)
        return _joined(self.pair[at - 1], self.word[at])

    @staticmethod
    def rows(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        """One row, for columns id, held, text: their ids, and the tokens as places in a sorted list of names."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(2), "")))
        words = split.flatten().dictionary_encode()
        kinds = words.dictionary.cast(pa.binary()).to_pylist()
        names = np.fromiter(map(xxhash.xxh64_intdigest, kinds, repeat(0)), np.uint64, len(kinds)) & ~_U(1)
        real = np.fromiter(map(bool, kinds), bool, len(kinds))  # white space at an end leaves an empty word
        at = words.indices.to_numpy()
        there = real[at] if len(at) else np.zeros(0, bool)
        upto = np.concatenate(([0], np.cumsum(there)))[np.cumsum(pc.list_value_length(split).to_numpy())]
        sizes = np.diff(upto, prepend=0) + 1
        every, place = np.unique(np.concatenate((names, [_U(_END & ~1)])), return_inverse=True)
        row = np.full(int(sizes.sum()), place[-1], np.uint32)
        body = np.ones(len(row), bool)
        body[np.cumsum(sizes) - 1] = False
        row[body] = place[at[there]] if len(at) else 0
        held = batch.column(1)
        train = int(sizes[~held.to_numpy(zero_copy_only=False)].sum())
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(batch.column(0)), one(held), pa.array([_packed(sizes.astype(np.int64))]), pa.array([_packed(every)]), pa.array([_packed(row)]), pa.array([train], pa.int64())],
            ["slice", "ids", "held", "sizes", "words", "at", "train"],
        )


_SENT = "bucket int, grams int, slice long, names binary, counts binary"
_REPLY = "slice long, grams int, bucket int, totals binary, different long"


def _distinct(names: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct names (whose last bit is free), and how often each is learnt from."""
    every = np.sort(names | train)
    new = np.ones(len(every), bool)
    np.not_equal(every[1:] >> _U(1), every[:-1] >> _U(1), out=new[1:])
    at = np.flatnonzero(new)
    counts = np.add.reduceat((every & _U(1)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return every[at] & ~_U(1), counts


def _sent(number: int, grams: int, names: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted names with their counts, cut into ranges of names."""
    bucket = ((names >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    own = np.unique(bucket)
    ends = np.searchsorted(bucket, own, "right").tolist()
    parts = list(zip([0, *ends], ends, strict=False))
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int32()), pa.array([grams] * len(own), pa.int32()), pa.array([number] * len(own), pa.int64()), pa.array([_packed(names[s:e]) for s, e in parts], pa.binary()), pa.array([_packed(counts[s:e]) for s, e in parts], pa.binary())],
        ["bucket", "grams", "slice", "names", "counts"],
    )


def _totalled(sent: DataFrame, parts: int) -> DataFrame:
    """For each range that a slice sent: the totals over all slices, in the same order. Rows without a slice have the numbers of different names learnt from.

    A slice sends a name once however often it holds it, so no name's range outgrows the others.
    """

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        bucket, grams = rows[0][:2]
        names = [_unpacked(r[3], np.uint64) for r in rows]
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        every, counts = every[order], np.concatenate([_unpacked(r[4], np.int64) for r in rows])[order]
        new = np.ones(len(every), bool)
        np.not_equal(every[1:], every[:-1], out=new[1:])
        at = np.flatnonzero(new)
        every, total = every[at], np.add.reduceat(counts, at)
        replies = [_packed(total[np.searchsorted(every, x)]) for x in names]
        n = len(rows) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([*(r[2] for r in rows), None], pa.int64()), pa.array([grams] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array([*replies, None], pa.binary()), pa.array([*([None] * (n - 1)), int((total > 0).sum())], pa.int64())],
            ["slice", "grams", "bucket", "totals", "different"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "grams").mapInArrow(run, _REPLY)


def _of(replies: pa.Table, grams: int) -> np.ndarray:
    """A slice's totals for its distinct names of one length, in their order."""
    rows = sorted((b, t) for b, g, t in zip(replies["bucket"].to_pylist(), replies["grams"].to_pylist(), replies["totals"].to_pylist(), strict=True) if g == grams)
    return np.concatenate([np.zeros(0, np.int64), *(_unpacked(t, np.int64) for _, t in rows)])


def _slice_of(table: pa.Table) -> Slice:
    row = table.slice(0, 1).to_pylist()[0]
    return Slice(row["words"], row["at"], row["sizes"], row["held"])


def _held_out(docs: DataFrame, id_col: str) -> Column:
    return F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % 7 == 2


def traverse(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, h1: np.ndarray, h2: np.ndarray, norm: float, prior: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the unigram, log10 of the automaton's probability) of each token, read from left to right.

    States are the empty history, a word seen, and a pair seen; h1 and h2 are the counts of the word and
    of the pair before a token (0: no state), c1 to c3 those of the token, of the pair and of the triple that it ends. In the
    longest state, a token that has followed it has an arc of weight (c + m p) / (h + m), p being the
    probability in the state that drops the first word, m the prior; any other takes the failure
    arc to that state, of weight m / (h + m), and is read there. So each state's probabilities sum to one.
    """
    m2, m3 = prior
    p1 = np.log10((c1 + 1) / norm)
    arc2 = np.log10((c2 + m2 * 10.0**p1) / (h1 + m2))
    p2 = np.where(c2 > 0, arc2, np.log10(m2 / (h1 + m2)) + p1)
    arc3 = np.log10((c3 + m3 * 10.0**p2) / (h2 + m3))
    return p1, np.where(c3 > 0, arc3, np.log10(m3 / (h2 + m3)) + p2)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_state: int = 1, prior: tuple[float, float] = (128.0, 16.0)) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    The model is fitted to the rows whose crc32(id as text) mod 7 is not 2. Every word, every pair
    and every triple of those is counted and has an arc. The empty state's arcs are the
    add-one unigram probabilities, one for all unseen words, and give base_score. States and arcs are
    those of `traverse`; a pair is a state if it is seen `least_state` times or more, at any size of the
    corpus, and triples are counted behind such pairs only (1: all).

    The model never is in one place: texts are cut into slices of a few megabytes, each sends its
    distinct names (64-bit hashes) with their counts to the range that adds them up, and gets the totals back; once for words and
    pairs, once for triples. So what is gathered grows with the corpus, and no task with it.

    A null text counts as empty: its end is its only token. A null id counts as the empty text
    for the split. Repeated rows are counted and scored each; a text of any length is scored whole; without training
    rows every probability is 1; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = 2 * parts
    kind = docs.schema[id_col].dataType.simpleString()

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in slices(batches, 2, SLICE):
            yield Slice.rows(batch, number)
            number += 1

    chosen = docs.select(docs[id_col].alias("id"), _held_out(docs, id_col).alias("held"), docs[text_col].cast("string").alias("text"))
    whole = cut(chosen.mapInArrow(sliced, f"slice long, ids array<{kind}>, held array<boolean>, sizes binary, words binary, at binary, train long"))

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Slice(row["words"], row["at"], row["sizes"], row["held"])
                yield _sent(row["slice"], 1, s.words, np.bincount(s.at[s.train], minlength=len(s.words)), buckets)
                yield _sent(row["slice"], 2, *_distinct(s.pair, s.train), buckets)

    replies = cut(_totalled(whole.select("slice", "words", "at", "sizes", "held").mapInArrow(shorter, _SENT), parts), free=True)
    n_tokens, ends = whole.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()
    n_kinds = replies.filter("grams = 1").agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]
    norm = float(n_tokens + n_kinds + 1)

    def counted(s: Slice, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The counts of each token's pair, and of the pair before if it is a state."""
        c2 = _of(replies, 2)[np.searchsorted(_distinct(s.pair, s.train)[0], s.pair)]
        h2 = np.zeros_like(c2)
        h2[1:] = c2[:-1]
        h2[s.first | (h2 < least_state)] = 0
        return c2, h2

    def longer(left: pa.Table, right: pa.Table) -> pa.Table:
        s = _slice_of(left)
        live = counted(s, right)[1] > 0
        return pa.Table.from_batches([_sent(left["slice"][0].as_py(), 3, *_distinct(s.triples(live), s.train[live]), buckets)])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        s = _slice_of(left)
        c2, h2 = counted(s, right)
        c1 = _of(right, 1)[s.at]
        c3 = np.zeros_like(c2)
        names = s.triples(h2 > 0)
        c3[h2 > 0] = _of(right, 3)[np.searchsorted(_distinct(names, np.zeros(len(names), bool))[0], names)]
        h1 = np.empty_like(c1)
        h1[1:] = c1[:-1]
        h1[s.first] = ends
        base, own = traverse(c1, c2, c3, h1, h2, norm, prior)
        add = lambda x: pa.array(np.add.reduceat(x, s.begins))
        return pa.table([left["ids"].combine_chunks().flatten(), left["held"].combine_chunks().flatten(), pa.array(s.sizes), add((c1 > 0).astype(np.int64)), add(base), add(own)], [id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    known = replies.filter("slice is not null").select("slice", "grams", "bucket", "totals")
    by_slice = whole.select("slice", "ids", "held", "sizes", "words", "at").groupBy("slice")
    triples = cut(_totalled(by_slice.cogroup(known.groupBy("slice")).applyInArrow(longer, _SENT), parts), free=True)
    known = known.union(triples.filter("slice is not null").select("slice", "grams", "bucket", "totals"))
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = by_slice.cogroup(known.groupBy("slice")).applyInArrow(answer, schema)
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
