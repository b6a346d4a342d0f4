"""Packing token streams into fixed windows, mixed by source in deficit round-robin."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut, slices

#: Words whose ids a Python worker remembers; then it begins anew, and keeps those only until so many are new again.
REMEMBERED = 350_000
#: Punctuation that is split off a word's end.
_MARKS = ".,!?;:*#%&$|"
#: Offsets of (task, source) pairs are broadcast up to this many rows (24 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
_known: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of whole texts, by a tokenizer that never looks across ASCII white space.

    A text is cut at white space; the ids of a word are found once and remembered. That equals
    encoding the whole text where the tokenizer drops white space and normalises and merges
    within words only, as the `word_bpe` family does. New words are encoded as one line, whose ids
    are dealt out by the place at which a token begins.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if max(self.tokenizer.get_vocab().values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.ids: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Put words into `ids`: from the generation before, from a stem and the marks behind it, or by the tokenizer."""
        ids, before, fresh, parts = self.ids, self.before, set(), {}
        for w in words:
            if (x := before.get(w)) is not None:
                ids[w] = x
                continue
            stem = w.rstrip(_MARKS)
            # behind a letter or digit marks always begin a piece of their own
            if stem and stem != w and stem[-1].isascii() and stem[-1].isalnum() and "<|" not in w:
                parts[w] = stem, w[len(stem) :]
                for x in parts[w]:
                    if x not in ids:
                        if (y := before.get(x)) is not None:
                            ids[x] = y
                        else:
                            fresh.add(x)
            else:
                fresh.add(w)
        line = list(fresh)
        for at in range(0, len(line), 4096):
            self.encode(line[at : at + 4096])
        for w, (stem, marks) in parts.items():
            ids[w] = ids[stem] + ids[marks]

    def encode(self, words: list[str]) -> None:
        alone = [w for w in words if "<|" in w]  # may spell a special token
        words = [w for w in words if "<|" not in w]
        if words:
            found = self.tokenizer.encode_batch([" ".join(words)], add_special_tokens=False)[0]
            line, begins = np.array(found.ids, "<u2").tobytes(), np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
            after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            cuts = (2 * np.searchsorted(begins, after)).tolist()
            self.ids.update(zip(words, [line[s:e] for s, e in zip([0, *cuts], cuts, strict=False)], strict=True))
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.ids[w] = np.array(e.ids, "<u2").tobytes()

    def __call__(self, texts: pa.StringArray) -> list[bytes]:
        """Little-endian 16-bit ids of each text (none of a null one). Each different word is looked up once a call."""
        # the vocabulary is lower-case: folding A-Z first changes nothing, unless a special token is spelled out
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        texts = pc.fill_null(pc.if_else(special, texts, pc.ascii_lower(texts)), "")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if len(self.ids) > REMEMBERED:
            self.before, self.ids = self.ids, {"": b""}
        line = words.dictionary.to_pylist()
        self.learn([w for w in line if w not in self.ids])
        found = list(map(self.ids.__getitem__, line))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        begin, token = np.cumsum(size) - size, words.indices.to_numpy()
        many = size[token]
        upto = np.cumsum(many)
        ids = np.frombuffer(b"".join(found), "<u2")[np.repeat(begin[token] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = np.concatenate(([0], upto))[np.cumsum(pc.list_value_length(split).to_numpy())] * 2
        return [ids[s:e] for s, e in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    if path not in _known:
        _known[path] = WordEncoder(path)
    return _known[path]


@dataclass
class Mixture:
    """Whose turn it is: queues by kind, those of one weight and one number of chunks.

    A queue of weight w is due to have its chunk c served at (c + 1/2) / w: at any moment each queue
    that is not dry has been served its share to within half a chunk, its deficit, which is carried on. Turns are
    the order of due times (ties: by kind, then by member). Due times are compared as rounded,
    which is the same everywhere, so turns are a permutation, found without a look at other chunks.
    """

    weight: np.ndarray
    chunks: np.ndarray
    members: np.ndarray

    @staticmethod
    def of(queues: list[tuple[float, int]]) -> tuple[Mixture, list[tuple[int, int]]]:
        """The mixture of queues (weight, chunks), and each queue's (kind, member)."""
        kinds = {q: k for k, q in enumerate(sorted(set(queues)))}
        seen = [0] * len(kinds)
        names = []
        for q in queues:
            names.append((kinds[q], seen[kinds[q]]))
            seen[kinds[q]] += 1
        return Mixture(np.array([w for w, _ in kinds], np.float64), np.array([c for _, c in kinds], np.int64), np.array(seen, np.int64)), names

    def turns(self, kind: np.ndarray, member: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """The turn, from 0, in which each chunk is served."""
        mine = (chunk + 0.5) / self.weight[kind]
        turn = chunk * self.members[kind] + member
        for k, (w, most, many) in enumerate(zip(self.weight.tolist(), self.chunks.tolist(), self.members.tolist(), strict=True)):
            n = np.clip(np.floor(mine * w + 0.5), 0, most).astype(np.int64)  # chunks served before, to within one
            for _ in range(2):
                due = (n - 0.5) / w
                n = n - ((n > 0) & ((due > mine) | ((due == mine) & (k > kind))))
            for _ in range(2):
                due = (n + 0.5) / w
                n = n + ((n < most) & ((due < mine) | ((due == mine) & (k < kind))))
            turn += np.where(kind == k, 0, n * many)
        return turn


def weights(lengths: dict[str | None, int], targets: dict[str | None, float] | None) -> dict[str | None, float]:
    """The weight of each source: its target; the sources without one share the rest, 1 less the sum, by their lengths. No targets: by their lengths."""
    targets = targets or {}
    rest = 1 - sum(targets.get(s, 0.0) for s in lengths)
    unnamed = sum(n for s, n in lengths.items() if s not in targets)
    if any(t <= 0 for t in targets.values()) or (unnamed and rest < 1e-9):
        raise ValueError("targets are positive, and leave a rest if they don't name all sources")
    return {s: float(targets[s]) if s in targets else rest * n / unnamed for s, n in lengths.items()}


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id_col, source, task, start, doc_tokens, ids): each row's ids, with the end's; start: ids of its source before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        end, at = np.array([end_id], "<u2").tobytes(), {}
        for batch in slices(batches, 2):
            ids = [x + end for x in encode(batch.column(2))]
            starts = []
            for source, x in zip(batch.column(1).to_pylist(), ids, strict=True):
                starts.append(at.get(source, 0))
                at[source] = starts[-1] + len(x) // 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                [id_col, "source", "task", "start", "doc_tokens", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].alias(id_col), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, source string, task int, start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, quantum: int = 256, end_id: int = 2, targets: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of documents, laid into windows: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids).

    Each source's documents, in the order in which they are read, form a queue of chunks of
    `quantum` ids. `targets` are the proportions of tokens that every window is filled to, by source; without them
    they are the sources' shares of all ids. Queues take turns as in deficit round-robin, a
    chunk a turn, and what a queue is short of in one window is carried to the next, across tasks
    too; when a queue runs dry the others go on in their proportions. The turn of a chunk follows
    from the queues' weights and lengths (see `Mixture`), so no window depends on another task's work:
    lengths are summed by task and source, a small table, and each task cuts its own documents.
    Only the last chunk of a queue may be short, so the padding of all windows is below
    quantum * queues + window ids in total.

    Every source is a queue, a null source too; the driver and each worker hold two numbers a source, and work
    grows with the number of different queue lengths. A null or empty text is its end id only; a text
    of any length is encoded whole. Repeated rows are packed each; null ids are kept; extra columns
    are ignored; an empty table gives an empty result. `window` is a multiple of `quantum`.
    """
    if window % quantum:
        raise ValueError("window is not a multiple of quantum")
    spark = docs.sparkSession
    tokens = cut(tokenized(docs, tokenizer, end_id, id_col, text_col, source_col), large=True)
    runs = cut(tokens.groupBy("source", "task").agg(F.sum("doc_tokens").alias("n")))
    totals = {r[0]: r[1] for r in runs.groupBy("source").agg(F.sum("n")).collect()}  # a row a source
    weight = weights(totals, targets)
    names = sorted(totals, key=lambda x: (x is not None, x or ""))
    mixture, places = Mixture.of([(weight[s], -(-totals[s] // quantum)) for s in names])
    numbers = spark.createDataFrame([(s, k, m) for s, (k, m) in zip(names, places, strict=True)], "q_name string, kind int, member int")
    if len(names) <= BROADCAST_ROWS:
        numbers = F.broadcast(numbers)
    from pyspark.sql import Window

    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = cut(based.join(numbers, F.col("source").eqNullSafe(F.col("q_name"))).select(F.col("source").alias("__source"), F.col("task").alias("__task"), "kind", "member", "base"))
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    based = tokens.join(bases, (F.col("task") == F.col("__task")) & F.col("source").eqNullSafe(F.col("__source")))

    short = [(k, m, totals[s] // quantum, quantum - totals[s] % quantum) for s, (k, m) in zip(names, places, strict=True) if totals[s] % quantum]
    holes = np.array(short, np.int64).reshape(-1, 4)
    hole_turn = mixture.turns(holes[:, 0], holes[:, 1], holes[:, 2])
    order = np.argsort(hole_turn)
    hole_turn, hole_size = hole_turn[order], np.concatenate(([0], np.cumsum(holes[order, 3])))
    per = window // quantum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5):
            begin, n, kind, member = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4))
            first, last = begin // quantum, (begin + n - 1) // quantum
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            a = np.maximum(chunk * quantum, begin[row]) - begin[row]
            b = np.minimum((chunk + 1) * quantum, (begin + n)[row]) - begin[row]
            turn = mixture.turns(kind[row], member[row], chunk)
            sequence = turn // per
            # the short chunks that come before in the same window leave no hole
            gone = hole_size[np.searchsorted(hole_turn, turn)] - hole_size[np.searchsorted(hole_turn, sequence * per)]
            offset = (turn % per) * quantum + (begin[row] + a) % quantum - gone
            # a document's chunks served in a row are one piece
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + (b - a)[:-1])
            top = np.flatnonzero(new)
            length = np.add.reduceat(b - a, top) if len(top) else np.zeros(0, np.int64)
            row, start, sequence, offset = row[top], a[top], sequence[top], offset[top]
            ids = [np.frombuffer(x, "<u2").astype("<u4") for x in batch.column(5).to_pylist()]
            own = [ids[r][s : s + k].tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), batch.column(2).take(take), pa.array(sequence), pa.array(offset), batch.column(6).take(take), pa.array(own, pa.binary())],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = based.select(id_col, (F.col("base") + F.col("start")).alias("begin"), "doc_tokens", "kind", "member", "ids", "source")
    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
