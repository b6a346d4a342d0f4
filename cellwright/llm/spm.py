"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import slices

_MASK = (1 << 64) - 1
_SPACE = "▁"
#: Code points that are segmented at a time.
BLOCK = 1 << 20
#: Draws that a character brings along. A chunk of n characters has n - 1 candidate merges at first, and each merge makes two new ones at most.
DRAWS = 3
#: Chunks up to this length are merged side by side, many at a time; a place takes 6 bits of an agenda's entry.
SHORT = 62
#: Lengths of the matrices that chunks are sorted into.
_LENGTHS = (*range(1, 17), 24, 40, SHORT)
_NONE = np.uint32(0xFFFFFFC0)
_EMPTY = np.uint32(0xFFFFFFFF)
_GONE = 0xFFFF
_known: dict[tuple, Segmenter] = {}


class Segmenter:
    """Merges of one SentencePiece BPE model.

    Candidate merges wait in an agenda ordered by score, then place. With dropout (in 256ths), a
    candidate taken from the agenda is skipped for good if its draw is low. The t-th candidate that
    a chunk takes is decided by the t-th of the draws at the chunk's place in the text, and the
    draws are a keyed hash (Philox) of (seed, document, place); so each occurrence has draws of its own. Pieces only
    shrink by skips, so they decode to the same text.

    A chunk is white space and what follows up to the next: no piece spans more. The agendas of
    many chunks of like length are the columns of one matrix, whose minima are taken from all of
    them in one step. Pieces are numbers in the order of merges; a pair's merge is looked up in a hash table.
    """

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model without normalisation is needed")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal = sorted((-p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL)
        #: A piece's place in the order of merges; behind them, characters that are part of a piece but none themselves.
        number = {model.pieces[i].piece: r for r, (_, i) in enumerate(normal)}
        if any(_SPACE in p.lstrip(_SPACE) for p in number):
            raise ValueError("a piece spans white space")
        self.many = len(number)
        for c in sorted({c for p in number for c in p} - number.keys()):
            number[c] = len(number)
        self.unknown = len(number)
        if self.unknown >= _GONE:
            raise ValueError("pieces are kept in 16 bits")
        self.id = np.array([i for _, i in normal], "<u2")
        self.byte = np.zeros(256, "<u2")
        self.text = [p.piece.replace(_SPACE, " ").encode() for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.text[i] = b""
        self.symbol = np.full(0x110000, self.unknown, np.uint16)
        for p, r in number.items():
            if len(p) == 1 and p != _SPACE:
                self.symbol[ord(p)] = r
        self.symbol[32] = number.get(_SPACE, self.unknown)  # a "▁" of the text itself goes to bytes
        self.pairs = {(number[p[:k]] << 16) | number[p[k:]]: r for p, r in number.items() if r < self.many for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        bits = max(8, (8 * len(self.pairs)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.keys, self.merged = np.full(1 << bits, _EMPTY), np.full(1 << bits, _NONE)
        for key, r in self.pairs.items():
            at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> int(self.shift)
            while self.keys[at] != _EMPTY:
                at = (at + 1) & ((1 << bits) - 1)
            self.keys[at], self.merged[at] = key, r << 6
        self.limit, self.seed = round(dropout * (1 << 8)), seed

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair's merge times 64, or _NONE."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right
        at = ((key * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.merged[at], _NONE)
        rest = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.merged[at[rest[hit]]]
            rest = rest[~hit & (found != _EMPTY)]
        return out

    def _side_by_side(self, symbols: np.ndarray, agenda: np.ndarray, low: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The symbols of chunks, a column each, after all merges; _GONE where a symbol went into the one before.

        Row 0 and the rows behind a chunk hold the unknown symbol, which has no merge. agenda:
        each place's merge with the next (times 64, plus the place). low[base + t]: whether the chunk's t-th candidate is skipped.
        """
        height, n = symbols.shape
        out, column = np.empty_like(symbols), np.arange(n)
        place = np.arange(height)[:, None]
        after, before = np.repeat(place + 1, n, 1).ravel(), np.repeat(place - 1, n, 1).ravel()
        s, a = symbols.ravel(), agenda.ravel()
        step = 0
        while True:
            least = a.reshape(height, n).min(axis=0)
            rows = np.flatnonzero(least < _NONE)
            if 2 * len(rows) < n:  # what is done goes out, and the rest moves together
                out[:, column] = s.reshape(height, n)
                if not len(rows):
                    return out
                s, a, after, before = (x.reshape(height, n)[:, rows].ravel() for x in (s, a, after, before))
                column, base, least, n = column[rows], base[rows], least[rows], len(rows)
                rows = np.arange(n)
            took = least[rows]
            at = (took & np.uint32(63)).astype(np.int64)
            here = at * n + rows
            a[here] = _NONE
            goes = np.flatnonzero(~low[base[rows] + step])
            rows, at, here = rows[goes], at[goes], here[goes]
            new = (took[goes] >> np.uint32(6)).astype(np.uint16)
            there = after[here] * n + rows
            follows = after[there]
            s[here], s[there], a[there], after[here] = new, _GONE, _NONE, follows
            behind = follows * n + rows
            before[behind] = at
            ahead = before[here]
            front = ahead * n + rows
            a[here] = self.merge(new, s[behind]) | at.astype(np.uint32)
            a[front] = self.merge(s[front], new) | ahead.astype(np.uint32)
            step += 1

    def _alone(self, symbols: list[int], low: np.ndarray) -> list[int]:
        """The same for one long chunk, whose agenda is a heap; entries whose parts were merged meanwhile are passed over."""
        pairs, n, asked = self.pairs, len(symbols), 0
        parts, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

        def entry(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := pairs.get((parts[i] << 16) | parts[j])) is not None:
                heapq.heappush(agenda, (r, i, parts[i], parts[j]))

        agenda: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            entry(i, i + 1)
        while agenda:
            r, i, one, other = heapq.heappop(agenda)
            j = after[i]
            if parts[i] != one or j >= n or parts[j] != other:
                continue
            asked += 1
            if low[asked - 1]:
                continue
            parts[i], parts[j], after[i] = r, _GONE, after[j]
            if after[j] < n:
                before[after[j]] = i
            entry(i, after[i])
            entry(before[i], i)
        return parts

    def _draws(self, key: int, n: int) -> np.ndarray:
        """Whether each of the draws of n characters is low."""
        if not self.limit:
            return np.zeros(DRAWS * n, bool)
        return np.random.Philox(key=[self.seed & _MASK, key & _MASK]).random_raw(-(-DRAWS * n // 8)).view(np.uint8)[: DRAWS * n] < self.limit

    def segment(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of texts that begin with a blank each."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        low = np.concatenate([self._draws(k, n) for k, n in zip(keys, size.tolist(), strict=True)])
        blank = points == 32
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[np.cumsum(size) - size] = True
        starts = np.flatnonzero(new)
        length = np.diff(starts, append=len(points))
        symbols = self.symbol[points]
        agenda = np.full(len(points), _NONE)
        agenda[:-1] = self.merge(symbols[:-1], symbols[1:])
        agenda[starts[1:] - 1] = _NONE
        done = symbols.copy()
        kind = np.searchsorted(_LENGTHS, length)
        order = np.argsort(kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=len(_LENGTHS) + 1))
        for k, wide in enumerate(_LENGTHS):
            for at in range(ends[k - 1] if k else 0, ends[k], 1 << 14):
                mine = order[at : min(at + (1 << 14), ends[k])]
                place = np.arange(wide)[:, None]
                inside = place < length[mine]
                index = np.where(inside, starts[mine] + place, 0)
                s = np.full((wide + 2, len(mine)), self.unknown, np.uint16)
                s[1:-1] = np.where(inside, symbols[index], self.unknown)
                a = np.full((wide + 2, len(mine)), _NONE)
                a[1:-1] = np.where(inside, agenda[index], _NONE) | (place + 1).astype(np.uint32)
                merged = self._side_by_side(s, a, low, DRAWS * starts[mine])[1:-1]
                done[index[inside]] = merged[inside]
        for c in order[ends[-2] :].tolist():
            s, n = int(starts[c]), int(length[c])
            done[s : s + n] = self._alone(symbols[s : s + n].tolist(), low[DRAWS * s :])
        return self._ids(points, done, size)

    def _ids(self, points: np.ndarray, done: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """A piece's id, or those of the bytes of a character that is no piece."""
        left = np.flatnonzero(done != _GONE)
        done = done[left]
        fallback = np.flatnonzero(done >= self.many)
        ids = self.id[np.minimum(done, self.many - 1)]
        upto = np.searchsorted(left, np.cumsum(size))
        if len(fallback):
            many = np.ones(len(done), np.int64)
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in points[left[fallback]].tolist()]
            many[fallback] = list(map(len, spelt))
            ends = np.cumsum(many)
            ids = np.repeat(ids, many)
            bytewise = np.repeat(done >= self.many, many)
            ids[bytewise] = self.byte[np.frombuffer(b"".join(spelt), np.uint8)]
            upto = np.concatenate(([0], ends))[upto]
        return np.split(ids, upto[:-1])

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Little-endian 16-bit ids of each text. keys: those of the draws. A long text is cut before white space; its later parts have keys that follow from the first."""
        parts: list[tuple[int, str, int]] = []
        for t, (text, key) in enumerate(zip(texts, keys, strict=True)):
            at, k = 0, 0
            while at < len(text):
                end = at + BLOCK
                while 0 <= (end := text.find(" ", end)) and text[end - 1] == " ":
                    end += 1
                end = len(text) if end < 0 else end
                parts.append((t, text[at:end] if at else f" {text[:end]}", key + k * 0x9E3779B97F4A7C15))
                at, k = end, k + 1
        out: list[list[bytes]] = [[] for _ in texts]
        begin = 0
        while begin < len(parts):
            end, size = begin, 0
            while end < len(parts) and (end == begin or size + len(parts[end][1]) <= BLOCK):
                size += len(parts[end][1])
                end += 1
            own = parts[begin:end]
            for (t, _, _), ids in zip(own, self.segment([x for _, x, _ in own], [k for *_, k in own]), strict=True):
                out[t].append(ids.tobytes())
            begin = end
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; the white space that encoding puts in front is taken off again."""
        return b"".join(map(self.text.__getitem__, memoryview(ids).cast("H")))[1:]


def segmenter(path: str, dropout: float, seed: int) -> Segmenter:
    """The worker's segmenter; it outlives the task."""
    key = (path, dropout, seed)
    if key not in _known:
        _known[key] = Segmenter(*key)
    return _known[key]


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, n_ids, decoded): each text's ids under dropout, how many, and the UTF-8 text they decode to.

    ids: little-endian 16-bit numbers. Each occurrence of a word has its own draws, keyed by the
    seed, the document's id and the place, so each row's result depends on its id, text and the
    parameters only. A null text counts as empty and has no ids; a null id is hashed like 0; repeated
    rows get equal ids; a text of any length is encoded whole, in parts of about a million
    characters; extra columns are ignored; an empty table gives an empty result. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = segmenter(model, dropout, seed)
        for batch in slices(batches, 2):
            ids = cut.encode([x or "" for x in batch.column(2).to_pylist()], batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(map(cut.decode, ids), pa.binary())],
                [id_col, "ids", "n_ids", "decoded"],
            )

    key = F.xxhash64(F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("0")))
    chosen = docs.select(docs[id_col].alias(id_col), key.alias("__key"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_ids long, decoded binary")
