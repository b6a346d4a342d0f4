"""Scores and fingerprints against versions in plain Python, a symbol or a word at a time."""

import math
import random
import struct
from collections import Counter

import numpy as np
import xxhash

from cellwright.llm import lcp
from cellwright.llm.quality import scored
from tests.llm.conftest import make, prose
from tests.llm.test_texts import WORD, slow_counts

MASK = (1 << 64) - 1


def slow_scores(texts, trusted, buckets, prior):
    """The mean log ratio of each text's hashed words and pairs; both hashes as Spark has them."""
    grams = []
    for t in texts:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(t or "")]
        one = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        grams.append([signed(x) % buckets for x in h] + [signed(one(b, one(a, 42))) % buckets for a, b in zip(h, h[1:], strict=False)])
    raw, target = Counter(), Counter()
    for i, g in enumerate(grams):
        raw.update(g)
        if i in trusted:
            target.update(g)
    f = sum(target.values()) / sum(raw.values())
    w = lambda b: math.log((target[b] + prior) / (f * raw[b] + prior))
    return [sum(map(w, g)) / len(g) if g else None for g in grams]


def test_quality_scores(spark, texts):
    many = [*texts, *(prose(k, 80) for k in range(60)), *(" ".join(w + "#" for w in prose(k, 70).split()) for k in range(20))]
    trusted = set(range(len(texts), len(texts) + 30))
    expected = slow_scores(many, trusted, 512, 4.0)
    rows = scored(make(spark, many), spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=512, prior=4.0).collect()
    assert len(rows) == len(many)
    for r in rows:
        e = expected[r["doc_id"]]
        assert (r["score"] is None) == (e is None) and (e is None or abs(r["score"] - e) < 1e-9)
        assert r["base_failed"] == slow_counts(many[r["doc_id"]])[5] and r["kept"] == (not r["base_failed"] and e is not None and e >= -0.08)


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


STEP = 0x9E3779B97F4A7C15


def toss(left, own):
    """Twice the lowest bit in which two labels differ, plus the own bit there."""
    if left == own:
        return 0
    k = ((left ^ own) & -(left ^ own)).bit_length() - 1
    return 2 * k + (own >> k & 1)


def slow_parse(symbols):
    if not symbols:
        return []
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    seq = [s if n == 1 else mix((s + n * STEP) & MASK) for s, n in runs]
    # the first symbol is tossed against one that differs from it in the lowest bit
    label = [toss(seq[i - 1] if i else seq[0] ^ 1, x) for i, x in enumerate(seq)]
    for _ in range(2):
        label = [toss(label[i - 1] if i else label[0] ^ 1, x) for i, x in enumerate(label)]
    starts = [i for i, x in enumerate(label) if i == 0 or (x > label[i - 1] and (i + 1 == len(label) or x > label[i + 1]))]
    out = []
    for s, e in zip(starts, [*starts[1:], len(seq)], strict=True):
        total = sum(mix((seq[i] + mix((((i - s) & 255) + 1) * STEP & MASK) + ((i - s) >> 8)) & MASK) for i in range(s, e)) & MASK
        out.append(mix((total + (e - s) * STEP) & MASK))
    return out


def slow_sketch(text):
    symbols, out = [mix((ord(c) + STEP) & MASK) for c in text], []
    for level in (1, 2, 3):
        symbols = slow_parse(symbols)
        if level > 1:
            least = [None] * 64
            for s in symbols:
                v = mix((s + level * STEP) & MASK)
                least[v & 63] = v if least[v & 63] is None else min(least[v & 63], v)
            out += [0 if v is None else mix(v) % 255 + 1 for v in least]
    return bytes(out)


def test_sketches(texts, monkeypatch):
    r = random.Random(2)
    odd = ["", "a", "ab" * 300, "x" * 1000, "\U0001f600é" * 40, "".join(r.choices("ab", k=700)), *((t or "")[:4000] for t in texts), *(prose(k, 150) for k in range(6))]
    expected = [slow_sketch(t) for t in odd]
    for block in (lcp.BLOCK, 500):  # texts laid end to end, and texts longer than a block
        monkeypatch.setattr(lcp, "BLOCK", block)
        assert [x.tobytes() for x in lcp.sketches(odd)] == expected


def test_likeness_follows_the_shared_part():
    """Against the exact Jaccard similarity of phrase names at the two levels."""
    near = []
    for k in range(30):
        base, other = prose(k, 400), prose(1000 + k, 400)
        text = base[: len(base) * (k + 1) // 31] + other
        names = []
        for t in (base, text):
            symbols, levels = [mix((ord(c) + STEP) & MASK) for c in t], []
            for level in (1, 2, 3):
                symbols = slow_parse(symbols)
                levels += [set(symbols)] if level > 1 else []
            names.append(levels)
        exact = np.mean([len(a & b) / len(a | b) for a, b in zip(*names, strict=True)])
        a, b = lcp.sketches([base, text])
        near.append(lcp.likeness(a[None], b[None])[0] - exact)
    assert abs(np.mean(near)) < 0.05 and np.std(near) < 0.1
