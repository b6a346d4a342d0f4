import random

from cellwright.llm import nearcopies, simhash
from cellwright.llm.common import cut
from cellwright.llm.nearcopies import linked, near_copies
from cellwright.llm.simhash import fingerprint
from corpus_pipeline import near_dedup
from tests.llm.conftest import make, prose
from tests.llm.test_dedup import components


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(texts):
    sets = [slow_shingles(t) for t in texts]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return components(near, range(len(texts)))


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for k in range(edits):
        words[r.randrange(len(words))] = f"new{seed}x{k}"
    return " ".join(words)


def family():
    """Copies with few to many edits, some of edited ones, around the threshold; a line that all texts hold."""
    line = "this very line stands in each of the texts here"
    base = [prose(k, 60 + 40 * k) for k in range(6)]
    near = [edited(b, 100 * i + e, e) for i, b in enumerate(base) for e in range(1, 9)]
    chains = [edited(near[k], 1000 + k, 2) for k in range(0, len(near), 3)]
    return [f"{line}\n{t}" for t in [*base, *near, *chains]]


def test_near_copies_are_complete(spark, texts, empty, clashing):
    every = [*texts, *family()]
    rows = near_copies(make(spark, every)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == slow_components(every)
    for pivots in (0,):
        again = near_copies(make(spark, every), pivots=pivots).collect()
        assert {r["doc_id"]: r["component_id"] for r in again} == slow_components(every)
    assert near_copies(empty).collect() == [] and near_copies(clashing).count() == len(texts)


def test_stage_removes_near_copies_far_beyond_two_bits(spark):
    every = family()
    expected = slow_components(every)
    far = [i for i, c in expected.items() if c < i and ((fingerprint(every[i]) ^ fingerprint(every[c])) & (1 << 64) - 1).bit_count() > 2]
    kept = near_dedup(spark, make(spark, every), "")
    assert len(far) > 5 and {r["doc_id"] for r in kept.collect()} == set(expected.values())


def test_fingerprints_link_first(spark, monkeypatch):
    """Texts are linked by their fingerprints through multi-index hashing; a link of texts that are not alike is dropped by the exact check."""
    base, asked = prose(900, 400), []
    drowned = "again " * 4000
    every = [base, f"{base} end", drowned, f"{drowned} {prose(901, 30)}", prose(902, 80)]
    prints = [fingerprint(t, 5) for t in every]
    apart = lambda i, j: ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count()
    assert apart(0, 1) <= 2 and apart(2, 3) <= 2

    pairs = linked(spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, node long")).collect()
    assert {tuple(r) for r in pairs} == {(i, j) for i in range(5) for j in range(i + 1, 5) if apart(i, j) <= 2}

    monkeypatch.setattr(nearcopies, "linked", lambda p: asked.append({r["fp"] for r in p.collect()}) or linked(p))
    assert {r["doc_id"]: r["component_id"] for r in near_copies(make(spark, every)).collect()} == slow_components(every) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert asked == [set(prints)]


def test_linking_broadcasts_no_probes(spark, monkeypatch):
    """The pipeline's fingerprints: however few rows Spark takes the exploded probes for."""
    seen, r = [], random.Random(12)
    monkeypatch.setattr(simhash, "cut", lambda df, **more: seen.append(df) or cut(df, **more))
    linked(spark.createDataFrame([(r.getrandbits(63), k) for k in range(3000)], "fp long, node long"))
    assert len(seen) == 1 and "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()
