import hashlib
import random
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from cellwright.llm import sharding, simhash
from cellwright.llm.common import cut
from cellwright.llm.graph import connected_components
from cellwright.llm.lcp import edited, fingerprints, likeness, sketches
from cellwright.llm.linededup import dedup_lines
from cellwright.llm.sharding import longest_first, shard_by_bytes
from cellwright.llm.simhash import fingerprint, keep_first, links, near_duplicates
from tests.llm.conftest import make, prose


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def test_fingerprints(texts):
    for t in texts:
        assert fingerprint(t) == slow_fingerprint(t)
    assert max(len((t or "").split()) for t in texts) > 8192  # more shingles than are counted at a time


def test_links_find_all_within_two_bits(spark):
    r = random.Random(5)
    seen = {0}
    for _ in range(40):
        x = r.getrandbits(64)
        seen.add(x)
        for _ in range(r.randrange(9)):
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            seen.add(x)
    # one large family
    family = r.getrandbits(64)
    seen |= {family ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)}
    prints = sorted(map(signed, seen))
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & mask).bit_count() <= 2]
    expected = components(near, prints)
    for crowd in (0, 3, 10_000):  # every slot is split, some, and none
        got = {row["node"]: row["root"] for row in connected_components(links(df, crowd=crowd)).collect()}
        assert {x: got.get(x, x) for x in prints} == expected
    pairs = {tuple(sorted(x)) for x in links(df, crowd=10_000).collect()}
    assert pairs == {tuple(sorted(x)) for x in near}


def test_probes_are_not_broadcast(spark, monkeypatch):
    """However few rows Spark takes an exploded table for."""
    seen = []
    monkeypatch.setattr(simhash, "cut", lambda df, **more: seen.append(df) or cut(df, **more))
    r = random.Random(11)
    links(spark.createDataFrame([(signed(r.getrandbits(64)),) for _ in range(3000)], "fp long"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chains(spark):
    r = random.Random(3)
    names = list(range(400))
    r.shuffle(names)
    pairs = [(names[i], names[i + 1]) for i in range(299)] + [(names[i], names[300]) for i in range(301, 400)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components(pairs, names)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark, texts, empty, clashing):
    rows = near_duplicates(make(spark, texts)).collect()
    prints = {r["doc_id"]: r["fp"] for r in rows}
    mask = (1 << 64) - 1
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & mask).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(near, prints)
    assert near_duplicates(empty).collect() == [] and near_duplicates(clashing).count() == len(texts)
    odd = near_duplicates(make(spark, ["one two three four", "one two three four", None], ids=[None, 4, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in odd if r["component_id"] is not None) == [(False, 4), (True, 4)]


def test_keep_first(spark, texts, empty, clashing):
    docs = make(spark, texts)
    kept = keep_first(docs)
    firsts = {r["component_id"] for r in near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == firsts
    assert keep_first(empty).collect() == []
    assert sorted(keep_first(clashing).columns) == sorted(clashing.columns) and keep_first(clashing).count() == len(firsts)
    # repeated rows become one, another text of the same id is another document only where its group lacks a smaller id
    twice = make(spark, ["alpha beta gamma delta", "alpha beta gamma delta", "one two three four five", None], ids=[1, 1, 7, None])
    assert sorted(str(r["doc_id"]) for r in keep_first(twice).collect()) == ["1", "7", "None"]


def slow_schedule(sizes, shards):
    """Each item, largest first, to the least-loaded shard: {(size, shard): items}, loads."""
    loads, out = [0] * shards, Counter()
    for size in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += size
        out[size, k] += 1
    return out, loads


def test_longest_first_equals_one_by_one():
    r = random.Random(8)
    assert slow_schedule([7, 5, 4, 4, 1], 2) == ({(7, 0): 1, (5, 1): 1, (4, 1): 1, (4, 0): 1, (1, 1): 1}, [11, 10])
    for _ in range(300):
        shards = r.randrange(1, 9)
        sizes = [s for s in r.sample(range(1, 60), r.randrange(1, 12)) for _ in range(r.choice((1, 2, 7, 40, 300)))]
        got = {(s, k): n for s, own in longest_first(Counter(sizes).items(), shards) for k, n in enumerate(own) if n}
        assert got == slow_schedule(sizes, shards)[0]


def test_sharding(spark, texts, empty, clashing):
    many = texts + [prose(k % 150, 5 + k % 60) for k in range(600)]
    group = Counter()
    for t in many:
        group[t or ""] += len((t or "").encode()) + 1
    expected, loads = slow_schedule(group.values(), 5)
    for most in (sharding.BROADCAST_BYTES, 0):
        sharding.BROADCAST_BYTES, kept = most, sharding.BROADCAST_BYTES
        rows = shard_by_bytes(make(spark, many), shards=5).collect()
        sharding.BROADCAST_BYTES = kept
        assert len(rows) == len(many)
        home, load, slots = {}, [0] * 5, {}
        for r in rows:
            t = many[r["doc_id"]] or ""
            assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
            home.setdefault(t, set()).add(r["shard"])
            load[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(len(x) == 1 for x in home.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert Counter((group[t], next(iter(x))) for t, x in home.items()) == expected and load == loads
    assert shard_by_bytes(empty).collect() == [] and shard_by_bytes(clashing).count() == len(texts)
    assert shard_by_bytes(make(spark, ["a", None, ""], ids=[None, None, 1])).count() == 3


def test_locally_consistent():
    base, head = prose(1, 900), prose(2, 50)
    prints = sketches([base, head + base, base[: len(base) // 2], prose(3, 900), "", "", "x" * 5000, "ab" * 300])
    near = lambda a, b: likeness(prints[a : a + 1], prints[b : b + 1])[0]
    assert near(0, 0) == 1 and near(0, 1) > 0.85 and 0.35 < near(0, 2) < 0.65 and near(0, 3) < 0.15
    assert near(4, 5) == 1 and near(0, 4) == 0 and (prints[4] == 0).all()


def test_text_fingerprints(spark, texts, empty, clashing):
    docs = make(spark, texts)
    rows = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    seen = {}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        own, after = texts[i] or "", texts[j] or ""
        new = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        r = rows[i]
        assert new == edited(own, after) and r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (sketches([x]) for x in (own, new, after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.tobytes().hex(), b.tobytes().hex())
        assert r["near_edited"] == likeness(a, b)[0] and r["near_next"] == likeness(a, c)[0]
        assert seen.setdefault(own, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints(empty).collect() == [] and fingerprints(clashing).count() == len(texts)
    assert fingerprints(make(spark, ["only one"])).first()["near_next"] == 1
    assert fingerprints(make(spark, ["a b", "c d", None, "e"], ids=[5, 5, None, 9])).count() == 4


def slow_lines(rows, width=3):
    """rows: (id, text) without repetitions, in order. {(id, text): (lines, removed, text)}"""
    seen, out = set(), {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - width + 1):
            w = tuple(lines[k : k + width])
            if w in seen:
                gone |= set(range(k, k + width))
            seen.add(w)
        out[i, text] = len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark, texts, empty, clashing):
    passage = "first line of it\nsecond line of it\nthird line of it\nfourth line"
    more = [f"a{k}\nb\n{passage}\nc{k}" for k in range(5)] + ["x\n" * 30, "\n\n\n\n", "p\nq", "p\nq\nr", "p\nq\nr\np\nq\nr"]
    every = [*texts, *more]
    docs = make(spark, every)
    expected = slow_lines([(i, t) for i, t in enumerate(every) if t is not None])
    for r in dedup_lines(docs).collect():
        t = every[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["text"]) == ((0, 0, None) if t is None else expected[r["doc_id"], t])
    assert dedup_lines(empty).collect() == []
    assert dedup_lines(clashing).filter("fp <> 'mine'").count() == 0 and dedup_lines(clashing).count() == len(texts)
    twice = dedup_lines(make(spark, [passage, passage, passage], ids=[1, 1, None])).orderBy("doc_id").select("n_removed").collect()
    assert [r[0] for r in twice] == [0, 4, 4]
