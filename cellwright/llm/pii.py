"""Personal data: fixed patterns as seeds, and identifiers found by the contexts those seeds induce."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut, slices

#: In the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits is entered at its first digit only: a later start would end the same way
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# loose shapes, which a context may confirm
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])++")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3}(?![0-9])")
_LOOSE_EMAIL = re.compile(r"(?<![^\s\"'<(,;:])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63})*", re.IGNORECASE)
_WORD = re.compile(r"\S+")
#: Characters on each side of a candidate in which its context words are looked for.
REACH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > floor and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches, leftmost and non-overlapping within a kind, in order."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, possible kinds) of identifier-like strings that overlap neither `taken` spans nor each other."""
    found: list[tuple[int, int, tuple[int, ...]]] = []
    if "@" in text or "at]" in text.lower() or "at)" in text.lower():
        found += [(m.start(), m.end(), (0,)) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), (1,)) for m in _LOOSE_IP.finditer(text) if all(int(x) <= 255 for x in re.findall(r"[0-9]+", m.group()))]
        for m in _NUMBER.finditer(text):
            n, s = len(_digits(m.group())), m.start()
            kinds = (*((2,) if 12 <= n <= 19 else ()), *((3,) if 7 <= n <= 15 else ()))
            if kinds:
                while s and text[s - 1] in "(+":
                    s -= 1
                found.append((s, m.end(), kinds))
    busy = sorted((s, e) for s, _, e in taken)
    out, k, last = [], 0, -1
    for s, e, kinds in sorted(found):
        while k < len(busy) and busy[k][1] <= s:
            k += 1
        if s >= last and not (k < len(busy) and busy[k][0] < e):
            out.append((s, e, kinds))
            last = e
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span: the word before, the two before, the words on both sides."""
    before = _WORD.findall(_DIGIT.sub("#", text[max(0, start - REACH) : start].lower()))[-2:]
    after = _WORD.search(_DIGIT.sub("#", text[end : end + REACH].lower()))
    one = before[-1] if before else "^"
    return [_hash(f"L {one}"), _hash(f"LL {' '.join(before)}"), _hash(f"LR {one} _ {after.group() if after else '$'}")]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns with `base` (kind, start, end of the seeds), `base_sha256`, and `found`: every identifier-like string with its contexts."""
    others = [c for c in docs.columns if c != text_col]
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    seen = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.list_(pa.int32())), ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(others)):
            base, digest, found = [], [], []
            for text in batch.column(len(others)).to_pylist():
                text = text or ""
                seeds = seed_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in seeds])
                digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in seeds).encode()).hexdigest())
                every = [(s, e, (k,), True) for s, k, e in seeds] + [(s, e, k, False) for s, e, k in loose_spans(text, seeds)]
                found.append([{"start": s, "end": e, "kinds": k, "instance": _hash(text[s:e].lower()), "seed": seed, "patterns": contexts(text, s, e)} for s, e, k, seed in every])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(base, pa.list_(span)), pa.array(digest), pa.array(found, pa.list_(seen))], [*others, "base", "base_sha256", "found"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    schema = f"{kinds}, base array<struct<start:bigint,kind:int,end:bigint>>, base_sha256 string, found array<struct<start:bigint,end:bigint,kinds:array<int>,instance:bigint,seed:boolean,patterns:array<bigint>>>"
    return docs.select(*others, docs[text_col].cast("string").alias(text_col)).mapInArrow(run, schema)


def good_patterns(found: DataFrame, rounds: int = 3, support: int = 3, confident: float = 0.8) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that reach `confident`, after `rounds` rounds over the pattern-instance graph.

    An edge joins a pattern and an instance found in it. Seeds weigh 1. A pattern's confidence for a
    kind is the weight of its instances of that kind over the number of all its instances, of
    whatever kind; it needs `support` weighty instances. An instance that is no seed weighs, for a
    kind it may have, 1 less the product of what its confident patterns leave. So an
    identifier vouched for by one context vouches for its other contexts. Edges are distinct
    (a thousand copies of a document count once), and a frequent pattern is a partial aggregate,
    not a list.
    """
    edges = found.select(F.explode("found").alias("f")).select("f.instance", "f.seed", "f.kinds", F.explode("f.patterns").alias("pattern")).distinct()
    edges = cut(edges.select("pattern", "instance", "seed", F.explode("kinds").alias("kind")))
    many = cut(edges.groupBy("pattern").agg(F.count_distinct("instance").alias("instances")))
    # weights and logarithms are summed as decimals, whose sum doesn't depend on the order
    seeds = edges.filter("seed").select("instance", "kind").distinct().withColumn("weight", F.lit(1).cast("decimal(18,9)"))
    weight = seeds
    for k in range(rounds):
        near = edges.select("pattern", "instance", "kind").distinct().join(weight, ["instance", "kind"])
        scored = near.groupBy("pattern", "kind").agg(F.sum("weight").alias("mass")).join(many, "pattern")
        good = cut(scored.select("pattern", "kind", (F.col("mass").cast("double") / F.col("instances")).alias("confidence"), "mass").filter((F.col("mass") >= support) & (F.col("confidence") >= confident)).drop("mass"))
        if k == rounds - 1:
            return good
        left = F.sum(F.log(1 - F.least("confidence", F.lit(0.999999))).cast("decimal(28,14)")).cast("double")
        vouched = edges.filter("not seed").select("pattern", "instance", "kind").distinct().join(good, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(left)).cast("decimal(18,9)").alias("weight"))
        weight = cut(seeds.union(vouched).groupBy("instance", "kind").agg(F.max("weight").alias("weight")))
    raise ValueError("rounds is less than 1")


def personal_data(docs: DataFrame, text_col: str = "text", rounds: int = 3, support: int = 3, confident: float = 0.8) -> DataFrame:
    """docs' other columns, `base` and `base_sha256`, and `spans`: array of (start, kind, end), in order, seeds and discoveries.

    The seeds are always among the spans. A looser identifier is added where one of its contexts is
    a good pattern for a kind it may have (the most confident one decides). Positions are
    code points, ends exclusive. A null text has no spans; texts of any length are searched whole;
    repeated rows count once as evidence and are all answered; an empty table gives an empty result.
    Columns of docs that have a result's name are replaced.
    """
    own = [c for c in docs.columns if c not in (text_col, "base", "base_sha256", "spans")]
    numbered = docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(own)], F.monotonically_increasing_id().alias("__row"), docs[text_col].cast("string").alias("__text"))
    found = cut(candidates(numbered, "__text"))
    good = good_patterns(found, rounds, support, confident)
    loose = found.select("__row", F.explode("found").alias("f")).filter("not f.seed").select("__row", "f.start", "f.end", F.explode("f.kinds").alias("kind"), "f.patterns")
    asked = loose.select("__row", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    best = asked.join(good, ["pattern", "kind"]).groupBy("__row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    more = best.groupBy("__row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__more"))
    out = found.drop("found").join(more, "__row", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("__more", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(own)], "base", "base_sha256", spans.alias("spans"))


def masked_recall(docs: DataFrame, text_col: str = "text", share: int = 10, rounds: int = 3, support: int = 3, confident: float = 0.8) -> DataFrame:
    """kind, hidden, answered, right: how the method does on seeds that are hidden from it.

    One in `share` of the seed instances (by hash) counts as an unseen string of unknown kind; answered are
    those that a good pattern gives some kind, right those that get their own. right / hidden is the
    recall, right / answered the precision.
    """
    found = candidates(docs.select(F.monotonically_increasing_id().alias("__row"), docs[text_col].alias("__text")), "__text")
    hide = lambda f: f["seed"] & (F.pmod(f["instance"], F.lit(share)) == 0)
    every = F.array(*[F.lit(k) for k in range(len(KINDS))])
    masked = F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.when(hide(f), every).otherwise(f["kinds"]).alias("kinds"), f["instance"].alias("instance"), (f["seed"] & ~hide(f)).alias("seed"), f["patterns"].alias("patterns"), F.when(hide(f), F.get(f["kinds"], F.lit(0))).alias("own")))
    masked = cut(found.select("__row", masked.alias("found")))
    good = good_patterns(masked.select(F.transform("found", lambda f: f.dropFields("own")).alias("found")), rounds, support, confident)
    asked = masked.select(F.explode("found").alias("f")).filter("f.own is not null").select("f.instance", "f.own", "f.patterns")
    best = asked.select("instance", "own", F.explode("patterns").alias("pattern")).join(good, "pattern").groupBy("instance", "own").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    every_one = asked.select("instance", "own").distinct().join(best, ["instance", "own"], "left")
    out = every_one.groupBy("own").agg(F.count("*").alias("hidden"), F.count("kind").alias("answered"), F.count_if(F.col("kind") == F.col("own")).alias("right"))
    return out.select(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("own")).alias("kind"), "hidden", "answered", "right")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, e.g. <email>; overlapping spans become one mark of the first.

    Only rows with spans are looked up, by (id, text hash). All columns stay, and other rows are untouched.
    """
    key = docs.select(docs[id_col].alias("__id"), F.xxhash64(docs[text_col].cast("string")).alias("__hash"), docs[text_col].alias("__text"))
    spans = cut(personal_data(key, "__text", **options).filter(F.size("spans") > 0).groupBy("__id", "__hash").agg(F.first("spans").alias("__spans")))
    whole = docs.withColumn("__hash", F.xxhash64(docs[text_col].cast("string")))
    joined = whole.join(spans, whole[id_col].eqNullSafe(spans["__id"]) & (whole["__hash"] == spans["__hash"]), "left").drop(spans["__hash"])
    text, names = F.col(text_col).cast("string"), F.array(*[F.lit(f"<{k}>") for k in KINDS])
    # (end so far, text so far), left to right
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"])).alias("out"))
    )
    done = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(done)).select(*docs.columns)
