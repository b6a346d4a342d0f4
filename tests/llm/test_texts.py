import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

from cellwright.llm.licenses import RULES, SENTENCES, scan
from cellwright.llm.lm import score
from cellwright.llm.pii import KINDS, masked_recall, personal_data, redact, seed_spans
from cellwright.llm.quality import measured, scored
from tests.llm.conftest import make, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts(spark, texts, empty, clashing):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    many = [*texts, "a b c d a b c", "a b c a b c a b c", "x y\n\nx y\n \nx y", "# * $ %%% & | < > a#b"]
    for r in measured(make(spark, many)).collect():
        assert tuple(r[n] for n in names) == slow_counts(many[r["doc_id"]]), many[r["doc_id"]]


def test_quality_separates(spark, empty, clashing, texts):
    good = [prose(k, 120) for k in range(120)]
    junk = [" ".join(w + "***" for w in prose(500 + k, 120).split()) for k in range(60)]
    docs = make(spark, good + junk)
    trusted = spark.createDataFrame([(i,) for i in range(0, 120, 2)] + [(None,)], "doc_id long")
    out = {r["doc_id"]: r for r in scored(docs, trusted).collect()}
    assert all(out[i]["kept"] for i in range(120)) and not any(out[i]["kept"] for i in range(120, 180))
    none = scored(docs, trusted.filter("doc_id < 0"))
    assert none.filter("kept").count() == 180  # nobody is trusted: only the base rules decide
    assert scored(empty, trusted).collect() == []
    wide = scored(clashing, trusted)
    assert wide.filter("kept").count() <= len(texts) and wide.filter("fp = 'mine'").count() == len(texts)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


class SlowModel:
    """The automaton by hand: counts of sequences, probabilities by recursion along the failure arcs. rows: (id, text)."""

    def __init__(self, rows, least_state=1, prior=(128.0, 16.0)):
        low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        self.tokens = [[*WORD.findall(low(t)), "\n"] for _, t in rows]
        self.held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
        self.counts, self.least, self.prior = Counter(), least_state, prior
        for t, h in zip(self.tokens, self.held, strict=True):
            if not h:
                line = ["\t", *t]
                self.counts["\t",] += 1
                for i in range(1, len(line)):
                    self.counts[line[i],] += 1
                    self.counts[tuple(line[i - 1 : i + 1])] += 1
                    if i > 1:
                        self.counts[tuple(line[i - 2 : i + 1])] += 1
        self.words = {k[0] for k in self.counts if len(k) == 1 and k[0] != "\t"}
        self.n = sum(self.counts[w,] for w in self.words)

    def p(self, history, word):
        if not history:
            return (self.counts[word,] + 1) / (self.n + len(self.words) + 1)
        seen, m, lower = self.counts[history], self.prior[len(history) - 1], self.p(history[1:], word)
        if len(history) == 2 and seen < self.least:
            return lower
        return (self.counts[*history, word] + m * lower) / (seen + m)

    def scores(self):
        for t, h in zip(self.tokens, self.held, strict=True):
            line = ["\t", *t]
            base = sum(math.log10(self.p((), w)) for w in t)
            own = sum(math.log10(self.p(tuple(line[max(0, i - 2) : i]), line[i])) for i in range(1, len(line)))
            yield h, len(t), sum(self.counts[w,] > 0 for w in t), self.n, base, own


def test_lm(spark, texts, empty, clashing):
    vocabulary = prose(7, 60, 60).split()

    def chained(seed):
        r, w = random.Random(seed), [0]
        for _ in range(80):
            w.append((3 * w[-1] + r.randrange(4)) % len(vocabulary))  # four words may follow each
        return " ".join(vocabulary[i] for i in w)

    rows = list(enumerate([*texts, *map(chained, range(200))]))
    docs = make(spark, [t for _, t in rows])
    for options in ({}, {"least_state": 3, "prior": (2.0, 0.5)}):
        got = {r["doc_id"]: r for r in score(docs, **options).collect()}
        for i, e in enumerate(SlowModel(rows, **options).scores()):
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
            assert all(abs(x - y) < 1e-6 * max(1, abs(y)) for x, y in zip((r["base_score"], r["score"]), e[4:], strict=True))
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])
    assert score(empty).collect() == [] and score(clashing).count() == len(texts)
    assert score(make(spark, ["a b", None], ids=[None, None])).count() == 2
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    assert [r["score"] for r in score(make(spark, ["a b", None], ids=ids)).collect()] == [0.0, 0.0]  # nothing to learn from


def test_each_state_is_a_distribution(spark):
    """Read from the operator's scores: p(w | history) is the difference of the scores of texts that differ in what follows."""
    r = random.Random(1)
    chain = {"a": "bc", "b": "ca", "c": "aab"}
    texts = []
    for _ in range(300):
        w = ["a"]
        while len(w) < r.randrange(2, 12):
            w.append(r.choice(chain[w[-1]]))
        texts.append(" ".join(w))
    train = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    words = ["a", "b", "c", "unseen"]
    asked = [f"{h} {w}" for h in ("a b", "b a", "c c", "unseen a", "a unseen") for w in words]
    ids = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(asked)]
    got = {row["doc_id"]: row["score"] for row in score(make(spark, texts + asked, ids=[*train, *ids])).collect()}
    model = SlowModel(list(zip(train, texts, strict=True)))
    for i, t in zip(ids, asked, strict=True):
        line = ["\t", *t.split(), "\n"]
        assert abs(got[i] - sum(math.log10(model.p(tuple(line[max(0, k - 2) : k]), line[k])) for k in range(1, len(line)))) < 1e-9
    for history in ((), ("\t",), ("a",), ("a", "b"), ("b", "a"), ("unseen", "a"), ("a", "unseen")):
        assert abs(sum(model.p(history, w) for w in [*words, "\n"]) - 1) < 1e-12
    assert model.p(("b", "a"), "b") > 10 * model.p(("b", "a"), "a")


def luhn(d):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for x in re.finditer(p, text):
            d = re.sub("[^0-9]", "", x.group())
            if (k == 1 and any(int(y) > 255 for y in x.group().split("."))) or (k == 2 and not (12 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((x.start(), k, x.end()))
    return sorted(out)


def test_seed_spans_equal_the_patterns():
    r = random.Random(2)
    fixed = ["a@b.c x@y@z.com @@ a@b a@b..c a.@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (555) 010-1234 +12 +1234567890123456 ++49 30 1234567", "é+44 20 7946 0958\U0001f600 a@é.com b@c.de"]
    for t in [*fixed, *("".join(r.choices("ab1234567890.@+-() %", k=r.randrange(60))) for _ in range(4000))]:
        assert seed_spans(t) == slow_spans(t), t


def test_contexts_find_unseen_identifiers(spark, empty, clashing, texts):
    known = [f"word{i} then call phone: +1 (555) 010-{1000 + i} today" for i in range(8)]
    unseen = ["please call phone: (555) 777-1234 today", "and call phone: 555-777-9999 ok"]
    clean = ["number (555) 999-1234 stands in a text", "5551112222 is a count", None, ""]
    every = known + unseen + clean + known[:1] * 3
    out = {r["doc_id"]: r for r in personal_data(make(spark, every)).collect()}
    for i, t in enumerate(every):
        spans = [(s["start"], s["kind"], s["end"]) for s in out[i]["spans"]]
        assert set(slow_spans(t or "")) <= set(spans)
        assert [(s["start"], s["kind"], s["end"]) for s in out[i]["base"]] == slow_spans(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in slow_spans(t or "")).encode()).hexdigest()
        assert len(spans) == (0 if t is None or t in clean else 1), t
    assert every[8][slice(*(out[8]["spans"][0][k] for k in ("start", "end")))] == "(555) 777-1234"
    hidden = {r["doc_id"]: r["text"] for r in redact(make(spark, every)).collect()}
    assert hidden[8] == "please call phone: <phone> today" and hidden[0] == "word0 then call phone: <phone> today" and hidden[12] is None and hidden[10] == clean[0]
    assert personal_data(empty).collect() == [] and redact(empty).collect() == []
    assert redact(clashing).count() == len(texts) and sorted(redact(clashing).columns) == sorted(clashing.columns)
    wide = personal_data(clashing)
    assert wide.count() == len(texts) and wide.filter("found = 'mine'").count() == len(texts) and sorted(wide.columns) == sorted({*clashing.columns, "base", "base_sha256", "spans"} - {"text"})


def test_contexts_recover_hidden_seeds(spark):
    r = random.Random(3)
    lead = {0: "write to mail address", 1: "the server answers at", 3: "or call us on phone"}
    value = {0: lambda: f"u{r.randrange(10**6)}@host{r.randrange(99)}.org", 1: lambda: f"10.{r.randrange(200)}.{r.randrange(200)}.{r.randrange(200)}", 3: lambda: f"+1 (555) 010-{r.randrange(10**4):04d}"}
    said = [f"{prose(k, 4)} {lead[k % 4]} {value[k % 4]()} {prose(900 + k, 3)}" for k in range(400) if k % 4 != 2]
    random_ = [f"{prose(2000 + k, 5)} {value[k % 2]()} {prose(3000 + k, 5)}" for k in range(60)]  # contexts that tell nothing
    got = {x["kind"]: x for x in masked_recall(make(spark, said + random_)).collect()}
    assert set(got) == {"email", "ip", "phone"}
    hidden, answered, right = (sum(x[c] for x in got.values()) for c in ("hidden", "answered", "right"))
    assert hidden > 15 and right >= 0.75 * hidden and right == answered


def test_redact_overlaps(spark):
    t = "é mail x@y.zz and +49 4111 1111 1111 end \U0001f600 1.2.3.4!"
    assert redact(make(spark, [t])).first()["text"] in ("é mail <email> and <phone> end \U0001f600 <ip>!", "é mail <email> and +49 <card> end \U0001f600 <ip>!")


def test_licences(spark, texts, empty, clashing):
    notice = lambda *names: "\n\n".join("\n".join(textwrap.wrap(SENTENCES[n], 60)) for n in names)
    comment = lambda t: "\n".join("# " + x for x in t.split("\n"))
    mit = notice("mit-grant", "mit-notice", "mit-warranty", "mit-liability")
    cases = [
        (mit, ["MIT"]), (comment(mit), ["MIT"]), (mit.upper(), ["MIT"]),
        (notice("mit-grant", "mit-warranty", "mit-notice", "mit-liability"), []),
        (notice("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), ["BSD-2-Clause"]),
        (notice("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"), ["BSD-3-Clause"]),
        ("some words | a table\nReleased under the MIT License.\nmore words", ["MIT"]),
        ("Licensed under CC BY-NC 4.0. And so on. SPDX-License-Identifier: Apache-2.0\n", ["Apache-2.0", "CC-BY-NC-4.0"]),
        ("a licence to print money, with permission", []),
    ]
    out = {r["doc_id"]: r for r in scan(make(spark, [t for t, _ in cases] + [None, ""])).collect()}
    for i, (t, expected) in enumerate(cases):
        assert out[i]["licenses"] == expected, (t[:60], out[i]["sentences"])
    assert out[len(cases)]["licenses"] == [] and out[len(cases)]["sentences"] == []
    assert scan(empty).collect() == [] and scan(clashing).filter("fp = 'mine'").count() == len(texts)
    assert not re.search("Python|Pandas|Arrow", scan(clashing)._jdf.queryExecution().executedPlan().toString())
    assert {s for _, rule in RULES for s in rule} <= set(SENTENCES)
