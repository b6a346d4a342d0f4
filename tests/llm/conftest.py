import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, ids=None, source=None):
    """Documents of these texts, in three partitions."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (source or (lambda k: f"src{k % 3}"))(k), None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, KIND).repartition(3)


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    v = ["".join(random.Random(f"v{k}").choices("abcdefghijklmnopqrstuvwxyz", k=3 + k % 7)) for k in range(vocabulary)]
    return " ".join(r.choice(v) + (r.choice(".,") if r.random() < 0.1 else "") + ("\n" if r.random() < 0.05 else "") for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Awkward and plain texts: null, empty, white space, one word, copies, near copies, other scripts, a very long one."""
    plain = [prose(k, 30 + 17 * k) for k in range(12)]
    near = plain[5].replace(" ", "  ", 3)
    return [None, "", " \t\n", "word", "Two words", *plain, plain[3], plain[3], near, plain[5].upper(), "日本語 \U0001f600 ñandú É́ İ", "a▁b ▁ c  d", prose(99, 9000), "x" * 70_000, "a a a a a a a a\n" * 40]


#: Names that operators use for their own columns.
CLASHES = ["fp", "text_hash", "component_id", "shard", "slot", "size", "start", "length", "ids", "tail", "row", "base", "found", "spans", "n_lines", "n_removed", "score", "kept", "n_words", "sentences", "licenses", "bucket", "key", "word", "hash", "lines", "at", "queue", "task", "h", "n"]


@pytest.fixture(scope="session")
def clashing(spark, texts):
    from pyspark.sql import functions as F

    df = make(spark, texts)
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
