"""Quality rules in DataFrame functions only: text counts, and a hashed n-gram likelihood ratio."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import WORD_SPACE, text_of


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPACE), "")


def repeated_words(word_hashes: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found twice or more, the first included.

    Windows are compared by a 64-bit hash. Only where some window repeats, (hash, position) pairs
    are sorted, so that equal windows are neighbours; the positions' union is then measured by the
    gaps between them. Never quadratic in the text's length.
    """
    n = F.size(word_hashes)
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(width)])))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def measured(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda x, k: F.coalesce(F.least(F.get(at, k + 1) - x, F.lit(width)), F.lit(width))), F.lit(0).cast("long"), lambda s, x: s + x)

        return _let(_let(pairs, positions), measured)

    return _let(windows, lambda w: F.when(w.isNull() | (F.size(F.array_distinct(w)) == F.size(w)), F.lit(0).cast("long")).otherwise(covered(w)))


def _let(value: Column, body) -> Column:
    """body(value), where value is evaluated once: a lambda's variable is bound to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and __h, the words' hashes. A null text has no words."""
    text = text_of(docs, text_col)
    a_line = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))
    sized = words.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _let(a_line, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.transform("__words", lambda x: F.xxhash64(x)).alias("__h"),
    )
    counted = sized.withColumn("n_repeat_words", repeated_words(F.col("__h")))
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, most_trusted: int, prior: float) -> DataFrame:
    """One row: `w`, array of log(p_target / p_raw) by bucket, for multinomials over hashed words and word pairs.

    The raw multinomial counts every document, and is scaled to the target's size f; the target
    one counts the documents of up to `most_trusted` trusted ids (those of the smallest hash), the
    only bounded sample. Both get `prior` counts a bucket: w = log((target + prior) / (f raw + prior)),
    so a rare n-gram, which tells nothing, weighs nothing at any size of the corpus. Counts are
    partial aggregates over `buckets` keys. Without any trusted document all weights are 0.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most_trusted)
    flagged = docs.select(docs[id_col].alias("__doc"), words_of(text_of(docs, text_col)).alias("__words")).join(F.broadcast(ids), F.col("__doc") == F.col("__id"), "left")
    hashed = flagged.select(F.transform("__words", lambda x: F.xxhash64(x)).alias("h"), F.col("__id").isNotNull().cast("long").alias("t"))
    single = F.transform("h", lambda x: _bucket(x, buckets))
    pairs = F.when(F.size("h") > 1, F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: _bucket(F.xxhash64(F.get("h", i), F.get("h", i + 1)), buckets))).otherwise(F.array().cast("array<int>"))
    counts = hashed.select("t", F.explode(F.concat(single, pairs)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    gathered = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("b"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    scale = F.when(F.col("n_raw") > 0, F.col("n_target") / F.col("n_raw")).otherwise(0.0)
    return gathered.withColumn("f", scale).select(F.transform("b", lambda x: F.log((x["target"] + prior) / (F.col("f") * x["raw"] + prior))).alias("w"))


def _constant(one: DataFrame, kind: str) -> Column:
    """The value of a one-row, one-column table as a constant: a session variable, for subqueries may not stand in lambdas."""
    spark, name = one.sparkSession, f"cellwright_{uuid.uuid4().hex}"
    one.createOrReplaceTempView(name)
    spark.sql(f"declare or replace variable {name} {kind}")
    spark.sql(f"set variable {name} = (select * from {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"session.{name}")


def scored(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, threshold: float = -0.08, most_trusted: int = 16384, prior: float = 16.0) -> DataFrame:
    """docs with the counts of `measured`, `score` and `kept`.

    score: the mean weight of the document's hashed words and word pairs (see `weights`), that is
    the log-likelihood ratio between the trusted and the raw multinomial, divided by the number of
    n-grams; null without words. kept: not base_failed, and score >= threshold. Nulls: a null text
    has no words and fails; a null id is never trusted. Repeated rows are judged each; an empty
    table gives an empty result. Columns of docs that have a result's name are replaced.
    """
    w = _constant(weights(docs, trusted, id_col, text_col, buckets, most_trusted, prior), "array<double>")
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    base = measured(docs.drop(*[c for c in made if c in docs.columns and c not in (id_col, text_col)]), text_col)
    n = F.size("__h")

    def total(w: Column) -> Column:
        at = lambda h: F.get(w, _bucket(h, buckets))
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0.0),
            lambda s, i: s + at(F.get("__h", i)) + F.when(i + 1 < n, at(F.xxhash64(F.get("__h", i), F.get("__h", i + 1)))).otherwise(0.0),
        )

    out = base.withColumn("score", F.when(n > 0, total(w) / (2 * n - 1)))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))).drop("__h")
