"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut


def windows(lines: Column, width: int) -> Column:
    """array of (at, w1, w2): the 128-bit hash of every `width` consecutive lines; `lines`: their (a, b) hashes."""
    n = F.size(lines)
    part = lambda i, name: F.xxhash64(*[F.get(lines, i + k)[name] for k in range(width)])
    made = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(i.alias("at"), part(i, "a").alias("w1"), part(i, "b").alias("w2")))
    return F.when(n >= width, made)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with `n_lines`, `n_removed` and the text without repeated passages; all other columns stay.

    A window is `width` consecutive lines (cut at line feeds). Of windows that are equal, anywhere
    in the table, the first (by id, then text hash, then line) stays, and all lines that any later one
    covers are removed. A document shorter than a window never changes; one that is covered
    entirely becomes the empty text. Windows are compared by 128-bit hash; a frequent window
    is a partial aggregate, and is joined back by a plain inner join, whose skewed side adaptive
    execution can split.

    A null text stays null, without lines. Rows of equal id and text count as one document: their
    passages are no repetitions of each other. Null ids come first. An empty table gives an empty
    result; columns of docs named n_lines or n_removed are replaced.
    """
    text = docs[text_col].cast("string")
    hashed = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(width), x).alias("b")))
    lined = docs.filter(text.isNotNull()).select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), hashed.alias("lines"))
    every = cut(lined.select("id", "hash", F.explode(windows(F.col("lines"), width)).alias("w")).select("id", "hash", "w.at", "w.w1", "w.w2"), large=True)
    place = F.struct("id", "hash", "at")
    first = every.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("w1", "w2", "first")
    later = every.join(first, ["w1", "w2"]).filter(place > F.col("first"))
    covered = later.groupBy("id", "hash").agg(F.collect_set("at").alias("at"))
    covered = cut(covered.select(F.col("id").alias("__id"), F.col("hash").alias("__of"), F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: x + k))))).alias("__gone")))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(*[docs[c] for c in rest], F.xxhash64(text).alias("__hash"))
    joined = whole.join(covered, whole[id_col].eqNullSafe(covered["__id"]) & (whole["__hash"] == covered["__of"]), "left")
    joined = joined.withColumn("__lines", F.split(F.col(text_col).cast("string"), "\n"))
    # what stays lies between neighbours among the removed places
    edge = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size("__lines")))
    joined = joined.withColumn("__edge", F.when(F.col("__gone").isNotNull(), edge))
    kept = F.transform(F.sequence(F.lit(1), F.size("__edge") - 1), lambda k: F.slice("__lines", F.get("__edge", k - 1) + 2, F.get("__edge", k) - F.get("__edge", k - 1) - 1))
    new = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(kept), "\n"))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return joined.withColumn(text_col, new).select(*rest, count("__lines").alias("n_lines"), count("__gone").alias("n_removed"))


#: The same rule for DuckDB, comparing the lines themselves.
ORACLE_SQL = """
WITH docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, text, unnest(range(1, len(lines) - 1)) AS pos, lines FROM docs WHERE len(lines) >= 3),
named AS (SELECT doc_id, text, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS w FROM win),
ranked AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r FROM named),
gone AS (SELECT DISTINCT doc_id, text, pos + k AS i FROM ranked, (VALUES (0), (1), (2)) AS v(k) WHERE r > 1),
line AS (SELECT doc_id, text, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS l FROM docs),
kept AS (SELECT a.doc_id, a.text, count(*) AS n_lines, count(g.i) AS n_removed,
  coalesce(string_agg(a.l, chr(10) ORDER BY a.i) FILTER (WHERE g.i IS NULL), '') AS new
  FROM line a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.text = g.text AND a.i = g.i GROUP BY a.doc_id, a.text)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.new AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
