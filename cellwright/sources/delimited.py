"""Delimited text: header, delimiter, encoding, rows to skip."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.config import SourceSpec

#: What no file holds; the reader gives null for it and for an empty field, which is then made the empty text (as are fields a short row lacks).
_NULL = "\x00null\x00"


def unique_names(names: list[str], warnings: list[str] | None = None) -> list[str]:
    """Header names: blank ones are numbered, repeated ones get _1, _2 and so on."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = name.strip() or f"column{i}"
        fresh, k = name, 0
        while fresh in out:
            k += 1
            fresh = f"{name}_{k}"
        if fresh != name and warnings is not None:
            warnings.append(f"the header repeats {name}; the later one is called {fresh}")
        out.append(fresh)
    return out


def sniff(lines: list[str], quote: str = '"') -> str:
    """The delimiter that cuts the lines into the most equal numbers of fields; a comma where none does."""
    best, score = ",", (0.0, 0)
    for d in (",", "\t", ";", "|"):
        counts = [len(r) for r in csv.reader(lines, delimiter=d, quotechar=quote or None, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE)]
        if not counts or (usual := max(set(counts), key=counts.count)) < 2:
            continue
        found = (counts.count(usual) / len(counts), usual)
        if found > score:
            best, score = d, found
    return best


def _lines(spark: SparkSession, spec: SourceSpec, encoding: str) -> DataFrame:
    """file, at, line: every line of every file, blank ones too; `at` ascends within a file. Read in splits."""
    options = {} if encoding in ("utf-8", "utf8") else {"encoding": encoding, "lineSep": "\n"}
    lines = spark.read.options(**options).text(spec.path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def _records(lines: DataFrame, skip: int, header: bool, quote: str, escape: str) -> DataFrame:
    """file, at, record: each file's records behind its first `skip` lines and its header. A quoted line feed goes on with the record.

    A record ends with a line at which the quotes so far are even. One task walks through a file.
    """
    in_file = Window.partitionBy("file").orderBy("at")
    line = F.col("line") if escape in ("", quote) else F.replace("line", F.lit(escape + quote), F.lit(""))
    quotes = (F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))) if quote else F.lit(0)
    kept = lines.withColumn("__i", F.row_number().over(in_file)).filter(F.col("__i") > skip)
    opened = F.coalesce(F.sum(quotes).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    begun = kept.withColumn("__new", (opened == 0).cast("int")).filter((F.col("__new") == 0) | (F.length("line") > 0))
    numbered = begun.withColumn("__record", F.sum("__new").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    found = numbered.groupBy("file", "__record").agg(F.min("at").alias("at"), whole.alias("record"))
    return (found.filter(F.col("__record") > 1) if header else found).select("file", "at", "record")


def read(spark: SparkSession, spec: SourceSpec, warnings: list[str], limit: int | None = None) -> DataFrame:
    """The file or files as columns of text, in UTF-8 or any charset that the JVM knows.

    `skip_rows` lines of each file, blank ones too, come off first, then each file's header. Files
    are read in splits unless a quoted field has a line feed, or the charset needs whole files.
    """
    encoding = spec.encoding.lower().replace("utf-8-sig", "utf-8")
    if encoding not in ("utf-8", "utf8", "utf-16", "us-ascii", "iso-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else such charsets are refused
    options = {"quote": spec.quote, "escape": spec.escape, "encoding": encoding, "nullValue": _NULL, "emptyValue": "", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    # the head, one line a record, by the same reader: so the charset is decoded alike
    raw = spark.read.options(**options | {"sep": "\x01", "quote": "", "multiLine": "false"}).schema("line string").csv(spec.path)
    if spec.skip_rows:
        lines = _lines(spark, spec, encoding)
        head = [(r["line"] or "").lstrip("\ufeff") for r in lines.head(spec.skip_rows + 200)][spec.skip_rows :]
        head = [x for x in head if x]
    else:
        head = [(r[0] or "").lstrip("\ufeff") for r in raw.head(200)]
    delimiter = spec.known_delimiter() or sniff(head[:100], spec.quote)
    delimiter = {"\\t": "\t", "\\n": "\n", "\\r": "\r"}.get(delimiter, delimiter)
    first = next(csv.reader(head, delimiter=delimiter, quotechar=spec.quote or '"'), []) if head else []
    names = unique_names(first, warnings) if spec.header else [f"column{i}" for i in range(len(first))]
    if not names:
        raise ValueError(f"{spec.path}: no columns; is the file empty?")
    if spec.skip_rows:
        records = _records(lines, spec.skip_rows, spec.header, spec.quote, spec.escape).orderBy("file", "at")
        parsed = records.select(F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), options | {"sep": delimiter, "multiLine": "true"}).alias("r"))
        df = parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        odd = (F.length("line") - F.length(F.replace("line", F.lit(spec.quote), F.lit("")))) % 2 == 1 if spec.quote else F.lit(False)
        whole = encoding.startswith(("utf-16", "utf-32")) or bool(raw.filter(odd).head(1))
        df = spark.read.options(**options | {"sep": delimiter, "header": str(spec.header).lower(), "multiLine": str(whole).lower(), "enforceSchema": "true"}).schema(schema).csv(spec.path)
    df = df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    return df.limit(limit) if limit else df
