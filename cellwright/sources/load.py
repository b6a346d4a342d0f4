"""Loading a source of any kind."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from cellwright.config import SourceSpec
from cellwright.operators.align import guard
from cellwright.sources import delimited, excel
from cellwright.sources.rowid import with_row_id
from cellwright.sources.text import as_text


@dataclass
class Loaded:
    """A side as a table of texts with __row_id, in source order."""

    df: DataFrame
    columns: list[str]
    path: str
    kind: str
    warnings: list[str] = field(default_factory=list)
    row_count: int | None = None


def _parquet(spark: SparkSession, spec: SourceSpec, warnings: list[str], limit: int | None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(spec.path)
    return as_text(df.limit(limit) if limit else df)


def _json(spark: SparkSession, spec: SourceSpec, warnings: list[str], limit: int | None) -> DataFrame:
    first = spark.read.text(spec.path).filter("length(trim(value)) > 0").head(1)
    df = spark.read.option("multiLine", str(bool(first) and first[0][0].lstrip("﻿ \t").startswith("[")).lower()).json(spec.path)
    return as_text(df.limit(limit) if limit else df)


_READERS = {"csv": delimited.read, "parquet": _parquet, "json": _json, "excel": excel.read}


def load(spark: SparkSession, spec: SourceSpec, side: str = "source", limit: int | None = None) -> Loaded:
    """Read a source; paths may be globs, and lie wherever Spark reads. ValueError tells what is wrong with it, FileNotFoundError that there is none."""
    kind = spec.resolved_kind()
    if kind not in _READERS:
        raise ValueError(f"{side}: unknown kind {kind}; there are {', '.join(_READERS)}")
    warnings: list[str] = []
    try:
        df = _READERS[kind](spark, spec, warnings, limit or None)
    except (PySparkException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{side}: nothing at {spec.path}") from e
        raise ValueError(f"{side}: {spec.path} can't be read as {kind}: {' '.join(str(e).splitlines()[:2])[:300]}") from e
    guard(df.columns, side)
    return Loaded(with_row_id(df), df.columns, spec.path, kind, warnings)
