"""The queries of the training-data operators: thin digests of their outputs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import read_documents


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the vocabulary files are not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.spm import encode

    docs = read_documents(spark, sf_dir)
    out = encode(docs.select(F.struct("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")).alias("key"), "text"), tokenizer_path("piece_bpe_32k.model"), id_col="key")
    return out.select("key.doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"), (F.crc32("decoded") == F.col("key.crc")).alias("lossless"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.licenses import scan

    out = scan(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.simhash import near_duplicates

    found = near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.sharding import shard_by_bytes

    out = shard_by_bytes(read_documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.lcp import fingerprints

    return fingerprints(read_documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.linededup import dedup_lines

    return dedup_lines(read_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.quality import scored

    out = scored(read_documents(spark, sf_dir), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.lm import score

    return score(read_documents(spark, sf_dir))


def _only(k: int):
    """A lambda that keeps k and turns all else into null (a default argument would be taken for the index)."""
    return lambda x: F.when(x == k, x)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.pii import KINDS, personal_data

    out = personal_data(read_documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.col("base.kind")
    many = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return out.select("doc_id", *many, "base_sha256", joined.alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellwright.llm.packing import pack

    out = pack(read_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from cellwright.llm import licenses, linededup

    return {"op2_licenses": licenses.oracle_sql(), "op6_line_dedup": linededup.ORACLE_SQL}
