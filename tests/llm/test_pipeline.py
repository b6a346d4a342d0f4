from collections import Counter

import corpus_pipeline
from cellwright.llm.packing import WordEncoder
from cellwright.llm.queries import tokenizer_path
from tests.llm.conftest import make, prose
from tests.llm.test_dedup import slow_lines
from tests.llm.test_nearcopies import family, slow_components


def test_stages_and_run(spark, tmp_path):
    passage = "first line of it\nsecond line of it\nthird line of it"
    texts = [*family(), *(f"{prose(500 + k, 90)}\n{passage}\n{prose(600 + k, 90)}\nwrite to jo{k}@example.org" for k in range(6))]
    make(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = stages["quality rules"](spark, docs, sf)
    first = {r["doc_id"]: r["text"] for r in judged.collect()}
    assert first and all(texts[i] == t for i, t in first.items())

    lined = stages["line dedup"](spark, judged, sf)
    second = {r["doc_id"]: r["text"] for r in lined.collect()}
    expected = slow_lines(sorted(first.items()))
    assert second == {i: expected[i, t][2] for i, t in first.items()} and all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    near = stages["simhash near-dedup"](spark, lined, sf)
    third = {r["doc_id"]: r["text"] for r in near.collect()}
    ids = sorted(second)
    groups = slow_components([second[i] for i in ids])
    assert third == {ids[c]: second[ids[c]] for c in set(groups.values())} and len(third) < len(second)

    clean = stages["personal data"](spark, near, sf)
    fourth = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert fourth.keys() == third.keys() and not any("@example.org" in t for t in fourth.values())

    tokenizer = WordEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in fourth.items()}
    last, whole = stages["packing"](spark, clean, sf).collect(), corpus_pipeline.run(spark, sf).collect()
    for rows in (last, whole):
        packed = Counter()
        for r in rows:
            packed[r["doc_id"]] += r["length"]
        assert packed == tokens
