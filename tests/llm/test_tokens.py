import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellwright.llm.packing import Mixture, WordEncoder, pack, weights
from cellwright.llm.queries import tokenizer_path
from cellwright.llm.spm import Segmenter, encode
from tests.llm.conftest import make, prose

WORDS = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")

ODD = ["It's we'LL don't 'S", "İstanbul ΑΣ ας Ḱé", "a\x0bb\x1cc d", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "１２３ x² ½ 12.5", "日本語 テスト", "̈a ä ‍", "", "  ", "é'd", "ß ẞ ŉ ǰ", "a.b. c,d!? x.; é. 12. 1.2.! it.s. ... .a", "</w> w</w>x <x", "𝔘𝔫 Ⅷ"]


def test_word_encoder_equals_the_tokenizer():
    e = WordEncoder(WORDS)
    texts = [*ODD, *(prose(k, 60) for k in range(20))]
    got = e(pa.array([*texts, None], pa.string()))
    assert got[-1] == b""
    for x, ids in zip(texts, got, strict=False):
        assert np.frombuffer(ids, "<u2").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids, x


def served(weights_, chunks):
    """The order in which queues are served, one chunk after another: the one that is due first."""
    due = sorted(((c + 0.5) / w, (w, k), q) for q, (w, k) in enumerate(zip(weights_, chunks, strict=True)) for c in range(k))
    return [q for *_, q in due]


def test_turns_are_a_permutation_and_carry_deficits():
    chunks = [1, 7, 7, 64, 1000, 3, 7, 64]
    for given in ([float(k) for k in chunks], [0.5, 0.05, 0.05, 0.1, 0.2, 0.02, 0.03, 0.05]):
        mixture, names = Mixture.of(list(zip(given, chunks, strict=True)))
        queue = np.repeat(np.arange(len(chunks)), chunks)
        chunk = np.concatenate([np.arange(k) for k in chunks])
        kind, member = np.array(names)[queue].T
        turn = mixture.turns(kind, member, chunk)
        assert sorted(turn.tolist()) == list(range(sum(chunks)))
        order = queue[np.argsort(turn)]
        assert order.tolist() == served(given, chunks)
        # while no queue is dry, each is within a few chunks of its share of what was served
        dry = min(np.flatnonzero(order == q)[-1] for q in range(len(chunks))) if given[0] < 1 else len(order)
        for q, w in enumerate(given):
            got = np.cumsum(order == q)[:dry]
            assert np.abs(got - np.arange(1, dry + 1) * w / sum(given)).max(initial=0) <= 3


def test_weights():
    assert weights({"a": 10, "b": 30, None: 60}, {"a": 0.5}) == {"a": 0.5, "b": 0.5 * 30 / 90, None: 0.5 * 60 / 90}
    assert weights({"a": 10, "b": 30}, None) == {"a": 0.25, "b": 0.75}
    with pytest.raises(ValueError):
        weights({"a": 1, "b": 2}, {"a": 1.0})


def check_packing(rows, ids, window):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][r["start"] : at], "<u4").tobytes()) and bytes(r["ids"]) == np.array(ids[i][r["start"] : at], "<u4").tobytes()
        assert at == len(ids[i])
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return by_window


def test_pack(spark, texts):
    tok = WordEncoder(WORDS).tokenizer
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = pack(make(spark, texts, source=lambda k: None if k % 4 == 0 else f"s{k % 4}"), WORDS, window=512, quantum=32).collect()
    by_window = check_packing(rows, ids, 512)
    assert len(by_window) * 512 < sum(map(len, ids.values())) + 32 * 4 + 2 * 512
    # all but the last windows keep the sources' shares to within a few quanta
    share = {}
    for r in rows:
        share[r["source"]] = share.get(r["source"], 0) + r["length"]
    total = sum(share.values())
    for w in range(max(by_window) - 3):
        for s, n in share.items():
            assert abs(sum(r["length"] for r in by_window[w] if r["source"] == s) - 512 * n / total) <= 3 * 32


def test_targets_fill_every_window(spark):
    texts = [prose(k, 200) for k in range(60)]
    tok = WordEncoder(WORDS).tokenizer
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    targets = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    by_window = check_packing(pack(make(spark, texts, source=lambda k: f"s{k % 3}"), WORDS, window=512, quantum=16, targets=targets).collect(), ids, 512)
    first = sum(len(x) for i, x in ids.items() if i % 3 == 0)  # s0 runs dry first
    carried = dict.fromkeys(targets, 0.0)
    for w in range(first * 2 // 512 - 1):
        for s, share in targets.items():
            carried[s] += 512 * share - sum(r["length"] for r in by_window[w] if r["source"] == s)
            assert abs(carried[s]) <= 2 * 16  # what is short in one window is made good in the next
    tail = [w for w in by_window if w > first * 2 // 512 + 1]
    assert tail and all({r["source"] for r in by_window[w]} <= {"s1", "s2"} for w in tail)


def test_many_sources(spark):
    texts = [prose(k, 3 + k % 9) for k in range(300)]
    tok = WordEncoder(WORDS).tokenizer
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    check_packing(pack(make(spark, texts, source=lambda k: f"host{k}"), WORDS, window=64, quantum=16).collect(), ids, 64)


def test_pack_edges(spark, empty, clashing):
    assert pack(empty, WORDS).collect() == []
    twice = make(spark, ["same text", "same text", None], ids=[1, 1, None])
    rows = pack(twice, WORDS).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows) == [(False, 3), (False, 3), (True, 1)]
    assert pack(clashing, WORDS).count() > 0
    with pytest.raises(ValueError):
        pack(empty, WORDS, window=100, quantum=64)


def test_segmenter_without_dropout_is_the_library(texts):
    import sentencepiece

    sp, s = sentencepiece.SentencePieceProcessor(model_file=PIECES), Segmenter(PIECES, 0.0, 1)
    plain = [*ODD, "  a  b ", "\n\ttab\r\n", "x" * 500, "<s></s><unk>", *[t for t in texts if t and "▁" not in t]]
    for x, ids in zip(plain, s.encode(plain, [0] * len(plain)), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == sp.encode(x), x[:40]


def test_dropout_varies_and_decodes(texts):
    s, other = Segmenter(PIECES, 0.1, 7), Segmenter(PIECES, 0.1, 7)
    plain = [*ODD, *[t for t in texts if t]]
    for k in range(4):
        ids = s.encode(plain, [k] * len(plain))
        assert [s.decode(x).decode() for x in ids] == plain and ids == other.encode(plain, [k] * len(plain))
    word = "internationalisation"
    assert len(set(s.encode([word] * 50, list(range(50))))) > 1 and s.encode([word] * 50, list(range(50))) != Segmenter(PIECES, 0.1, 8).encode([word] * 50, list(range(50)))


def test_encode_query(spark, texts, empty, clashing):
    out = {r["doc_id"]: r for r in encode(make(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        assert bytes(out[i]["decoded"]).decode() == (t or "") and out[i]["n_ids"] * 2 == len(out[i]["ids"])
    again = {r["doc_id"]: r["ids"] for r in encode(make(spark, texts).repartition(5), PIECES).collect()}
    assert all(again[i] == r["ids"] for i, r in out.items())
    assert encode(empty, PIECES).collect() == [] and encode(clashing, PIECES).count() == len(texts)
    assert encode(make(spark, ["a", "a"], ids=[None, None]), PIECES).count() == 2
