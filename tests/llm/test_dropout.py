import random
from collections import Counter

import numpy as np
import pytest

from cellwright.llm import spm
from cellwright.llm.queries import tokenizer_path
from cellwright.llm.spm import Segmenter, encode
from tests.llm.conftest import make, prose
from tests.llm.test_tokens import ODD

PIECES = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return {sp.id_to_piece(i): (-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}, sp


def slow_encode(text, key, seed, limit, vocabulary):
    """The agenda by strings and lists, one chunk after another."""
    scores, sp = vocabulary
    if not text:
        return []
    line = " " + text
    drawn = np.random.Philox(key=[seed, key & (1 << 64) - 1]).random_raw(-(-3 * len(line) // 8)).view(np.uint8)
    out, at = [], 0
    while at < len(line):
        end = at
        while end < len(line) and line[end] == " ":
            end += 1
        while end < len(line) and line[end] != " ":
            end += 1
        parts, dead, t = ["▁" if c == " " else "\0literal" if c == "▁" else c for c in line[at:end]], set(), 0
        ids = list(range(len(parts)))  # names of the parts: a skipped pair of them stays skipped
        while True:
            pairs = [(scores[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores and (ids[i], ids[i + 1]) not in dead]
            if not pairs:
                break
            _, i = min(pairs)
            t += 1
            if drawn[3 * at + t - 1] < limit:
                dead.add((ids[i], ids[i + 1]))
                continue
            parts[i : i + 2], ids[i : i + 2] = [parts[i] + parts[i + 1]], [("m", t, i)]
        for p in parts:
            out += [scores[p][1]] if p in scores else [sp.piece_to_id(f"<0x{b:02X}>") for b in ("▁" if p == "\0literal" else p).encode()]
        at = end
    return out


def test_equal_to_a_slow_agenda(vocabulary):
    r = random.Random(4)
    texts = [*ODD, "a▁b ▁ c  d ", "x" * 90 + " y" * 3, "internationalisation " * 5, "".join(r.choices("etaoin shr", k=400)), "".join(r.choices("abc", k=150)), *(prose(k, 40) for k in range(8))]
    for dropout in (0.0, 0.1, 0.5):
        s = Segmenter(PIECES, dropout, 7)
        for ids, x, k in zip(s.encode(texts, list(range(len(texts)))), texts, range(len(texts)), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == slow_encode(x, k, 7, round(dropout * 256), vocabulary), (dropout, x[:60])


def test_parts_of_a_long_text(monkeypatch):
    text = "".join(random.Random(1).choices("ab  cde", k=5000))
    s = Segmenter(PIECES, 0.1, 7)
    monkeypatch.setattr(spm, "BLOCK", 64)
    ids = s.encode([text, "", "short", "z" * 700], [1, 2, 3, 4])
    assert [s.decode(x).decode() for x in ids] == [text, "", "short", "z" * 700]
    plain = Segmenter(PIECES, 0.0, 7)
    cut = plain.encode([text], [1])
    monkeypatch.undo()
    assert plain.encode([text], [1]) == cut


def test_copies_and_occurrences_vary(spark):
    text = "internationalisation of the corpus " * 3
    rows = encode(make(spark, [text] * 300), PIECES).collect()
    assert all(bytes(r["decoded"]).decode() == text for r in rows)
    assert len({bytes(r["ids"]) for r in rows}) > 100


def test_a_tenth_is_skipped():
    s = Segmenter(PIECES, 0.1, 7)
    drawn = np.concatenate([s._draws(k, 1000) for k in range(100)])
    assert abs(drawn.mean() - 26 / 256) < 0.003
    plain = Segmenter(PIECES, 0.0, 7).encode(["corpus"], [0])[0]
    got = Counter(s.encode(["corpus"] * 20_000, list(range(20_000))))
    merges = len("▁corpus") - len(plain) // 2
    assert len(got) > 3 and (1 - 26 / 256) ** merges - 0.02 < got[plain] / 20_000 < 0.9  # after a skip another way may lead to the same pieces
