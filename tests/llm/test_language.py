"""Language identification: phrases by a plain longest-match parse, what is learned, accuracy on held-out rows, defined cases."""

import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import language
from tests.conftest import DATA


def plain(text, pieces, block):
    """Phrases of a text: the longest that stands in a piece, block by block."""
    data, n = language.letters_of(text), 0
    for at in range(0, len(data), block):
        part, i = data[at : at + block], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and any(part[i : i + k + 1] in p for p in pieces):
                k += 1
            i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_phrases_by_longest_match(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "LANES", 5)
    r = random.Random(block)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    samples = {"x": [text("abc", 30) for _ in range(4)], "y": [text("abcdé", 40), "Ça, 1 va!"], "z": [text("ж中a", 30)]}
    model = language.LanguageModel.of(samples)
    texts = ["", "a", "q", "é", "--", "A, b.", "ж" * 40] + [text("abcdéж中q", r.randint(1, 90)) for _ in range(40)]
    bits, sizes = model.entropies(texts)
    assert sizes.tolist() == [len(language.letters_of(t)) for t in texts]
    for k, lang in enumerate(model.languages):
        pieces = [language.letters_of(p) for p in samples[lang]]
        assert np.allclose(bits[k], [plain(t, pieces, block) * model.bits[k] for t in texts])
        assert model.bits[k] == pytest.approx(np.log2(sum(map(len, pieces))))


def test_an_automaton_takes_the_substrings_alone():
    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(60))
    moves = {(s, b): t for s, b, t in zip(*(x.tolist() for x in language.automaton(data)), strict=True)}
    assert len({s for s, _ in moves}) <= 2 * len(data)
    for _ in range(2000):
        word, state = bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))), 0
        for b in word:
            state = moves.get((state, b))
            if state is None:
                break
        assert (state is not None) == (word in data)


def test_query_on_held_out_documents(spark):
    from corpusloom.llm import queries

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op11_language"](spark, DATA).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_scores_by_hand_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 16)
    rows = [(i, t, lang, "clash", 0.5) for i, (t, lang) in enumerate([("the dog and the cat " * 9, "en"), ("der hund und die katze " * 9, "de"), ("no label here", None), (None, "fr"), ("", "fr"), ("123 ½ ²", "it")] * 3)]
    docs = spark.createDataFrame([*rows, (None, "the cat", None, "clash", 0.1)], "doc_id long, text string, lang string, lang_pred string, score double")
    models = [language.LanguageModel.learn(docs.repartition(n)) for n in (1, 5)]
    assert models[0].languages == ["de", "en"] and all((a == b).all() for x, y in zip(models[0].automata, models[1].automata, strict=True) for a, b in zip(x, y, strict=True))
    asked = spark.createDataFrame([(1, t, "a", "b", 1.0, "c") for t in ("the cat", "die katze", None, "", " 12 ½ ²!", "the cat", "ΩΩ", "und")], "doc_id long, text string, told_text string, lang_pred string, score double, hash string")
    got = models[0].predict(asked).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und", "und", "en", got[6]["lang_pred"], "de"] and got[6]["lang_pred"] in ("de", "en")
    assert [r["score"] for r in got][2:5] == [0, 0, 0] and got[0].asDict().keys() == set(asked.columns)
    bits, _ = models[0].entropies(["the cat"])
    assert got[0]["score"] == pytest.approx(1 / (1 + 2 ** ((bits[1, 0] - bits[0, 0]) / language.TEMPER)))
    assert models[0].predict(asked.limit(0)).count() == 0
    nothing = language.LanguageModel.learn(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in nothing.predict(asked).collect()} == {("und", 0.0)}
