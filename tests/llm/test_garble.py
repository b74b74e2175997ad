"""Wrongly decoded text: found, restored, and clean text left alone."""

import random

import pytest

from lumenfold.llm import garble as G

CLEAN = ["Größenvergleich für später prüfen", "Die Störung löst nichts aus", "Nous préférons une sélection variée", "La température relevée dépasse 3 °C", "Según el análisis, está más cerca",
         "El depósito no registró unidades", "A distância é próxima, não há exclusão", "São 3 células típicas", "Różnica między ofertami wynosi 2", "Wybraliśmy możliwie różne oferty",
         "Контрольная сумма не совпадает", "Склад не передавал данные 5 дней", "電圧3ボルトは物理的にあり得ない値だ。", "似た提案を避けて、5種類を選びました。", "Cost: £20, “stable” — that’s €5", "plain words only", "🚚 ⚠️ ✅ café ½ m³"]
CHAINS = [("utf-8", "cp1252", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp1252", 2)]


def garble(text, right, wrong, times):
    for _ in range(times):
        text = "".join(chr(b) if (c := bytes([b]).decode(wrong, "replace")) == "�" else c for b in text.encode(right))
    return text


def test_every_chain_is_undone():
    word = "Größenvergleich"
    for k, (right, wrong, times) in enumerate(G.CHAINS):
        if right == "utf-8":
            assert G.undo(garble(word, right, wrong, times), k) == word
    assert G.undo("abc", 3) is None and G.undo("�", G.LOST) == "�"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    rows, bad, original = [], set(), {}
    for k in range(1200):
        parts = [rng.choice(CLEAN) for _ in range(rng.randint(1, 4))]
        original[k] = " ".join(parts)
        if k % 25 == 0:
            foreign = [c for c in CLEAN if not c.isascii()]
            at = rng.randrange(len(parts))
            parts[at] = rng.choice(foreign)
            original[k] = " ".join(parts)
            chain = rng.choice(CHAINS)
            parts[at] = garble(parts[at], *chain)
            bad.add(k)
        rows.append((k, " ".join(parts), rng.choice(["S a", "sa", "b", None])))
    rows += [(2000, None, "b"), (2001, "", "b"), (2002, "   ", None), (2003, "Die St�rung l�st aus", "b"), (2004, "é", "b"), (2005, "Ã", "new")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").selectExpr("*", "'k' AS key", "1 AS prior")
    return df, bad, original


def test_garbled_records_are_found_and_restored(corpus):
    df, bad, original = corpus
    got = G.garbled_texts(df, "doc_id", "text", "source").collect()
    found = {r.doc_id: r for r in got}
    assert set(found) == bad | {2003}
    assert len([r for r in got if r.doc_id == 0]) == 2
    assert found[2003].lost_words == 2 and found[2003].restored == "Die St�rung l�st aus"
    right = sum(found[k].restored == original[k] for k in bad)
    assert right >= 0.9 * len(bad)


def test_empty_table(corpus):
    df, _, _ = corpus
    assert G.garbled_texts(df.limit(0), "doc_id", "text", "source").count() == 0
    assert G.garbled_texts(df.limit(0), "doc_id", "text", None).count() == 0


def test_words():
    assert G.words_of("abc né 12é3 東京は né") == ["né", "0é0", "東京は"]
