import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from tidewheel.llm import langid, queries

STEMS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ster", "ung", "heit", "ver"], "cc": ["tion", "ment", "eau", "que"]}


def corpus(seed=7, n=150):
    rng = random.Random(seed)
    rows = [(*r, "aa", None, None) for r in EDGES]
    for d in range(n):
        lang = rng.choice(list(STEMS))
        text = " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        rows.append((1000 + d, text.title(), lang if rng.random() < 0.9 else None, "s", None))
    return rows, {}


def brute_word(word, p, ids):
    """Sum over all segmentations, written out."""
    text = langid.START + word
    total = np.zeros(p.shape[1])
    for k in range(len(text)):
        for cut in itertools.combinations(range(1, len(text)), k):
            parts = [text[a:b] for a, b in zip((0, *cut), (*cut, len(text)), strict=True)]
            product = np.ones(p.shape[1])
            for x in parts:
                if x in ids:
                    product = product * p[ids[x]]
                elif len(x) == 1:
                    product = product * p[-1]
                else:
                    product = product * 0
            total += product
    return np.log(total)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "ü"]
    p = np.random.default_rng(0).random((len(pieces) + 1, 3))
    ids = {x: i for i, x in enumerate(pieces)}
    words = ["a", "ab", "abab", "bababa", "xax", "übaü", "b"]
    found = langid.Lattice([w.encode() for w in words], langid.Trie(pieces)).log_scores(p)
    for w, row in zip(words, found, strict=True):
        assert np.allclose(row, brute_word(w, p, ids))


def test_expected_uses_are_derivatives():
    pieces = ["▁", "▁a", "a", "b", "ab"]
    p = np.random.default_rng(1).random((len(pieces) + 1, 2))
    words, counts = [b"abba", b"aab"], np.array([[2.0, 1.0], [0.5, 3.0]])
    lattice = langid.Lattice(words, langid.Trie(pieces))
    uses = lattice.expected(p, counts)
    for i in range(len(pieces)):
        more = p.copy()
        more[i] *= 1 + 1e-6
        slope = ((lattice.log_scores(more) - lattice.log_scores(p)) * counts).sum(axis=0) / 1e-6
        assert np.allclose(slope, uses[i], atol=1e-4)


def plain_log(word, p, ids):
    """The sum over all segmentations of a word of any length, in exact fractions."""
    text, depth = langid.START + word, max(map(len, ids))
    out = []
    for column in p.T:
        exact, uncovered = {x: Fraction(float(column[i])) for x, i in ids.items()}, Fraction(float(column[-1]))
        reach = [Fraction(1)]
        for j in range(1, len(text) + 1):
            total = Fraction(0)
            for n in range(1, min(depth, j) + 1):
                x = text[j - n : j]
                total += reach[j - n] * (exact[x] if x in exact else uncovered if n == 1 else 0)
            # as many digits as double precision needs, of numbers of any size
            bits = max(0, total.numerator.bit_length() - 200)
            shift = max(0, total.denominator.bit_length() - total.numerator.bit_length() + 200)
            reach.append(Fraction(round(total * (1 << shift)), 1 << shift) if bits or shift else total)
        last = reach[-1]
        out.append((math.log(last.numerator >> max(0, last.numerator.bit_length() - 900)) + max(0, last.numerator.bit_length() - 900) * math.log(2)) - last.denominator.bit_length() * math.log(2) + math.log(2))
    return out


PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "abababab", "这是", "的", "ü"]


@pytest.mark.parametrize("places", [8, 50, 1024])
def test_words_of_any_length_are_summed_over_all_segmentations(monkeypatch, places):
    monkeypatch.setattr(langid, "PLACES", places)
    rng = random.Random(places)
    ids = {x: i for i, x in enumerate(PIECES)}
    p = np.random.default_rng(2).random((len(PIECES) + 1, 2)) ** 3 + 1e-6
    p[-1] = 1e-8
    words = ["a", "abab" * 6, "x" * 40, "x" * 47, "ж" * 300, "这是的" * 40, "ab", *("".join(rng.choice("abüж的") for _ in range(n)) for n in (23, 24, 25, 49, 129, 300))]
    found = langid.Lattice([w.encode() for w in words], langid.Trie(PIECES)).log_scores(p)
    for w, row in zip(words, found, strict=True):
        assert np.allclose(row, plain_log(w, p, ids), rtol=1e-9), w


@pytest.mark.parametrize("places", [9, 1024])
def test_expected_uses_of_long_words(monkeypatch, places):
    """The same from logarithms part by part as from products of whole words, and as many characters as the words have."""
    p = np.random.default_rng(4).random((len(PIECES) + 1, 2)) ** 2 + 1e-6
    words = [b"ab" * 9, b"abba" * 5, b"x" * 20, b"a"]
    counts = np.array([[2.0, 1.0], [0.0, 3.0], [1.0, 1.0], [5.0, 0.5]])
    whole = langid.Lattice(words, langid.Trie(PIECES)).expected(p, counts)
    monkeypatch.setattr(langid, "SHORT", 1)
    monkeypatch.setattr(langid, "PLACES", places)
    assert np.allclose(langid.Lattice(words, langid.Trie(PIECES)).expected(p, counts), whole)
    long = [b"ab" * 400, ("ж" * 300).encode()]
    uses = langid.Lattice(long, langid.Trie(PIECES)).expected(p, np.ones((2, 2)))
    length = np.array([*map(len, PIECES), 1])
    assert np.allclose((uses * length[:, None]).sum(axis=0), 801 + 301)


def test_texts_with_long_words_leave_no_trace(monkeypatch):
    model = langid.Model(["x", "y"], PIECES, np.random.default_rng(6).random((len(PIECES) + 1, 2)))
    texts = [b"ab " + b"ab" * 200 + b" ba", b"", "这是的".encode() * 90, b"a b ab", None, b"123"]
    scorer = langid.Scorer(model)
    both = scorer.predict_all(texts)
    assert both == [langid.Scorer(model).predict(x) for x in texts] == scorer.predict_all(texts)
    assert max(map(len, scorer.at)) <= 4 * langid.SHORT


def test_op9(spark, make, table):
    rows, _ = corpus()
    found = queries.op9_language_id(spark, table(documents=make(rows))).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        expected = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == expected and 0 <= r["score"] <= 1 and r["lang_pred"] in {"aa", "bb", "cc", "und"}
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    truth = {r[0]: next(k for k, v in STEMS.items() if r[1][:2].lower() in {x[:2] for x in v}) for r in rows if r[0] and 1000 <= r[0] < 2000}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([by[d][0][0] == truth[d] for d in held]) >= 0.95
    for blank in (5, 6, 7):
        assert by[blank] == [("und", 0.0)]


def test_nothing_is_learned_from_held_out_rows(spark, make):
    rows, _ = corpus()
    held = [r for r in rows if r[0] and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and langid.training_rows(make(held)).count() == 0
    other = [(r[0], r[1], "zz", *r[3:]) if r in held else r for r in rows]
    a, b = langid.train(make(rows)), langid.train(make(other))
    assert a.languages == b.languages and np.array_equal(a.p, b.p)


@pytest.mark.parametrize("rows", [[], [(1, "no label here", None, None, None)]])
def test_nothing_to_learn_from(spark, make, table, rows):
    found = queries.op9_language_id(spark, table(documents=make(rows))).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)] * len(rows)
