"""Phrase mining against brute force with Python's whole numbers."""

import collections
import random
import re
from dataclasses import replace

import pytest

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(docs, least, top=2000, max_words=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in n:
        kept = []
        for (x, p), a in good.items():
            longer = [q for y, q in good if y == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))] if x == lang else []
            if x != lang or any(100 * good[lang, q] >= 100 * a for q in longer):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


KIND = "text string, lang string, phrase long, f string, `__text` int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["New", "york", "city", "the", "of", "é", " ", "ß", "a", "a", "\U0001f600", "x\x1cy", "CITY"]
    docs = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    return [*docs, (None, "en"), ("", None), ("a " * 3000, "en"), ("one two three four five six. " * 40, "de"), docs[0], docs[0], ("...;:!", "fr")]


def frame_of(spark, docs):
    return spark.createDataFrame([(t, x, 1, "f", 2) for t, x in docs], KIND)


@pytest.mark.parametrize("least", [2, 20])
def test_phrases_match_brute_force(spark, texts, least):
    from tidemark.llm.phrases import PhraseParams, mine_phrases

    # slices of a few texts, a bit map with many false hits
    params = PhraseParams(least=least, slice_bytes=2000, flag_bits=6, most_flag_bits=6)
    want = mined(texts, least)
    assert len(want) > 5 and found(mine_phrases(frame_of(spark, texts).repartition(5), params)) == want
    first = [r for r in want if r[1] <= 3]
    assert found(mine_phrases(frame_of(spark, texts), replace(params, top=3, salts=5, flag_bits=16, most_flag_bits=20))) == first
    assert found(mine_phrases(frame_of(spark, texts), replace(params, max_words=2))) == mined(texts, least, max_words=2)


def test_phrases_of_nothing(spark):
    from tidemark.llm.phrases import mine_phrases

    out = mine_phrases(frame_of(spark, []))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "words"]
    assert mine_phrases(frame_of(spark, [(None, None), ("", "en"), ("rare words only", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    from tidemark.llm.phrases import PhraseParams, score_cuts

    a, left, right, n = 3 * 10**12, 4 * 10**12 + 1, 5 * 10**12 + 7, 9 * 10**14
    rows = [("en", 0, "", n), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    got = score_cuts(spark.createDataFrame(rows, "lang string, words int, phrase string, f long"), PhraseParams()).collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(a, left, right, n, 1000 * a * n // (left * right))]
