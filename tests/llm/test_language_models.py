"""Kneser-Ney against a textbook version with dictionaries; characters beyond 16 bits; calibrated rejection."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataq.llm import langid


def textbook(words):
    """Interpolated Kneser-Ney over strings: p(gram) for the words' 4-grams, continuation counts below."""
    tops = Counter(w[i : i + 4] for word in words for w in ["\x02" * 3 + word + "\x03"] for i in range(len(word) + 1))
    counts = {4: dict(tops)}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    total, types = defaultdict(int), defaultdict(int)
    for n, c in counts.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            types[n, g[:-1]] += 1

    def p(g):
        n = len(g)
        if not n:
            return langid.UNKNOWN
        if (n, g[:-1]) not in total:
            return p(g[1:])
        t = total[n, g[:-1]]
        return max(counts[n].get(g, 0) - discount[n], 0) / t + discount[n] * types[n, g[:-1]] / t * p(g[1:])

    return p


def cost(p, text):
    grams = [w[i : i + 4] for word in langid.words(text) for w in ["\x02" * 3 + word + "\x03"] for i in range(len(word) + 1)]
    return sum(-math.log(p(g)) for g in grams) / len(grams), len(grams)


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


LETTERS = {"aa": "abcdee", "bb": "bcdffg", "cc": "αβγδε", "dd": "abcd\U00010400\U00010414"}


def test_models_are_the_textbook_s():
    rng = random.Random(5)
    said = {lang: [speech(rng, x, 30) for _ in range(20)] for lang, x in LETTERS.items()}
    books, models = {}, []
    for lang, texts in said.items():
        words = [w for t in texts for w in langid.words(t)]
        books[lang] = textbook(words)
        keys, n = langid.grams(words)
        distinct, inverse = np.unique(keys, return_inverse=True)
        models.append(langid.fit(lang, distinct, np.bincount(inverse)))
    texts = [speech(rng, rng.choice([*LETTERS.values(), "xyzabc"]), rng.randrange(1, 30)) for _ in range(60)]
    counted, sizes, entropies = langid._entropies(texts, models)
    assert counted == list(range(60))
    for i, t in enumerate(texts):
        for j, p in enumerate(books.values()):
            want, n = cost(p, t)
            # A language without a unigram of a character gives UNKNOWN without the first level's backoff.
            assert sizes[i] == n
            if all(c in LETTERS[list(books)[j]] for c in t.replace(" ", "")):
                assert abs(entropies[i, j] - want) < 1e-9
        best = langid.classify([t], models)[0][0]
        assert best == models[int(np.argmin(entropies[i]))].name


def test_wide_characters_are_no_others():
    wide = [chr(c) for c in (0x10041, 0x10400, 0x20000, 0x1D400)]
    codes = langid._codes("A" + "".join(wide) + "é")
    assert codes[0] == 0x41 and codes[-1] == 0xE9 and len(set(codes.tolist())) == 6
    assert all(0xD800 <= c < 0xF900 for c in codes[1:-1])


@pytest.mark.parametrize("bound", [10**9, 0])
def test_rejection_is_calibrated(spark, monkeypatch, bound):
    """About WITHIN of unseen texts of a language are accepted, whatever their length; texts of another script's are not."""
    rng = random.Random(6)
    words = {lang: [speech(rng, x, 1) for _ in range(400)] for lang, x in (("aa", "abcdefgh"), ("bb", "hijklmno"))}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([3, 10, 40, 300]))), lang) for i in range(6000) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(6000 + i, speech(rng, "pqrstuvw", 20), None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(langid, "LEAST_TEXTS", 50)
    monkeypatch.setattr(langid, "BROADCAST_GRAMS", bound)
    models = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, models).collect()}
    for size in (3, 10, 40, 300):
        held = [got[i]["rejected"] for i, t, lang in rows if lang and got[i]["held_out"] and t.count(" ") == size - 1]
        assert len(held) > 200 and sum(held) / len(held) < 0.05
    assert sum(got[6000 + i]["rejected"] for i in range(40)) >= 38
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if lang and got[i]["held_out"]]
    assert sum(held) / len(held) > 0.99
