"""Decontamination against brute force: counts, items, longest matches, removal; test sets in one block, in many and with cut items."""

import hashlib
import random
import re

import pytest

from strataq.llm import decontam

WORDS = ["the", "of", "and", "Thon", "erly", "tion", "über", "ñandú", "cœur", "x1", "ab,", "end."]
EDGES = [None, "", " \n\t ", "a", "\U0001f600 é \x1c\x85\xa0 b", "word " * 3000, "x" * 30_000, "#$%" * 40, "line\nline\n\nline\nother\n line"]
SCHEMA = "doc_id long, text string, item string, n_words long, content string"


def prose(n, rng):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "er"]) for _ in range(n))


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    """n_words, n_hit, items and (item, start, length) of the matches: from the left, each the longest at its start."""
    w, hit, found, matches = words(text), set(), set(), set()
    for k, t in items:
        v = words(t)
        n = min(13, len(v))
        done = 0
        for s in range(len(w) - n + 1 if n else 0):
            sizes = [next((j for j in range(len(v) - o) if s + j >= len(w) or w[s + j] != v[o + j]), len(v) - o) for o in range(len(v)) if w[s : s + n] == v[o : o + n]]
            sizes = [x for x in sizes if x >= n]
            if sizes:
                found.add(str(k))
                hit |= set(range(s, s + n))
                if s + n > done:
                    matches.add((str(k), s, max(sizes)))
                    done = s + max(sizes)
    return len(w), len(hit), found, matches


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    items = [(i, prose(rng.choice([2, 5, 13, 20, 40]), rng)) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (53, "unseen"), (60, "na " * 30), (0, items_twice := prose(30, rng)), (0, items_twice)]
    texts = EDGES + [prose(40, rng) + " " + rng.choice(items[:12])[1].upper() + " " + prose(rng.randrange(200), rng) for _ in range(30)]
    texts += [items[0][1] + " " + items[1][1], " ".join(words(items_twice)[4:25]), "na " * 100 + "b " + "na " * 20]
    return texts, items


@pytest.mark.parametrize(("block", "piece"), [(8 << 20, 200_000), (200, 200_000), (200, 20)])
def test_matches(spark, monkeypatch, case, block, piece):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "PIECE_WORDS", piece)
    rows = [*enumerate(texts), (None, texts[12]), (5, texts[12]), (5, texts[12])]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = decontam.match(docs, bench, block_bytes=block).collect()
    want = {}
    for i, t in rows:
        n, hit, found, matches = brute(t, items)
        want.setdefault((i, n, hit, tuple(sorted(found))), []).append(matches)
    for r in got:
        one = want[r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])].pop()
        if block > 1000:
            assert {(m["item"], m["start"], m["length"]) for m in r["matches"]} == one
        of_item = {str(k): [] for k, _ in items}
        for k, t in items:
            of_item[str(k)].append(words(t))
        w = words(next(t for i, t in rows if i == r["doc_id"] and brute(t, items)[0] == r["n_words"]))
        for m in r["matches"]:
            mine = w[m["start"] : m["start"] + m["length"]]
            assert len(mine) == m["length"] and any(v[m["item_start"] : m["item_start"] + m["length"]] == mine for v in of_item[m["item"]])
    assert not any(want.values())
    full = {(r["doc_id"], r["n_words"]): r for r in decontam.digest(docs, bench).collect()}
    for i, t in rows:
        n, hit, found, _ = brute(t, items)
        r = full[i, n]
        assert (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * hit >= n)
    kept = decontam.remove(docs, bench, block_bytes=block)
    assert kept.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t in rows if not brute(t, items)[1]), key=repr)


def test_neighbouring_items_are_two_matches(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(13)) for x in "ab")
    bench = spark.createDataFrame([("a", a), ("b", b)], "item_id string, text string")
    got = decontam.match(spark.createDataFrame([(1, f"see {a} {b} end")], "doc_id long, text string"), bench).first()
    assert [tuple(m) for m in got["matches"]] == [("a", 0, 1, 13), ("b", 0, 14, 13)] and got["n_hit"] == 26


def test_one_window_in_a_long_document_removes_it(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(13))
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    docs = spark.createDataFrame([(1, prose(3000, rng) + " " + passage), (2, prose(3000, rng)), (3, " ".join(passage.split()[:12]))], "doc_id long, text string")
    assert [r["contaminated"] for r in decontam.digest(docs, bench).orderBy("doc_id").collect()] == [False, False, False]
    assert sorted(r["doc_id"] for r in decontam.remove(docs, bench).collect()) == [2, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "a b")], "item_id string, text string")
    assert decontam.digest(docs.limit(0), bench).count() == 0 and decontam.remove(docs.limit(0), bench).count() == 0
    assert decontam.digest(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.remove(docs, bench.limit(0)).count() == 2
