"""All stages against a plain pipeline in Python, over documents with nulls, repeats, empty texts and rows without an id."""

import random
import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strataq.llm import toxicity
from test_decontamination import words as item_words
from test_secrets import brute as secrets

FILL = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ban", "dor", "fin", "gul") for c in ("", "s", "t", "ra")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, rules long"


def brute(rows, bad, items):
    """The (doc_id, text) that pass the filters, and how often."""
    rows = [r for r in rows if not bad((r[1] or ""))]
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    near = {}

    def root(i):
        while near.setdefault(i, i) != i:
            i = near[i]
        return i

    own = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    holders = {}
    for i in own:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in own:
        for j in {j for s in sets[i] for j in holders[s] if j < i}:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                near[b] = a
    rows = [r for i, r in enumerate(rows) if r[0] is None or not sets[i] or rows[root(i)][0] == r[0]]
    out = []
    for i, t in rows:
        w = item_words(t)
        hit = False
        for _, x in items:
            v = item_words(x)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            hit |= any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1))
        if not hit and not secrets(t or ""):
            out.append((i, t))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    items = [("a", say(20)), ("b", say(13)), ("c", None), ("d", "")]
    rows = []
    for i in range(500):
        t = say(rng.randrange(1, 120))
        kind = rng.randrange(12)
        if kind == 0:
            t += " you nasty grubling"
        elif kind == 1:
            t = t.replace(" ", "  ", 1) + " " + rng.choice(items[:2])[1] + " " + say(rng.randrange(600))
        elif kind == 2:
            t += " password = 'hunter22'"
        elif kind == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        elif kind == 4 and rows:
            t = (rows[rng.randrange(len(rows))][1] or "").upper()
        elif kind == 5 and rows:
            t = (rows[rng.randrange(len(rows))][1] or "") + " " + say(1)
        elif kind == 6:
            t = rng.choice([None, "", " \n ", say(3000)])
        rows.append((i, t))
    rows += [(None, None), (None, say(30)), (None, say(30) + " " + items[1][1]), (None, "token: abcdef0"), (None, "you nasty grubling"), rows[7], rows[8]]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "xx", "s", 1, "y", 2) for i, t in rows], SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int("nasty" in (t or ""))) for i, t in rows if i is None or i % 5 < 4], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_pipeline_keeps_what_plain_python_keeps(spark, tables):
    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{at}/labels.parquet"))
    known = toxicity._Known(model.index)
    bad = lambda t: model.score(toxicity.active_terms([t], known))[0] >= 0.5
    assert bad("you nasty grubling") and not bad("karan")
    want = brute(rows, bad, items)
    assert 200 < len(want) < 450
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for i, t in want:
        own = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(own), 2048):
            piece = own[a : a + 2048]
            ids[i, a, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)), len(own)] += 1
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == ids
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 2048


def test_stages_keep_the_columns(spark, tables):
    at, rows, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).schema == docs.schema, name
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, tables, tmp_path):
    at, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
