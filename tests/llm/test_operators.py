"""Each operator against brute force on small texts, with nulls, empties, long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataq.llm import common, components, decontam, langid, minhash, packing, pii, quality, suffix_dedup, token_counts, toxicity

RNG = random.Random(5)
WORDS = ["the", "of", "and", "Thon", "erly", "tion", "über", "ñandú", "cœur", "x1", "ab,", "end."]
SCHEMA = "doc_id long, text string, lang string, value string, spans string, n long, rules long, __bad long, sequence_id long"


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "er"]) for _ in range(n))


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "v", "s", 3, 1, 0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " \n\t ", "a", "\U0001f600 é \x1c\x85\xa0 b", "word " * 3000, "x" * 30_000, "#$%" * 40, "line\nline\n\nline\nother\n line"]


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


PII_TEXTS = [
    "mail me at a.b@c.example.org, or x@y@z.com; no@dots and @start.com",
    "hosts 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 5500005555555559 7",
    "call +1 (202) 555-0143, +49 30 1234567 89. +12 or +1.2",
    "iban DE89370400440532013000 and DE89370400440532013001, ssn: 078-05-1120 and then some far words 078-05-1121",
    "1" * 5000 + "." + "2" * 5000,
    "a@" * 500 + "b.c",
    "😀😀 q@w.ee 😀 +123456789012",
]


def brute_pii(text):
    out = []
    kinds = ["email", "ip", "card", "phone"]
    pats = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]

    def good(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p or 0) <= 255 for p in s.split(".")) if len(s) < 1000 else False
        if kind == "card":
            alt = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and alt % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for r, (kind, pat) in enumerate(zip(kinds, pats, strict=True)):
        out += [(m.start(), r, m.end(), kind) for m in re.finditer(pat, text) if good(kind, m[0])]
    return out


def test_pii(spark, empty):
    texts = EDGES + [t for t in PII_TEXTS if len(t) < 3000] + [prose(50) + " " + RNG.choice(PII_TEXTS[:5]) for _ in range(20)] + ["7" * 3000 + ".", "1.2.3.4 " * 4000]
    twice = table(spark, texts).union(table(spark, texts).where("doc_id < 3")).union(table(spark, [PII_TEXTS[0]]).selectExpr("cast(null as long)", "text", "lang", "value", "spans", "n", "rules", "__bad", "sequence_id"))
    assert pii.digest(twice).count() == len(texts) + 4 and pii.digest(twice).where("doc_id is null and n_email > 0").count() == 1
    assert pii.digest(table(spark, [PII_TEXTS[5]])).first()["n_ip"] == 0
    got = rows(pii.digest(table(spark, texts)))
    for i, t in enumerate(texts):
        want = brute_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), (t, got[i]["spans"], joined(want))
        assert got[i]["n_email"] == sum(k == "email" for *_, k in want)
    kinds = [s.split(":")[0] for s in got[texts.index(PII_TEXTS[4])]["spans"].split(",")]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 1
    assert pii.digest(empty).count() == 0
    assert pii.detect(table(spark, ["x a@b.co"])).first()["spans"][0]["value"] == "a@b.co"


def test_account_numbers():
    good = ["DE89 3704 0044 0532 0130 00 PLEASE PAY NOW", "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "iban GB82WEST12345698765432.", "NO9386011117947 x", "XDE NO9386011117947"]
    bad = ["DE89370400440532013001", "DE8937040044053201300", "DE893704004405320130001", "DE89  370400440532013000", "QQ89370400440532013000", "xDE89370400440532013000"]
    at = lambda t: [t[s.start : s.end].replace(" ", "") for s in pii.find(t) if s.kind == "iban"]
    assert [at(t) for t in good] == [["DE89370400440532013000"]] * 2 + [["GB82WEST12345698765432"]] + [["NO9386011117947"]] * 2
    assert not any(map(at, bad))
    numbers = ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-3456", "123-45-0000", "123-45-6789"]
    assert [n for n in numbers if pii.find(f"ssn {n}")] == ["123-45-6789"]


def test_token_counts(spark, empty, tmp_path):
    path = public_tokenizers.path
    texts = [*EDGES, prose(300), prose(300), "a <|endoftext|> b", "漢字 かな", "tabs\t\tand  spaces \n\n x"]
    texts.append(texts[9])
    cache = str(tmp_path / "cache")
    args = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), cache)
    got = rows(token_counts.count_tokens(table(spark, texts), *args))
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(t or "" for t in texts))
    token_counts.count_tokens(table(spark, [*texts, "new"]), *args)
    assert spark.read.parquet(cache).count() == stored.count() + 1 or spark.read.parquet(cache).count() == len(set(t or "" for t in texts)) + 1
    assert token_counts.count_tokens(empty, *args).count() == 0


def brute_sets(texts, width):
    sets = []
    for t in texts:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return sets


def brute_groups(texts, width=4):
    sets = brute_sets(texts, width)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


def near(text, edits, rng):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"q{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("short", [64, 0])
def test_minhash(spark, empty, monkeypatch, short):
    monkeypatch.setattr(minhash, "SHORT_LIST", short)
    rng = random.Random(3)
    texts = list(EDGES)
    for size in (3, 4, 12, 60, 200):
        for _ in range(4):
            base = " ".join(f"w{rng.randrange(500)}" for _ in range(size))
            texts += [base, base.upper(), *[near(base, rng.randrange(1, 1 + max(1, size // 20)), rng) for _ in range(6)]]
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        texts.append(" ".join(chain[: 88] + [f"s{step}{i}" for i in range(step)]))
    rng.shuffle(texts)
    df = table(spark, texts)
    got = rows(minhash.groups(df, width=4))
    sizes, label = brute_groups(texts)
    for i in range(len(texts)):
        assert got[i]["n_shingles"] == sizes[i]
        assert got[i]["component_id"] == label[i], (i, texts[i])
        assert got[i]["kept"] == (label[i] == i)
    assert minhash.groups(empty, width=4).count() == 0
    assert minhash.groups(df.union(df.limit(3)), width=4).count() == len(texts) + 3
    assert {r["doc_id"] for r in minhash.deduplicate(df, width=4).collect()} == {i for i in range(len(texts)) if label[i] == i}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 60)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 0, 150: 0}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        insult, group, y = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1)][rng.randrange(4)]
        words = [rng.choice(WORDS) for _ in range(30)] + ["nasty"] * insult + ["martians"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, y))
    texts += [t for t in EDGES]
    docs = table(spark, texts)
    y = spark.createDataFrame([*labels, (9999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, y)
    got = rows(toxicity.score(docs, model))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], v) for i, v in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert got[400]["predicted"] == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.learn(docs, y.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0


def test_language_id(spark, empty):
    rng = random.Random(4)
    syllables = {"aa": ["the", "tion", "er", "on"], "bb": ["der", "ung", "ein", "ö"], "cc": ["el", "ción", "ñ", "os"]}
    texts, langs = [], {}
    for i in range(200):
        lang = rng.choice(list(syllables))
        langs[i] = lang
        texts.append(" ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)))
    langs |= dict.fromkeys(range(200, 200 + len(EDGES)), None)
    docs = table(spark, texts + EDGES, langs)
    models = langid.learn(docs)
    assert [m.name for m in models] == ["aa", "bb", "cc"]
    got = rows(langid.predict(docs, models))
    assert all(got[i]["lang_pred"] == langs[i] for i in range(200))
    assert [got[200 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[207]["lang_pred"] == "und"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert langid.predict(empty, models).count() == 0
    assert langid.learn(empty) == []
    assert {r["lang_pred"] for r in langid.predict(docs, []).collect()} == {"und"}


@pytest.mark.parametrize("bound", [10**9, 0])
def test_language_models_keep_all_grams(spark, monkeypatch, bound):
    rng = random.Random(5)
    texts = [" ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(6)) for _ in range(1000)) for _ in range(120)]
    texts += ["der " + "".join(chr(97 + rng.randrange(26)) for _ in range(5)) for _ in range(600)]
    langs = {i: "zh" if i < 120 else f"l{i % 300:03}" for i in range(len(texts))}
    docs = table(spark, texts, langs).repartition(3)
    count = {}
    for i, lang in langs.items():
        if zlib.crc32(str(i).encode()) % 4 != 2:
            keys, n = langid.grams(langid.words(texts[i]))
            count.setdefault(lang, Counter()).update(keys.tolist())
    want = [langid.fit(lang, np.array(list(c), dtype=np.uint64), np.array(list(c.values()))) for lang, c in sorted(count.items())]
    assert len(want) > 256 and len(want[-1].levels[-1].keys) > 300_000
    monkeypatch.setattr(langid, "BROADCAST_GRAMS", bound)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 20_000)
    models = langid.learn(docs)
    assert isinstance(models, langid.Stored) == (bound == 0)
    languages = models if bound else models.languages
    assert [m.name for m in languages] == [m.name for m in want]
    assert np.allclose([m.spread for m in languages], [m.spread for m in want])
    want = [w._replace(entropy=m.entropy, wander=m.wander, limit=m.limit) for w, m in zip(want, languages)]
    if bound:
        kept = {(m.name, 2 * n): len(level.keys) for m in models for n, level in enumerate(m.levels, 1)}
    else:
        kept = {(languages[r["lang"]].name, r["slot"]): r["count"] for r in models.values.where("slot % 2 = 0").groupBy("lang", "slot").count().collect()}
    assert kept == {(m.name, 2 * n): len(level.keys) for m in want for n, level in enumerate(m.levels, 1)}
    some = docs.where("doc_id % 7 = 0")
    got = rows(langid.predict(some, models))
    for i, (lang, score, rejected) in zip(range(0, len(texts), 7), langid.classify(texts[::7], want), strict=True):
        assert (got[i]["lang_pred"], got[i]["rejected"]) == (lang, rejected) and abs(got[i]["score"] - score) < 1e-6


def test_kneser_ney_sums_to_one():
    keys, n = langid.grams(["abc", "abd", "bca", "aab"] * 3 + ["cab"])
    distinct, inverse = langid.np.unique(keys, return_inverse=True)
    m = langid.fit("x", distinct, langid.np.bincount(inverse))
    top = m.levels[-1]
    context = top.keys[0] >> langid.np.uint64(16)
    alphabet = m.levels[0].keys
    p = m.probability((context << langid.np.uint64(16)) | alphabet)
    assert 0.97 < p.sum() <= 1.001


def test_packing(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    texts = EDGES + [prose(rng.randrange(1, 700), rng) for _ in range(60)] + [prose(6000, rng), "It's <|endoftext|> don't x²", "ΑΣ Σ İ Å á", "a..,b'll 12"]
    docs = table(spark, texts)
    got = packing.sequences(docs.union(docs.limit(2)), path).collect()
    lib = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        if i >= 2:
            assert sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)), t
            assert p["doc_tokens"] == len(ids)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert packing.sequences(empty, path).count() == 0


def test_pack_fills_sequences():
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(50_000))
    slots = packing.pack(histogram)
    total = sum(k * n for k, n in histogram.items())
    used = max(s.base + s.hi - s.lo for s in slots) * 2048
    assert sum(s.hi - s.lo for s in slots) == sum(histogram.values())
    assert used / total < 1.02
    assert packing.pack({}) == []


def brute_quality(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, empty):
    texts = EDGES + [prose(60), prose(80) * 3, " ".join(WORDS * 40), "a b c d a b c " + prose(30), "x\x0by\x0cz\r\nq", " ".join(f"w{i % 97}" for i in range(400))]
    ledger = quality.ledger(table(spark, texts))
    got = rows(quality.apply_policy(ledger))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t or ""), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    table_ = {r["rule"]: r for r in quality.ablations(ledger).collect()}
    assert table_["few_words"]["failed"] == sum(brute_quality(t or "")[0] < 50 for t in texts)
    assert quality.digest(empty).count() == 0


def brute_repeats(texts):
    first = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            first.setdefault(raw[s : s + 50], i)
    out = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup(spark, empty):
    rng = random.Random(6)
    passage = prose(30, rng)
    texts = list(EDGES)
    for _ in range(25):
        base = prose(rng.randrange(5, 80), rng)
        texts += [base, near(base, 2, rng), base + passage, passage[: rng.randrange(40, 60)] + base, base]
    texts += ["a" * 49, "a" * 50, "b" + "a" * 51, passage * 3, prose(30, rng) + "x" * 120]
    rng.shuffle(texts)
    docs = table(spark, texts)
    got = rows(suffix_dedup.repeated(docs))
    for i, want in enumerate(brute_repeats(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (i, texts[i])
    assert suffix_dedup.repeated(empty).count() == 0
    kept = rows(suffix_dedup.repeated(docs, keep_text=True))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept.values() if r["n_removed"])


def test_long_texts_are_taken_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = random.Random(2)
    text = prose(400, rng).encode()
    parts = list(suffix_dedup.anchors([text, b"", text[:70]]))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 20)
    whole = list(suffix_dedup.anchors([text, b"", text[:70]]))[0]
    starts = lambda rs: {(int(d), s): int(p) for r in rs for d, p, a, z in zip(r.doc, r.anchor, r.first, r.last) for s in range(a, z + 1)}
    assert starts(parts) == starts([whole])
    assert len(starts([whole])) == len(text) - 49 + 21


def test_multikey_groups():
    rng = suffix_dedup.np.random.default_rng(0)
    x = rng.integers(0, 3, (500, 4)).astype(suffix_dedup.np.uint64)
    g = suffix_dedup.multikey_groups(x)
    seen = {}
    for row, k in zip(map(tuple, x.tolist()), g.tolist(), strict=True):
        assert seen.setdefault(row, k) == k
    assert len(set(seen.values())) == len(seen)


def test_words_agree_with_unicode():
    assert unicodedata.normalize("NFC", "é") == "é"
    assert decontam.words("ÀB c-d_9") == ["ÀB".encode().lower(), b"c", b"d", b"9"]


@pytest.mark.parametrize("long", [4, 1024])
def test_minhash_block(monkeypatch, long):
    """A block's pairs connect what all similar pairs connect, whether its sets are held whole or not."""
    monkeypatch.setattr(minhash, "LONG", long)
    monkeypatch.setattr(minhash, "LONG_SHARED", min(2, long))
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(12, rng.integers(8, 12), replace=False)) for _ in range(60)]
    own = np.arange(60) % 2
    held = [s[:long].astype(np.int64) for s in sets]
    pdf = pd.DataFrame({"value": 0, "doc_id": range(60), "n": [len(s) for s in sets], "c": np.arange(60) // 3, "held": held, "own": own, "i": 0, "j": 1})
    near = [(a, b) for a in range(60) for b in range(a + 1, 60) if own[a] != own[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]

    def classes(links):
        root = {}
        for a, b in links:
            minhash._join(root, a // 3, b // 3)
        return [minhash._root(root, c) for c in range(20)]

    got = list(minhash._block(pdf, 80).itertuples(index=False, name=None))
    if long < 12:
        got = [p for p in got if p in near]
    assert set(got) <= set(near) and classes(got) == classes(near)
    assert minhash._block(pdf.assign(c=1), 80).empty


@pytest.mark.parametrize("least", [100, 1])
def test_hot_keys_are_joined_whole(spark, monkeypatch, least):
    """With and without hot keys, joins by groups and by salt give what a plain join gives."""
    monkeypatch.setattr(common, "LEAST_HOT", least)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rng = random.Random(1)
    pairs = [(0 if rng.random() < 0.4 else rng.randrange(1, 60), i) for i in range(400)] + [(None, 5), (77, 6)]
    df = common.settle(spark.createDataFrame(pairs, "k long, v long"))
    count = Counter(k for k, _ in pairs)
    groups = spark.createDataFrame([(k, n, f"m{k}") for k, n in count.items() if k not in (None, 77)], "k long, n long, m string")
    got = common.join_groups(df, groups, "k", len(pairs), -1 - F.col("v")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, v, None if k in (None, 77) else f"m{k}") for k, v in pairs), key=repr)
    got = common.join_salted(df, groups.select("k", "m"), "k", "v").select("k", "v", "m").collect()
    assert sorted(map(tuple, got)) == sorted((k, v, f"m{k}") for k, v in pairs if k not in (None, 77))


@pytest.mark.parametrize("least", [100, 1])
def test_copies_and_hubs(spark, monkeypatch, least):
    """Exact copies, near copies of one text and rows without an id, with every key hot and with none."""
    monkeypatch.setattr(common, "LEAST_HOT", least)
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    texts = [base] * 40 + [near(base, 1, rng) for _ in range(60)] + [prose(30, rng) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (3, base)]
    got = minhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    _, label = brute_groups(texts)
    assert len(got) == len(docs) and all(r["component_id"] == label[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert all(r["kept"] for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("most", [200_000, 0])
def test_one_passage_in_very_many_documents(spark, monkeypatch, most):
    """Its edges, each in another context, have one lead; they are compared in salted parts and again by all bytes."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 20)
    monkeypatch.setattr(suffix_dedup, "MOST_LEADS", most)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    rng = random.Random(16)
    passage, other = prose(14, rng), prose(9, rng)
    texts = [prose(rng.randrange(1, 12), rng) + rng.choice([passage, passage, other + passage]) + prose(rng.randrange(1, 12), rng) for _ in range(220)]
    rng.shuffle(texts)
    extra = spark.createDataFrame([(None, texts[3]), (7, texts[7]), (7, texts[7] + " more " + passage)], "doc_id long, text string")
    got = rows(suffix_dedup.repeated(table(spark, texts)))
    for i, want in enumerate(brute_repeats(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (i, texts[i])
    again = suffix_dedup.repeated(table(spark, texts[:20]).select("doc_id", "text").union(extra)).collect()
    assert len(again) == 23 and next(r for r in again if r["doc_id"] is None)["n_removed"] == 0
