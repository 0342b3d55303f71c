"""Secrets through an inverted index of trigrams: rules become Boolean trigram queries, postings are intersected, candidates verified.

DataFrame functions only. The index is a bitmap: a column of bits for each trigram of the rules, whose set bits are its
postings, so that an intersection is an AND of columns. A document's bits are computed where its text is, and no text
moves. write_index() stores the bitmap, which then says without the texts which documents to verify. A rule whose
pattern has no mandatory trigrams is verified on every text.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as K
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm import common


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int


#: The first three are the base kinds. Runs that can only match whole are taken from their first character, possessively.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    Rule("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 30),
]
BASE = ("assign", "access", "hex")
#: A query is a set of alternatives, each a set of trigrams that must all occur; no alternatives: the rule lacks one.
Query = frozenset[frozenset[str]]
MOST_STRINGS = 64


def trigram_query(pattern: str) -> Query | None:
    """Trigrams, in lower case, that any match must have; None if there are none that it must."""
    found: list[Query] = []

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            found.append(_absorbed(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)))

    def exact(items) -> set[str] | None:
        """The finite set of strings that a part matches, in lower case."""
        out = {""}
        for op, arg in items:
            if op is K.LITERAL:
                own = {chr(arg).lower()}
            elif op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
                own = {chr(a).lower() for _, a in arg}
            elif op is K.SUBPATTERN:
                own = exact(arg[-1])
            elif op is K.BRANCH:
                each = [exact(b) for b in arg[1]]
                own = None if None in each else set().union(*each)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1:
                own = exact(arg[2])
                own = own and own | ({""} if arg[0] == 0 else set())
            elif op is K.ASSERT_NOT or op is K.AT:
                own = {""}
            else:
                own = None
            if own is None or len(out) * len(own) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    run = {""}
    for item in _parser.parse(pattern):
        own = exact([item])
        if own is None:
            flush(run)
            run = {""}
        elif len(run) * len(own) > MOST_STRINGS:
            flush(run)
            run = own
        else:
            run = {a + b for a in run for b in own}
    flush(run)
    if not found:
        return None
    return reduce(lambda a, b: _absorbed(frozenset(x | y for x in a for y in b)), found)


def _absorbed(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


QUERIES = {r.kind: trigram_query(r.pattern) for r in RULES}
TRIGRAMS = sorted({t for q in QUERIES.values() if q for a in q for t in a})


WORDS = -(-len(TRIGRAMS) // 62)  # columns of 62 bits


def _once(value: Column, f) -> Column:
    """f of a value, which f would evaluate wherever it has it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bits(text: Column) -> Column:
    """What the bitmap holds of one document, as a struct of m0, m1, ... The trigrams are a literal array that one loop goes through: written out, each would add to a single generated method."""
    words = lambda value: F.struct(*[value(k).alias(f"m{k}") for k in range(WORDS)])
    bit = lambda i: words(lambda k: F.lit(1 << (i % 62) if i // 62 == k else 0).cast("long"))
    grams = F.array(*[F.struct(F.lit(t).alias("gram"), bit(i).alias("bit")) for i, t in enumerate(TRIGRAMS)])
    either = lambda acc, g: words(lambda k: acc[f"m{k}"].bitwiseOR(g["bit"][f"m{k}"]))
    return _once(F.lower(text), lambda low: F.aggregate(F.filter(grams, lambda g: F.contains(low, g["gram"])), words(lambda k: F.lit(0).cast("long")), either))


def postings(docs: DataFrame) -> DataFrame:
    """The index as bitmaps: doc_id, m0, m1, ...; bit i % 62 of column i // 62 is set for the postings of trigram i."""
    return common.whole_texts(docs).select("doc_id", _bits(F.col("text")).alias("bits")).select("doc_id", "bits.*")


def write_index(docs: DataFrame, path: str) -> None:
    """Store the bitmap; new documents are appended."""
    postings(docs).write.mode("append").parquet(path)


def _rules(masks: list[Column]) -> Column:
    """A bit for each rule whose query the intersected postings satisfy."""

    def all_of(alternative: frozenset[str]) -> Column:
        need = [0] * WORDS
        for t in alternative:
            i = TRIGRAMS.index(t)
            need[i // 62] |= 1 << (i % 62)
        return reduce(lambda a, b: a & b, [masks[k].bitwiseAND(F.lit(m).cast("long")) == m for k, m in enumerate(need) if m])

    bits = []
    for r, rule in enumerate(RULES):
        if q := QUERIES[rule.kind]:
            hit = reduce(lambda a, b: a | b, [all_of(a) for a in sorted(q, key=sorted)])
            bits.append(F.when(hit, F.lit(1 << r)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def candidates(index: DataFrame) -> DataFrame:
    """(doc_id, rules) from a bitmap: bit r is set if the document is in the intersected postings of rule r; documents without a bit are left out."""
    return index.select("doc_id", _rules([F.col(f"m{k}") for k in range(WORDS)]).alias("rules")).where("rules != 0")


SPANS = "array<struct<start:long,rule:int,end:long,kind:string>>"
#: Matches that are placed together; then whole blocks are placed, so that work is linear in a text's matches.
BLOCK = 256


def _spans(text: Column, r: int, rule: Rule) -> Column:
    """Spans of one rule: the pieces between its matches and the matches themselves give the places, in code points."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    paired = lambda whole: F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), whole, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m")))
    steps = F.zip_with(_once(whole, paired), counted, lambda pm, g: F.struct(pm["p"].alias("p"), pm["m"].alias("m"), (F.length(g) >= rule.least).alias("ok"))) if rule.group else F.transform(_once(whole, paired), lambda pm: F.struct(pm["p"].alias("p"), pm["m"].alias("m"), (pm["m"] >= rule.least).alias("ok")))
    place = "struct<at:long,spans:array<struct<start:long,end:long,ok:boolean>>>"

    def placed(block: Column) -> Column:
        """Spans of a block as if it began the text, and its length."""
        return F.aggregate(
            block,
            F.from_json(F.lit('{"at":0,"spans":[]}'), place),
            lambda acc, x: F.struct(
                (acc["at"] + x["p"] + x["m"]).alias("at"),
                F.array_append(acc["spans"], F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + x["m"]).alias("end"), x["ok"].alias("ok"))).alias("spans"),
            ),
        )

    def whole_text(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: placed(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        moved = F.aggregate(
            blocks,
            F.from_json(F.lit('{"at":0,"done":[]}'), "struct<at:long,done:array<array<struct<start:long,end:long,ok:boolean>>>>"),
            lambda acc, b: F.struct(
                (acc["at"] + b["at"]).alias("at"),
                F.array_append(acc["done"], F.transform(b["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["ok"].alias("ok")))).alias("done"),
            ),
        )
        good = F.filter(F.flatten(_once(moved, lambda m: m["done"])), lambda s: s["ok"])
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rule"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return F.when(F.rlike(text, F.lit(rule.pattern)), _once(steps, whole_text)).otherwise(F.array().cast(SPANS))


def _marked(text: Column, rules: Column) -> Column:
    """All spans of a text by the rules whose bits are set, and by those without trigrams."""
    free = sum(1 << r for r, rule in enumerate(RULES) if not QUERIES[rule.kind])
    parts = [F.when(rules.bitwiseOR(F.lit(free)).bitwiseAND(F.lit(1 << r)) != 0, _spans(text, r, rule)).otherwise(F.array().cast(SPANS)) for r, rule in enumerate(RULES)]
    return F.sort_array(F.concat(*parts))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start, rule, end, kind) by start and kind, for every row of docs (doc_id, text).

    A null or empty text has no spans. Repeated rows each give a row, and so do rows without an id or with another's;
    an empty table gives an empty one; other columns are ignored. Nothing moves.
    """
    common.prepare(docs.sparkSession)
    held = common.whole_texts(docs).select("doc_id", "text", _bits(F.col("text")).alias("bits"))
    asked = held.select("doc_id", "text", _rules([F.col(f"bits.m{k}") for k in range(WORDS)]).alias("rules"))
    return asked.select("doc_id", _marked(F.col("text"), F.col("rules")).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = lambda s: s["rule"] < len(BASE)
    count = lambda r: F.size(F.filter("spans", lambda s: s["rule"] == r)).cast("long")
    return find(docs).select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(BASE)],
        F.sha2(joined(F.filter("spans", base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def remove(docs: DataFrame) -> DataFrame:
    """The rows without a secret, with all their columns, as they are; rows without an id or with a repeated one are judged like any other."""
    common.prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumn("__bits", _bits(text))
    marked = held.withColumn("__spans", _marked(text, _rules([F.col(f"__bits.m{k}") for k in range(WORDS)])))
    return marked.where(F.size("__spans") == 0).drop("__spans", "__bits")
