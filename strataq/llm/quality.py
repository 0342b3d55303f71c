"""Quality rules as a ledger: every rule is evaluated once, and policies are masks over the failure bits.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm import common

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Bit, name and failure condition over the measurements.
RULES: list[tuple[int, str, Callable[[], Column]]] = [
    (0, "few_words", lambda: F.col("n_words") < 50),
    (1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    (2, "symbols", lambda: 10 * F.col("n_symbols") > F.col("word_chars")),
    (3, "repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    (4, "long_words", lambda: F.col("word_chars") > 30 * F.col("n_words")),
    (5, "short_words", lambda: 2 * F.col("word_chars") < 3 * F.col("n_words")),
]
BASE_MASK = 0b11
#: A policy is the set of rules that reject; a changed policy never evaluates a text again.
POLICIES = {"base": BASE_MASK, "v1": 0b111111}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice; windows are compared by 64-bit hashes."""

    def windows(h: Column) -> Column:
        tri = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return F.when(F.size(h) >= 3, let(tri, repeated)).otherwise(F.lit(0))

    def repeated(tri: Column) -> Column:
        twice = let(F.sort_array(tri), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(covered(F.when(F.size(d) <= 16, by_list(tri, d)).otherwise(by_sort(tri)))))

    def by_list(tri: Column, d: Column) -> Column:
        return F.filter(F.transform(tri, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())

    def by_sort(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda p, i: (p["x"] == F.get(i[0], i[1])["x"])
        both = let(pairs, lambda s: F.filter(s, lambda p, i: F.coalesce((i > 0) & same(p, (s, i - 1)), F.lit(False)) | F.coalesce(same(p, (s, i + 1)), F.lit(False))))
        return F.sort_array(F.transform(both, lambda p: p["i"]))

    def covered(positions: Column) -> Column:
        return let(positions, lambda at: _sum(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_mask (bit b: rule b failed) for every row of docs (doc_id, text).

    A null or empty text has no words and no lines: all measurements are 0 and few_words fails. Repeated rows each
    give a row, an empty table an empty one; other columns are ignored. One pass, without a shuffle.
    """
    common.prepare(docs.sparkSession)
    text = F.col("text")
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+", -1))
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACE, text)
    symbols = reduce(lambda a, b: a + b, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS])
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    measured = common.whole_texts(docs).select(
        "doc_id",
        counted.alias("__w"),
        F.length(bare).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        of_lines.alias("__l"),
    ).select("doc_id", "__w.n_words", "word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines")
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule(), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, rule in RULES])
    return measured.withColumn("fail_mask", mask.cast("long"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """base_failed and kept, from the bits alone."""
    base = F.col("fail_mask").bitwiseAND(F.lit(BASE_MASK)) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", F.col("fail_mask").bitwiseAND(F.lit(BASE_MASK | POLICIES[policy])) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, failed, only_failed (rows that this rule alone rejects), kept_without, from one aggregation of the bits."""
    mask, whole = F.col("fail_mask"), POLICIES[policy]
    sums = []
    for bit, name, _ in RULES:
        others = mask.bitwiseAND(F.lit(whole & ~(1 << bit))) == 0
        fails = mask.bitwiseAND(F.lit(1 << bit)) != 0
        sums.append(F.struct(F.lit(name).alias("rule"), F.count_if(fails).alias("failed"), F.count_if(fails & others).alias("only_failed"), F.count_if(others).alias("kept_without")))
    return rows.agg(F.array(*sums).alias("a")).select(F.inline("a"))


def digest(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END)
  + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask FROM f
"""
