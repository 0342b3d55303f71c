"""Scalar expressions; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: the namespace of point ids and what ends a line.
POINT_NAMESPACE = "f47ac10b58cc4372a5670e02b2c3d479"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def symbol_id(path: Column, name: Column, parent: Column | None = None) -> Column:
    return F.concat(path, F.lit("::"), name if parent is None else F.concat_ws(".", parent, name))


def point_id(repo_id: Column, chunk_id: Column) -> Column:
    """UUID version 5 of "repo:chunk" in the fixed namespace."""
    key = F.concat(repo_id.cast("string"), F.lit(":"), chunk_id)
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant.substr(nibble + 1, F.lit(1)), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def kind_label(kind: Column, is_method: Column) -> Column:
    return F.when(kind == "class", "Class").when(is_method, "Method").otherwise("Function")


def lines(text: Column) -> Column:
    """Lines without their ends; a text that ends with a line end has no further, empty line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, counted from 1, joined by newlines."""
    return F.array_join(F.slice(lines(text), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def mask(value: Column) -> Column:
    """All but the last four characters as stars; null as "not set"."""
    n = F.length(value)
    hidden = F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(4))))
    return F.coalesce(hidden, F.lit("not set"))


def display(name: Column, value: Column) -> Column:
    """A setting as shown: those named like a secret are masked."""
    return F.when(F.lower(name).rlike("key|token|secret|password"), mask(value)).otherwise(F.coalesce(value, F.lit("not set")))


def minute(stamp: Column) -> Column:
    """ISO text to the minute; null or empty: Never; what can't be read stays."""
    shown = F.coalesce(F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd HH:mm"), stamp)
    return F.when(stamp.isNull() | (stamp == ""), "Never").otherwise(shown)


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
