"""The property graph as two tables, built from parsed modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import expressions as X
from strataq.operators import parse, resolve


def nodes(modules: DataFrame) -> DataFrame:
    none = F.lit(None)
    m = modules.select(F.col("relative_path").alias("node_id"), F.lit("module").alias("kind"), X.stem(F.col("relative_path")).alias("name"), "relative_path", none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("parent_id"), F.lit(False).alias("is_method"))
    c = parse.classes(modules).select(F.col("class_id").alias("node_id"), F.lit("class").alias("kind"), "name", "relative_path", "start_line", "end_line", none.cast("string").alias("parent_id"), F.lit(False).alias("is_method"))
    f = parse.functions(modules).select(F.col("function_id").alias("node_id"), F.lit("function").alias("kind"), "name", "relative_path", "start_line", "end_line", "parent_id", "is_method")
    return m.unionByName(c).unionByName(f)


def edges(modules: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """src, dst, type, pos: contains, inherits, imports, calls; pos: a base's place among those declared, null for other types."""
    of = of if of is not None else nodes(modules)
    keys = resolve.module_keys(modules.select(F.col("relative_path").alias("path")))
    typed = lambda df, t: df.select("src", "dst", F.lit(t).alias("type"), (F.col("pos") if "pos" in df.columns else F.lit(None)).cast("int").alias("pos"))
    contains = of.where("kind <> 'module'").select(F.coalesce("parent_id", "relative_path").alias("src"), F.col("node_id").alias("dst"))
    imports = parse.imports(modules)
    calls = resolve.call_edges(parse.functions(modules), parse.call_sites(modules), imports, keys)
    parts = [(contains, "contains"), (resolve.inherits_edges(parse.classes(modules)), "inherits"), (resolve.import_edges(imports, keys), "imports"), (calls, "calls")]
    out = typed(*parts[0])
    for p in parts[1:]:
        out = out.union(typed(*p))
    return out
