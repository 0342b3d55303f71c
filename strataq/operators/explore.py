"""Reports over the graph: counts, listings, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions import expressions as X

EDGE_TYPES = ("contains", "inherits", "imports", "calls")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of each type; types without edges count 0."""
    kinds = edges.sparkSession.createDataFrame([(t,) for t in EDGE_TYPES], "type string")
    return kinds.join(edges.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def module_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes, functions (methods included), imports out and in of every module."""
    symbols = nodes.where("kind <> 'module'").groupBy("relative_path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("functions"))
    imports = edges.where("type = 'imports'")
    ends = imports.select(F.explode(F.array(F.struct(F.col("src").alias("m"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("m"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    links = ends.groupBy("e.m").agg(F.sum("e.o").alias("imports_out"), F.sum("e.i").alias("imports_in"))
    modules = nodes.where("kind = 'module'").select(F.col("node_id").alias("module_id"))
    out = modules.join(symbols, F.col("module_id") == F.col("relative_path"), "left").join(links, F.col("module_id") == F.col("m"), "left")
    return out.select("module_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("classes", "functions", "imports_out", "imports_in")])


def top_imported(edges: DataFrame, k: int = 5) -> DataFrame:
    counts = edges.where("type = 'imports'").groupBy("dst").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "dst").limit(k)


def symbols_listing(nodes: DataFrame) -> DataFrame:
    """Every class, method and function by its shown name."""
    parents = nodes.where("kind = 'class'").select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    own = nodes.where("kind <> 'module'").join(parents, "parent_id", "left")
    symbol = F.when(F.col("is_method"), F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
    return own.select(symbol.alias("symbol"), X.kind_label(F.col("kind"), F.col("is_method")).alias("kind"), F.col("relative_path").alias("module"), "start_line", "end_line")


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Import neighbours of every module, both ways, sorted."""
    imports = edges.where("type = 'imports'").select("src", "dst").distinct()
    listed = lambda key, other, name: imports.groupBy(F.col(key).alias("module_id")).agg(F.array_join(F.array_sort(F.collect_list(other)), ",").alias(name))
    modules = nodes.where("kind = 'module'").select(F.col("node_id").alias("module_id"))
    out = modules.join(listed("src", "dst", "imports"), "module_id", "left").join(listed("dst", "src", "imported_by"), "module_id", "left")
    return out.select("module_id", F.coalesce("imports", F.lit("")).alias("imports"), F.coalesce("imported_by", F.lit("")).alias("imported_by"))


def graph_inspect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its attributes and, for each direction and type of its edges, their number and all neighbours, sorted. A node without edges has one row."""
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.lit(True).alias("out"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.lit(False).alias("out"), F.col("src").alias("other")))
    flat = edges.select("type", F.explode(ends).alias("e")).select("e.node_id", F.struct("e.out", "type").alias("way"), "e.other")
    # By node alone, so that lists are moved once and meet their node where they are made; ends that are no node find none.
    held = flat.groupBy("node_id").agg(F.collect_list(F.struct("way", "other")).alias("x"))
    lists = F.transform(F.array_distinct("x.way"), lambda w: F.struct(w.alias("way"), F.array_sort(F.transform(F.filter("x", lambda e: e["way"] == w), lambda e: e["other"])).alias("others")))
    own = nodes.select("node_id", "kind", "name", "start_line", "end_line").join(held, "node_id", "left").select("node_id", "kind", "name", "start_line", "end_line", F.explode_outer(lists).alias("l"))
    direction = F.when(F.col("l.way.out"), "out").when(~F.col("l.way.out"), "in")
    return own.select("node_id", "kind", "name", "start_line", "end_line", direction.alias("direction"), F.col("l.way.type").alias("type"), F.when(F.col("l").isNotNull(), F.size("l.others")).cast("long").alias("n"), F.col("l.others").alias("others"))


def largest_modules(nodes: DataFrame, k: int = 5) -> DataFrame:
    return nodes.where("kind <> 'module'").groupBy("relative_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relative_path").limit(k)


def largest_classes(nodes: DataFrame, k: int = 5) -> DataFrame:
    methods = nodes.where("is_method").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    classes = nodes.where("kind = 'class'").select("node_id")
    return classes.join(methods, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "node_id").limit(k)


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("n"), F.min("relative_path").alias("first_path"))


def repo_stats(nodes: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: split of files and symbols, lines and averages with one decimal."""
    python, markdown = F.col("language") == "python", F.col("language") == "markdown"
    f = files.agg(F.count("*").alias("files"), F.count_if(python).alias("python_files"), F.count_if(markdown).alias("markdown_files"), F.count_if(~F.coalesce(python | markdown, F.lit(False))).alias("other_files"))
    s = nodes.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("module", "modules"), ("class", "classes"))], F.count_if(F.col("is_method")).alias("methods"), F.count_if((F.col("kind") == "function") & ~F.col("is_method")).alias("functions"))
    t = texts.agg(F.coalesce(F.sum(F.size(X.lines(F.col("text")))), F.lit(0)).alias("loc"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 1)
    return f.join(s).join(t).withColumns({"loc_per_file": ratio("loc", "files"), "methods_per_class": ratio("methods", "classes"), "functions_per_module": ratio("functions", "modules")})


def repo_summary(nodes: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """One row: the facts that are there, a line each; sections with nothing to say are left out."""
    python = F.col("language") == "python"
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    section = lambda label, value, there: F.when(there, F.concat(F.lit(label), value))
    path = F.col("relative_path")
    f = files.agg(
        listed("language").alias("languages"),
        F.count_if(python).alias("modules"),
        listed(F.when(python & path.contains("/"), F.substring_index(path, "/", 1))).alias("top"),
        listed(F.when(python & F.element_at(F.split(path, "/"), -1).isin("main.py", "cli.py", "__main__.py", "app.py"), path)).alias("entry"),
    )
    s = nodes.agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("functions"))
    return f.join(s).select(
        F.concat_ws(
            "\n",
            F.lit(f"Repository: {name}"),
            section("Languages: ", F.col("languages"), F.col("languages") != ""),
            section("Python modules: ", F.col("modules").cast("string"), F.col("modules") > 0),
            section("Top-level packages/directories: ", F.col("top"), F.col("top") != ""),
            F.when(F.col("classes") + F.col("functions") > 0, F.concat(F.lit("Classes: "), F.col("classes"), F.lit(", Functions/Methods: "), F.col("functions"))),
            section("Likely entrypoints: ", F.col("entry"), F.col("entry") != ""),
        ).alias("summary")
    )


def health(checks: DataFrame) -> DataFrame:
    """Overall state of (failures, indexed, stale): failed, then not indexed, then stale, then healthy."""
    state = F.when(F.col("failures") > 0, "failed").when(~F.col("indexed"), "not indexed").when(F.col("stale"), "stale").otherwise("healthy")
    return checks.withColumn("status", state)


def roll_up(checks: DataFrame) -> DataFrame:
    """failures, indexed, stale from check rows (check, state)."""
    return checks.agg(
        F.count_if(F.col("state") == "failed").cast("int").alias("failures"),
        F.coalesce(F.bool_or((F.col("check") == "Repository") & (F.col("state") == "ok")), F.lit(False)).alias("indexed"),
        F.coalesce(F.bool_or((F.col("check") == "Freshness") & (F.col("state") == "warning")), F.lit(False)).alias("stale"),
    )


def last_turns(turns: DataFrame, k: int = 4) -> DataFrame:
    """The last k turns of every conversation, oldest first by position."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", back).where(F.col("back") <= k)
