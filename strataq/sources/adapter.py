"""The driver's tables as the engine's canonical relations.

One SQL text serves Spark and DuckDB. HASH256(x) and BYTES(x) stand for each engine's function.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataq.sources import store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIALECT = {"spark": {"HASH256": "(sha2({}, 256))", "BYTES": "(octet_length({}))"}, "duckdb": {"HASH256": "(sha256({}))", "BYTES": "(strlen({}))"}}

VIEWS = {
    "files_now": """SELECT doc_id, CAST(substring(source, 4) AS INT) AS repo_id,
        concat(lang, '/doc_', CAST(doc_id AS STRING), CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.md' WHEN 'fr' THEN '.json' ELSE '.txt' END) AS relative_path,
        CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'markdown' WHEN 'fr' THEN 'json' END AS language,
        HASH256(text) AS content_hash, CAST(BYTES(text) AS BIGINT) AS size_bytes FROM documents""",
    "files_prev": """SELECT f.repo_id, f.relative_path, CASE WHEN f.doc_id % 10 = 5 THEN HASH256(concat(d.text, '!')) ELSE f.content_hash END AS content_hash
        FROM files_now f JOIN documents d ON d.doc_id = f.doc_id WHERE f.doc_id % 10 <> 3
        UNION ALL SELECT repo_id, concat('old/', relative_path), content_hash FROM files_now WHERE doc_id % 10 = 7""",
    "mods": """SELECT n_nationkey, concat(lower(replace(r_name, ' ', '_')), '/nation_', CAST(n_nationkey AS STRING), '.py') AS module_id,
        concat('nation_', CAST(n_nationkey AS STRING)) AS name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cls": """SELECT s_suppkey, s_nationkey, m.module_id, concat(m.module_id, '::S', CAST(s_suppkey AS STRING)) AS class_id,
        concat('S', CAST(s_suppkey AS STRING)) AS name FROM supplier JOIN mods m ON s_nationkey = m.n_nationkey""",
    "meth": """SELECT p_partkey, c.module_id, c.class_id, concat(c.class_id, '.', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS fn_id,
        concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS name, CAST(p_partkey * 3 + 1 AS INT) AS start_line,
        CAST(p_partkey * 3 + 1 + p_size AS INT) AS end_line
        FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_partkey) x ON l_partkey = p_partkey JOIN cls c ON c.s_suppkey = x.sk""",
    "nodes": """SELECT module_id AS node_id, 'module' AS kind, name, module_id AS relative_path, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line,
        CAST(NULL AS STRING) AS parent_id, false AS is_method FROM mods
        UNION ALL SELECT class_id, 'class', name, module_id, CAST(s_suppkey + 1 AS INT), CAST(s_suppkey + 100 AS INT), CAST(NULL AS STRING), false FROM cls
        UNION ALL SELECT fn_id, 'function', name, module_id, start_line, end_line, class_id, true FROM meth
        UNION ALL SELECT concat(m.module_id, '::f', CAST(c_custkey AS STRING)), 'function', concat('f', CAST(c_custkey AS STRING)), m.module_id,
        CAST(c_custkey + 1 AS INT), CAST(c_custkey + 9 AS INT), CAST(NULL AS STRING), false FROM customer JOIN mods m ON c_nationkey = m.n_nationkey""",
    "edges": """SELECT coalesce(parent_id, relative_path) AS src, node_id AS dst, 'contains' AS type, CAST(NULL AS INT) AS pos FROM nodes WHERE kind <> 'module'
        UNION ALL SELECT a.class_id, b.class_id, 'inherits', CAST(row_number() OVER (PARTITION BY a.class_id ORDER BY (b.s_suppkey * 7) % 11, b.s_suppkey) AS INT)
        FROM cls a JOIN cls b ON a.module_id = b.module_id AND b.s_suppkey < a.s_suppkey AND b.s_suppkey >= a.s_suppkey - 100
        UNION ALL SELECT DISTINCT a.module_id, b.module_id, 'imports', CAST(NULL AS INT) FROM (SELECT DISTINCT c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = l_suppkey) x JOIN mods a ON a.n_nationkey = c_nationkey JOIN mods b ON b.n_nationkey = s_nationkey
        WHERE c_nationkey <> s_nationkey
        UNION ALL SELECT DISTINCT a.fn_id, b.fn_id, 'calls', CAST(NULL AS INT) FROM (SELECT DISTINCT l_partkey, (l_partkey * 7 + l_linenumber * 13 + l_suppkey) % n AS callee FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM part) k) x
        JOIN meth a ON a.p_partkey = x.l_partkey JOIN meth b ON b.p_partkey = x.callee""",
    "py": """SELECT p_partkey, p_name, concat(CASE WHEN p_name LIKE '%ring' THEN 'src/' ELSE '' END, replace(p_name, ' ', '/'), '_', CAST(p_size AS STRING), '.py') AS path FROM part""",
    "paths": """SELECT path FROM py
        UNION SELECT concat('src/', path) FROM py WHERE p_name LIKE '%rod'
        UNION SELECT concat(split_part(p_name, ' ', 1), CASE WHEN p_name LIKE 'red%' THEN '/__main__.py' ELSE '/__init__.py' END) FROM part
        UNION SELECT concat('src/', split_part(p_name, ' ', 1), CASE WHEN p_name LIKE 'cold%' THEN '/__main__.py' ELSE '/__init__.py' END) FROM part
        UNION SELECT concat(split_part(p_name, ' ', 1), '.py') FROM part WHERE p_name LIKE 'new%'""",
    "imports_in": """SELECT DISTINCT a.path AS source_path,
        CASE WHEN a.p_partkey % 4 = 0 THEN split_part(b.p_name, ' ', 1) WHEN a.p_partkey % 4 IN (1, 2) THEN replace(replace(replace(b.path, 'src/', ''), '/', '.'), '.py', '')
        ELSE replace(split_part(replace(b.path, 'src/', ''), '/', 2), '.py', '') END AS module, CASE WHEN a.p_partkey % 4 = 3 THEN 1 ELSE 0 END AS level
        FROM py a CROSS JOIN (SELECT count(*) AS n FROM part) k JOIN py b ON b.p_partkey = (a.p_partkey * 3 + 1) % k.n""",
    "tree": """SELECT doc_id, text, concat(CASE doc_id % 9 WHEN 0 THEN 'pkg/' WHEN 1 THEN 'src/app/' WHEN 2 THEN 'node_modules/left/' WHEN 3 THEN 'docs/' WHEN 4 THEN 'a/.git/objects/' WHEN 5 THEN 'lib/build/' WHEN 6 THEN 'skip/deep/'
        WHEN 7 THEN 'venvs/' ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN concat('d', CAST(doc_id AS STRING), '/Makefile') ELSE concat('doc_', CAST(doc_id AS STRING),
        CASE doc_id % 29 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.log' WHEN 3 THEN '.PNG' WHEN 4 THEN '.min.js' WHEN 5 THEN '.tsx' WHEN 6 THEN '' WHEN 7 THEN '.json' WHEN 8 THEN '.tar.gz' WHEN 9 THEN '.yml' WHEN 10 THEN '.tmp'
        WHEN 11 THEN '.PY' WHEN 12 THEN '.lock' WHEN 13 THEN '.rs' WHEN 14 THEN '.go' WHEN 15 THEN '.h' WHEN 16 THEN '.cc' WHEN 17 THEN '.kts' WHEN 18 THEN '.zsh' WHEN 19 THEN '.swift' WHEN 20 THEN '.rb' WHEN 21 THEN '.php' WHEN 22 THEN '.cs'
        WHEN 23 THEN '.dart' WHEN 24 THEN '.scss' WHEN 25 THEN '.sql' WHEN 26 THEN '.toml' WHEN 27 THEN '.htm' ELSE '.unknown' END) END) AS path,
        CASE doc_id % 101 WHEN 0 THEN 1048576 WHEN 1 THEN 1048577 ELSE 0 END AS fill FROM documents""",
    "turns": """SELECT conv_id, turn, text AS question, nxt AS answer FROM (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) z WHERE role = 'user' AND nr = 'assistant'""",
    "points": "SELECT vec_id, label AS repo_id, concat('emb/v', CAST(vec_id AS STRING), '.py::f') AS chunk_id FROM embeddings",
}
_NAME = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def _needed(sql: str, kept: dict[str, str] | None = None) -> list[str]:
    """Views of a statement, each after those that it reads; of a kept view only itself."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS:
            below = [] if kept and name in kept else _needed(VIEWS[name], kept)
            out += [x for x in (*below, name) if x not in out]
    return out


def _dialect(sql: str, engine: str) -> str:
    for name, form in DIALECT[engine].items():
        while (at := sql.find(f"{name}(")) >= 0:
            depth, end = 0, at + len(name)
            while True:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
                if not depth:
                    break
            sql = sql[:at] + form.format(sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


def statement(sql: str, engine: str, sf_dir: str = "", extra: dict[str, str] | None = None, kept: dict[str, str] | None = None) -> str:
    """A single statement with the views that it needs as common table expressions; extra: more of them, in order; kept: views that are read instead."""
    kept = kept or {}
    parts = [(v, kept.get(v, VIEWS[v])) for v in _needed(" ".join([sql, *(extra or {}).values()]), kept)] + list((extra or {}).items())
    if engine == "spark":
        used = {t for _, s in parts for t in _NAME.findall(s)} | set(_NAME.findall(sql))
        parts = [(t, f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`") for t in TABLES if t in used] + parts
    with_ = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts) + " " if parts else ""
    return _dialect(with_ + sql, engine)


def relation(spark: SparkSession, sf_dir: str, name: str, kept: dict[str, str] | None = None) -> DataFrame:
    """One canonical relation, or a driver table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if kept and name in kept:
        return spark.sql(kept[name])
    return spark.sql(statement(f"SELECT * FROM {name}", "spark", sf_dir, kept=kept))


def relations(spark: SparkSession, sf_dir: str, settled: tuple[str, ...] = ()) -> Callable[[str], DataFrame]:
    """A loader of relations. Those settled, each after what it is made of, are written when first asked for and then read."""
    kept: dict[str, str] = {}

    def load(name: str) -> DataFrame:
        for view in settled:
            if view not in kept and view in [*_needed(VIEWS.get(name, "")), name]:
                where = store.folder(spark)
                relation(spark, sf_dir, view, kept).write.parquet(where)
                kept[view] = f"SELECT * FROM parquet.`{where}`"
        return relation(spark, sf_dir, name, kept)

    return load
