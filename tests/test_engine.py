"""The engine: parsing, scanning, resolution, the catalog and a session; and that all queries agree with their oracles."""

import os

import duckdb
import pytest

from strataq.functions import expressions as X
from strataq.operators import expand, graph, parse, resolve, retrieve
from strataq.plans import registry
from strataq.plans.session import NotIndexed, Session, Stale
from strataq.sources import catalog, scan
from strataq.sources.catalog import Catalog

SOURCE = '''from __future__ import annotations
import os, a.b as c
from .pkg import thing as other, more
from .. import up
if True:
    def hidden(): pass

@deco
class A(Base, metaclass=M):
    def first(self, x=default()):
        self.second()
        helper(inner(1))
        def nested():
            os.path.join("x")
    @property
    def second(self): return f"{call(2)}"
    @second.setter
    def second(self, v): pass

async def top():
    return A().first()
'''


def test_parse_module():
    m = parse.parse_module("p/m.py", SOURCE)
    assert m["parse_error"] is None
    assert [(c["name"], c["start_line"], c["end_line"], c["base_classes"]) for c in m["classes"]] == [("A", 9, 18, ["Base", "metaclass=M"])]
    assert [(f["id"], f["start_line"], f["is_method"]) for f in m["functions"]] == [("p/m.py::A.first", 10, True), ("p/m.py::A.second", 18, True), ("p/m.py::top", 20, False)]
    assert [(c["callee_name"], c["receiver"]) for c in m["functions"][0]["calls"]] == [("second", "self"), ("helper", None), ("inner", None), ("join", "os.path")]
    assert [(i["module"], i["level"], [n["name"] for n in i["imported_names"]]) for i in m["imports"]] == [("os", 0, []), ("a.b", 0, []), ("pkg", 1, ["thing", "more"]), (None, 2, ["up"])]
    for bad in (b"\xff\xfe", b"def (", b"\0", None):
        assert parse.parse_module("x.py", bad)["classes"] == []


def test_lines(spark):
    texts = ["", "a", "a\n", "a\n\nb\r\nc\x0bd\x0ce\x1cf\x85g h i\n", "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(X.lines(X.F.col("text")).alias("x")).collect()
    assert [r["x"] for r in got] == [t.splitlines() for t in texts]


def test_bfs_limits_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("b", "e", "calls"), ("a", "a", "calls"), ("b", "a", "calls")] + [("s", f"l{i:02}", "calls") for i in range(15)], "src string, dst string, type string")
    starts = spark.createDataFrame([("a",), ("s",), ("none",)], "start string")
    got = sorted((r["start"], r["rank"], r["node_id"]) for r in expand.bfs_calls(edges, starts).collect())
    assert [n for s, _, n in got if s == "a"] == ["b", "c", "e"]
    assert [n for s, _, n in got if s == "s"] == [f"l{i:02}" for i in range(10)]


def test_import_rules(spark):
    paths = ["a.py", "pkg/__init__.py", "pkg/m.py", "pkg/sub/x.py", "src/a.py", "src/only.py", "both.py", "both/__init__.py", "stub.pyi"]
    keys = resolve.module_keys(spark.createDataFrame([(p,) for p in paths], "path string"))
    rows = [("z.py", "a", 0, None), ("z.py", "only", 0, "src/only.py"), ("z.py", "pkg", 0, "pkg/__init__.py"), ("z.py", "pkg.m", 0, "pkg/m.py"), ("z.py", "pkg.sub.x", 0, None), ("z.py", "both", 0, "both.py"), ("z.py", "stub", 0, None),
            ("pkg/m.py", None, 1, "pkg/__init__.py"), ("pkg/m.py", "m", 1, "pkg/m.py"), ("pkg/m.py", "a", 2, "a.py"), ("pkg/m.py", None, 2, None), ("z.py", None, 0, None), ("z.py", "a", 5, None)]
    df = spark.createDataFrame(rows, "source_path string, module string, level int, want string")
    assert all(r["target"] == r["want"] for r in resolve.import_targets(df, keys).collect())


def test_hybrid_order(spark):
    schema = "query_id int, chunk_id string, rank int"
    v = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], schema)
    s = spark.createDataFrame([(0, "b", 1), (0, "c", 2), (0, "d", 3)], schema)
    got = {r["rank"]: (r["chunk_id"], r["origin"]) for r in retrieve.hybrid(v, s, 3).collect()}
    assert got == {1: ("a", "vector"), 2: ("b", "name"), 3: ("c", "name")}


@pytest.fixture
def tree(tmp_path):
    files = {"app.py": "from lib import helper\n\ndef run():\n    helper()\n", "lib.py": "class B:\n    pass\n\nclass C(B):\n    def m(self):\n        return self.m()\n\ndef helper():\n    return 1\n",
             "README.md": "# hi\n", "node_modules/x.js": "", "a.log": "", "i.PNG": "x", "broken.py": "def (", ".scanignore": "# c\n\nskip/\n*.tmp\n", "skip/y.py": "", "z.tmp": "", "Makefile": "all:\n", "pkg/__init__.py": "", "_x[1].py": "a = 1\n"}
    for name, text in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "tree" / "exact.txt").write_bytes(b"x" * (1 << 20))
    (tmp_path / "tree" / "large.txt").write_bytes(b"x" * ((1 << 20) + 1))
    return tmp_path


def test_scan(spark, tree):
    got = {r["relative_path"]: r for r in scan.scan(spark, str(tree / "tree")).collect()}
    state = {k: r["disposition"] for k, r in got.items()}
    assert state["large.txt"] == "large" and state["exact.txt"] == "kept" and state["a.log"] == "ignored" and state["i.PNG"] == "binary" and state["z.tmp"] == "ignored"
    assert state["skip"] == state["node_modules"] == "ignored_dir" and "skip/y.py" not in state
    assert all(state[p] == "kept" and got[p]["content_hash"] for p in ("pkg/__init__.py", "_x[1].py", ".scanignore"))
    assert got["app.py"]["language"] == "python" and got["Makefile"]["language"] == "makefile" and got["exact.txt"]["language"] is None


def test_session(spark, tree):
    root = str(tree / "tree")
    s = Session(Catalog(spark, str(tree / "catalog")), root)
    with pytest.raises(NotIndexed):
        s.update()
    assert s.doctor().first()["status"] == "not indexed"
    first = s.init().first()
    assert first["added"] == first["total_files"] and first["updated"] == 0
    edges = {(r["src"], r["dst"], r["type"]) for r in s.graph()[1].collect()}
    assert {("app.py", "lib.py", "imports"), ("app.py::run", "lib.py::helper", "calls"), ("lib.py::C.m", "lib.py::C.m", "calls"), ("lib.py::C", "lib.py::B", "inherits"), ("lib.py::C", "lib.py::C.m", "contains")} <= edges
    assert s.catalog.list_point_ids(1).count() == 3 and s.catalog.vector_size() == 64
    assert "Function:\nhelper" in s.ask("where is helper defined?") and "=== Retrieved Symbol 1 ===" in s.ask("what does helper do")
    assert s.doctor().first()["status"] == "healthy"
    with open(os.path.join(root, "lib.py"), "a") as f:
        f.write("\ndef more():\n    helper()\n")
    with pytest.raises(Stale):
        s.modules()
    again = s.update().first()
    assert (again["added"], again["updated"], again["removed"]) == (0, 1, 0)
    assert s.catalog.list_point_ids(1).count() == 4
    s.remove()
    assert s.catalog.list_repositories().count() == 0 and s.catalog.read("vectors").count() == 0


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in registry.adapter.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_oracle(spark, oracle, name):
    df, want = registry.queries()[name](spark, "/root/testdata/sf0.001"), oracle.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    assert cols == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(*cols).fetchall()))


def test_line_ends_and_marks():
    plain = parse.parse_module("p/m.py", SOURCE)
    for other in (SOURCE.replace("\n", "\r"), SOURCE.replace("\n", "\r\n"), "\ufeff" + SOURCE, SOURCE.replace("\n", "\r\n", 7)):
        assert parse.parse_module("p/m.py", other.encode()) == parse.parse_module("p/m.py", other) == plain
    one = parse.parse_module("x.py", b"\xef\xbb\xbfdef f():\r    a.b(1)\r\r\ndef g(): pass")
    assert [(f["name"], f["start_line"], f["end_line"]) for f in one["functions"]] == [("f", 1, 2), ("g", 4, 4)]
    assert one["functions"][0]["calls"] == [{"callee_name": "b", "receiver": "a", "line": 2}]


def test_base_class_is_the_first_declared(spark):
    modules = parse.parse(spark.createDataFrame([("m.py", b"class A: pass\nclass Z: pass\nclass C(Elsewhere, Z, A):\n    def f(self): pass\n    def g(self): self.f()\n")], "relative_path string, content binary"))
    nodes, edges = graph.nodes(modules), graph.edges(modules)
    assert [tuple(r) for r in resolve.first_base(edges).collect()] == [("m.py::C", "m.py::Z")]
    hits = spark.createDataFrame([("m.py::C.g", 2), ("m.py::C.f", 1)], "start string, rank int")
    got = {r["rank"]: r for r in expand.expand(nodes, edges, hits).collect()}
    assert tuple(got[1]["base_class"]) == ("Z", "class", 2, 2) and tuple(got[1]["parent"]) == ("C", "class", 3, 5)
    assert [tuple(x) for x in got[1]["siblings"]] == [("g", "function", 5, 5)] and [x["name"] for x in got[2]["calls"]] == ["f"] and got[2]["called_by"] is None
    assert expand.owners(nodes, edges).where("n <> 1").isEmpty()


def test_names_in_questions(spark):
    nodes = spark.createDataFrame([(n, "function", n) for n in ("foo", "bar", "baz", "x", "Get_X", "")] + [("K", "class", "foo")], "node_id string, kind string, name string")
    asked = [(0, "\tfoo"), (1, "foo\n"), (2, " \t "), (3, "what is BA"), (4, "in (foo)"), (5, None), (6, "get_\u2003zz"), (7, "t_x")]
    got = {}
    for r in retrieve.lexical_match(nodes, spark.createDataFrame(asked, "query_id int, query string")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert got == {0: ["foo"], 1: ["foo"], 3: ["bar", "baz"], 4: ["foo"], 6: ["Get_X"], 7: ["x", "Get_X"]}
    routed = spark.createDataFrame([("\twhere is x defined?\n",), ("where is ??",), ("Show Implementation of A.b ??",)], "q string").select(retrieve.route(X.F.col("q")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in routed] == [("definition", "x"), None, ("implementation", "A.b")]


def test_near_vectors_keep_their_order(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 1e-4]), (2, 1, [1.0, 2e-4]), (3, 1, [1.0, 1e-4]), (4, 2, [1.0, 0.0]), (5, 1, [0.0, 0.0]), (6, 1, None)], "vec_id long, repo_id long, embedding array<double>")
    q = spark.createDataFrame([(0, 1, [1.0, 2e-4]), (9, 2, [1.0, 0.0])], "query_id long, repo_id long, query_embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in retrieve.vector_topk(v, q, 4).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 2, 1.0), (0, 1, 1.0), (0, 3, 1.0), (0, 4, 1.0)]
    own = [(r["query_id"], r["vec_id"]) for r in retrieve.vector_topk(v, q, 5, same_repo=True).orderBy("query_id", "rank").collect()]
    assert own == [(0, 2), (0, 1), (0, 3), (0, 5), (9, 4)]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    one, two = c.get_or_create("/a", "a"), c.get_or_create("/b", "b")
    assert (one, two, c.get_or_create("/a", "a")) == (1, 2, 1)
    modules = lambda *ps: spark.createDataFrame([(p, "h", "{}") for p in ps], "relative_path string, content_hash string, data string")
    c.replace("modules", one, modules("x", "y"))
    c.replace("modules", two, modules("x"))
    before = c._versions(c._part("modules", two))
    c.upsert_modules(one, modules("y", "z"))
    assert {r["relative_path"] for r in c.read("modules", one).collect()} == {"x", "y", "z"} and c._versions(c._part("modules", two)) == before
    assert c.delete_modules(one, modules("x", "none")) == 1 and c.clear_modules(one) == 2 and c.clear_modules(one) == 0 and c.read("modules").count() == 1
    row = [("p", "k", "function", "x", 1, 2, "text", "h", [1.0, 2.0])]
    points = spark.createDataFrame(row, ", ".join(catalog.SCHEMAS["vectors"].split(", ")[:-1]))
    c.create_collection(2)
    c.create_collection(3)
    c.upsert_vectors(one, points)
    c.upsert_vectors(one, points.limit(0))
    with pytest.raises(ValueError):
        c.upsert_vectors(one, points.withColumn("embedding", X.F.array(X.F.lit(1.0).cast("float"))))
    c.upsert_vectors(one, points.withColumn("content", X.F.lit("new")))
    assert [r["content"] for r in c.read("vectors", one).collect()] == ["new"]
    c.delete_vectors(one, points.limit(0))
    c.remove(one)
    assert c.read("vectors").count() == 0 and [r["name"] for r in c.list_repositories().collect()] == ["b"] and c.repository_by_id(1).isEmpty()


def test_commands(spark, tree):
    s = Session(Catalog(spark, str(tree / "catalog2")), str(tree / "tree"))
    assert {r["check"]: r["state"] for r in s.checks().collect()} == {"Configuration": "ok", "Source tree": "ok", "Catalog": "ok", "Vectors": "open", "Repository": "open", "Freshness": "open", "Embeddings": "open"}
    s.init()
    assert {r["state"] for r in s.checks().collect()} == {"ok"} and s.doctor().first()["status"] == "healthy"
    shown = [(r["section"], r["name"], r["shown"]) for r in s.config({"answer_key": "abcdefgh", "odd": "1", "root": "/x"}).collect()]
    assert shown[:3] == [("Paths", "root", "/x"), ("Answers", "answer_key", "****efgh"), ("Other", "odd", "1")] and shown[3][:2] == ("Scanner", "ignored_directories")
    assert dict(map(tuple, s.version().collect()))["Spark"] == spark.version and s.help().where("command = 'chat'").count() == 1
    assert s.chat("history") == "No conversation history yet." and s.chat(" ") == "" and s.chat("EXIT") is None and "clear" in s.chat("help")
    assert "Base class:\nB (lines 1-2)" in s.chat("what does m do") and "Parent class:\nC (lines 4-6)" in s.turns[0][1] and "1. User: what does m do" in s.chat("history")
    assert "Conversation turns: 1" in s.chat("stats") and s.chat("clear") and not s.turns
    got = {(r["direction"], r["type"]): r["others"] for r in s.inspect("lib.py::C").collect()}
    assert got == {("out", "contains"): ["lib.py::C.m"], ("out", "inherits"): ["lib.py::B"], ("in", "contains"): ["lib.py"]}
    os.rename(s.root, s.root + "x")
    assert s.doctor().first()["status"] == "failed"


def test_navigation_gives_all_matches_and_sources(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(103):
        (root / f"m{i:03}.py").write_text(f"def run():\n    return {i}\n")
    (root / "c.py").write_text("class Box:\n    size = 7\n\n    def open(self):\n        return self.size\n")
    s = Session(Catalog(spark, str(tmp_path / "catalog")), str(root))
    s.init()
    where = s.ask("where is run defined?")
    assert where.count("Function:\nrun") == 103 and "Source:" not in where
    shown = s.ask("show implementation of run")
    assert all(f"Source:\nFunction run\nModule m{i:03}.py\ndef run():\n    return {i}" in shown for i in range(103))
    assert "Class:\nBox\n\nLocation:\nc.py lines 1-5\n\nSource:\nclass Box:\n    size = 7\n" in s.ask("show me the implementation of Box")
    assert "Source:\nMethod Box.open\nModule c.py\n    def open(self):" in s.ask("show implementation of Box.open")
