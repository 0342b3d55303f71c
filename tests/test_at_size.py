"""Steps that must not grow faster than their input: what they move, and that results stay whole."""

import random

import pytest

from strataq.functions import expressions as X
from strataq.operators import chunk, expand, explore, parse, retrieve
from strataq.plans import registry
from strataq.sources import scan


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_bfs(edges, starts, hops, most):
    out = []
    for s in starts:
        seen, front = {s: 0}, {s}
        for hop in range(1, hops + 1):
            front = {b for a, b in edges if a in front} - set(seen)
            seen |= dict.fromkeys(front, hop)
        near = sorted((hop, n) for n, hop in seen.items() if hop)[:most]
        out += [(s, n, hop, i + 1) for i, (hop, n) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("reverse", [False, True])
def test_bfs_takes_the_first_neighbours_before_it_deals_them(spark, reverse):
    """a node's neighbours are cut to what can count before they are shuffled; hubs, loops and repeated edges included."""
    rnd = random.Random(3)
    nodes = [f"n{i:02}" for i in range(60)]
    pairs = [(a, b) for a in nodes[:50] for b in rnd.sample(nodes, rnd.choice((0, 1, 1, 2, 3, 30)))] + [("n00", n) for n in nodes] + [("n01", "n01"), ("n01", "n00"), ("n01", "n00")]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs] + [("n59", "n00", "imports")], "src string, dst string, type string")
    starts = spark.createDataFrame([(n,) for n in nodes], "start string")
    ends = [(b, a) for a, b in pairs] if reverse else pairs
    for hops, most in ((1, 3), (2, 4), (2, 10), (3, 3)):
        got = expand.bfs_calls(edges, starts, reverse, hops, most)
        assert sorted(map(tuple, got.collect())) == plain_bfs(ends, nodes, hops, most)
    assert "WindowGroupLimit" in plan(got) and "Partial" in plan(got)


@pytest.mark.parametrize("task_bytes", [64, 1 << 28])
def test_siblings_as_text_are_those_listed(spark, monkeypatch, task_bytes):
    """an owner's text is made once and cut, by several tasks if it is long."""
    monkeypatch.setattr(expand, "TASK_BYTES", task_bytes)
    rows = [(f"m.py::f{i}", "function", f"fü{i}", "m.py", (i * 7) % 5, i, None) for i in range(9)] + [("o.py::g", "function", "g", "o.py", 1, 2, None)] + [(f"m.py::C.{x}", "function", x, "m.py", 3, 4, "m.py::C") for x in "ab"]
    nodes = spark.createDataFrame(rows + [("m.py::C", "class", "C", "m.py", 1, 9, None)], "node_id string, kind string, name string, relative_path string, start_line int, end_line int, parent_id string")
    starts = nodes.select(X.F.col("node_id").alias("start"))
    listed = {r["start"]: ", ".join(f"<{s['name']} (lines {s['start_line']}-{s['end_line']})" for s in r["siblings"]) for r in expand.siblings(nodes, starts).collect()}
    got = {r["start"]: r["siblings"] for r in expand.with_siblings(nodes, starts, "<", ", ").collect()}
    assert {k: v for k, v in got.items() if v is not None} == listed and len(got) == len(rows) + 1 and got["o.py::g"] is got["m.py::C"] is None


def test_a_prompt_is_made_where_its_siblings_are(spark):
    """no block, which holds the text of all siblings, is gathered by query; the last step makes the prompts."""
    made = plan(registry.queries()["prompt_text"](spark, "/root/testdata/sf0.001"))
    assert "block" not in made and "collect_list(struct(rank" not in made


def test_a_file_is_split_once_for_all_of_its_spans(spark):
    """spans meet lines, not whole texts; also of odd line ends, beyond the end, without lines and of a file that isn't there."""
    texts = {"a": "one\r\ntwo three\n", "b": "", "c": "x\n\ny"}
    spans = [(f"{f}{i}{j}", f, i, j) for f in "abcz" for i in range(1, 5) for j in range(0, 6)]
    files, df = spark.createDataFrame(list(texts.items()), "relative_path string, text string"), spark.createDataFrame(spans, "node_id string, relative_path string, start_line int, end_line int")
    want = {r["node_id"]: r["s"] for r in df.join(files, "relative_path").select("node_id", X.line_slice(X.F.col("text"), X.F.col("start_line"), X.F.col("end_line")).alias("s")).collect()}
    assert {r["node_id"]: r["source"] for r in chunk.slices(df, files).collect()} == want
    assert len(want) == 72 and want["a22"] == "two" and want["a14"] == "one\ntwo\nthree"


@pytest.mark.parametrize("name", ["navigation_facts", "embed_chunks", "chunk_text"])
def test_no_text_of_a_file_is_joined_to_its_symbols(spark, name, monkeypatch):
    """what is joined are lines; the text of a file is read by the step that splits it only."""
    joined = []
    frame = type(spark.range(0))
    plain = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, *a, **k: joined.append((self.columns, other.columns)) or plain(self, other, *a, **k))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert joined and not any("text" in x for pair in joined for x in pair)


def test_modules_are_handed_on_as_they_are_parsed(monkeypatch):
    """a worker holds one file or so, not what a batch of files makes."""
    schema, held = parse.to_arrow_schema(parse.StructType.fromDDL(parse.MODULE)), []
    monkeypatch.setattr(parse, "parse_module", lambda path, content: held.append(path) or {"relative_path": path, "parse_error": None, "classes": [], "functions": [], "imports": []})
    big = b"#" * parse.BATCH_BYTES
    files = parse.pa.RecordBatch.from_pydict({"relative_path": list("abcde"), "content": [big, b"", big, None, b"x"]})
    got = [(b.column(0).to_pylist(), list(held)) for b in parse.parse_batches(iter([files]), schema)]
    assert got == [(["a"], ["a"]), (["b", "c"], list("abc")), (["d", "e"], list("abcde"))]


@pytest.mark.parametrize("name", ["graph_nodes", "graph_edges"])
def test_modules_are_parsed_once(spark, name):
    """the graph's parts read parsed modules; none parses again."""
    assert "MapIn" not in plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("most", [None, 2])
def test_names_match_as_by_brute_force(spark, monkeypatch, most):
    """Words are looked for once by their ends; those wanted are the best of each word; long, repeated and many words."""
    if most:
        monkeypatch.setattr(retrieve, "BROADCAST_WORDS", 0)
    rnd = random.Random(5)
    names = ["".join(rnd.choice(("in", "a", "_b", "Large_Ring_Long", "12")) for _ in range(rnd.randint(1, 5))) for _ in range(120)] + ["", "in", "in"]
    asked = [(i, rnd.choice(("in ", "", " \t", "zz ", "the")) + rnd.choice(names) + rnd.choice(("", "?", " work in"))) for i in range(60)] + [(60, None), (61, " ")]
    nodes = spark.createDataFrame([(f"n{i:03}", "function", n) for i, n in enumerate(names)], "node_id string, kind string, name string")
    want = []
    for i, query in asked:
        q = (query or "").lower()
        placed = []
        for k, n in enumerate(names):
            places = [n.lower().find(w) for w in q.split() if w in n.lower()]
            if n and (places or n.lower() in q):
                placed.append((min(places, default=0), f"n{k:03}"))
        want += [(i, n, r + 1) for r, (_, n) in enumerate(sorted(placed)[:most])]
    got = retrieve.lexical_match(nodes, spark.createDataFrame(asked, "query_id int, query string"), **({"most": most} if most else {}))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hybrid_search_ranks_the_best_names_only(spark):
    """of a word, which many names hold, five names a task are shuffled."""
    assert plan(registry.queries()["hybrid_search"](spark, "/root/testdata/sf0.001")).count("WindowGroupLimit [word") == 2


@pytest.mark.parametrize("uri", [False, True])
def test_a_tree_is_listed_by_the_executors(spark, tmp_path, monkeypatch, uri):
    """the driver holds no name; links, ignored folders and links to nothing as before."""
    top = tmp_path / "t"
    for name in ("a.py", "p/q/r/deep.md", "p/.hidden", "node_modules/x.py", "p/build/y.py", "p/empty/.gitkeep"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(name)
    (top / "gone.py").symlink_to(top / "nowhere")
    (top / "a_link.py").symlink_to(top / "a.py")
    if not uri:
        (top / "p/back").symlink_to(top)
    made = []
    frame = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or frame(self, data, *a, **k))
    df = scan.scan(spark, f"file://{top}" if uri else str(top))
    got = {r["relative_path"]: (r["disposition"], r["content"] and bytes(r["content"])) for r in df.collect()}
    kept = {n: ("kept", n.encode()) for n in ("a.py", "p/q/r/deep.md", "p/.hidden", "p/empty/.gitkeep")}
    assert got == kept | {"a_link.py": ("kept", b"a.py"), "node_modules": ("ignored_dir", None), "p/build": ("ignored_dir", None)}
    assert made == [1] and "Join" not in plan(df) and scan.scan(spark, str(top / "none")).isEmpty()


def test_lists_of_neighbours_are_moved_once(spark):
    """ends are gathered by node alone and joined where they are; odd ends, kinds and nodes without edges stay right."""
    nodes = spark.createDataFrame([(n, "function", n, 1, 2) for n in "abc"], "node_id string, kind string, name string, start_line int, end_line int")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "a", "calls"), ("a", "b", "odd"), ("b", "z", "odd"), ("z", "b", "calls"), ("a", "b", "calls")], "src string, dst string, type string")
    df = explore.graph_inspect(nodes, edges)
    got = {(r["node_id"], r["direction"], r["type"]): (r["n"], r["others"]) for r in df.collect()}
    assert got == {("a", "out", "calls"): (3, ["a", "b", "b"]), ("a", "in", "calls"): (1, ["a"]), ("a", "out", "odd"): (1, ["b"]), ("b", "out", "odd"): (1, ["z"]),
                   ("b", "in", "calls"): (3, ["a", "a", "z"]), ("b", "in", "odd"): (1, ["a"]), ("c", None, None): (None, None)}
    assert plan(df).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2
