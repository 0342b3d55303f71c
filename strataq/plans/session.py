"""Commands over one catalog: index, update, explore, ask."""

from __future__ import annotations

import os
import platform
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import expressions as X
from strataq.operators import chunk, expand, explore, graph, parse, retrieve, sync
from strataq.plans.providers import AnswerProvider, CatalogVectors, Echo, EmbeddingProvider, HashedWords
from strataq.sources import scan
from strataq.sources.catalog import Catalog

HISTORY_WINDOW = 4
COMMANDS = {
    "Repositories": {"init": "index a tree", "update": "index its changes", "repos": "list indexed trees", "remove": "forget a tree"},
    "Exploration": {
        "architecture": "counts and most imported modules", "stats": "files, symbols, lines", "modules": "modules with their counts",
        "symbols": "classes, methods, functions", "dependencies": "who imports whom", "inspect": "a node and its neighbours",
    },
    "Questions": {"chat": "ask about the tree"},
    "Utilities": {"doctor": "check the installation and the index", "config": "settings in effect", "version": "versions in use", "help": "this list"},
}
CHAT_COMMANDS = {"help": "these words", "history": "the turns so far", "clear": "forget them", "stats": "about this session", "exit": "leave", "quit": "leave"}
#: Section of each setting; others are listed under Other, last.
SECTIONS = {"catalog": "Paths", "root": "Paths", "vector_size": "Vectors", "embedding_model": "Embeddings", "embedding_url": "Embeddings", "answer_model": "Answers", "answer_key": "Answers"}
SECTION_ORDER = ("Paths", "Vectors", "Embeddings", "Answers", "Other")


class NotIndexed(Exception):
    """The repository isn't in the catalog."""


class Stale(Exception):
    """The tree differs from what was indexed."""


class NoResults(Exception):
    """Nothing was found for a question."""


class Session:
    """One source tree. embeddings and answers may call services."""

    def __init__(self, catalog: Catalog, root: str, embeddings: EmbeddingProvider | None = None, answers: AnswerProvider | None = None):
        self.catalog, self.spark, self.root = catalog, catalog.spark, os.path.abspath(root)
        self.embeddings, self.answers, self.turns = embeddings or HashedWords(), answers or Echo(), []
        self.vectors = CatalogVectors(catalog)

    def _id(self) -> int:
        found = self.catalog.repository(self.root)
        if found is None:
            raise NotIndexed(self.root)
        return found

    def _files(self) -> DataFrame:
        return scan.kept(scan.scan(self.spark, self.root)).cache()

    def changes(self, repo_id: int, files: DataFrame) -> DataFrame:
        stored = self.catalog.read("files", repo_id)
        return sync.changes(files.withColumn("repo_id", F.lit(repo_id).cast("long")), stored)

    def init(self) -> DataFrame:
        """Index the tree; a first run makes the repository's row."""
        return self._index(self.catalog.get_or_create(self.root, os.path.basename(self.root)))

    def update(self) -> DataFrame:
        return self._index(self._id())

    def _index(self, repo_id: int) -> DataFrame:
        files = self._files()
        counted = sync.summary(self.changes(repo_id, files)).collect()
        python = files.where("language = 'python'")
        cached = self.catalog.read("modules", repo_id)
        nested = cached.select("content_hash", F.from_json("data", parse.MODULE).alias("m")).select("m.*", "content_hash")
        modules = parse.parse_incremental(python, nested).cache()
        data = F.to_json(F.struct(*[c for c in modules.columns if c != "content_hash"]), {"ignoreNullFields": "false"})
        self.catalog.replace("modules", repo_id, modules.select("relative_path", "content_hash", data.alias("data")))
        texts = python.select("relative_path", F.decode("content", "UTF-8").alias("text"))
        chunks = chunk.chunks(graph.nodes(modules), texts).withColumns({"point_id": X.point_id(F.lit(repo_id), F.col("chunk_id")), "content_hash": F.sha2("content", 256)}).cache()
        self.vectors.create_collection(self.embeddings.dimension)
        fresh = chunk.embed(sync.to_embed(chunks, self.catalog.read("vectors", repo_id)), self.embeddings.embed).cache()
        self.vectors.upsert(repo_id, fresh)
        self.vectors.delete(repo_id, sync.stale_points(self.vectors.list_ids(repo_id), chunks))
        self.catalog.replace("files", repo_id, files)
        self.catalog.touch(repo_id)
        for df in (files, modules, chunks, fresh):
            df.unpersist()
        return self.spark.createDataFrame(counted, "repo_id long, added long, updated long, removed long, unchanged long, total_files long")

    def graph(self, fresh: bool = True) -> tuple[DataFrame, DataFrame]:
        """nodes and edges from the stored modules; fresh: the tree must be as indexed."""
        repo_id = self._id()
        if fresh and not self.changes(repo_id, self._files()).where("change <> 'unchanged'").isEmpty():
            raise Stale(self.root)
        modules = self.catalog.read("modules", repo_id).select(F.from_json("data", parse.MODULE).alias("m")).select("m.*")
        nodes = graph.nodes(modules)
        return nodes, graph.edges(modules, nodes)

    def architecture(self) -> dict[str, DataFrame]:
        nodes, edges = self.graph()
        return {"nodes": explore.node_counts(nodes), "edges": explore.edge_counts(edges), "top": explore.top_imported(edges), "languages": explore.language_breakdown(self.catalog.read("files", self._id())).orderBy(F.desc("n"), "first_path")}

    def modules(self) -> DataFrame:
        return explore.module_stats(*self.graph()).orderBy("module_id")

    def symbols(self) -> DataFrame:
        return explore.symbols_listing(self.graph()[0]).orderBy("module", "start_line")

    def dependencies(self, module: str | None = None) -> DataFrame:
        out = explore.dependencies(*self.graph())
        return out if module is None else _some(out.where(F.col("module_id") == module), module)

    def inspect(self, node: str) -> DataFrame:
        nodes, edges = self.graph()
        _some(nodes.where(F.col("node_id") == node), node)
        return explore.graph_inspect(nodes.where(F.col("node_id") == node), edges)

    def stats(self) -> DataFrame:
        files = self._files()
        return explore.repo_stats(self.graph()[0], files, files.select(F.decode("content", "UTF-8").alias("text")))

    def repos(self) -> DataFrame:
        return self.catalog.list_repositories().select("repo_id", "name", "path", X.minute(F.col("last_indexed_at")).alias("last_indexed"))

    def remove(self) -> None:
        self.catalog.remove(self._id())

    def checks(self) -> DataFrame:
        """check, state (ok, open, warning, failed), detail: what doctor() sums up, in order. A check that raises has failed; the others still run."""
        rows: list[tuple[str, str, str]] = []

        def check(name: str, f) -> None:
            try:
                rows.append((name, *f()))
            except Exception as e:  # a diagnosis must end, whatever is broken
                rows.append((name, "failed", f"{type(e).__name__}: {e}".splitlines()[0]))

        def stale() -> tuple[str, str]:
            if self._known() is None:
                return "open", "Not indexed"
            changed = self.changes(self._known(), self._files()).where("change <> 'unchanged'").count()
            return ("warning", "Index is out of date") if changed else ("ok", "Index is up to date")

        def stored() -> tuple[str, str]:
            n = 0 if self._known() is None else self.vectors.list_ids(self._known()).count()
            return "ok" if n else "open", f"{n} stored"

        check("Configuration", lambda: ("ok", f"{len(self.settings())} settings"))
        check("Source tree", lambda: ("ok", self.root) if os.path.isdir(self.root) else ("failed", f"No folder {self.root}"))
        check("Catalog", lambda: ("ok", f"{self.catalog.list_repositories().count()} repositories"))
        check("Vectors", lambda: ("ok", f"Collection of size {self.catalog.vector_size()}") if self.vectors.collection_exists() else ("open", "No collection yet"))
        check("Repository", lambda: ("ok", "Indexed") if self._known() is not None else ("open", "Not indexed"))
        check("Freshness", stale)
        check("Embeddings", stored)
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, check string, state string, detail string")

    def _known(self) -> int | None:
        return self.catalog.repository(self.root)

    def doctor(self) -> DataFrame:
        """One row: failures, indexed, stale and the status that follows."""
        return explore.health(explore.roll_up(self.checks()))

    def settings(self) -> dict[str, str | None]:
        e, a = self.embeddings, self.answers
        size = self.catalog.vector_size()
        return {"catalog": self.catalog.root, "root": self.root, "vector_size": size and str(size), "embedding_model": getattr(e, "model", type(e).__name__), "embedding_url": getattr(e, "url", None),
                "answer_model": getattr(a, "model", type(a).__name__), "answer_key": getattr(a, "api_key", None)}

    def config(self, settings: dict[str, str | None] | None = None) -> DataFrame:
        """section, name, shown of every setting, secrets masked, and the sizes of the scanner's fixed lists."""
        rows = [(SECTIONS.get(k, "Other"), k, v) for k, v in (settings or self.settings()).items()]
        fixed = [("Scanner", n, str(len(v))) for n, v in (("ignored_directories", scan.IGNORED_DIRECTORIES), ("ignored_patterns", scan.IGNORED_PATTERNS), ("binary_extensions", scan.BINARY_EXTENSIONS))]
        order = (*SECTION_ORDER, "Scanner")
        listed = sorted(rows, key=lambda r: order.index(r[0])) + fixed
        df = self.spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "place int, section string, name string, value string")
        return df.select("place", "section", "name", X.display(F.col("name"), F.col("value")).alias("shown")).orderBy("place")

    def version(self) -> DataFrame:
        """name, value: of this package, of what it runs on, and where it is."""
        try:
            own = metadata.version("strataq")
        except metadata.PackageNotFoundError:
            own = "development"
        here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        rows = [("Version", own), ("Python", platform.python_version()), ("Spark", self.spark.version), ("Platform", platform.platform()), ("Install path", here)]
        return self.spark.createDataFrame(rows, "name string, value string")

    def help(self) -> DataFrame:
        """section, command, what it does."""
        return self.spark.createDataFrame([(s, c, w) for s, cs in COMMANDS.items() for c, w in cs.items()], "section string, command string, what string")

    def chat(self, line: str) -> str | None:
        """What a line of a conversation gives: one of CHAT_COMMANDS, or the answer to a question; None ends the conversation, an empty line gives nothing."""
        word = line.strip().lower()
        if word in ("exit", "quit"):
            return None
        if word == "help":
            return "\n".join(f"{k:8} {v}" for k, v in CHAT_COMMANDS.items())
        if word == "history":
            short = lambda t: t if len(t) <= 200 else t[:200] + "..."
            return "\n".join(f"{i}. User: {q}\n   Assistant: {short(a)}" for i, (q, a) in enumerate(self.turns, 1)) or "No conversation history yet."
        if word == "clear":
            self.turns = []
            return "Conversation history cleared."
        if word == "stats":
            nodes, edges = self.graph()
            facts = {"Repository": self.root, "Repo ID": self._id(), "Conversation turns": len(self.turns), "History window": HISTORY_WINDOW, "Graph nodes": nodes.count(), "Graph edges": edges.count()}
            return "\n".join(f"{k}: {v}" for k, v in facts.items())
        return self.ask(line) if word else ""

    def ask(self, question: str, k: int = 5) -> str:
        """Navigation if the question is one, else retrieval, expansion and a prompt for the provider."""
        repo_id, (nodes, edges) = self._id(), self.graph()
        q = self.spark.createDataFrame([(0, question)], "query_id int, query string")
        vectors = self.catalog.read("vectors", repo_id)
        routed = q.select(retrieve.route(F.col("query")).alias("r")).first()["r"]
        named = None
        if routed:
            found = retrieve.symbol_lookup(nodes, self.spark.createDataFrame([(routed["symbol"],)], "symbol string"))
            named = nodes.join(found, "node_id", "left_semi")
        if named is not None and not named.isEmpty():
            texts = self._files().where("language = 'python'").select("relative_path", F.decode("content", "UTF-8").alias("text"))
            facts = chunk.facts(named, vectors.select(F.col("chunk_id").alias("node_id"), "content"), texts, routed["nav_type"] == "implementation")
            reply = self.answers.generate(chunk.navigation_prompt(question, [r["fact"] for r in facts.orderBy("node_id").collect()]))
        else:
            by_vector = self.vectors.query(self.embeddings.embed([question])[0], repo_id, k).select(F.lit(0).alias("query_id"), "chunk_id", "rank")
            by_name = retrieve.lexical_match(nodes, q, k).select("query_id", F.col("node_id").alias("chunk_id"), "rank")
            hits = retrieve.hybrid(by_vector, by_name, k)
            if hits.isEmpty():
                raise NoResults(question)
            around = expand.expand(nodes, edges, hits.select(F.col("chunk_id").alias("start"))).withColumnRenamed("start", "chunk_id")
            full = hits.join(vectors.select("chunk_id", "relative_path", "start_line", "end_line", "content"), "chunk_id").join(around, "chunk_id")
            turns = self.spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(self.turns)], "conv_id int, turn int, question string, answer string")
            past = chunk.history_block(explore.last_turns(turns, HISTORY_WINDOW)).select("history").first() if self.turns else None
            overview = explore.repo_summary(nodes, self.catalog.read("files", repo_id), os.path.basename(self.root)).first()["summary"]
            asked = q.select("query_id", "query", F.lit(overview).alias("overview"), F.lit(past and past["history"]).alias("history"))
            reply = self.answers.generate(chunk.prompts(asked, chunk.symbol_block(full)).first()["prompt"])
        self.turns = [*self.turns, (question, reply)][-HISTORY_WINDOW:]
        return reply


def _some(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise KeyError(what)
    return rows
