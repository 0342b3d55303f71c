"""Python source to typed rows; the one operator that needs Python on the executors."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CALL = "struct<callee_name:string,receiver:string,line:int>"
MODULE = (
    "relative_path string, parse_error string, "
    "classes array<struct<id:string,name:string,start_line:int,end_line:int,base_classes:array<string>>>, "
    f"functions array<struct<id:string,name:string,start_line:int,end_line:int,parent_id:string,is_method:boolean,calls:array<{CALL}>>>, "
    "imports array<struct<module:string,level:int,imported_names:array<struct<name:string,alias:string>>,line:int>>"
)
#: Bytes of source whose modules are held and handed on at once.
BATCH_BYTES = 1 << 20
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Source:
    """Text of nodes by byte offsets, without splitting the file again for each."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.starts = [0]
        for line in self.raw.split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def of(self, node: ast.AST) -> str:
        a = self.starts[node.lineno - 1] + node.col_offset
        return self.raw[a : self.starts[node.end_lineno - 1] + node.end_col_offset].decode()


def _calls(body: list[ast.stmt], source: _Source) -> list[dict]:
    """Call sites of a body, outer before inner, otherwise in source order."""
    out, stack = [], list(reversed(body))
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append({"callee_name": f.id, "receiver": None, "line": node.lineno})
            elif isinstance(f, ast.Attribute):
                out.append({"callee_name": f.attr, "receiver": source.of(f.value), "line": node.lineno})
        inner = sorted(ast.iter_child_nodes(node), key=lambda n: (getattr(n, "lineno", node.__dict__.get("lineno", 0)), getattr(n, "col_offset", 0)))
        stack.extend(reversed(inner))
    return out


def parse_module(path: str, content: bytes | str | None) -> dict:
    """Top-level symbols of one file; a file that can't be read has none, and says why in parse_error."""
    out = {"relative_path": path, "parse_error": None, "classes": [], "functions": [], "imports": []}
    try:
        text = content.removeprefix("\ufeff") if isinstance(content, str) else (content or b"").decode("utf-8-sig")
        text = text.replace("\r\n", "\n").replace("\r", "\n")  # the parser ends lines at all three
        return out | _symbols(path, ast.parse(text), _Source(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"parse_error": f"{type(e).__name__}: {e}"}


def _symbols(path: str, tree: ast.Module, source: _Source) -> dict:
    out = {"classes": [], "functions": [], "imports": []}

    def function(node, owner: dict | None) -> dict:
        name = f"{owner['name']}.{node.name}" if owner else node.name
        return {"id": f"{path}::{name}", "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "parent_id": owner and owner["id"], "is_method": bool(owner), "calls": _calls(node.body, source)}

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            bases = sorted([*node.bases, *node.keywords], key=lambda n: (n.lineno, n.col_offset))
            own = {"id": f"{path}::{node.name}", "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "base_classes": [source.of(b) for b in bases]}
            out["classes"].append(own)
            out["functions"] += [function(x, own) for x in node.body if isinstance(x, _DEF)]
        elif isinstance(node, _DEF):
            out["functions"].append(function(node, None))
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "level": 0, "imported_names": [], "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            names = [{"name": a.name, "alias": a.asname} for a in node.names]
            out["imports"].append({"module": node.module, "level": node.level, "imported_names": names, "line": node.lineno})
    for kind in ("classes", "functions"):  # of repeated definitions the last counts
        out[kind] = list({x["id"]: x for x in out[kind]}.values())
    return out


def parse_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Modules of (path, content), handed on before the next BATCH_BYTES of source are parsed."""
    rows, size = [], 0
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            source = content.as_py()
            rows.append(parse_module(path.as_py(), source))
            size += len(source or b"")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def parse(files: DataFrame) -> DataFrame:
    """One nested row for each of files (relative_path, content)."""
    schema = to_arrow_schema(StructType.fromDDL(MODULE))
    return files.select("relative_path", "content").mapInArrow(lambda batches: parse_batches(batches, schema), MODULE)


def parse_incremental(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached modules where path and content hash agree, all others parsed; both with content_hash."""
    key = ["relative_path", "content_hash"]
    reused = cache.join(files.select(*key), key, "left_semi")
    fresh = files.join(cache.select(*key), key, "left_anti")
    parsed = parse(fresh).join(fresh.select(*key), "relative_path")
    return reused.unionByName(parsed.select(reused.columns))


def classes(modules: DataFrame) -> DataFrame:
    return modules.select("relative_path", F.posexplode("classes").alias("pos", "c")).select("relative_path", "pos", F.col("c.id").alias("class_id"), "c.name", "c.start_line", "c.end_line", "c.base_classes")


def functions(modules: DataFrame) -> DataFrame:
    return modules.select("relative_path", F.posexplode("functions").alias("pos", "f")).select(
        "relative_path", "pos", F.col("f.id").alias("function_id"), "f.name", "f.start_line", "f.end_line", "f.parent_id", "f.is_method"
    )


def call_sites(modules: DataFrame) -> DataFrame:
    return modules.select(F.explode("functions").alias("f")).select(F.col("f.id").alias("caller_id"), F.posexplode("f.calls").alias("pos", "c")).select("caller_id", "pos", "c.callee_name", "c.receiver", "c.line")


def imports(modules: DataFrame) -> DataFrame:
    return modules.select(F.col("relative_path").alias("source_path"), F.posexplode("imports").alias("pos", "i")).select(
        "source_path", "pos", "i.module", "i.level", F.transform("i.imported_names", lambda n: n["name"]).alias("names"), "i.line"
    )
