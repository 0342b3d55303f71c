"""Scan of a source tree: names, contents and hashes by the executors, from any store that all reach."""

from __future__ import annotations

import datetime
import fnmatch
import functools
import itertools
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.sources import store

MAX_BYTES = 1 << 20
IGNORE_FILE = ".scanignore"
# What is never scanned, and the languages of names.
IGNORED_DIRECTORIES = (
    ".git", ".github", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".idea", ".vscode", "dist", "build", "target", "coverage", ".coverage", ".tox", ".cache",
)
IGNORED_PATTERNS = (
    "*.pyc", "*.pyo", "*.class", "*.o", "*.obj", "*.so", "*.dll", "*.exe", "*.bin", "*.log", "*.lock", "*.min.js",
    "*.min.css", "*.map",
)
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".mp3", ".wav", ".mp4", ".mov", ".zip", ".tar", ".gz", ".rar",
    ".7z", ".pdf", ".docx", ".xlsx",
)
LANGUAGES = {
    "python": [".py", ".pyi"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "java": [".java"],
    "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "go": [".go"], "rust": [".rs"], "csharp": [".cs"], "php": [".php"],
    "ruby": [".rb"], "kotlin": [".kt", ".kts"], "swift": [".swift"], "dart": [".dart"], "html": [".html", ".htm"], "css": [".css"],
    "scss": [".scss"], "sql": [".sql"], "json": [".json"], "yaml": [".yaml", ".yml"], "toml": [".toml"], "xml": [".xml"],
    "markdown": [".md", ".markdown"], "shell": [".sh", ".bash", ".zsh"],
}
SPECIAL_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake"}


def language(name: Column) -> Column:
    """Language of a file name: special names first, then the last extension in lower case; null if unknown."""
    by_extension = {e: lang for lang, es in LANGUAGES.items() for e in es}
    table = F.create_map(*[F.lit(x) for pair in by_extension.items() for x in pair])
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(special, name), F.try_element_at(table, F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))))


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a root, which is a local path or a URI (file, hdfs, s3, gs)."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def ignore_rules(root: str) -> tuple[list[str], list[str]]:
    """Directories and file patterns that the tree's own ignore file adds; one that can't be read adds none."""
    files, top = _store(root)
    try:
        with files.open_input_stream(f"{top}/{IGNORE_FILE}") as f:
            rules = [line.strip() for line in f.read().decode().splitlines()]
    except (OSError, UnicodeDecodeError):
        return [], []
    rules = [r for r in rules if r and not r.startswith("#")]
    return [r.rstrip("/") for r in rules if r.endswith("/")], [r for r in rules if not r.endswith("/")]


#: Names and bytes that a worker hands on at once.
NAMES, HELD_BYTES = 4096, 8 << 20


def _listed(root: str, folder: str, ignored: set[str]) -> Iterator[tuple[str, str]]:
    """(relative path, file | pruned | folder) of what is in one folder; a link to a folder, which may lead back, or to nothing is left out."""
    if "://" in root:
        files, top = _store(root)
        for info in files.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)):
            is_folder = info.type is fs.FileType.Directory
            yield info.path[len(top) + 1 :], "file" if not is_folder else "pruned" if info.base_name in ignored else "folder"
        return
    try:
        entries = os.scandir(os.path.join(os.path.abspath(root), folder))
    except FileNotFoundError:
        return
    with entries:
        for e in entries:
            kind = "file" if not e.is_dir() else "pruned" if e.name in ignored else None if e.is_symlink() else "folder"
            if kind and not (kind == "file" and e.is_symlink() and not os.path.exists(e.path)):
                yield f"{folder}/{e.name}" if folder else e.name, kind


def _walk(spark: SparkSession, root: str, ignored: set[str]) -> DataFrame:
    """relative_path, kind (file | pruned) of the tree, listed by the executors a level at a time; the driver holds no name.

    Ignored directories are not entered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder in pdf["relative_path"]:
                found = _listed(root, folder, ignored)
                while some := list(itertools.islice(found, NAMES)):
                    yield pd.DataFrame(some, columns=["relative_path", "kind"])

    schema = "relative_path string, kind string"
    level, levels = spark.createDataFrame([("",)], "relative_path string"), []
    while True:
        levels.append(store.settle(level.mapInPandas(run, schema)))
        folders = levels[-1].where("kind = 'folder'").select("relative_path")
        if folders.isEmpty():
            break
        level = folders.repartition(store.parts(spark))
    return functools.reduce(DataFrame.union, levels).where("kind <> 'folder'")


def scan(spark: SparkSession, root: str, repo_id: int = 0) -> DataFrame:
    """Every listed file with its disposition (ignored, binary, large, error, kept), in walk order by file_ord.

    repo_id, relative_path, file_ord, language, content_hash, size_bytes, last_modified, content, disposition. Ignored
    directories are not entered; each is one row with disposition ignored_dir. Executors list names and read contents, of
    files up to MAX_BYTES only, from the same store; a content is moved by no shuffle. A file that can't be read is
    an error. Names are tested first. (Spark's own file sources leave out names that begin with _ or a dot.)
    """
    root = root if "://" in root else os.path.abspath(root)  # as the driver sees it
    dirs, patterns = ignore_rules(root)
    table = _walk(spark, root, {*IGNORED_DIRECTORIES, *dirs}).repartition(store.parts(spark), "relative_path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = _store(root)
        columns = ["relative_path", "early", "size_bytes", "last_modified", "content"]
        for pdf in batches:
            out, held = [], 0
            for p, early in zip(pdf["relative_path"], pdf["early"].astype(object).where(pdf["early"].notna(), None), strict=True):
                size = stamp = content = None
                try:
                    if early is None:
                        info = files.get_file_info(f"{top}/{p}")
                        size, stamp = info.size, info.mtime.astimezone(datetime.UTC).isoformat() if info.mtime else None
                        if size is not None and size <= MAX_BYTES:
                            with files.open_input_stream(f"{top}/{p}") as f:
                                content = f.read()
                except OSError:
                    content = None
                out.append((p, early, size, stamp, content))
                held += len(content or b"")
                if held >= HELD_BYTES:
                    yield pd.DataFrame(out, columns=columns).astype({"size_bytes": "Int64"})
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns).astype({"size_bytes": "Int64"})

    base = F.element_at(F.split("relative_path", "/"), -1)
    globs = "|".join(fnmatch.translate(p).replace(r"\z", r"\Z") for p in (*IGNORED_PATTERNS, *patterns))
    binary = F.lower(F.regexp_extract(base, r".(\.[^.]*)$", 1)).isin(*BINARY_EXTENSIONS)
    early = table.withColumn("early", F.when(F.col("kind") == "pruned", "ignored_dir").when(base.rlike(globs), "ignored").when(binary, "binary"))
    got = early.select("relative_path", "early").mapInPandas(read, "relative_path string, early string, size_bytes long, last_modified string, content binary")
    late = F.when(F.col("size_bytes") > MAX_BYTES, "large").when(F.col("content").isNull(), "error").otherwise("kept")
    parts = F.split("relative_path", "/")
    order = F.concat(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.concat(F.lit("1"), d)), F.array(F.concat(F.lit("0"), F.element_at(parts, -1))))
    return got.select(
        F.lit(repo_id).cast("long").alias("repo_id"), "relative_path", order.alias("file_ord"), language(base).alias("language"), F.sha2("content", 256).alias("content_hash"),
        "size_bytes", "last_modified", "content", F.coalesce("early", late).alias("disposition"),
    )


def kept(scanned: DataFrame) -> DataFrame:
    return scanned.where("disposition = 'kept'").drop("disposition")


def scan_summary(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("disposition").agg(F.count("*").alias("n"))


