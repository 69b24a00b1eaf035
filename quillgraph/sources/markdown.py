"""A directory of Markdown files as parsed notes.

Paths are listed on the driver (a listing, not the contents), so hidden and underscored names count like any
other; contents are read and parsed on the executors.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import markdown as md
from quillgraph.functions.text import checksum, first_bytes, namespace_of, resolved_link

#: Fixed value: bytes of the stripped text that a note keeps as its body.
BODY_BYTES = 2000
IGNORE_FILE = ".quillgraphignore"


def ignore_patterns(path: str) -> list[str]:
    """Lines that are neither blank nor comments; a missing file has none."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = [x.strip() for x in f]
    except OSError:
        return []
    return [x for x in lines if x and not x.startswith("#")]


def glob_regex(pattern: str) -> str:
    """One level only: * and ? don't cross slashes."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := pattern.find("]", i + 2)) > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(ch)
        i += 1
    return out


def excluded(path: str, patterns: list[str]) -> bool:
    """Whether a pattern fits the whole relative path or one of its parts."""
    parts = [path, *path.split("/")]
    return any(re.fullmatch(glob_regex(p.removesuffix("/")), x) for p in patterns for x in parts)


def excluded_column(path: Column, patterns: list[str]) -> Column:
    """The same as a column, for paths that are data."""
    out = F.lit(False)
    for p in patterns:
        form = f"^(?:{glob_regex(p.removesuffix('/'))})$"
        out = out | path.rlike(form) | F.exists(F.split(path, "/"), _fits(form))
    return out


def _fits(form: str) -> Callable[[Column], Column]:
    return lambda part: part.rlike(form)


def markdown_files(root: str, exclude: list[str]) -> list[str]:
    """Relative paths of all .md files below root that no pattern excludes."""
    patterns = list(dict.fromkeys([*exclude, *ignore_patterns(os.path.join(root, IGNORE_FILE))]))
    out = []

    def fail(error: OSError) -> None:
        raise error

    for folder, folders, names in os.walk(root, onerror=fail):
        folders.sort()
        for name in sorted(names):
            rel = posixpath.relpath(os.path.join(folder, name).replace(os.sep, "/"), root.replace(os.sep, "/"))
            if name.endswith(".md") and not excluded(rel, patterns):
                out.append(rel)
    return out


def _contents(root: str):
    def rows(batches):
        import pandas as pd

        for pdf in batches:
            found = []
            for rel in pdf["path"]:
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        found.append((rel, f.read()))
                except OSError:
                    continue  # unreadable: visited, not parsed
            yield pd.DataFrame(found, columns=["path", "raw"])

    return rows


def read_markdown(spark: SparkSession, root: str, exclude: list[str] = (), namespaces: dict[str, list[str]] | None = None, default_namespace: str = "", now: int = 0) -> tuple[DataFrame, DataFrame]:
    """(parsed notes with full_body, visited paths) of a directory that executors see as well."""
    paths = markdown_files(root, list(exclude))
    visited = spark.createDataFrame([(p,) for p in paths], "path string")
    raw = visited.repartition(max(1, min(len(paths) // 64, 4 * spark.sparkContext.defaultParallelism) or 1)).mapInPandas(_contents(root), "path string, raw binary")
    return parse_notes(raw, namespaces or {}, default_namespace, now), visited


def parse_notes(raw: DataFrame, namespaces: dict[str, list[str]] | None = None, default_namespace: str = "", now: int = 0, resolver: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, raw bytes) to notes with full_body, in column expressions alone."""
    rows = raw.select("path", "raw", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"))
    rows = rows.withColumn("full_body", md.strip_markdown(md.body_of(F.col("content"))))
    namespace = resolver(F.col("path")) if resolver else namespace_of(F.col("path"), namespaces or {}, default_namespace)
    return rows.select(
        "path",
        namespace.alias("namespace"),
        md.title_of(F.col("content"), F.col("path")).alias("title"),
        first_bytes(F.col("full_body"), BODY_BYTES).alias("body"),
        md.tags_of(F.col("content")).alias("tags"),
        F.transform(md.links_of(F.col("content")), lambda x: resolved_link(F.col("path"), x)).alias("links_out"),
        checksum(F.col("raw")).alias("checksum"),
        md.last_verified(F.col("content")).alias("last_verified"),
        F.lit(now).cast("long").alias("last_indexed"),
        F.lit(None).cast("long").alias("consolidated_at"),
        "full_body",
    )
