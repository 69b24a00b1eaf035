"""The link graph: edges, neighbours, expansion, export, degrees, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.functions.text import days_ago, path_group

_NO_LINKS = "cast(array() as array<string>)"


def edges(notes: DataFrame) -> DataFrame:
    """(src, pos, dst), dangling targets included."""
    return notes.select(F.col("path").alias("src"), F.posexplode(F.coalesce("links_out", F.expr(_NO_LINKS))).alias("pos", "dst"))


def out_links(notes: DataFrame, path: str) -> DataFrame:
    return edges(notes.filter(F.col("path") == path)).select("pos", "dst").orderBy("pos")


def backlinks(notes: DataFrame, path: str, mode: str = "exact") -> DataFrame:
    """Paths of other notes that link to `path`; `substring` also takes targets that contain it."""
    if mode == "exact":
        hit = F.array_contains("links_out", path)
    elif mode == "substring":
        low = path.lower()
        hit = F.exists("links_out", lambda x: F.lower(x).contains(low))
    else:
        raise ValueError(mode)
    return notes.filter(F.coalesce(hit, F.lit(False)) & (F.col("path") != path)).select("path").distinct().orderBy("path")


def degrees(notes: DataFrame) -> DataFrame:
    """(path, out_degree, in_degree); duplicates and self-links count. In-degrees are summed before they
    move, so a note that everything links to costs one row a task."""
    incoming = edges(notes).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    own = notes.select("path", F.size(F.coalesce("links_out", F.expr(_NO_LINKS))).alias("out_degree"))
    return own.join(incoming, "path", "left").select("path", "out_degree", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def graph_nodes(notes: DataFrame, namespace: str | None = None) -> DataFrame:
    rows = notes if namespace is None else notes.filter(F.col("namespace") == namespace)
    return rows.select(F.col("path").alias("id"), "title", "tags", path_group(F.col("path")).alias("group"), "namespace", F.size(F.coalesce("links_out", F.expr(_NO_LINKS))).alias("links"))


def graph_edges(notes: DataFrame, namespace: str | None = None) -> DataFrame:
    """Edges between notes of the export; dangling ones go."""
    rows = notes if namespace is None else notes.filter(F.col("namespace") == namespace)
    known = rows.select(F.col("path").alias("dst"))
    return edges(rows).join(known, "dst", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("target"))


def neighbourhood(notes: DataFrame, path: str) -> DataFrame:
    """Edges at either end of a note."""
    return edges(notes).filter((F.col("src") == path) | (F.col("dst") == path)).select("src", "dst")


def expand(notes: DataFrame, found: DataFrame, hops: int, namespaces: tuple[str, ...] = ()) -> DataFrame:
    """k-hop expansion of `found` (path, base): rows (path, base, graph, hop) that links reach and `found`
    lacks. At hop h (from 0) a node takes base * 0.5**(h + 1) of its best parent; with
    namespaces, targets must be notes of one of them.

    A small frontier meets the edges by a join each hop; visited paths leave by an anti join.
    """
    all_edges = edges(notes).select("src", "dst")
    known = notes.filter(F.col("namespace").isin(list(namespaces))).select(F.col("path").alias("dst")) if namespaces else None
    frontier, visited, out = found.select("path", "base"), found.select("path"), None
    for hop in range(hops):
        reached = frontier.join(all_edges, F.col("path") == F.col("src")).select(F.col("dst"), (F.col("base") * 0.5 ** (hop + 1)).alias("base"))
        if known is not None:
            reached = reached.join(known, "dst", "left_semi")
        new = reached.join(visited, F.col("dst") == F.col("path"), "left_anti").groupBy(F.col("dst").alias("path")).agg(F.max("base").alias("base")).persist()
        rows = new.select("path", "base", F.lit(model.LINK_HIT).alias("graph"), F.lit(hop + 1).alias("hop"))
        out = rows if out is None else out.unionByName(rows)
        frontier, visited = new, visited.unionByName(new.select("path"))
    return out


# ------------------------------------------------------------------ lint


def lint(notes: DataFrame, now: int, stale_days: int = 90, namespaces: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, orphan, no_backlink, stale, days_ago) of every note that the filters leave; notes that they
    drop give no backlinks either."""
    rows = notes
    if namespaces:
        rows = rows.filter(F.col("namespace").isin(list(namespaces)))
    for prefix in exclude:
        rows = rows.filter(~F.col("path").startswith(prefix))
    degree = degrees(rows)
    age = rows.select("path", F.lit(now) - F.col("last_indexed") > stale_days * 86400, days_ago(now, F.col("last_indexed")).alias("days_ago")).toDF("path", "stale", "days_ago")
    joined = degree.join(age, "path")
    lonely: Column = F.col("in_degree") == 0
    return joined.select("path", ((F.col("out_degree") == 0) & lonely).alias("orphan"), ((F.col("out_degree") > 0) & lonely).alias("no_backlink"), "stale", "days_ago")


def lint_summary(status: DataFrame) -> DataFrame:
    one = lambda c: F.count(F.when(c, 1))
    bad = F.col("orphan") | F.col("no_backlink") | F.col("stale")
    return status.agg(F.count("*").alias("total"), one(F.col("orphan")).alias("orphans"), one(F.col("no_backlink")).alias("no_backlinks"), one(F.col("stale")).alias("stale"), one(~bad).alias("healthy"))

