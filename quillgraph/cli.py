"""Command line: init index query graph similar cluster lint mark unmark stats serve version."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime

from quillgraph import config, report
from quillgraph.functions.text import readable_size
from quillgraph.model import SearchOptions

VERSION = "0.1.0"


def seconds_of(day: str | None, plus: int = 0) -> int | None:
    """Midnight UTC of YYYY-MM-DD; anything else is ignored."""
    try:
        return int(datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=UTC).timestamp()) + plus if day else None
    except ValueError:
        return None


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillgraph").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quillgraph")
    p.add_argument("--dir", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("stats")
    sub.add_parser("init").add_argument("folder", nargs="?", default=".")
    c = sub.add_parser("index")
    c.add_argument("folder", nargs="?")
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("--ns", default="")
    c = sub.add_parser("query")
    c.add_argument("text", nargs="+")
    c.add_argument("--ctx", default="")
    c.add_argument("--top", type=int, default=0)
    c.add_argument("--format", choices=("table", "json", "paths"))
    c.add_argument("--ns", action="append", default=[])
    c.add_argument("--hops", type=int, default=0)
    c.add_argument("--after")
    c.add_argument("--before")
    c.add_argument("--skip-consolidated", action="store_true")
    sub.add_parser("graph").add_argument("file")
    c = sub.add_parser("similar")
    c.add_argument("text", nargs="+")
    c.add_argument("--against", default="")
    c.add_argument("--top", type=int, default=5)
    c.add_argument("--threshold", type=float, default=0.0)
    c.add_argument("--ns", action="append", default=[])
    c = sub.add_parser("cluster")
    c.add_argument("folder", nargs="?", default="")
    c.add_argument("--topics", type=int, default=5)
    c.add_argument("--ns", action="append", default=[])
    c.add_argument("--prefix", default="")
    c = sub.add_parser("lint")
    c.add_argument("--stale-days", type=int, default=90)
    c.add_argument("--ns", action="append", default=[])
    c.add_argument("--json", action="store_true")
    c.add_argument("--exclude", action="append", default=[])
    for name in ("mark", "unmark"):
        sub.add_parser(name).add_argument("paths", nargs="+")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=7331)
    return p


def relative(path: str, root: str) -> str:
    return os.path.relpath(path, root).replace(os.sep, "/") if os.path.isabs(path) else path.removeprefix("./")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(f"quillgraph {VERSION}")
        return 0
    if a.command == "init":
        try:
            print(f"created {config.scaffold(a.folder)}")
        except FileExistsError as e:
            print(f"already configured: {e.filename}", file=sys.stderr)
            return 1
        return 0
    from quillgraph.operators import cluster, graph, search
    from quillgraph.sources import embedders, markdown
    from quillgraph.sources.store import Store

    workspace = config.load_or_default(a.dir)
    spark = session()
    store = Store(spark, os.path.join(workspace.root, config.FOLDER, "index"))
    embedder = embedders.chosen(workspace.config.embed.provider, workspace.config.embed.api_key, workspace.config.embed.base_url)
    if a.command == "index":
        began, now = time.time(), int(time.time())
        parsed, visited = markdown.read_markdown(spark, a.folder or workspace.root, list(workspace.config.exclude), workspace.config.namespaces, a.ns, now)
        done = store.index(parsed, embedder, visited)
        if a.verbose and done.removed:
            print(f"removed {done.removed}")
        print(f"Indexed {done.total} files ({done.updated} updated) in {time.time() - began:.2f}s")
        return 0
    if not store.exists():
        print("no index here; run: quillgraph index", file=sys.stderr)
        return 1
    notes, chunks = store.read("notes"), store.read("chunks")

    def vectors_for(text: str) -> dict:
        """The query's vector, if there is an embedder that answers."""
        if embedder is None:
            return {}
        try:
            return {"query_vector": tuple(embedder.embed([text])[0])}
        except OSError:
            return {}

    if a.command == "query":
        text = " ".join(a.text)
        options = SearchOptions(a.top or workspace.config.top_n, config.context_prefix(workspace, a.ctx) if a.ctx else "", tuple(a.ns), a.hops, seconds_of(a.after), seconds_of(a.before, 86400), a.skip_consolidated, **vectors_for(text))
        rows = search.search(notes, chunks, text, options, store.read("vectors") if embedder else None, store.text_index()).collect()
        form = a.format or workspace.config.format
        print({"json": report.results_json, "paths": report.paths}.get(form, report.table)(rows))
    elif a.command == "similar":
        text = " ".join(a.text)
        options = SearchOptions(a.top, a.against, tuple(a.ns), **vectors_for(text))
        rows = search.similar(notes, chunks, text, options, a.threshold, store.read("vectors") if embedder else None, store.text_index()).collect()
        print(report.similar_table(rows) if rows else f"No results above threshold {a.threshold:.2f}")
    elif a.command == "graph":
        path = relative(a.file, workspace.root)
        out = [r["dst"] for r in graph.out_links(notes, path).collect()]
        print(report.neighbours(path, out, [r["path"] for r in graph.backlinks(notes, path).collect()]))
    elif a.command == "cluster":
        found = cluster.clusters(notes, a.topics, store.read("vectors") if embedder else None, chunks, a.prefix or a.folder, tuple(a.ns))
        print(report.clusters_text(report.cluster_lists(found)))
    elif a.command == "lint":
        status = graph.lint(notes, int(time.time()), a.stale_days, tuple(a.ns), tuple(a.exclude)).cache()
        found = report.lint_report(status, graph.lint_summary(status).first().asDict())
        print(json.dumps(found, indent=2) if a.json else report.lint_text(found, a.stale_days))
    elif a.command in ("mark", "unmark"):
        n = store.mark([relative(p, workspace.root) for p in a.paths], int(time.time()) if a.command == "mark" else None)
        print(f"{a.command}ed {n} files")
    elif a.command == "stats":
        s = store.stats()
        when = datetime.fromtimestamp(s["modified_ms"] / 1000).strftime("%Y-%m-%d %H:%M:%S")
        print(f"  Files indexed:  {s['files']}\n  Index size:     {readable_size(s['bytes'])}\n  Index path:     {s['path']}\n  Last modified:  {when}")
    elif a.command == "serve":
        from quillgraph.server import serve

        serve(store, a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
