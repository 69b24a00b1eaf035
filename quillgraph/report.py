"""Text and JSON of results. Everything here formats rows that are already cut to a few."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_WIDTH, TAG_WIDTH, REASON_WIDTH = 50, 30, 30


def _cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 3] + "..."


def _cut_left(text: str, width: int) -> str:
    return text if len(text) <= width else "..." + text[3 - width :]


def table(rows: list) -> str:
    tags = [", ".join(r["tags"] or []) for r in rows]
    path_width = min(PATH_WIDTH, max([4, *(len(r["path"]) for r in rows)]))
    tag_width = min(TAG_WIDTH, max([4, *map(len, tags)]))
    head = f"{'Path':<{path_width}}  {'Score':<7}  {'Tags':<{tag_width}}  {'Reason':<{REASON_WIDTH}}"
    lines = [head, "-" * len(head)]
    for r, t in zip(rows, tags, strict=True):
        lines.append(f"{_cut_left(r['path'], path_width):<{path_width}}  {r['score']:<7.4f}  {_cut(t, tag_width):<{tag_width}}  {_cut(r['reason'], REASON_WIDTH):<{REASON_WIDTH}}")
    return "\n".join(lines)


def results_json(rows: list) -> str:
    names = (("Path", "path"), ("Title", "title"), ("Score", "score"), ("Tags", "tags"), ("LastVerified", "last_verified"), ("Reason", "reason"))
    return json.dumps([{k: r[c] for k, c in names} for r in rows], indent=2, ensure_ascii=False)


def paths(rows: list) -> str:
    return "\n".join(r["path"] for r in rows)


def similar_table(rows: list) -> str:
    lines = [f"{'Path':<{PATH_WIDTH}}  {'Similarity':<10}  Confidence", "-" * (PATH_WIDTH + 24)]
    return "\n".join(lines + [f"{_cut_left(r['path'], PATH_WIDTH):<{PATH_WIDTH}}  {r['similarity'] * 100:<9.1f}%  {r['label']}" for r in rows])


def neighbours(path: str, out: list[str], back: list[str]) -> str:
    def part(name: str, arrow: str, items: list[str]) -> list[str]:
        return [f"{name} ({len(items)}):", *([f"  {arrow} {x}" for x in items] or ["  (none)"])]

    return "\n".join([f"graph: {path}", "", *part("Outbound links", "→", out), "", *part("Backlinks", "←", back)])


def cluster_lists(placed: DataFrame, shown: int = 8) -> list[tuple[str, int, list[str]]]:
    """(label, size, first paths) of each cluster, misc last: the lists are cut on the executors."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("path")
    sizes = placed.groupBy("label").agg(F.count("*").alias("n"))
    first = placed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= shown).groupBy("label").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    rows = sizes.join(first, "label").collect()
    return [(r["label"], r["n"], r["paths"]) for r in sorted(rows, key=lambda r: (r["label"] == "misc", -r["n"], r["label"]))]


def clusters_text(found: list[tuple[str, int, list[str]]]) -> str:
    lines = [f"Clusters ({len(found)} groups)", ""]
    for i, (label, n, shown) in enumerate(found, 1):
        lines += [f"{i}. [{label}] ({n} files)", *(f"   {p}" for p in shown), *([f"   … and {n - len(shown)} more"] if n > len(shown) else []), ""]
    return "\n".join(lines)


def lint_report(status: DataFrame, summary: dict) -> dict:
    """The lint result as one value; lists hold the paths of each condition."""
    bad = status.filter("orphan or no_backlink or stale").collect()
    pick = lambda c: sorted(r["path"] for r in bad if r[c]) or None
    stale = sorted((r for r in bad if r["stale"]), key=lambda r: (-r["days_ago"], r["path"]))
    return {"total": summary["total"], "orphaned": pick("orphan"), "no_backlink": pick("no_backlink"), "stale": [{"path": r["path"], "days_ago": r["days_ago"]} for r in stale] or None, "healthy": summary["healthy"]}


def lint_text(report: dict, stale_days: int) -> str:
    out = [f"lint — {report['total']} files", ""]
    for name, key in (("Orphaned", "orphaned"), ("No backlinks", "no_backlink")):
        items = report[key] or []
        out += [f"{name} ({len(items)})" if items else f"{name}: none", *(f"   → {p}" for p in items), ""]
    stale = report["stale"] or []
    out += [f"Stale ({len(stale)}) — {stale_days}+ days" if stale else f"Stale: none (threshold: {stale_days} days)", *(f"   → {s['path']} ({s['days_ago']} days ago)" for s in stale), ""]
    share = report["healthy"] * 100 // report["total"] if report["total"] else 0
    return "\n".join([*out, f"Summary: {report['healthy']}/{report['total']} files healthy ({share}%)"])
