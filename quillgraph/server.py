"""A small HTTP server over a snapshot: /api/graph?ns=, /api/namespaces, /api/search?q= and a page.

Answers are whole JSON documents, so the graph export is meant for vaults, not for clusters' tables.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from quillgraph import report
from quillgraph.model import SearchOptions
from quillgraph.operators import graph, search
from quillgraph.sources.store import Store

PAGE = """<!doctype html><meta charset="utf-8"><title>quillgraph</title>
<input id="q" placeholder="search"><ul id="r"></ul><script>
let t; q.oninput = () => { clearTimeout(t); t = setTimeout(async () => {
  const rows = await (await fetch('/api/search?q=' + encodeURIComponent(q.value))).json();
  r.replaceChildren(...rows.map(x => Object.assign(document.createElement('li'), {textContent: x.Path + ' ' + x.Score.toFixed(4)})));
}, 250) }</script>"""


def graph_data(store: Store, namespace: str = "") -> dict:
    notes = store.read("notes")
    nodes = [r.asDict() for r in graph.graph_nodes(notes, namespace or None).collect()]
    links = [r.asDict() for r in graph.graph_edges(notes, namespace or None).collect()]
    return {"nodes": nodes, "links": links}


def namespaces(store: Store) -> list[str]:
    return [r["namespace"] for r in store.read("notes").select("namespace").distinct().orderBy("namespace").collect()]


def found(store: Store, text: str) -> str:
    if not text:
        return "[]"
    return report.results_json(search.search(store.read("notes"), store.read("chunks"), text, SearchOptions(top=20), index=store.text_index()).collect())


def handler(store: Store) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            kind = "application/json"
            if url.path == "/api/graph":
                body = json.dumps(graph_data(store, asked.get("ns", "")))
            elif url.path == "/api/namespaces":
                body = json.dumps(namespaces(store))
            elif url.path == "/api/search":
                body = found(store, asked.get("q", ""))
            else:
                body, kind = PAGE, "text/html; charset=utf-8"
            data = body.encode()
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(store: Store, port: int) -> None:
    print(f"http://localhost:{port}")
    ThreadingHTTPServer(("localhost", port), handler(store)).serve_forever()
