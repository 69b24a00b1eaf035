"""DuckDB SQL for the registered queries' rows."""

from __future__ import annotations

NOTES = """
base AS (
  SELECT d.doc_id, d.lang || '/' || d.source || '/doc-' || d.doc_id || '.md' AS path, d.lang AS namespace,
         'Doc ' || d.doc_id AS title, d.text AS body, l.quality, l.toxic, sha256(d.text) AS checksum,
         list_filter([d.lang, d.source, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END,
                      CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags,
         1704067200 + 3600 * d.doc_id AS last_indexed,
         CASE WHEN d.doc_id % 5 = 0 THEN 1704067200 + 3600 * d.doc_id END AS consolidated_at
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""
LINKS = """
total AS (SELECT count(*) AS n FROM documents),
links AS (
  SELECT s.path AS src, 0 AS pos, t.path AS dst FROM base s, total, base t WHERE s.doc_id % 10 <> 0 AND t.doc_id = (7 * s.doc_id + 1) % total.n
  UNION ALL
  SELECT s.path, 1, t.path FROM base s, total, base t WHERE s.doc_id % 10 <> 0 AND t.doc_id = (13 * s.doc_id + 5) % total.n
  UNION ALL
  SELECT s.path, 2, 'missing/doc-' || s.doc_id || '.md' FROM base s WHERE s.doc_id % 10 <> 0 AND s.doc_id % 11 = 0)
"""
TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"

CHUNKS = r"""
pars AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM documents),
tidy AS (SELECT doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM pars),
parts AS (SELECT doc_id, i, CASE WHEN (strlen(p) + 3) // 4 <= 512 THEN [p]
            ELSE list_transform(string_split(regexp_replace(p, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) END AS u FROM tidy),
units AS (SELECT doc_id, list_filter(flatten(list(u ORDER BY i)), lambda x: x <> '') AS u FROM parts GROUP BY doc_id),
sized AS (SELECT doc_id, u, len(u) AS n, list_transform(range(len(u) + 1), lambda k: coalesce(list_sum(list_transform(u[1:k], lambda x: strlen(x))), 0)::BIGINT) AS c FROM units),
steps AS (SELECT doc_id, s, greatest(s + 1, list_max(list_filter(range(s + 1, n + 1), lambda e: (c[e + 1] - c[s + 1] + e - s - 1 + 3) // 4 <= 512 OR e = s + 1))) AS e FROM (SELECT *, unnest(range(n)) AS s FROM sized)),
jumps AS (SELECT doc_id, s, e, list_max(list_filter(range(s, e), lambda b: b = s OR list_sum(list_transform(range(b, e), lambda k: (strlen(u[k + 1]) + 3) // 4)) >= 64)) AS back FROM steps JOIN sized USING (doc_id)),
walk AS (SELECT doc_id, 0::BIGINT AS s, 0 AS idx FROM sized WHERE n > 0
         UNION ALL
         SELECT j.doc_id, CASE WHEN j.back > j.s THEN j.back ELSE j.e END, w.idx + 1
         FROM walk w JOIN jumps j ON j.doc_id = w.doc_id AND j.s = w.s
         JOIN sized z ON z.doc_id = w.doc_id WHERE CASE WHEN j.back > j.s THEN j.back ELSE j.e END < z.n),
chunks AS (SELECT d.lang || '/' || d.source || '/doc-' || d.doc_id || '.md' AS path, d.lang AS namespace, w.idx AS chunk_index,
             array_to_string(z.u[w.s + 1:j.e], ' ') AS content
           FROM walk w JOIN jumps j ON j.doc_id = w.doc_id AND j.s = w.s JOIN sized z ON z.doc_id = w.doc_id JOIN documents d ON d.doc_id = w.doc_id)
"""


def bm25(rows: str, key: str, texts: list[str], phrases: list[tuple], holds: str) -> str:
    """CTEs that end in bm(key, bm25). phrases: (tokens, last is a prefix, numbers of the texts or none for all);
    holds: a condition over tf0, tf1 ..."""
    tokens = " , ".join(f"{TOKENS.format(t)} AS t{i}" for i, t in enumerate(texts))
    size = " + ".join(f"len(t{i})" for i in range(len(texts)))

    def tf(words: list[str], prefix: bool, where: tuple[int, ...] | None = None) -> str:
        def one(i: int) -> str:
            tests = " AND ".join((f"starts_with(t{i}[p + {k}], '{w}')" if prefix and k == len(words) - 1 else f"t{i}[p + {k}] = '{w}'") for k, w in enumerate(words))
            return f"len(list_filter(range(1, len(t{i}) + 2 - {len(words)}), lambda p: {tests}))"

        return " + ".join(one(i) for i in where or range(len(texts)))

    n = range(len(phrases))
    score = " + ".join(f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{k} + 0.5) / (df{k} + 0.5)) END * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * size / avg))" for k in n)
    return f"""
tok AS (SELECT {key}, {tokens} FROM {rows}),
tfs AS (SELECT {key}, {size} AS size, {", ".join(f"{tf(*p)} AS tf{k}" for k, p in enumerate(phrases))} FROM tok),
num AS (SELECT count(*) AS n, avg(size) AS avg, {", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in n)} FROM tfs),
bm AS (SELECT {key}, {score} AS bm25 FROM tfs, num WHERE {holds})
"""


_TERM = [(["license"], False)]
_PHRASE = [(["mit", "license"], False)]
_BOOLEAN = [(["licens"], True), (["public", "license"], False), (["apache"], False), (["mit"], False)]
_BOTH = ["title", "body"]

_CAND = bm25("chunks", "path, namespace, chunk_index", ["content"], _TERM, "tf0 > 0")
_TOP = _CAND + ", cand AS (SELECT path || '#' || chunk_index AS chunk_id, path, bm25 FROM bm {where} ORDER BY bm25 DESC, chunk_id LIMIT 20)"
_FOUND = """,
sides AS (SELECT chunk_id, path, (bm25 / max(bm25) OVER ())::FLOAT AS b FROM cand),
found AS (SELECT path, max(b)::DOUBLE AS bm25, 0.0::DOUBLE AS vector FROM sides WHERE b >= 0.1::FLOAT GROUP BY path)"""
_HYBRID = """,
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vec AS (SELECT d.path || '#0' AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], qv.q)::FLOAT AS s FROM embeddings e JOIN base d ON d.doc_id = e.vec_id, qv),
vcand AS (SELECT * FROM vec ORDER BY s DESC, chunk_id LIMIT 20),
tside AS (SELECT chunk_id, (bm25 / max(bm25) OVER ())::FLOAT AS b FROM cand),
fuse AS (SELECT coalesce(t.chunk_id, v.chunk_id) AS chunk_id, coalesce(b, 0)::FLOAT AS b, coalesce(s, 0)::FLOAT AS s FROM tside t FULL JOIN vcand v ON t.chunk_id = v.chunk_id),
found AS (SELECT c.path, max(b)::DOUBLE AS bm25, max(s)::DOUBLE AS vector FROM fuse f JOIN chunks c ON c.path || '#' || c.chunk_index = f.chunk_id
          WHERE 0.6::FLOAT * s + 0.4::FLOAT * b >= 0.1::FLOAT GROUP BY c.path)"""
_BLEND = """,
signals AS (SELECT f.*, b.title, 3.0 * (contains(lower(f.path), 'license'))::INT AS filename, 2.0 * list_contains(b.tags, 'license')::INT AS tag FROM found f LEFT JOIN base b USING (path)),
best AS (SELECT path FROM signals ORDER BY bm25 + filename + vector DESC, path LIMIT 3),
boost AS (SELECT dst AS path, 0.5 * count(*) AS graph FROM links WHERE src IN (SELECT path FROM best) AND dst IN (SELECT path FROM signals) GROUP BY dst),
first AS (SELECT s.path, title, bm25, vector, filename, tag, coalesce(graph, 0)::DOUBLE AS graph FROM signals s LEFT JOIN boost USING (path))"""
_SCORED = """,
scored AS (SELECT *, CASE WHEN vector > 0 THEN 0.6 * vector + 0.4 * (0.4 * filename + 0.5 * bm25 + 0.1 * graph + tag)
                     ELSE 0.4 * filename + 0.5 * bm25 + 0.1 * graph + tag END AS score FROM {rows}),
result AS (SELECT * FROM scored ORDER BY score DESC, path LIMIT {limit})"""
_SIGNALS = """
SELECT path, coalesce(title, '') AS title, round(score, 5) AS score, round(bm25, 5) AS bm25, round(vector, 5) AS vector,
       filename::DOUBLE AS filename, tag::DOUBLE AS tag, graph FROM result"""


def _hops(start: str, hops: int, known: str = "") -> str:
    """CTEs hop1, hop2 ... of (path, base, graph, hop) from `start` (path, base)."""
    out, seen = "", f"SELECT path FROM {start}"
    for h in range(1, hops + 1):
        source = start if h == 1 else f"hop{h - 1}"
        out += f""",
hop{h} AS (SELECT l.dst AS path, max(f.base) * {0.5**h} AS base, 0.5 AS graph, {h} AS hop FROM {source} f JOIN links l ON l.src = f.path
           WHERE l.dst NOT IN ({seen}) {known} GROUP BY l.dst)"""
        seen += f" UNION ALL SELECT path FROM hop{h}"
    return out


_FORMS = r"""
SELECT page_id, array_to_string(list_distinct_ordered, '|') AS links FROM (
  SELECT page_id, list_filter(all_links, lambda x, i: x <> '' AND list_position(all_links, x) = i) AS list_distinct_ordered FROM (
    SELECT page_id, list_transform(list_filter(list_transform(
             regexp_extract_all(regexp_replace(html, '<a href="/?([^"]*)">([^<]*)</a>', '[\2](\1/index.md)', 'g'), '\[(?:[^\]]*)\]\(([^)]+)\)', 1),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
             lambda x: NOT (starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, '/'))),
             lambda x: string_split(x, '#')[1]) AS all_links FROM pages))
"""

_STATUS = """
deg AS (SELECT b.path, b.last_indexed, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree
        FROM kept b LEFT JOIN (SELECT src, count(*) AS n FROM links WHERE src IN (SELECT path FROM kept) GROUP BY src) o ON o.src = b.path
        LEFT JOIN (SELECT dst, count(*) AS n FROM links WHERE src IN (SELECT path FROM kept) GROUP BY dst) i ON i.dst = b.path),
status AS (SELECT path, out_degree = 0 AND in_degree = 0 AS orphan, out_degree > 0 AND in_degree = 0 AS no_backlink,
                  1735689600 - last_indexed > 345 * 86400 AS stale, (1735689600 - last_indexed) // 86400 AS days_ago FROM deg)
"""
_TFIDF = r"""
words AS (SELECT doc_id, path, list_filter(regexp_extract_all(lower(body), '\p{L}+'), lambda w: strlen(w) >= 4 AND NOT list_contains(
  string_split('with this that from they will have been more when what your which their said each into also used some there then than very just only over after before about like does would could should same both', ' '), w)) AS w FROM base),
tf AS (SELECT path, term, count(*) / any_value(size) AS tf FROM (SELECT path, len(w) AS size, unnest(w) AS term FROM words) GROUP BY path, term),
lim AS (SELECT count(*) AS n, greatest(2, floor(0.4 * count(*))) AS most FROM base),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING df BETWEEN 2 AND (SELECT most FROM lim)),
sc AS (SELECT path, term, tf * (ln(n / df) + 1) AS tfidf FROM tf JOIN df USING (term), lim),
terms AS (SELECT term, max(tfidf) AS score FROM sc GROUP BY term),
"""



def _kmeans(k: int, rounds: int) -> str:
    """Each round's centroids and the assignment to them, one CTE after another."""
    out = ["v AS MATERIALIZED (SELECT 'v' || lpad(vec_id::VARCHAR, 8, '0') AS path, embedding::DOUBLE[] AS e FROM embeddings)", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path) AS k, e AS c FROM (SELECT * FROM v ORDER BY path LIMIT {k}))"]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED (SELECT path, e, arg_max(k, (s, -k)) AS k FROM (SELECT path, e, k, list_cosine_similarity(e, c)::FLOAT AS s FROM v, c{r}) GROUP BY path, e)")
        out.append(f"m{r} AS MATERIALIZED (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS x FROM (SELECT k, unnest(range(len(e))) AS i, unnest(e) AS x FROM a{r}) GROUP BY k, i) GROUP BY k)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (k))")
    return "WITH " + ",\n".join(out) + f" SELECT 'cluster-' || k AS label, path FROM a{rounds - 1}"


#: NEAR(general license, 1): at most one word between them, in either order.
_NEAR = f"""
tok AS (SELECT path, {TOKENS.format("title")} AS t0, {TOKENS.format("body")} AS t1 FROM base),
places AS (SELECT path, len(t0) + len(t1) AS size, len(list_filter(t1, lambda w: w = 'general')) AS all0, len(list_filter(t1, lambda w: w = 'license')) AS all1,
  len(list_filter(range(1, len(t1) + 1), lambda p: t1[p] = 'general' AND (t1[p + 1] = 'license' OR t1[p + 2] = 'license' OR (p > 1 AND t1[p - 1] = 'license') OR (p > 2 AND t1[p - 2] = 'license')))) AS tf0,
  len(list_filter(range(1, len(t1) + 1), lambda p: t1[p] = 'license' AND (t1[p + 1] = 'general' OR t1[p + 2] = 'general' OR (p > 1 AND t1[p - 1] = 'general') OR (p > 2 AND t1[p - 2] = 'general')))) AS tf1 FROM tok),
num AS (SELECT count(*) AS n, avg(size) AS avg, count(*) FILTER (all0 > 0) AS df0, count(*) FILTER (all1 > 0) AS df1 FROM places),
bm AS (SELECT path, {" + ".join(f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{k} + 0.5) / (df{k} + 0.5)) END * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * size / avg))" for k in (0, 1))} AS bm25 FROM places, num WHERE tf0 > 0 AND tf1 > 0)
"""
_OPEN = "last_indexed BETWEEN 1704067200 + 36000 AND 1704067200 + {} AND consolidated_at IS NULL"
_SEE = "'See shown and text, , out, wiki-' || doc_id || '.'"


_HIT = "3.0 * (contains(lower(f.path), 'license'))::INT AS filename, 2.0 * list_contains(b.tags, 'license')::INT AS tag"
_HITS = "3.0 * (contains(lower(f.path), 'doc')::INT + contains(lower(f.path), '12')::INT) AS filename, 2.0 * (list_contains(b.tags, 'doc')::INT + list_contains(b.tags, '12')::INT) AS tag"

SQL: dict[str, str] = {
    # documents hold no Markdown but marks of emphasis, and blanks at their ends
    "strip_markdown": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[*]{1,3}([^*]+)[*]{1,3}', '\1', 'g'), '_{1,3}([^_]+)_{1,3}', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS plain_md5 FROM documents",
    "kmeans_assign": _kmeans(5, 10),
    "markdown_parse": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' WHEN doc_id % 3 = 0 THEN lang || ',' || source WHEN doc_id % 3 = 1 THEN source || ',x' || doc_id ELSE '' END AS tags, CASE WHEN doc_id % 5 = 0 THEN 'My ' || upper(source[1]) || source[2:] || ' File' || doc_id ELSE 'The **' || source || '** note ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS verified FROM documents",
    "markdown_links": "SELECT doc_id, 'wiki-' || doc_id || '|../' || source || '/b-' || doc_id || '.md|i.png' AS links, lang || '/wiki-' || doc_id || '|' || source || '/b-' || doc_id || '.md|' || lang || '/i.png' AS resolved FROM documents",
    "markdown_plain": f"WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'The ' || source || ' note ' || doc_id || chr(10) || chr(10) END || {_SEE} || chr(10) || chr(10) || 'quoted word' || chr(10) || chr(10) || '!imglast' AS plain FROM documents) SELECT doc_id, plain, plain[1:40] AS start FROM p",
    "match_malformed": f"WITH {NOTES}, {bm25('base', 'path', _BOTH, [(['mit', 'license', 'and'], False)], 'tf0 > 0')} SELECT path, round(bm25, 6) AS bm25 FROM bm",
    "match_columns": f"WITH {NOTES}, {bm25('base', 'path', _BOTH, [(['doc'], False, (0,)), (['licens'], True, (1,)), (['mit'], False)], 'tf0 > 0 AND tf1 > 0 AND NOT tf2 > 0')} SELECT path, round(bm25, 6) AS bm25 FROM bm",
    "match_near": f"WITH {NOTES}, {_NEAR} SELECT path, round(bm25, 6) AS bm25 FROM bm",
    "search_dated": f"WITH RECURSIVE {CHUNKS}, {NOTES}, {_TOP.replace('{where}', 'WHERE path IN (SELECT path FROM base WHERE ' + _OPEN.format(2520000) + ')')} SELECT chunk_id, path, round(bm25, 6) AS bm25 FROM cand",
    "vector_filtered": f"WITH {NOTES}, qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), vec AS (SELECT d.path || '#0' AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], qv.q)::FLOAT AS s FROM embeddings e JOIN base d ON d.doc_id = e.vec_id, qv WHERE starts_with(d.path, 'en/') AND {_OPEN.format(10**12)}) SELECT chunk_id, round(s, 5) AS similarity FROM (SELECT * FROM vec ORDER BY s DESC, chunk_id LIMIT 20)",
    "search_fallback": f"WITH {NOTES}, {LINKS}, {bm25('base', 'path', _BOTH, [(['doc'], False), (['12'], False)], 'tf0 > 0 AND tf1 > 0')}, found AS (SELECT path, bm25, 0.0::DOUBLE AS vector FROM bm ORDER BY bm.bm25 DESC, path LIMIT 50) {_BLEND.replace(_HIT, _HITS)} {_SCORED.format(rows='first', limit=10)} {_SIGNALS}",
    "similar_threshold": f"WITH RECURSIVE {CHUNKS}, {NOTES}, {LINKS}, {_TOP.replace('{where}', '')} {_FOUND} {_BLEND} {_SCORED.format(rows='first', limit=30)}, sim AS (SELECT path, score / max(score) OVER () AS s FROM result) SELECT path, round(s, 5) AS similarity, CASE WHEN s >= 0.8 THEN 'MATCH' WHEN s >= 0.5 THEN 'SIMILAR' ELSE 'RELATED' END AS label FROM (SELECT * FROM sim WHERE s >= 0.9 ORDER BY s DESC, path LIMIT 10)",
    "neighbourhood": f"WITH {NOTES}, {LINKS}, hub AS (SELECT path FROM base WHERE doc_id = 8) SELECT src, dst FROM links, hub WHERE src = hub.path OR dst = hub.path",
    "namespaces_resolved": f"WITH {NOTES} SELECT path, CASE WHEN path = 'en/src1/doc-1.md' THEN 'second' WHEN starts_with(path, 'en/src1/') OR starts_with(path, 'fr/') THEN 'first' WHEN starts_with(path, 'en/') THEN 'second' ELSE 'rest' END AS ns, 'Doc ' || doc_id AS title FROM base",
    "reasons": "WITH s AS (SELECT doc_id, (doc_id % 3) / 4.0 AS bm, (doc_id % 2) / 2.0 AS vec, 3 * (doc_id % 3) AS fname, 2 * (doc_id % 2) AS tag, (doc_id % 5) / 2.0 AS graph FROM documents), t AS (SELECT *, CASE WHEN vec > 0 THEN 0.6 * vec + 0.4 * (0.4 * fname + 0.5 * bm + 0.1 * graph + tag) ELSE 0.4 * fname + 0.5 * bm + 0.1 * graph + tag END AS score FROM s) SELECT doc_id, round(score, 6)::DOUBLE AS score, CASE WHEN vec + fname + bm + tag + graph = 0 THEN 'score:0.0000' ELSE concat_ws(' ', CASE WHEN vec > 0 THEN 'vec:0.50' END, CASE fname WHEN 3 THEN 'filename:3' WHEN 6 THEN 'filename:6' END, CASE doc_id % 3 WHEN 1 THEN 'bm25:0.25' WHEN 2 THEN 'bm25:0.50' END, CASE WHEN tag > 0 THEN 'tag:2' END, CASE doc_id % 5 WHEN 1 THEN 'graph:0.5' WHEN 2 THEN 'graph:1.0' WHEN 3 THEN 'graph:1.5' WHEN 4 THEN 'graph:2.0' END) END AS reason FROM t",
    "first_chunk_vectors": f"WITH {NOTES} SELECT path, len(embedding)::INT AS dimensions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings e JOIN base d ON d.doc_id = e.vec_id WHERE trim(body, chr(32) || chr(9) || chr(10) || chr(13)) <> ''",
    "store_index": f"WITH RECURSIVE changed AS (SELECT o.doc_id, o.lang, o.source, CASE WHEN l.quality = 0 THEN 'New. ' ELSE '' END || o.text AS text, o.text AS old FROM documents o LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1), {CHUNKS.replace('documents', 'changed')}, per AS (SELECT path, count(*) AS chunks, count(*) FILTER (starts_with(content, 'New. ')) AS new FROM chunks GROUP BY path) SELECT p.path, CASE WHEN text = old THEN '' ELSE 'New. ' END || sha256(old) AS checksum, per.chunks, per.new FROM (SELECT *, lang || '/' || source || '/doc-' || doc_id || '.md' AS path FROM changed) p LEFT JOIN per USING (path)",
    "notes_scan": f"WITH {NOTES} SELECT path, namespace, title, array_to_string(tags, ',') AS tags, checksum, last_indexed, consolidated_at FROM base",
    "namespace_list": "SELECT DISTINCT lang AS namespace FROM documents",
    "stats_count": "SELECT count(*) AS files FROM documents",
    "prefix_filter": f"WITH {NOTES} SELECT path FROM base WHERE path ILIKE 'EN/src3/%'",
    "ns_filter": f"WITH {NOTES} SELECT path, namespace FROM base WHERE namespace IN ('de', 'fr')",
    "temporal_filter": f"WITH {NOTES} SELECT path, last_indexed FROM base WHERE last_indexed BETWEEN 1704067200 + 360000 AND 1704067200 + 1800000 AND consolidated_at IS NULL",
    "checksum": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "path_group": f"WITH {NOTES} SELECT string_split(path, '/')[1] AS grp, count(*) AS notes FROM base GROUP BY grp",
    "token_estimate": "SELECT doc_id, ((strlen(text) + 3) // 4)::INT AS tokens FROM documents",
    "page_links": "SELECT target, count(*) AS links FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY target",
    "extract_links": _FORMS,
    "chunk_tokens": f"WITH RECURSIVE {CHUNKS} SELECT path, chunk_index::INT AS chunk_index, ((strlen(content) + 3) // 4)::INT AS token_count, md5(content) AS content_md5 FROM chunks",
    "tokenize_df": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS uses FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_notes": f"WITH {NOTES}, {bm25('base', 'path', _BOTH, _TERM, 'tf0 > 0')} SELECT path, round(bm25, 6) AS bm25 FROM bm",
    "bm25_phrase": f"WITH {NOTES}, {bm25('base', 'path', _BOTH, _PHRASE, 'tf0 > 0')} SELECT path, round(bm25, 6) AS bm25 FROM bm",
    "bm25_boolean": f"WITH {NOTES}, {bm25('base', 'path', _BOTH, _BOOLEAN, 'tf0 > 0 AND (tf1 > 0 OR tf2 > 0) AND NOT tf3 > 0')} SELECT path, round(bm25, 6) AS bm25 FROM bm",
    "bm25_postings": f"WITH {bm25('documents', 'doc_id', ['text'], _TERM, 'tf0 > 0')} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_notes_top": f"WITH {NOTES}, {bm25('base', 'path, namespace', _BOTH, _TERM, 'tf0 > 0')} SELECT path, round(bm25, 6) AS bm25 FROM (SELECT * FROM bm WHERE namespace IN ('en', 'fr') ORDER BY bm.bm25 DESC, path LIMIT 50)",
    "bm25_chunks_topk": f"WITH RECURSIVE {CHUNKS}, {_TOP.replace('{where}', '')} SELECT chunk_id, path, round(bm25, 6) AS bm25 FROM cand",
    "bm25_rollup": f"WITH RECURSIVE {CHUNKS}, {_TOP.replace('{where}', '')} {_FOUND} SELECT path, round(bm25, 5) AS bm25 FROM found",
    "filename_score": f"WITH {NOTES} SELECT * FROM (SELECT path, 3.0::DOUBLE * (contains(lower(path), 'license')::INT + contains(lower(path), 'src3')::INT + contains(lower(path), 'good')::INT) AS score FROM base) WHERE score > 0",
    "tag_bonus": f"WITH {NOTES} SELECT * FROM (SELECT path, 2.0::DOUBLE * (list_contains(tags, 'license')::INT + list_contains(tags, 'src3')::INT + list_contains(tags, 'good')::INT) AS score FROM base) WHERE score > 0",
    "tag_only": f"WITH {NOTES} SELECT path FROM base WHERE list_contains(tags, 'toxic') AND NOT list_contains({TOKENS.format('body')}, 'stupid')",
    "cosine_all": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings",
    "cosine_topk": f"WITH {NOTES}, qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), vec AS (SELECT d.path || '#0' AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], qv.q)::FLOAT AS s FROM embeddings e JOIN base d ON d.doc_id = e.vec_id, qv) SELECT chunk_id, round(s, 5) AS similarity FROM (SELECT * FROM vec ORDER BY s DESC, chunk_id LIMIT 20)",
    "search_text": f"WITH RECURSIVE {CHUNKS}, {NOTES}, {LINKS}, {_TOP.replace('{where}', '')} {_FOUND} {_BLEND} {_SCORED.format(rows='first', limit=10)} {_SIGNALS}",
    "hybrid_search": f"WITH RECURSIVE {CHUNKS}, {NOTES}, {LINKS}, {_TOP.replace('{where}', '')} {_HYBRID} {_BLEND} {_SCORED.format(rows='first', limit=15)} {_SIGNALS}",
    "search_hops": f"WITH RECURSIVE {CHUNKS}, {NOTES}, {LINKS}, {_TOP.replace('{where}', chr(32) + 'WHERE namespace IN (' + chr(39) + 'en' + chr(39) + ')')} {_FOUND} {_BLEND}, start AS (SELECT path, bm25 + vector AS base FROM first) {_hops('start', 2, 'AND l.dst IN (SELECT path FROM base WHERE namespace = ' + chr(39) + 'en' + chr(39) + ')')}, allrows AS (SELECT path, title, bm25, vector, filename, tag, graph FROM first UNION ALL SELECT h.path, b.title, h.base, 0, 3.0 * contains(lower(h.path), 'license')::INT, 2.0 * list_contains(b.tags, 'license')::INT, h.graph FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) h LEFT JOIN base b USING (path)) {_SCORED.format(rows='allrows', limit=25)} {_SIGNALS}",
    "similar_labels": f"WITH RECURSIVE {CHUNKS}, {NOTES}, {LINKS}, {_TOP.replace('{where}', '')} {_FOUND} {_BLEND} {_SCORED.format(rows='first', limit=30)}, sim AS (SELECT path, score / max(score) OVER () AS s FROM result) SELECT path, round(s, 5) AS similarity, CASE WHEN s >= 0.8 THEN 'MATCH' WHEN s >= 0.5 THEN 'SIMILAR' ELSE 'RELATED' END AS label FROM (SELECT * FROM sim ORDER BY s DESC, path LIMIT 10)",
    "edges": f"WITH {NOTES}, {LINKS} SELECT src, (row_number() OVER (PARTITION BY src ORDER BY pos) - 1)::INT AS pos, dst FROM links",
    "out_links": f"WITH {NOTES}, {LINKS} SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS pos, dst FROM links WHERE src = (SELECT path FROM base WHERE doc_id = 8)",
    "backlinks_exact": f"WITH {NOTES}, {LINKS} SELECT DISTINCT src AS path FROM links WHERE dst = (SELECT path FROM base WHERE doc_id = 8) AND src <> dst",
    "backlinks_substring": f"WITH {NOTES}, {LINKS} SELECT DISTINCT src AS path FROM links WHERE contains(lower(dst), 'src8/doc-8') AND src <> 'src8/doc-8'",
    "degree": f"WITH {NOTES}, {LINKS} SELECT path, (SELECT count(*) FROM links WHERE src = path)::INT AS out_degree, (SELECT count(*) FROM links WHERE dst = path) AS in_degree FROM base",
    "graph_nodes": f"WITH {NOTES}, {LINKS} SELECT path AS id, title, array_to_string(tags, ',') AS tags, string_split(path, '/')[1] AS grp, namespace, (SELECT count(*) FROM links WHERE src = path)::INT AS links FROM base",
    "graph_edges": f"WITH {NOTES}, {LINKS} SELECT src AS source, dst AS target FROM links WHERE src IN (SELECT path FROM base WHERE namespace = 'en') AND dst IN (SELECT path FROM base WHERE namespace = 'en')",
    "bfs_1hop": f"WITH {NOTES}, {LINKS}, {bm25('base', 'path', ['body'], _PHRASE, 'tf0 > 0')}, start AS (SELECT path, bm25 AS base FROM bm) {_hops('start', 1)} SELECT path, round(base, 6) AS base, graph::DOUBLE AS graph, hop::INT AS hop FROM hop1",
    "bfs_2hop": f"WITH {NOTES}, {LINKS}, {bm25('base', 'path', ['body'], _PHRASE, 'tf0 > 0')}, start AS (SELECT path, bm25 AS base FROM bm) {_hops('start', 2)} SELECT path, round(base, 6) AS base, graph::DOUBLE AS graph, hop::INT AS hop FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)",
    "graph_boost": f"WITH {NOTES}, {LINKS}, {bm25('base', 'path', ['body'], _PHRASE, 'tf0 > 0')}, best AS (SELECT path FROM bm ORDER BY bm25 DESC, path LIMIT 3) SELECT dst AS path, (0.5 * count(*))::DOUBLE AS graph FROM links WHERE src IN (SELECT path FROM best) AND dst IN (SELECT path FROM base) GROUP BY dst",
    "lint_status": f"WITH {NOTES}, {LINKS}, kept AS (SELECT * FROM base WHERE NOT starts_with(path, 'en/src1/')), {_STATUS} SELECT * FROM status",
    "lint_summary": f"WITH {NOTES}, {LINKS}, kept AS (SELECT * FROM base), {_STATUS} SELECT count(*) AS total, count(*) FILTER (orphan) AS orphans, count(*) FILTER (no_backlink) AS no_backlinks, count(*) FILTER (stale) AS stale, count(*) FILTER (NOT (orphan OR no_backlink OR stale)) AS healthy FROM status",
    "stale_anti": f"WITH {NOTES} SELECT path FROM base WHERE quality IS NULL",
    "upsert_merge": f"WITH {NOTES} SELECT path, CASE WHEN quality = 0 THEN sha256('x' || checksum) ELSE checksum END AS checksum, CASE WHEN quality = 0 THEN 1735689600 ELSE last_indexed END AS last_indexed, consolidated_at FROM base",
    "mark_consolidated": f"WITH {NOTES} SELECT path, CASE WHEN toxic = 1 THEN 1735689600 ELSE consolidated_at END AS consolidated_at FROM base",
    "unmark_consolidated": f"WITH {NOTES} SELECT path, CASE WHEN quality = 1 THEN NULL ELSE consolidated_at END AS consolidated_at FROM base",
    "tfidf_terms": f"WITH {NOTES}, {_TFIDF} top AS (SELECT * FROM terms ORDER BY score DESC, term LIMIT 20) SELECT term, round(score, 6) AS score, (row_number() OVER (ORDER BY top.score DESC, term))::INT AS place FROM top",
    "tfidf_clusters": f"WITH {NOTES}, {_TFIDF} top AS (SELECT term, row_number() OVER (ORDER BY score DESC, term) AS place FROM (SELECT * FROM terms ORDER BY score DESC, term LIMIT 5)), own AS (SELECT path, term, row_number() OVER (PARTITION BY path ORDER BY tfidf DESC, place) AS r FROM sc JOIN top USING (term)) SELECT coalesce(o.term, 'misc') AS label, b.path FROM base b LEFT JOIN own o ON o.path = b.path AND o.r = 1",
    "tag_clusters": f"WITH {NOTES}, lim AS (SELECT greatest(2, floor(0.4 * count(*))) AS most FROM base), uses AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM base) GROUP BY tag), top AS (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) AS place FROM (SELECT * FROM uses WHERE n BETWEEN 2 AND (SELECT most FROM lim) ORDER BY n DESC, tag LIMIT 5)), own AS (SELECT b.path, t.tag, row_number() OVER (PARTITION BY b.path ORDER BY t.place) AS r FROM base b JOIN top t ON list_contains(b.tags, t.tag)) SELECT coalesce(o.tag, 'misc') AS label, b.path FROM base b LEFT JOIN own o ON o.path = b.path AND o.r = 1",
}

SQL["cluster_chain"] = SQL["tfidf_clusters"].replace("base AS (", "every AS (", 1).replace("FROM documents d LEFT JOIN labels l USING (doc_id))", "FROM documents d LEFT JOIN labels l USING (doc_id)), base AS (SELECT * FROM every WHERE starts_with(path, 'en/'))", 1)

_CHANGED = SQL["store_index"].partition(", per AS (")[0]
SQL["store_search"] = f"{_CHANGED}, {bm25('chunks', 'path, namespace, chunk_index', ['content'], [(['public'], False), (['licens'], True)], 'tf0 > 0 AND tf1 > 0')}, cand AS (SELECT path || '#' || chunk_index AS chunk_id, path, bm25 FROM bm ORDER BY bm25 DESC, chunk_id LIMIT 20) SELECT chunk_id, path, round(bm25, 6) AS bm25 FROM cand"
