"""SQL for the registered queries, as DuckDB reads it over the same tables."""

from __future__ import annotations

# The prompt's texts, said here a second time so that a wrong one in the engine shows.
SYSTEM = (
    "You are a knowledgeable assistant. Answer the question based ONLY on the provided context.\n\nINSTRUCTIONS:\n"
    "- Answer based only on the information in the context\n"
    '- If the context doesn\'t contain the answer, say "I don\'t have enough information to answer that"\n'
    "- Be concise but thorough\n- When quoting sources, mention the document name\n- Use a helpful, friendly tone\n"
)
SOURCES, TOPICS, CONTENT, PAST, QUESTION, ANSWER = "\n📚 SOURCES: ", "\n📊 HIGH-LEVEL TOPIC SUMMARIES:", "\n📄 RELEVANT CONTENT:", "\n💬 CONVERSATION HISTORY:", "\n❓ QUESTION: ", "\n✅ ANSWER:"

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


SLIDING = f"""
SELECT doc_id, printf('chunk_%06d', i) AS chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index,
       0 AS level, CAST(i AS INTEGER) AS position, substr(text, i + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents)
WHERE {strip('substr(text, i + 1, 500)')} <> ''
"""
FIXED = f"""
SELECT doc_id, CAST(i // 250 AS INTEGER) AS chunk_id, substr(t, i + 1, 300) AS text, CAST(i AS INTEGER) AS start_index, CAST(i + length(substr(t, i + 1, 300)) AS INTEGER) AS end_index
FROM (SELECT doc_id, t, unnest(range(0, length(t), 250)) AS i FROM (SELECT doc_id, {strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS t FROM documents))
"""
BOUNDARY = f"""
WITH w AS (
  SELECT doc_id, text, length(text) AS n, i, substr(text, i + 1, 50) AS c, {strip('substr(text, i + 1, 50)')} = '' AS blank
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 45)) AS i FROM documents)
), kept AS (
  SELECT *, min(i) FILTER (WHERE i + 50 >= n AND NOT blank) OVER (PARTITION BY doc_id) AS last FROM w
), chunks AS (
  SELECT doc_id, text, i, c || CASE WHEN i > 0 AND i + 50 < n THEN regexp_extract(substr(text, i + 51, 10), '^[^.!?]*[.!?]') ELSE '' END AS c
  FROM kept WHERE NOT blank AND i <= coalesce(last, i)
)
SELECT doc_id, printf('chunk_%04d_%04d', i, i + length(c)) AS chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index,
       CAST(i AS INTEGER) AS start_position, CAST(i + length(c) AS INTEGER) AS end_position, CAST(length(c) AS INTEGER) AS chunk_size,
       CASE WHEN contains(text, '\\documentclass') OR contains(text, '\\usepackage') OR contains(text, '\\begin{{') THEN 'latex' ELSE 'plain_text' END AS file_type, c AS text
FROM chunks
"""
PARAGRAPH = f"""
WITH RECURSIVE p AS (
  SELECT doc_id, string_split(text, {NL}) AS ps FROM documents WHERE length(text) > 10000 AND contains(text, {NL})
), f(doc_id, i, now, done) AS (
  SELECT doc_id, 0, '', CAST(NULL AS VARCHAR) FROM p
  UNION ALL
  SELECT f.doc_id, i + 1,
         CASE WHEN length(now) + length(ps[i + 1]) > 500 AND now <> '' THEN ps[i + 1] WHEN now <> '' THEN now || {NL} || ps[i + 1] ELSE ps[i + 1] END,
         CASE WHEN length(now) + length(ps[i + 1]) > 500 AND now <> '' THEN {strip('now')} END
  FROM f JOIN p ON f.doc_id = p.doc_id WHERE i < len(ps)
), emitted AS (
  SELECT doc_id, i, done AS text FROM f WHERE done IS NOT NULL
  UNION ALL
  SELECT f.doc_id, i + 1, {strip('now')} FROM f JOIN p ON f.doc_id = p.doc_id WHERE i = len(ps) AND now <> ''
), numbered AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text FROM emitted
)
SELECT doc_id, printf('chunk_%06d', chunk_index) AS chunk_id, chunk_index, 0 AS level, CAST(NULL AS INTEGER) AS position, text FROM numbered
UNION ALL
SELECT doc_id, printf('chunk_%06d', i), CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER), 0, CAST(i AS INTEGER), substr(text, i + 1, 500)
FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents WHERE NOT (length(text) > 10000 AND contains(text, {NL})))
WHERE {strip('substr(text, i + 1, 500)')} <> ''
"""
CHUNK_STATS = f"SELECT source, count(*) AS n FROM (SELECT source, text, unnest(range(0, length(text), 450)) AS i FROM documents) WHERE {strip('substr(text, i + 1, 500)')} <> '' GROUP BY source"
CHUNK_DEDUP = f"SELECT doc_id, count(*) AS n_chunks FROM ({SLIDING}) GROUP BY doc_id"
STORED = f"""
SELECT doc_id, doc_id || '_' || chunk_id || '_' || substr(md5(doc_id || '|' || chunk_id || '|' || text), 1, 8) AS chunk_key, chunk_index,
       replace(substr(text, 1, 50), {NL}, ' ') AS chunk_preview
FROM ({SLIDING})
"""
STORE_SCAN = f"""
SELECT doc_id, doc_id || '_' || chunk_id || '_' || substr(md5(doc_id || '|' || chunk_id || '|' || text), 1, 8) AS chunk_key, chunk_index, CAST(doc_id % 2 AS INTEGER) AS level, text
FROM ({SLIDING})
"""
INGESTED = f"""
SELECT DISTINCT source, source || '_' || chunk_id || '_' || substr(md5(source || '|' || chunk_id || '|' || c.text), 1, 8) AS chunk_key, chunk_id, replace(substr(c.text, 1, 50), {NL}, ' ') AS chunk_preview
FROM ({SLIDING}) c JOIN documents d ON d.doc_id = c.doc_id
"""
CLEAN_SPACES = f"SELECT doc_id, {strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS clean FROM documents"
_LATEX = f"""
SELECT doc_id, '\\documentclass{{article}}' || {NL} || '\\usepackage{{amsmath}}' || {NL} || '% a comment' || {NL} || '\\ProvidesPackage{{' || source || '}}' || {NL} || '\\RequirePackage{{graphics}}' || {NL}
  || '\\newcommand{{\\' || lang || '}}' || {NL} || '\\begin{{document}}' || {NL} || '\\section{{' || source || '}}' || {NL} || text || ' 50\\% % rest' || {NL} || {NL} || '  ' || {NL}
  || '\\subsection{{Part ' || lang || '}} \\textbf{{bold}} \\emph{{' || lang || '}} \\cite{{a1}} \\ref{{b2}} \\label{{c3}} \\item[x]{{y}} end' || {NL} || '\\end{{document}}' || {NL} AS text
FROM documents
"""


def _chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"
    return x


_ALL_COMMANDS = (r"\\[a-zA-Z]+(\[[^\]]*\])?(\{[^}]*\})?", "''")
LATEX_STRUCTURE = f"""SELECT doc_id, {strip(_chain("text", [
    ("(?m)%.*$", "''"),
    (r"\\section\{([^}]+)\}", f"{NL} || {NL} || '### SECTION: \\1 ###' || {NL} || {NL}"),
    (r"\\subsection\{([^}]+)\}", f"{NL} || {NL} || '### SUBSECTION: \\1 ###' || {NL} || {NL}"),
    (r"\\ProvidesPackage\{([^}]+)\}", "'PACKAGE: \\1'"),
    (r"\\RequirePackage\{([^}]+)\}", "'REQUIRES: \\1'"),
    (r"\\newcommand\{\\([^}]+)\}", "'COMMAND: \\1'"),
    _ALL_COMMANDS,
    (r"\n\s*\n", NL),
]))} AS clean FROM ({_LATEX})"""
LATEX_PLAIN = f"""SELECT doc_id, {strip(_chain("text", [
    ("(?m)%.*$", "''"),
    (r"\\begin\{[^}]+\}", "''"),
    (r"\\end\{[^}]+\}", "''"),
    (r"\\section\{([^}]+)\}", f"'\\1' || {NL}"),
    (r"\\subsection\{([^}]+)\}", f"'\\1' || {NL}"),
    (r"\\textbf\{([^}]+)\}", "'\\1'"),
    (r"\\textit\{([^}]+)\}", "'\\1'"),
    (r"\\emph\{([^}]+)\}", "'\\1'"),
    (r"\\label\{[^}]+\}", "''"),
    (r"\\cite\{[^}]+\}", "'[CITATION]'"),
    (r"\\ref\{[^}]+\}", "'[REFERENCE]'"),
    (r"\\usepackage\{[^}]+\}", "''"),
    (r"\\documentclass\{[^}]+\}", "''"),
    _ALL_COMMANDS,
    (r"\n\s*\n", f"{NL} || {NL}"),
]))} AS clean FROM ({_LATEX})"""
DETECT = f"""
SELECT kind, CASE WHEN contains(text, '\\documentclass') OR contains(text, '\\usepackage') OR contains(text, '\\begin{{') THEN 'latex' ELSE 'plain_text' END AS file_type, count(*) AS n
FROM (SELECT 'marked' AS kind, text FROM ({_LATEX}) UNION ALL SELECT 'raw', text FROM documents) GROUP BY ALL
"""
SENTENCES = f"SELECT doc_id, CAST(place AS INTEGER) AS \"at\", sentence FROM (SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))"
TOKENS = f"SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({words('text')})) AS INTEGER) AS n_distinct FROM documents"
PREVIEWS = f"""
SELECT doc_id, replace(substr(text, 1, 50), {NL}, ' ') AS p50, substr(text, 1, 30) AS p30, substr(text, 1, 40) AS p40, substr(text, 1, 100) AS p100,
       CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '...' ELSE text END AS cut, substr(text, 1, 200) || '...' AS answer FROM documents
"""
FORMATS = """
SELECT doc_id, printf('chunk_%06d', doc_id) AS chunk_id, printf('chunk_%04d_%04d', doc_id, n_chars) AS span_id, lang || '.TXT' AS base, '.txt' AS ext,
       printf('%.2f%%', (n_chars / 39999.0::DOUBLE) * 100) AS percent, printf('%.3f', n_chars / 39999.0::DOUBLE) AS fixed FROM documents
"""
DISPATCH = "SELECT CASE WHEN doc_id % 5 < 2 THEN 'text' WHEN doc_id % 5 < 4 THEN 'latex' ELSE 'pdf' END AS kind, count(*) AS n FROM documents GROUP BY ALL"
_KEYWORDS = f"""
each AS (
  SELECT source, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (SELECT source, doc_id, {words('text')} AS ws FROM documents)
), counted AS (
  SELECT source, word, count(*) AS n, min((doc_id, place)) AS first FROM each
  WHERE length(word) > 3 AND word NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'is', 'are', 'was', 'were', 'of', 'with') GROUP BY ALL
), ranked AS (
  SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS INTEGER) AS rank, word, n FROM counted
)
"""
KEYWORDS = f"WITH {_KEYWORDS} SELECT * FROM ranked WHERE rank <= 10"
FALLBACK = f"""
WITH {_KEYWORDS}, themes AS (
  SELECT source, string_agg(word, ', ' ORDER BY rank) AS themes FROM ranked WHERE rank <= 8 GROUP BY source
), g AS (
  SELECT source, count(*) AS n, arg_min(text, doc_id) AS head FROM documents GROUP BY source
)
SELECT source, n AS chunks_count, {strip(f"'Cluster Summary:' || {NL} || '- Total chunks: ' || n || {NL} || '- Key themes: ' || coalesce(themes, '') || {NL} || '- Sample content: ' || substr(head, 1, 200) || '...' || {NL} || {NL} || 'This cluster contains content related to these key concepts.'")} AS summary
FROM g LEFT JOIN themes USING (source)
"""
SUMMARY_INPUT = f"""
SELECT source, CASE WHEN length(j) > 4000 THEN substr(j, 1, 4000) || '...' ELSE j END AS input FROM (
  SELECT source, string_agg(text, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY doc_id) AS j
  FROM (SELECT source, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 15) GROUP BY source)
"""
MODEL_SUMMARIES = f"""
SELECT f.source, f.chunks_count, CASE WHEN length(input) % 3 = 2 AND {strip('substr(input, 1, 40)')} <> '' THEN {strip('substr(input, 1, 40)')} ELSE summary END AS summary
FROM ({FALLBACK}) f JOIN ({SUMMARY_INPUT}) i ON f.source = i.source
"""


def _nearest(rows: str, k: int) -> str:
    return f"""
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS s
  FROM embeddings q, ({rows}) v WHERE q.vec_id % 100 = 0)
QUALIFY rank <= {k}
"""


COSINE = _nearest("SELECT * FROM embeddings", 5)
COSINE_FILTERED = _nearest("SELECT * FROM embeddings WHERE label = 3", 5)
IVF_ALL = """
SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS s,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 5
"""
L2 = """
SELECT query_id, vec_id, round(d, 6) AS distance FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) ** 2, 9) AS d
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) = 1
"""
PAIRS = """
SELECT a.vec_id, round(1 - s, 6) AS distance, round(s, 6) AS similarity
FROM (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a
"""
ZIP = f"""
SELECT vec_id, replace(substr(text, 1, 50), {NL}, ' ') AS preview, CAST(len(embedding) AS INTEGER) AS dimensions, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm
FROM embeddings JOIN documents ON doc_id = vec_id
"""
_X = "x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim FROM embeddings)"
STATS = f"WITH {_X} SELECT dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY dim"
STANDARD_ROWS = f"WITH {_X}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY dim) SELECT vec_id, x.dim, round((v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 4) + 0.0 AS x FROM x JOIN s ON x.dim = s.dim"
COVARIANCE = f"WITH {_X} SELECT a.dim AS i, b.dim AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL"
VARIANCES = f"""
WITH {_X}, c AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.v, b.v) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL),
c2 AS (SELECT a.i, b.j, sum(a.cov * b.cov) AS cov FROM c a JOIN c b ON a.j = b.i GROUP BY ALL)
SELECT (SELECT count(*) FROM c WHERE i = j) AS n_components, (SELECT round(sum(cov), 9) FROM c WHERE i = j) AS variance,
       (SELECT round(sum(cov * cov), 9) FROM c) AS squares, (SELECT round(sum(c2.cov * c.cov), 9) FROM c2 JOIN c ON c2.i = c.j AND c2.j = c.i) AS cubes
"""
CENTROIDS = f"WITH {_X} SELECT label, dim, round(avg(v), 6) AS mean FROM x GROUP BY ALL"
MSTEP = f"""
WITH {_X}, w AS (SELECT label, count(*) / sum(count(*)) OVER () AS weight FROM embeddings GROUP BY label)
SELECT x.label, dim, round(any_value(weight), 6) AS weight, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM x JOIN w ON x.label = w.label GROUP BY x.label, dim
"""
_ESTEP = f"""
{_X}, m AS (SELECT label, dim, avg(v) AS mean, greatest(var_pop(v), 1e-6) AS var FROM x GROUP BY ALL),
w AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS component, count(*) / sum(count(*)) OVER () AS weight FROM embeddings GROUP BY label),
z AS (
  SELECT x.vec_id, w.component, ln(any_value(w.weight)) + sum(-0.5 * ((x.v - m.mean) ** 2 / m.var + ln(m.var) + ln(2 * pi()))) AS z
  FROM x JOIN m ON x.dim = m.dim JOIN w ON w.label = m.label GROUP BY ALL
), top AS (SELECT vec_id, max(z) AS t FROM z GROUP BY vec_id),
ll AS (SELECT z.vec_id, t + ln(sum(exp(z - t))) AS ll FROM z JOIN top ON z.vec_id = top.vec_id GROUP BY z.vec_id, t),
r AS (SELECT z.vec_id, component, exp(z - ll) AS p FROM z JOIN ll ON z.vec_id = ll.vec_id)
"""
ESTEP = f"WITH {_ESTEP} SELECT vec_id, component, round(p, 4) AS p FROM r"
CONFIDENCE = f"WITH {_ESTEP} SELECT vec_id, arg_max(component, p) AS cluster_id, round(max(p), 4) AS confidence FROM r GROUP BY vec_id"
ASSIGNED_NEW = f"""
WITH raw AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim FROM embeddings),
s AS (SELECT dim, avg(v) AS mu, stddev_pop(v) AS sd FROM raw WHERE vec_id % 2 = 0 GROUP BY dim),
x AS (SELECT vec_id, label, raw.dim, (v - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS v FROM raw JOIN s ON s.dim = raw.dim),
m AS (SELECT label, dim, avg(v) AS mean, greatest(var_pop(v), 1e-6) AS var FROM x WHERE vec_id % 2 = 0 GROUP BY ALL),
w AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS component, count(*) / sum(count(*)) OVER () AS weight FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label),
z AS (
  SELECT x.vec_id, w.component, ln(any_value(w.weight)) + sum(-0.5 * ((x.v - m.mean) ** 2 / m.var + ln(m.var) + ln(2 * pi()))) AS z
  FROM x JOIN m ON x.dim = m.dim JOIN w ON w.label = m.label WHERE x.vec_id % 2 = 1 GROUP BY ALL
), top AS (SELECT vec_id, max(z) AS t FROM z GROUP BY vec_id),
ll AS (SELECT z.vec_id, t + ln(sum(exp(z - t))) AS ll FROM z JOIN top ON z.vec_id = top.vec_id GROUP BY z.vec_id, t)
SELECT z.vec_id, arg_max(component, z) AS cluster_id, round(max(exp(z - ll)), 4) AS confidence FROM z JOIN ll ON z.vec_id = ll.vec_id GROUP BY z.vec_id
"""
AIC_BIC = f"""
WITH {_ESTEP}, s AS (SELECT sum(ll) AS ll, count(*) AS n, (SELECT count(*) FROM w) AS k, (SELECT count(DISTINCT dim) FROM x) AS d FROM ll)
SELECT round(ll, 2) AS log_likelihood, round(2 * (2 * k * d + k - 1) - 2 * ll, 2) AS aic, round((2 * k * d + k - 1) * ln(n) - 2 * ll, 2) AS bic FROM s
"""
_SILHOUETTES = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS s FROM e a, e b GROUP BY ALL),
f AS (
  SELECT d.vec_id, d.label, min(s / sizes.n) FILTER (WHERE other <> d.label) AS b, max(s / greatest(sizes.n - 1, 1)) FILTER (WHERE other = d.label) AS a, max(sizes.n) FILTER (WHERE other = d.label) AS n
  FROM d JOIN sizes ON sizes.label = other GROUP BY ALL
)
"""
_SILHOUETTE_OF = "CASE WHEN n = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END"
SILHOUETTE = f"{_SILHOUETTES} SELECT label, count(*) AS n, round(avg({_SILHOUETTE_OF}), 6) AS silhouette FROM f GROUP BY label"
# No label of the given tables is larger than the sample, so the estimate is exact and its interval 0.
SILHOUETTE_ESTIMATED = f"{_SILHOUETTES} SELECT round(avg({_SILHOUETTE_OF}), 4) AS silhouette, 0.0 :: DOUBLE AS within FROM f"
CHOOSE_K = """
SELECT source, n, CAST(greatest(2, least(8, n // 50)) AS INTEGER) AS k_hierarchy, CAST(greatest(2, least(8, n // 100)) AS INTEGER) AS k_hundredth,
       CAST(greatest(2, least(10, floor(sqrt(n / 2)))) AS INTEGER) AS k_root, CAST(least(10, greatest(3, n // 500)) AS INTEGER) AS k_pages, n >= 3 AS enough
FROM (SELECT source, count(*) * 37 AS n FROM documents GROUP BY source)
"""
_CLUSTERED = f"""
{_ESTEP}, best AS (SELECT vec_id, max(p) AS confidence FROM r GROUP BY vec_id),
clustered AS (
  SELECT e.vec_id, e.label AS cluster_id, confidence, source, replace(substr(text, 1, 50), {NL}, ' ') AS preview, e.vec_id AS chunk_index, printf('chunk_%06d', e.vec_id % 200) AS chunk_id
  FROM embeddings e JOIN best ON best.vec_id = e.vec_id JOIN documents ON doc_id = e.vec_id
)
"""
REPORT = f"WITH {_CLUSTERED} SELECT cluster_id, count(*) AS n, round(avg(confidence), 3) AS mean_confidence, round(min(confidence), 3) AS min_confidence, round(max(confidence), 3) AS max_confidence FROM clustered GROUP BY cluster_id"
SAMPLES = f"""
WITH {_CLUSTERED}, once AS (SELECT * FROM clustered QUALIFY row_number() OVER (PARTITION BY cluster_id, chunk_id ORDER BY chunk_index) = 1),
s AS (SELECT cluster_id, count(*) AS n_unique, round(avg(confidence), 3) AS mean_confidence, round(min(confidence), 3) AS min_confidence, round(max(confidence), 3) AS max_confidence FROM once GROUP BY cluster_id)
SELECT s.*, CAST(row_number() OVER (PARTITION BY once.cluster_id ORDER BY chunk_index, chunk_id) AS INTEGER) AS sample, chunk_id, round(confidence, 3) AS confidence
FROM once JOIN s ON s.cluster_id = once.cluster_id QUALIFY sample <= 3
"""
CLUSTER_CHUNKS = f"""
WITH {_CLUSTERED}, s AS (SELECT cluster_id, count(*) AS n, round(avg(confidence), 3) AS mean_confidence FROM clustered GROUP BY cluster_id)
SELECT s.cluster_id, CAST(row_number() OVER (PARTITION BY c.cluster_id ORDER BY chunk_index) AS INTEGER) AS place, chunk_id, n, greatest(n - 10, 0) AS more, mean_confidence
FROM clustered c JOIN s ON s.cluster_id = c.cluster_id QUALIFY place <= 10
"""
DISTRIBUTION = f"""
WITH {_CLUSTERED}, c AS (SELECT cluster_id, count(*) AS n FROM clustered GROUP BY cluster_id)
SELECT cluster_id, n, round(p, 6) AS percent, repeat('█', CAST(floor(p / 2) AS INTEGER)) AS bar FROM (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS p FROM c)
"""
CLUSTER_SOURCES = f"WITH {_CLUSTERED} SELECT cluster_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, list_sort(list(DISTINCT CASE WHEN vec_id % 7 <> 0 THEN source ELSE 'unknown' END)) AS sources FROM clustered GROUP BY cluster_id"
FULL_TEXT = "SELECT e.vec_id, e.label AS cluster_id, d.text AS full_text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"
MAPPING = f"WITH {_CLUSTERED} SELECT chunk_id, cluster_id, printf('%.3f', confidence) AS confidence, preview FROM clustered ORDER BY chunk_index, chunk_id LIMIT 20"
WRITEBACK = f"""
WITH {_ESTEP}, best AS (SELECT vec_id, arg_max(component, p) AS cluster_id, round(max(p), 4) AS cluster_confidence FROM r GROUP BY vec_id)
SELECT doc_id AS chunk_key, source, cluster_id, cluster_confidence FROM documents LEFT JOIN best ON vec_id = doc_id
"""
SOURCE_COUNTS = "SELECT CASE WHEN doc_id % 11 <> 0 THEN source ELSE 'Unknown' END AS source, count(*) AS n FROM documents GROUP BY ALL"
STORE_COUNTS = "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'conversations', count(*) FROM conversations"
LEVEL_SCAN = "SELECT doc_id, source FROM documents WHERE doc_id % 4 IN (0, 1)"
_SUMMARIES = """
made AS (
  SELECT 's_' || level || '_' || cluster_id AS summary_id, level, cluster_id, CASE WHEN cluster_id % 5 <> 0 THEN n END AS chunks_count,
         CASE WHEN cluster_id % 4 <> 0 THEN first / 1000.0::DOUBLE END AS silhouette_score, summary, first % 3 AS run
  FROM (SELECT CAST(greatest(doc_id % 4 - 1, 0) AS INTEGER) AS level, CAST(substr(source, 4) AS INTEGER) AS cluster_id, count(*) AS n, min(doc_id) AS first, arg_min(text, doc_id) AS summary
        FROM documents GROUP BY 1, 2)
)
"""
TREE = f"WITH {_SUMMARIES} SELECT summary_id, level, cluster_id, coalesce(chunks_count, 0) AS chunks_count, coalesce(silhouette_score, 0.0) AS silhouette_score, substr(summary, 1, 100) AS summary_preview, '' AS created_at FROM made"
HIERARCHY = f"""
WITH {_SUMMARIES}
SELECT level, count(*) OVER (PARTITION BY level) AS n_clusters, CAST(row_number() OVER (PARTITION BY level ORDER BY cluster_id) - 1 AS INTEGER) AS "at", cluster_id, coalesce(chunks_count, 0) AS chunks_count,
       printf('%.3f', coalesce(silhouette_score, 0.0)) AS silhouette, substr(summary, 1, 80) || '...' AS preview FROM made
"""
IMPROVEMENT = """
WITH h AS (SELECT CAST(greatest(doc_id % 4 - 1, 0) AS INTEGER) AS level, count(DISTINCT source) AS n_clusters, count(*) AS n_items, round(avg(length(text)) / 10000, 6) AS silhouette FROM documents GROUP BY 1),
i AS (SELECT *, coalesce(silhouette - lag(silhouette) OVER (ORDER BY level), 1.0::DOUBLE) AS gain FROM h)
SELECT level, n_clusters, n_items, silhouette, round(gain, 6) AS improvement, gain < 0.05 AS stop FROM i
"""
_HITS = """
h0 AS (
  SELECT query_id, vec_id, cluster_id, s AS raw, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, v.label AS cluster_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS s
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
  QUALIFY rank <= 5
), hits AS (
  SELECT h0.*, CASE WHEN doc_id % 7 <> 0 THEN source END AS source, text FROM h0 LEFT JOIN documents ON doc_id = vec_id
), asked AS (
  SELECT vec_id AS query_id, 'What does ' || vec_id || ' say?' AS question FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT -1, 'Nothing?'
)
"""
_ATTACHED = f"""
{_HITS}, {_SUMMARIES}, one AS (
  SELECT cluster_id, level, coalesce(chunks_count, 0) AS chunks_count, substr(summary, 1, 500) AS summary FROM made QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY run DESC, level, summary_id) = 1
), attached AS (
  SELECT query_id, one.cluster_id, level, chunks_count, summary FROM (SELECT DISTINCT query_id, cluster_id FROM hits) h JOIN one ON one.cluster_id = h.cluster_id
)
"""
ATTACH = f"WITH {_ATTACHED} SELECT * FROM attached"
ATTACH_STRICT = f"""
WITH {_HITS}, {_SUMMARIES}, one AS (
  SELECT cluster_id, level, coalesce(chunks_count, 0) AS chunks_count, substr(summary, 1, 500) AS summary FROM made QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY run DESC, level, summary_id) = 1
)
SELECT query_id, one.cluster_id, level, chunks_count, summary FROM (SELECT DISTINCT query_id, cluster_id FROM hits WHERE vec_id % 3 = 0) h JOIN one ON one.cluster_id = h.cluster_id
"""
ATTACH_LEVEL = f"WITH {_HITS}, {_SUMMARIES} SELECT query_id, made.cluster_id, level, coalesce(chunks_count, 0) AS chunks_count, substr(summary, 1, 500) AS summary FROM (SELECT DISTINCT query_id, cluster_id FROM hits) h JOIN made ON made.cluster_id = h.cluster_id AND level = 1"
_CONTEXT = f"""
{_ATTACHED}, g AS (
  SELECT query_id, count(*) AS n, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources, string_agg(text, '|' ORDER BY rank) AS texts,
         string_agg({NL} || '[' || rank || '] (Source: ' || coalesce(source, 'Unknown') || ', Relevance: ' || printf('%.2f%%', raw * 100) || ')' || {NL} || text, {NL} ORDER BY rank) AS content
  FROM hits GROUP BY query_id
), t AS (
  SELECT query_id, count(*) AS n_topics, string_agg({NL} || 'Topic ' || cluster_id || ' (Level ' || level || ', ' || chunks_count || ' chunks):' || {NL} || summary, {NL} ORDER BY cluster_id) AS topics FROM attached GROUP BY query_id
)
"""
CONTEXT = f"""
WITH {_CONTEXT}
SELECT query_id, question, n IS NOT NULL AS success, CASE WHEN n IS NULL THEN 'No relevant chunks found' END AS message, coalesce(n, 0) AS n_chunks, coalesce(sources, '') AS sources, texts, CAST(coalesce(n_topics, 0) AS INTEGER) AS n_topics
FROM asked LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id)
"""


def _prompt(topics: bool) -> str:
    parts = [lit(SYSTEM), f"CASE WHEN sources <> '' THEN {lit(SOURCES)} || replace(sources, ',', ', ') END"]
    parts += [f"CASE WHEN topics IS NOT NULL THEN {lit(TOPICS)} || {NL} || topics END"] if topics else []
    parts += [f"CASE WHEN content IS NOT NULL THEN {lit(CONTENT)} || {NL} || content ELSE {lit(CONTENT)} END", f"{lit(QUESTION)} || question", lit(ANSWER)]
    return f"concat_ws({NL}, {', '.join(parts)})"


PROMPT = f"WITH {_CONTEXT} SELECT query_id, {_prompt(True)} AS prompt FROM asked LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id)"
ANSWERS = f"""
WITH {_CONTEXT}, p AS (SELECT query_id, question, n, sources, {_prompt(False)} AS prompt FROM asked LEFT JOIN g USING (query_id)),
b AS (SELECT *, string_split(prompt, {NL} || '[1] ')[2] AS rest FROM p),
a AS (SELECT *, substr({strip(f"string_split(substr(rest, strpos(rest, {NL}) + 1), '. ')[1]")}, 1, 500) AS said FROM b)
SELECT query_id, question, CASE WHEN n IS NULL THEN 'Error: No relevant chunks found' ELSE said END AS answer, coalesce(sources, '') AS sources, coalesce(n, 0) AS context_chunks,
       CASE WHEN n IS NOT NULL THEN CAST(len({words('said')}) AS BIGINT) END AS tokens_generated FROM a
"""
_LETTERS = "[chr(CAST(c AS INTEGER)) FOR c IN range(97, 123)]"


def _embedded(x: str) -> str:
    counts = f"list_transform({_LETTERS}, lambda c: CAST(length({x}) - length(replace(replace({x}, c, ''), upper(c), '')) AS DOUBLE))"
    return f"(SELECT CASE WHEN n = 0 THEN CAST(v AS FLOAT[]) ELSE CAST(list_transform(v, lambda y: y / n) AS FLOAT[]) END FROM (SELECT v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT {counts} AS v)))"


ASK = f"""
WITH chunks AS (
  SELECT c.doc_id || '_' || c.chunk_id AS chunk_key, c.text, d.source, CAST({_embedded("c.text")} AS DOUBLE[]) AS v FROM ({SLIDING}) c JOIN documents d ON d.doc_id = c.doc_id
), asked AS (
  SELECT item_id AS query_id, text AS question, CAST({_embedded("b.text")} AS DOUBLE[]) AS q FROM benchmark b
), lengths AS (
  SELECT chunk_key, text, source, v, sqrt(list_inner_product(v, v)) AS n FROM chunks
), near AS (
  SELECT query_id, chunk_key, text, source, round(CASE WHEN n = 0 THEN 0 ELSE list_inner_product(v, q) / n / sqrt(list_inner_product(q, q)) END, 9) AS raw FROM asked, lengths
), hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_key) AS INTEGER) AS rank FROM near QUALIFY rank <= 5
), g AS (
  SELECT query_id, count(*) AS n, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources,
         string_agg({NL} || '[' || rank || '] (Source: ' || coalesce(source, 'Unknown') || ', Relevance: ' || printf('%.2f%%', raw * 100) || ')' || {NL} || text, {NL} ORDER BY rank) AS content
  FROM hits GROUP BY query_id
), p AS (SELECT query_id, question, n, sources, {_prompt(False)} AS prompt FROM asked LEFT JOIN g USING (query_id)),
b AS (SELECT *, substr(prompt, strpos(prompt, {NL} || '[1] ') + 5) AS rest FROM p),
a AS (SELECT *, substr({strip(f"string_split(substr(rest, strpos(rest, {NL}) + 1), '. ')[1]")}, 1, 500) AS said FROM b)
SELECT query_id, question, said AS answer, sources, n AS context_chunks, CAST(len({words('said')}) AS BIGINT) AS tokens_generated FROM a
"""
EMBED_LETTERS = f"""
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 6) AS x
FROM (SELECT doc_id, unnest(range(26)) AS dim, unnest(v) AS x FROM (SELECT doc_id, {_embedded("documents.text")} AS v FROM documents))
"""
_EXCHANGES = """
n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, text AS question, answer FROM n WHERE role = 'user' AND next_role = 'assistant'),
last3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM x QUALIFY back <= 3)
"""
HISTORY = f"WITH {_EXCHANGES} SELECT conv_id, back, turn, question, substr(answer, 1, 200) || '...' AS answer FROM last3"
PROMPT_HISTORY = f"""
WITH {_EXCHANGES}, h AS (SELECT conv_id, string_agg('Q: ' || question || {NL} || 'A: ' || substr(answer, 1, 200) || '...', {NL} ORDER BY turn) AS past FROM last3 GROUP BY conv_id)
SELECT conv_id, concat_ws({NL}, {lit(SYSTEM)}, {lit(CONTENT)}, {lit(PAST)} || {NL} || past, {lit(QUESTION)} || 'And now?', {lit(ANSWER)}) AS prompt FROM h
"""
SESSION = f"WITH {_EXCHANGES} SELECT conv_id, count(*) AS n_queries FROM x GROUP BY conv_id"
SESSION_JSON = f"""
WITH {_EXCHANGES}
SELECT CAST(conv_id AS VARCHAR) AS session, 'none' AS model, count(*) OVER w AS total_queries, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, question, answer FROM x WINDOW w AS (PARTITION BY conv_id)
"""
DISPLAY = f"WITH {_HITS} SELECT query_id, rank, printf('%.2f%%', raw * 100) AS relevance, substr(coalesce(source, 'Unknown'), 1, 40) AS source FROM hits WHERE rank <= 3"
F1 = f"""
SELECT item_id, round(coalesce(2.0 * len(list_intersect(a, r)) / nullif(len(a) + len(r), 0), 0.0)::DOUBLE, 6) AS f1
FROM (SELECT item_id, list_distinct({words('d.text')}) AS a, list_distinct({words('b.text')}) AS r FROM benchmark b JOIN documents d ON doc_id = item_id)
"""
RELEVANCE = f"WITH {_HITS} SELECT query_id, round(avg(CASE WHEN hits.cluster_id = e.label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS relevance FROM hits JOIN embeddings e ON e.vec_id = query_id GROUP BY query_id"
_CLAIMS = f"""
{_HITS}, s AS (SELECT doc_id - 1 AS query_id, {sentences('text')} AS said FROM documents WHERE doc_id - 1 IN (SELECT query_id FROM asked WHERE query_id >= 0)),
claims AS (SELECT query_id, CAST(unnest(range(len(said))) AS INTEGER) AS claim, unnest(said) AS sentence FROM s),
own AS (SELECT DISTINCT query_id, claim, unnest({words('sentence')}) AS word FROM claims),
sizes AS (SELECT query_id, claim, count(*) AS n FROM own GROUP BY ALL),
held AS (SELECT DISTINCT query_id, rank, unnest({words('text')}) AS word FROM hits WHERE text IS NOT NULL),
rare AS (SELECT query_id, word FROM held WHERE length(word) > 3 GROUP BY ALL HAVING count(*) <= 3),
meet AS (SELECT query_id, claim, rank, count(*) AS shared, count(*) FILTER (rare.word IS NOT NULL) AS n_rare FROM own JOIN held USING (query_id, word) LEFT JOIN rare USING (query_id, word) GROUP BY ALL),
best AS (
  SELECT query_id, claim, rank, round(shared / n :: DOUBLE, 6) AS score FROM meet JOIN sizes USING (query_id, claim) WHERE n_rare > 0
  QUALIFY row_number() OVER (PARTITION BY query_id, claim ORDER BY score DESC, rank) = 1
)
"""
ALIGNED = f"WITH {_CLAIMS} SELECT query_id, claim, sentence, rank, coalesce(score, 0.0) AS score FROM claims LEFT JOIN best USING (query_id, claim)"
HALLUCINATION = f"WITH {_CLAIMS} SELECT query_id, count(*) AS n_claims, round(avg(CASE WHEN coalesce(score, 0.0) < 0.3 THEN 1.0 ELSE 0.0 END) :: DOUBLE, 6) AS unsupported FROM claims LEFT JOIN best USING (query_id, claim) GROUP BY query_id"
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TABLE_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns" for t in _TABLES)
READ_FILES = "SELECT how, item_id, text FROM benchmark, (SELECT unnest(['plain', 'decoded']) AS how)"
READ_QUESTIONS = f"SELECT {strip(f"replace(text, {NL}, ' ')")} AS question FROM benchmark"
