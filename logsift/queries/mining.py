"""Message assembly, noise, templates, representatives, diagnostics and extract-all over
``log_lines`` (and ``documents``)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from logsift import constants as C
from logsift.catalog import noise_sql, register, sql_str
from logsift.functions.text import sanitize
from logsift.operators.diagnostics import LOCATED_ERROR_RE, TOOL_ERROR_RE, compiler_errors
from logsift.operators.extract import attach_analysis, extract_fused, remaining_artifacts
from logsift.operators.lines import assemble_messages, split_lines
from logsift.operators.noise import drop_noise
from logsift.operators.prompts import compression_ratio, format_snippets
from logsift.operators.templates import cluster_templates, latest_clusters, mine_templates, representative_snippets
from logsift.operators.tracebacks import python_tracebacks
from logsift.plans.views import LOG_LINES_SQL, log_lines, table, texts, with_views
from logsift.queries.extraction import TRACEBACKS_SQL

K = C.DEFAULT_MAX_CLUSTERS
N = C.DEFAULT_SNIPPET_LEN


def ll_source(ll):
    """Build logs of every third user are named ``mock_output.log`` (file-scoped noise rules)."""
    return ll.withColumn("source_file", F.when(F.col("artifact_id") % 3 == 0, F.lit("mock_output.log"))
                         .otherwise(F.lit("build.log")))


_SRC_SQL = "CASE WHEN artifact_id % 3 = 0 THEN 'mock_output.log' ELSE 'build.log' END"


# --- SQL fragments -----------------------------------------------------------------------------------

def _re2_mask_steps():
    """RE2 (no lookaround) form of each mask rule: (pattern, replacement, passes, placeholder).

    Lookarounds become captured boundary characters that are written back. A boundary consumed
    by one match hides the next match, so a second pass runs; during both passes a match is
    written as a placeholder ending in a letter, so the second pass sees an alphanumeric left
    neighbour exactly where the Java lookbehind saw the last digit of the previous match.
    """
    pre, post = "((?<=[^A-Za-z0-9])|^)", "((?=[^A-Za-z0-9])|$)"
    steps = []
    for pattern, tag in C.MASK_RULES:
        rep = C.MASK_PREFIX + tag + C.MASK_SUFFIX
        if pattern.startswith(pre) and pattern.endswith(post):
            core = re.sub(r"\((?!\?)", "(?:", pattern[len(pre):-len(post)])
            ph = "\x01" + tag + "x"
            steps.append(("(^|[^A-Za-z0-9])(?:" + core + ")([^A-Za-z0-9]|$)", "\\1" + ph + "\\2", 2, (ph, rep)))
        elif pattern.startswith("(?<="):
            close = pattern.index(")")
            look = pattern[4:close]
            core = re.sub(r"\((?!\?)", "(?:", pattern[close + 1:])
            steps.append(("(" + look + ")(?:" + core + ")", "\\1" + rep, 1, None))
        else:
            steps.append((pattern, rep, 1, None))
    return steps


def mask_sql(expr: str) -> str:
    out = expr
    for pattern, rep, passes, ph in _re2_mask_steps():
        for _ in range(passes):
            out = f"regexp_replace({out}, {sql_str(pattern)}, {sql_str(rep)}, 'g')"
        if ph:
            out = f"replace({out}, {sql_str(ph[0])}, {sql_str(ph[1])})"
    return out


def template_sql(expr: str) -> str:
    toks = (f"list_filter(regexp_split_to_array(regexp_replace(replace({mask_sql(expr)}, '_', ' '), "
            f"'^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '')")
    return (f"array_to_string(list_transform({toks}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') "
            f"THEN {sql_str(C.WILDCARD)} ELSE t END), ' ')")


CHUNKS_SQL = f"""
ne AS (SELECT artifact_id, line_no, line, CASE WHEN regexp_matches(line, '^[\\s|]') THEN 0 ELSE 1 END AS st
       FROM log_lines WHERE length(line) > 0),
isl AS (SELECT *, sum(st) OVER (PARTITION BY artifact_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM ne),
chunks AS (SELECT artifact_id, CAST(min(line_no) AS BIGINT) AS line_number,
                  string_agg(line, chr(10) ORDER BY line_no) AS text FROM isl GROUP BY artifact_id, island),
kept AS (SELECT *, {_SRC_SQL} AS source_file FROM chunks),
filtered AS (SELECT artifact_id, line_number, text FROM kept
             WHERE NOT {noise_sql('text', C.DEFAULT_NOISE_RULES, 'source_file')}),
mined AS (SELECT artifact_id, line_number, text, {template_sql('text')} AS template FROM filtered),
per AS (SELECT artifact_id, template, arg_min(line_number, line_number) AS line_number,
               arg_min(text, line_number) AS text, max(line_number) AS last_seen FROM mined GROUP BY 1, 2),
reps AS (SELECT artifact_id, line_number, text FROM (
           SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY last_seen DESC) AS rk FROM per) WHERE rk <= {K})
"""

_LOC, _TOOL = sql_str(LOCATED_ERROR_RE), sql_str(TOOL_ERROR_RE)
DIAG_SQL = f"""
dl AS (SELECT artifact_id, line_no, line,
              regexp_matches(line, '^[ \\t]') AND regexp_matches(line, '\\S') AS is_cont FROM log_lines),
di AS (SELECT *, sum(CASE WHEN is_cont THEN 0 ELSE 1 END) OVER (PARTITION BY artifact_id ORDER BY line_no
                 ROWS UNBOUNDED PRECEDING) AS island FROM dl),
dh AS (SELECT artifact_id, island, line_no,
              CASE WHEN regexp_matches(line, {_LOC}) THEN regexp_extract(line, {_LOC}, 1)
                   ELSE regexp_extract(line, {_TOOL}, 1) END AS file_name,
              CASE WHEN regexp_matches(line, {_LOC}) THEN CAST(regexp_extract(line, {_LOC}, 2) AS INTEGER)
                   ELSE 0 END AS src_line,
              CASE WHEN regexp_matches(line, {_LOC}) THEN regexp_extract(line, {_LOC}, 4)
                   ELSE regexp_extract(line, {_TOOL}, 2) END AS message
       FROM di WHERE regexp_matches(line, {_LOC}) OR regexp_matches(line, {_TOOL})),
dc AS (SELECT artifact_id, island, string_agg(line, chr(10) ORDER BY line_no) AS conts FROM di WHERE is_cont GROUP BY 1, 2),
dd AS (SELECT dh.artifact_id, dh.file_name, dh.src_line, CAST(dh.line_no AS BIGINT) AS line_number,
              CASE WHEN dc.conts IS NULL THEN dh.message ELSE dh.message || chr(10) || dc.conts END AS text
       FROM dh LEFT JOIN dc USING (artifact_id, island)),
diag AS (SELECT artifact_id, file_name, src_line, min(line_number) AS line_number, text
         FROM dd GROUP BY artifact_id, file_name, src_line, text)
"""


# --- Spark building blocks --------------------------------------------------------------------------

def ll_chunks(spark, sf):
    return assemble_messages(log_lines(table(spark, sf, "events")), N)


def ll_representatives(spark, sf):
    chunks = ll_source(ll_chunks(spark, sf))
    filtered = drop_noise(chunks, C.DEFAULT_NOISE_RULES, source_file="source_file")
    return representative_snippets(mine_templates(filtered.drop("source_file")), K)


def drain_extractor(lines):
    chunks = ll_source(assemble_messages(lines, N))
    filtered = drop_noise(chunks, C.DEFAULT_NOISE_RULES, source_file="source_file").drop("source_file")
    return representative_snippets(mine_templates(filtered), K)


def csgrep_extractor(lines):
    d = compiler_errors(lines).select("artifact_id", "line_number", "text")
    d = drop_noise(ll_source(d), C.DEFAULT_NOISE_RULES, source_file="source_file").drop("source_file")
    return representative_snippets(mine_templates(d), K)


def traceback_extractor(lines):
    return python_tracebacks(lines, N)


# --- registrations --------------------------------------------------------------------------------

@register("chunks_ll", with_views(",\n" + CHUNKS_SQL.split("kept AS")[0].rstrip().rstrip(",") + """
SELECT artifact_id, line_number, text FROM chunks""", LOG_LINES_SQL))
def q_chunks_ll(spark, sf):
    return ll_chunks(spark, sf)


@register("chunks_documents", f"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents),
b AS (SELECT doc_id, CASE WHEN arr[len(arr)] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS arr FROM a),
l AS (SELECT doc_id, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line FROM b)
SELECT doc_id AS artifact_id, CAST(line_no AS BIGINT) AS line_number,
       CASE WHEN length(line) > {N} THEN left(line, {N - len(C.TRUNCATED)}) || {sql_str(C.TRUNCATED)} ELSE line END AS text
FROM l WHERE length(line) > 0""")
def q_chunks_documents(spark, sf):
    return assemble_messages(split_lines(texts(spark, sf), "doc_id", "text"), N)


@register("noise_filtered_ll", with_views(",\n" + CHUNKS_SQL.split("mined AS")[0].rstrip().rstrip(",") + """
SELECT artifact_id, line_number, text FROM filtered""", LOG_LINES_SQL))
def q_noise_ll(spark, sf):
    chunks = ll_source(ll_chunks(spark, sf))
    return drop_noise(chunks, C.DEFAULT_NOISE_RULES, source_file="source_file").drop("source_file")


@register("templates_ll", with_views(",\n" + CHUNKS_SQL.split("per AS")[0].rstrip().rstrip(",") + """
SELECT artifact_id, template, CAST(count(*) AS BIGINT) AS n, min(line_number) AS first_line,
       max(line_number) AS last_line FROM mined GROUP BY 1, 2""", LOG_LINES_SQL))
def q_templates_ll(spark, sf):
    chunks = ll_source(ll_chunks(spark, sf))
    filtered = drop_noise(chunks, C.DEFAULT_NOISE_RULES, source_file="source_file").drop("source_file")
    return mine_templates(filtered).groupBy("artifact_id", "template").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"))


SIMILAR_SQL = CHUNKS_SQL + f""",
sig AS (SELECT *, string_split(template, ' ') AS toks, len(string_split(template, ' ')) AS size,
               string_split(template, ' ')[1] AS head
        FROM (SELECT artifact_id, template, min(line_number) AS line_number, arg_min(text, line_number) AS text,
                     max(line_number) AS last_seen, count(*) AS n FROM mined GROUP BY 1, 2)),
rounds AS (
  SELECT *, CAST(NULL AS VARCHAR) AS lead FROM sig
  UNION ALL
  SELECT artifact_id, template, line_number, text, last_seen, n, toks, size, head,
         CASE WHEN template = lt OR len(list_filter(range(1, size + 1), lambda i: toks[i] = ltoks[i] AND toks[i] <> {sql_str(C.WILDCARD)}))
                   >= size * {C.TEMPLATE_SIM_TH} THEN lt END
  FROM (SELECT *, first_value(template) OVER w AS lt, first_value(toks) OVER w AS ltoks FROM rounds WHERE lead IS NULL
        WINDOW w AS (PARTITION BY artifact_id, size, head ORDER BY line_number))),
places AS (SELECT artifact_id, lead, i, min(toks[i]) AS low, max(toks[i]) AS high
           FROM (SELECT artifact_id, lead, toks, unnest(range(1, size + 1)) AS i FROM rounds WHERE lead IS NOT NULL) GROUP BY 1, 2, 3),
merged AS (SELECT artifact_id, lead, string_agg(CASE WHEN low = high THEN low ELSE {sql_str(C.WILDCARD)} END, ' ' ORDER BY i) AS template
           FROM places GROUP BY 1, 2),
clusters AS (SELECT artifact_id, any_value(merged.template) AS template, min(line_number) AS line_number, arg_min(text, line_number) AS text,
                    max(last_seen) AS last_seen, CAST(sum(n) AS BIGINT) AS n
             FROM rounds JOIN merged USING (artifact_id, lead) GROUP BY artifact_id, lead)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("templates_similarity_ll", _recursive(with_views(",\n" + SIMILAR_SQL + """
SELECT artifact_id, template, n, line_number AS first_line, last_seen AS last_line FROM clusters""", LOG_LINES_SQL)))
def q_templates_similarity(spark, sf):
    chunks = ll_source(ll_chunks(spark, sf))
    filtered = drop_noise(chunks, C.DEFAULT_NOISE_RULES, source_file="source_file").drop("source_file")
    return cluster_templates(mine_templates(filtered)).select(
        "artifact_id", "template", "n", F.col("line_number").alias("first_line"), F.col("last_seen").alias("last_line"))


@register("representatives_similarity_ll", _recursive(with_views(",\n" + SIMILAR_SQL + f"""
SELECT artifact_id, line_number, text FROM (
  SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY last_seen DESC) AS rk FROM clusters) WHERE rk <= {K}""", LOG_LINES_SQL)))
def q_reps_similarity(spark, sf):
    chunks = ll_source(ll_chunks(spark, sf))
    filtered = drop_noise(chunks, C.DEFAULT_NOISE_RULES, source_file="source_file").drop("source_file")
    return latest_clusters(cluster_templates(mine_templates(filtered)), K)


@register("mask_documents", f"""
SELECT doc_id, {mask_sql('text')} AS masked FROM documents""")
def q_mask_documents(spark, sf):
    from logsift.functions.text import mask_column
    return mask_column(texts(spark, sf).select("doc_id", "text"), "text", "masked").drop("text")


@register("representatives_ll", with_views(",\n" + CHUNKS_SQL + """
SELECT artifact_id, line_number, text FROM reps""", LOG_LINES_SQL))
def q_reps_ll(spark, sf):
    return ll_representatives(spark, sf)


@register("format_representatives_ll", with_views(",\n" + CHUNKS_SQL + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY line_number) - 1 AS i FROM reps)
SELECT artifact_id, chr(10) || string_agg('Snippet No. ' || CAST(i AS VARCHAR) || ' at line #'
       || CAST(line_number AS VARCHAR) || ':' || chr(10) || chr(10) || text || chr(10)
       || {sql_str(C.SNIPPET_DELIMITER)} || chr(10) || chr(10), '' ORDER BY line_number) AS summary
FROM t GROUP BY artifact_id""", LOG_LINES_SQL))
def q_format_reps(spark, sf):
    return format_snippets(ll_representatives(spark, sf), ["artifact_id"])


@register("compiler_errors_ll", with_views(",\n" + DIAG_SQL + """
SELECT artifact_id, file_name, src_line, line_number, text FROM diag""", LOG_LINES_SQL))
def q_compiler_errors(spark, sf):
    return compiler_errors(log_lines(table(spark, sf, "events")))


_EXTRACT_ALL_SQL = with_views(",\n" + CHUNKS_SQL + ",\n" + DIAG_SQL + f""",
dsrc AS (SELECT artifact_id, line_number, text, {_SRC_SQL} AS source_file FROM diag),
dfil AS (SELECT artifact_id, line_number, text FROM dsrc
         WHERE NOT {noise_sql('text', C.DEFAULT_NOISE_RULES, 'source_file')}),
dmined AS (SELECT *, {template_sql('text')} AS template FROM dfil),
dper AS (SELECT artifact_id, template, arg_min(line_number, line_number) AS line_number,
                arg_min(text, line_number) AS text, max(line_number) AS last_seen FROM dmined GROUP BY 1, 2),
dreps AS (SELECT artifact_id, line_number, text FROM (
            SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY last_seen DESC) AS rk FROM dper)
          WHERE rk <= {K}),
tb AS ({TRACEBACKS_SQL.replace("WITH " + LOG_LINES_SQL.strip() + ",", "WITH ", 1)}),
allsn AS (SELECT artifact_id, 'drain' AS extractor, line_number, text FROM reps
          UNION ALL SELECT artifact_id, 'csgrep', line_number, text FROM dreps
          UNION ALL SELECT artifact_id, 'python_traceback', line_number, text FROM tb)
""", LOG_LINES_SQL)

EXTRACTORS = {"drain": drain_extractor, "csgrep": csgrep_extractor, "python_traceback": traceback_extractor}


@register("extract_all_ll", _EXTRACT_ALL_SQL + "SELECT artifact_id, extractor, line_number, text FROM allsn")
def q_extract_all(spark, sf):
    return extract_fused(ll_source(log_lines(table(spark, sf, "events"))), K, N, keep=("source_file",), source_file="source_file")


@register("compression_ratio_ll", _EXTRACT_ALL_SQL + """,
lg AS (SELECT artifact_id, sum(length(line)) + count(*) - 1 AS log_chars FROM log_lines GROUP BY 1),
sn AS (SELECT artifact_id, sum(length(text)) + count(*) - 1 AS snippet_chars FROM allsn GROUP BY 1)
SELECT lg.artifact_id, round(CAST(coalesce(sn.snippet_chars, 0) AS DOUBLE)
       / CASE WHEN lg.log_chars > 0 THEN lg.log_chars END, 6) AS ratio
FROM lg LEFT JOIN sn USING (artifact_id)""")
def q_ratio(spark, sf):
    ll = log_lines(table(spark, sf, "events"))
    snippets = extract_fused(ll_source(ll), K, N, keep=("source_file",), source_file="source_file")
    logs = ll.groupBy("artifact_id").agg(
        (F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("log_chars"))
    return compression_ratio(snippets, logs).select("artifact_id", F.round("ratio", 6).alias("ratio"))


# --- O37 / O38 over documents and labels ---------------------------------------------------------------

@register("remaining_documents", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_remaining(spark, sf):
    return remaining_artifacts(table(spark, sf, "documents").select("doc_id", "source"),
                               table(spark, sf, "labels").select("doc_id"), "doc_id")


def _snippets(spark, sf):
    """Documents as snippets: the language is the request, few file names occur in every request."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("request_id"), F.concat(F.lit("log"), (F.col("doc_id") % 5).cast("string")).alias("source_file"),
        F.floor(F.col("doc_id") / 25).cast("bigint").alias("line_number"), "n_chars")


def _analyses(spark, sf):
    lab = table(spark, sf, "labels").filter(F.col("doc_id") % 11 != 0)
    at = [F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "xx")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("request_id"),
          F.concat(F.lit("log"), (F.col("doc_id") % 6).cast("string")).alias("source_file"),
          F.floor(F.col("doc_id") / 25).cast("bigint").alias("line_number")]
    a = lab.select(F.col("doc_id").alias("analysis_id"), *at,
                   F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("snippet_analysis"))
    again = lab.filter(F.col("toxic") == 1).select((F.col("doc_id") + 1_000_000_000).alias("analysis_id"), *at,
                                                   F.lit("toxic").alias("snippet_analysis"))
    return a.unionByName(again)


_AT_SQL = """['en', 'de', 'fr', 'xx'][CAST(doc_id % 4 AS INTEGER) + 1] AS request_id,
           'log' || CAST(doc_id % 6 AS VARCHAR) AS source_file, CAST(doc_id // 25 AS BIGINT) AS line_number"""

_ANALYSES_SQL = f"""
WITH l AS (SELECT * FROM labels WHERE doc_id % 11 <> 0),
a AS (SELECT doc_id AS analysis_id, {_AT_SQL}, 'quality ' || CAST(quality AS VARCHAR) AS snippet_analysis FROM l
      UNION ALL
      SELECT doc_id + 1000000000, {_AT_SQL}, 'toxic' FROM l WHERE toxic = 1),
s AS (SELECT lang AS request_id, 'log' || CAST(doc_id % 5 AS VARCHAR) AS source_file,
             CAST(doc_id // 25 AS BIGINT) AS line_number, n_chars FROM documents),
k AS (SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM s WHERE s.request_id = a.request_id AND s.source_file = a.source_file
                                      AND s.line_number = a.line_number)),
f AS (SELECT request_id, source_file, line_number, min(analysis_id) AS analysis_id,
             arg_min(snippet_analysis, analysis_id) AS snippet_analysis FROM k GROUP BY 1, 2, 3)
"""


@register("attach_analysis_documents", _ANALYSES_SQL + """
SELECT request_id, source_file, line_number, s.n_chars, f.snippet_analysis
FROM s LEFT JOIN f USING (request_id, source_file, line_number)""")
def q_attach(spark, sf):
    analysed, _ = attach_analysis(_snippets(spark, sf), _analyses(spark, sf))
    return analysed


@register("attach_analysis_rejects", _ANALYSES_SQL + """
SELECT analysis_id, 'unknown_file' AS reason FROM a WHERE (request_id, source_file) NOT IN (SELECT (request_id, source_file) FROM s)
UNION ALL
SELECT analysis_id, 'unknown_line' FROM a WHERE (request_id, source_file) IN (SELECT (request_id, source_file) FROM s)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.request_id = a.request_id AND s.source_file = a.source_file AND s.line_number = a.line_number)
UNION ALL
SELECT analysis_id, 'already_analyzed' FROM k WHERE analysis_id NOT IN (SELECT analysis_id FROM f)""")
def q_attach_rejects(spark, sf):
    _, rejects = attach_analysis(_snippets(spark, sf), _analyses(spark, sf))
    return rejects


_SAN = "line"
for _p, _r in __import__("logsift.functions.text", fromlist=["REDACTIONS"]).REDACTIONS:
    _SAN = f"regexp_replace({_SAN}, {sql_str(_p)}, {sql_str(_r)}, 'gi')"


@register("sanitize_ll", with_views(f"""
SELECT artifact_id, line_no, {_SAN} AS redacted FROM log_lines WHERE {_SAN} <> line""", LOG_LINES_SQL))
def q_sanitize_ll(spark, sf):
    ll = log_lines(table(spark, sf, "events"))
    return ll.select("artifact_id", "line_no", sanitize("line").alias("redacted"), "line") \
        .filter(F.col("redacted") != F.col("line")).drop("line")
