"""Scalar, predicate and admission queries over documents, pages, part and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift import constants as C
from logsift.catalog import register, sql_str
from logsift.functions import text as T
from logsift.operators.lines import split_lines
from logsift.operators.prompts import format_snippets, to_messages
from logsift.sources.requests import admit_by_request_budget, validate_artifacts
from logsift.plans.views import LOG_LINES_SQL, log_lines, table, texts, with_views

_NL = "chr(10)"


def _re(s: str) -> str:
    return sql_str(s)


# --- O11 redaction ------------------------------------------------------------------------------

_SAN_SQL = "text"
for _p, _r in T.REDACTIONS:
    _SAN_SQL = f"regexp_replace({_SAN_SQL}, {_re(_p)}, {sql_str(_r)}, 'gi')"


@register("sanitize_documents", f"""
SELECT doc_id, {_SAN_SQL} AS redacted, ({_SAN_SQL}) <> text AS changed FROM documents""")
def q_sanitize(spark, sf):
    d = texts(spark, sf)
    red = T.sanitize("text")
    return d.select("doc_id", red.alias("redacted"), (red != F.col("text")).alias("changed"))


# --- O12 -------------------------------------------------------------------------------------------

@register("strip_nulls", """
SELECT doc_id, length(replace(text, chr(0), '')) AS clean_chars FROM documents""")
def q_strip_nulls(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(T.strip_nulls("text")).alias("clean_chars"))


# --- O13 / O14 --------------------------------------------------------------------------------------

_SPLIT_SQL = f"""
WITH a AS (SELECT doc_id, string_split(text, {_NL}) AS arr FROM documents),
b AS (SELECT doc_id, CASE WHEN arr[len(arr)] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS arr FROM a)
SELECT doc_id AS artifact_id, CAST(generate_subscripts(arr, 1) AS BIGINT) AS line_no, unnest(arr) AS line FROM b"""


@register("split_lines_documents", _SPLIT_SQL)
def q_split_lines(spark, sf):
    return split_lines(texts(spark, sf), "doc_id", "text")


@register("starts_message_ll", with_views("""
SELECT artifact_id, line_no, NOT regexp_matches(line, '^[\\s|]') AS starts
FROM log_lines WHERE length(line) > 0""", LOG_LINES_SQL))
def q_starts_message(spark, sf):
    ll = log_lines(table(spark, sf, "events"))
    return ll.filter(F.length("line") > 0).select("artifact_id", "line_no",
                                                  T.starts_message("line").alias("starts"))


@register("line_stats_documents", f"""
WITH a AS (SELECT doc_id, string_split(text, {_NL}) AS arr FROM documents),
b AS (SELECT doc_id, CASE WHEN arr[len(arr)] = '' THEN arr[1:len(arr) - 1] ELSE arr END AS arr FROM a),
l AS (SELECT doc_id, unnest(arr) AS line FROM b)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE length(line) > 0 AND NOT regexp_matches(line, '^[\\s|]')) AS BIGINT) AS n_starts,
       CAST(max(length(line)) AS BIGINT) AS longest
FROM l GROUP BY doc_id""")
def q_line_stats(spark, sf):
    ln = split_lines(texts(spark, sf), "doc_id", "text")
    return ln.groupBy(F.col("artifact_id").alias("doc_id")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.count(F.when((F.length("line") > 0) & T.starts_message("line"), 1)).cast("bigint").alias("n_starts"),
        F.max(F.length("line")).cast("bigint").alias("longest"))


# --- O19 / O20 truncation ----------------------------------------------------------------------------

_N = C.DEFAULT_SNIPPET_LEN
_KEEP = _N - len(C.TRUNCATED)
_BORDER = (_N - len(C.TRUNCATE_MIDDLE)) // 2


@register("truncate_documents", f"""
SELECT doc_id,
  CASE WHEN length(text) > {_N} THEN left(text, {_KEEP}) || {sql_str(C.TRUNCATED)} ELSE text END AS head_cut,
  CASE WHEN length(text) > {_N} THEN left(text, {_BORDER}) || {sql_str(C.TRUNCATE_MIDDLE)} || right(text, {_BORDER})
       ELSE text END AS middle_cut
FROM documents""")
def q_truncate(spark, sf):
    d = texts(spark, sf)
    head = F.when(F.length("text") > _N, T.truncate_head("text", _N)).otherwise(F.col("text"))
    return d.select("doc_id", head.alias("head_cut"), T.truncate_middle("text", _N).alias("middle_cut"))


# --- O21 / O22 prompt assembly -------------------------------------------------------------------------

@register("format_conversations", f"""
WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i
           FROM conversations)
SELECT conv_id, {_NL} || string_agg('Snippet No. ' || CAST(i AS VARCHAR) || ' at line #' || CAST(turn AS VARCHAR)
       || ':' || {_NL} || {_NL} || text || {_NL} || {sql_str(C.SNIPPET_DELIMITER)} || {_NL} || {_NL}, '' ORDER BY turn)
       AS prompt
FROM t GROUP BY conv_id""")
def q_format(spark, sf):
    c = table(spark, sf, "conversations")
    return format_snippets(c, ["conv_id"], "turn", "text").withColumnRenamed("summary", "prompt")


_SYSTEM_PROMPT = "You explain build failures."


@register("messages_conversations", f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS msg_pos, role,
       {sql_str(_SYSTEM_PROMPT)} || {_NL} || text AS content FROM t WHERE role = 'user'
UNION ALL
SELECT conv_id, turn, CAST(0 AS INTEGER), 'user', {sql_str(_SYSTEM_PROMPT)} FROM t WHERE role <> 'user'
UNION ALL
SELECT conv_id, turn, CAST(1 AS INTEGER), role, text FROM t WHERE role <> 'user'""")
def q_messages(spark, sf):
    c = table(spark, sf, "conversations")
    m = to_messages(c, system_prompt=F.lit(_SYSTEM_PROMPT), user_message=F.col("text"),
                    system_role=F.lit("user"), user_role=F.col("role"))
    return m.select("conv_id", "turn", F.posexplode("messages").alias("msg_pos", "m")) \
        .select("conv_id", "turn", "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


# --- O23 / O03 on pages -----------------------------------------------------------------------------------

@register("close_tag_pages", """
SELECT page_id, regexp_matches(html, '(?s)^</[^<]+>') AS leading_close_tag,
       CASE WHEN regexp_matches(html, '(?s)^</[^<]+>') THEN NULL ELSE length(html) END AS kept_chars
FROM pages""")
def q_close_tag(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.has_leading_close_tag("html").alias("leading_close_tag"),
                    F.length(T.drop_leading_close_tag("html")).alias("kept_chars"))


_URL_SQL = """
WITH u AS (SELECT page_id, url, regexp_matches(url, '(?is)^https?:') AS scheme_ok,
                  regexp_extract(url, '(?is)^https?:(.*)$', 1) AS rest FROM pages),
f AS (SELECT *, regexp_matches(rest, '(?s)^[^#]*#.') AS frag, regexp_extract(rest, '(?s)^([^#]*)', 1) AS bf FROM u),
q AS (SELECT *, regexp_matches(bf, '(?s)^[^?]*\\?.') AS query, regexp_extract(bf, '(?s)^([^?]*)', 1) AS bq FROM f),
n AS (SELECT *, CASE WHEN starts_with(bq, '//') THEN regexp_extract(bq, '(?s)^//([^/]*)', 1) ELSE '' END AS netloc,
             CASE WHEN starts_with(bq, '//') THEN regexp_extract(bq, '(?s)^//[^/]*(.*)$', 1) ELSE bq END AS path FROM q)
SELECT page_id, url,
       COALESCE(scheme_ok AND NOT frag AND NOT query AND NOT regexp_matches(path, '(?s)(?:^|/)[^/;]*;[^/]+$')
                AND (netloc <> '' OR path <> ''), FALSE) AS valid
FROM n"""


@register("valid_log_url_pages", _URL_SQL)
def q_url(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", T.is_valid_log_url("url").alias("valid"))


# --- O26 eligibility on part names ---------------------------------------------------------------------------

ALLOW = ["widget", "gear", "^blue"]
DENY = ["^red ", "small"]


@register("eligible_parts", f"""
SELECT p_partkey, p_name,
  COALESCE(({' OR '.join(f'regexp_matches(p_name, {sql_str(a)})' for a in ALLOW)})
           AND NOT ({' OR '.join(f'regexp_matches(p_name, {sql_str(d)})' for d in DENY)}), FALSE) AS eligible
FROM part""")
def q_eligible(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_name", T.is_eligible("p_name", ALLOW, DENY).alias("eligible"))


# --- O29 response length ------------------------------------------------------------------------------------

@register("response_length_conversations", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END AS response_length
FROM conversations""")
def q_response_length(spark, sf):
    c = table(spark, sf, "conversations")
    expl = F.when(F.col("role") == "assistant", F.col("text"))
    return c.select("conv_id", "turn", T.response_length(expl).alias("response_length"))


# --- O04 / O05 / O06 admission --------------------------------------------------------------------------------

SIZE_LIMIT = 60_000


@register("declared_size_documents", f"""
WITH h AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS cl
           FROM documents)
SELECT doc_id,
  CASE WHEN cl IS NULL THEN FALSE WHEN TRY_CAST(cl AS BIGINT) IS NULL THEN FALSE
       ELSE TRY_CAST(cl AS BIGINT) <= {SIZE_LIMIT} END AS proceed,
  TRY_CAST(cl AS BIGINT) AS size_in_bytes
FROM h""")
def q_declared_size(spark, sf):
    d = table(spark, sf, "documents")
    cl = (F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
          .when(F.col("doc_id") % 5 == 1, F.lit("n/a"))
          .otherwise(F.col("n_chars").cast("string")))
    s = T.admit_by_declared_size(cl, SIZE_LIMIT, require_header=True)
    return d.select("doc_id", s["proceed"].alias("proceed"), s["size_in_bytes"].alias("size_in_bytes"))


BUDGET = 400_000


@register("request_budget_documents", f"""
WITH f AS (SELECT source AS request_id, doc_id, n_chars, doc_id % 2 = 0 AS is_url FROM documents),
r AS (SELECT request_id, sum(CASE WHEN NOT is_url THEN n_chars ELSE 0 END) AS request_size FROM f GROUP BY 1),
u AS (SELECT f.request_id, f.doc_id, f.n_chars, r.request_size,
             coalesce(sum(f.n_chars) OVER (PARTITION BY f.request_id ORDER BY f.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM f JOIN r USING (request_id) WHERE f.is_url)
SELECT request_id, doc_id, CAST({BUDGET} - request_size - before AS BIGINT) AS remaining_limit,
       ({BUDGET} - request_size - before) > 0 AND n_chars <= ({BUDGET} - request_size - before) AS admitted
FROM u""")
def q_budget(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("request_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"),
        (F.col("doc_id") % 2 == 0).alias("is_url"))
    return admit_by_request_budget(d, BUDGET).select("request_id", F.col("pos").alias("doc_id"), "remaining_limit", "admitted")


@register("validate_pages", f"""
WITH a AS (SELECT CAST(page_id // 20 AS BIGINT) AS request_id, page_id AS pos,
                  regexp_extract(url, '([^/#?]*)(?:[#?].*)?$', 1) AS artifact_name,
                  CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS content,
                  CASE WHEN page_id % 3 <> 1 THEN url END AS url FROM pages),
c AS (SELECT request_id, count(*) AS n FROM a GROUP BY 1),
d AS (SELECT request_id, artifact_name, count(*) AS n FROM a GROUP BY 1, 2),
v AS (
  SELECT request_id, pos, 'bad_name' AS violation FROM a
   WHERE NOT (length(artifact_name) BETWEEN 1 AND 255 AND regexp_matches(artifact_name, {sql_str(C.ARTIFACT_NAME_RE)}))
  UNION ALL SELECT request_id, pos, 'content_xor_url' FROM a WHERE (content IS NULL) = (url IS NULL)
  UNION ALL SELECT a.request_id, a.pos, 'file_count' FROM a JOIN c USING (request_id) WHERE c.n > {C.MAX_FILES_PER_REQUEST}
  UNION ALL SELECT a.request_id, a.pos, 'duplicate_name' FROM a JOIN d USING (request_id, artifact_name) WHERE d.n > 1)
SELECT request_id, pos, violation FROM v""")
def q_validate(spark, sf):
    p = table(spark, sf, "pages")
    a = p.select((F.col("page_id") / 20).cast("bigint").alias("request_id"), F.col("page_id").alias("pos"),
                 F.regexp_extract("url", "([^/#?]*)(?:[#?].*)?$", 1).alias("artifact_name"),
                 F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.col("html")).alias("content"),
                 F.when(F.col("page_id") % 3 != 1, F.col("url")).alias("url"))
    return validate_artifacts(a)


# --- O08 archive dates derived from event days -------------------------------------------------------------------

TODAY = "2024-03-15"


@register("archive_dates_events", f"""
WITH n AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'results-' ELSE 'results-since-' END
                  || strftime(ts, '%Y-%m-%d') || '.tar.gz' AS archive FROM events)
SELECT archive, CAST(regexp_extract(archive, {sql_str(C.ARCHIVE_DATE_RE)}, 1) AS DATE) AS archive_date,
       date_diff('day', CAST(regexp_extract(archive, {sql_str(C.ARCHIVE_DATE_RE)}, 1) AS DATE), DATE '{TODAY}')
         > {C.ARCHIVE_MAX_AGE_DAYS} AS stale
FROM n""")
def q_archive_dates(spark, sf):
    from logsift.sources.contributions import archive_date, is_stale
    e = table(spark, sf, "events")
    n = e.select(F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("results-")).otherwise(F.lit("results-since-")),
                          F.date_format("ts", "yyyy-MM-dd"), F.lit(".tar.gz")).alias("archive")).distinct()
    return n.select("archive", archive_date("archive").alias("archive_date"),
                    is_stale(archive_date("archive"), F.lit(TODAY).cast("date")).alias("stale"))
