"""Annotation corpus and similarity queries over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift import constants as C
from logsift.catalog import ORACLE, noise_sql, register
from logsift.operators import corpus as K
from logsift.operators.diagnostics import compiler_errors, read_diagnostic_reports, report_snippets
from logsift.plans.views import LOG_LINES_SQL, log_lines, table, with_views
from logsift.queries.mining import DIAG_SQL, _SRC_SQL, ll_source
from logsift.sources.contributions import parse_contributions

TOPK = 3


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


_DIST = ("sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), "
         "lambda x: (x[1] - x[2]) * (x[1] - x[2]))))")


@register("nearest_embeddings", f"""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 = 0),
c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 <> 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST} AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOPK}""")
def q_nearest(spark, sf):
    e = _emb(spark, sf)
    q = e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding"))
    c = e.filter(F.col("vec_id") % 5 != 0).select(F.col("vec_id").alias("id"), F.col("embedding"))
    out = K.nearest_snippets(q, c, TOPK, qid="query_id", cid="id", vec_col="embedding")
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


@register("nearest_one_embedding", f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
d AS (SELECT c.vec_id, c.label, {_DIST} AS distance FROM embeddings c, q)
SELECT vec_id, label, round(distance, 6) AS distance FROM d ORDER BY distance, vec_id LIMIT 5""")
def q_nearest_one(spark, sf):
    e = _emb(spark, sf)
    first = e.orderBy("vec_id").select("embedding").limit(1).collect()[0]["embedding"]
    out = K.nearest_one(list(first), e, 5, id_col="vec_id", vec_col="embedding", max_k=None)
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@register("nearest_embeddings_pivots", ORACLE["nearest_embeddings"])
def q_nearest_pivots(spark, sf):
    """The exact lookup with 16 pivots: rows lie in cells that queries meet or skip."""
    e = _emb(spark, sf)
    q = e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.filter(F.col("vec_id") % 5 != 0).select(F.col("vec_id").alias("id"), "embedding")
    out = K.nearest_snippets(q, c, TOPK, qid="query_id", cid="id", vec_col="embedding", pivots=16)
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


@register("nearest_embeddings_approx")
def q_nearest_approx(spark, sf):
    e = _emb(spark, sf)
    q = e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.filter(F.col("vec_id") % 5 != 0).select(F.col("vec_id").alias("id"), "embedding")
    return K.nearest_snippets_approx(q, c, TOPK, qid="query_id", cid="id", vec_col="embedding")


@register("nearest_embeddings_approx_quality")
def q_nearest_approx_quality(spark, sf):
    e = _emb(spark, sf)
    q = e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.filter(F.col("vec_id") % 5 != 0).select(F.col("vec_id").alias("id"), "embedding")
    return K.probe_quality(q, c, TOPK, vec_col="embedding")


@register("embed_documents")
def q_embed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return K.embed(d, "text", dim=C.EMBEDDING_DIM).select("doc_id", F.size("text_embedding").alias("dim"),
                                                          "text_embedding")


def _batch(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("results/results/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 300).cast("string"),
                    F.lit(".json"))
    snip = F.array(F.struct(F.lit("build.log").alias("log_name"), F.col("text").alias("text"),
                            F.col("source").alias("user_comment")),
                   F.struct(F.lit("root.log").alias("log_name"), F.col("source").alias("text"),
                            F.col("lang").alias("user_comment")))
    return d.select(F.col("doc_id").alias("seq"), path.alias("source_path"),
                    F.concat(F.lit("failure in "), F.col("source")).alias("fail_reason"),
                    F.col("lang").alias("how_to_fix"),
                    F.when(F.col("doc_id") % 3 == 0, F.slice(snip, 1, 1)).otherwise(snip).alias("snippets"))


_BATCH_SQL = """
WITH bt AS (SELECT doc_id AS seq, 'results/results/' || source || '/' || CAST(doc_id % 300 AS VARCHAR) || '.json' AS source_path,
                   CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_snippets, text, source, lang FROM documents),
ex AS (SELECT source_path FROM bt WHERE seq % 11 = 0),
first AS (SELECT source_path, min(seq) AS seq FROM bt GROUP BY 1),
new AS (SELECT f.source_path, f.seq, b.n_snippets, b.text, b.source, b.lang FROM first f JOIN bt b USING (seq)
        WHERE f.source_path NOT IN (SELECT source_path FROM ex))
"""


@register("insert_new_builds_documents", _BATCH_SQL + "SELECT source_path, seq FROM new")
def q_insert_new(spark, sf):
    b = _batch(spark, sf)
    existing = b.filter(F.col("seq") % 11 == 0).select("source_path")
    builds, _ = K.insert_new_builds(existing, b)
    return builds.select("source_path", "seq")


@register("insert_new_snippets_documents", _BATCH_SQL + """
SELECT source_path, 0 AS pos, 'build.log' AS source_artifact_name, text, source AS annotation FROM new
UNION ALL
SELECT source_path, 1, 'root.log', source, lang FROM new WHERE n_snippets = 2""")
def q_insert_new_snippets(spark, sf):
    b = _batch(spark, sf)
    existing = b.filter(F.col("seq") % 11 == 0).select("source_path")
    return K.insert_new_builds(existing, b)[1]


@register("run_report_documents", _BATCH_SQL + """
SELECT CAST((SELECT count(*) FROM bt) AS BIGINT) AS processed, CAST(count(*) AS BIGINT) AS added,
       CAST(coalesce(sum(n_snippets), 0) AS BIGINT) AS snippets,
       CAST((SELECT count(*) FROM bt) - count(*) AS BIGINT) AS skipped FROM new""")
def q_run_report(spark, sf):
    b = _batch(spark, sf)
    existing = b.filter(F.col("seq") % 11 == 0).select("source_path")
    builds, _ = K.insert_new_builds(existing, b)
    return K.run_report(b, builds)


def _raw_contrib(spark, sf):
    d = table(spark, sf, "documents")
    s, lang = F.col("source"), F.col("lang")
    good = F.concat(F.lit('{"fail_reason": "failure in '), s, F.lit('", "how_to_fix": "'), lang,
                    F.lit('", "logs": {"build.log": {"snippets": [{"text": "'), s,
                    F.lit('", "user_comment": "c"}, {"text": "x"}, 7, {"text": "", "user_comment": "d"}]}, '
                          '"root.log": "junk"}}'))
    raw = (F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit('{"fail_reason": {"text": "'), s,
                                                         F.lit('"}, "how_to_fix": "x", "logs": {}}')))
           .when(F.col("doc_id") % 6 == 1, F.concat(F.lit('{"fail_reason": "'), s))
           .when(F.col("doc_id") % 6 == 2, good)
           .when(F.col("doc_id") % 6 == 3, F.concat(F.lit('{"fail_reason": "a", "how_to_fix": "'), lang,
                                                    F.lit('", "logs": ["build.log"]}')))
           .when(F.col("doc_id") % 6 == 4, F.concat(F.lit('{"fail_reason": "a", "how_to_fix": "b", "logs": '
                                                          '{"x.log": {"snippets": [{"text": "'), s,
                                                    F.lit('", "user_comment": ""}]}}}')))
           .otherwise(F.concat(F.lit('[{"fail_reason": "'), s, F.lit('"}]'))))
    return d.select(F.concat(F.lit("results/results/"), F.col("doc_id").cast("string"), F.lit(".json"))
                    .alias("source_path"), raw.alias("raw"))


_RAW_SQL = """
WITH d AS (SELECT 'results/results/' || CAST(doc_id AS VARCHAR) || '.json' AS source_path, CASE doc_id % 6
  WHEN 0 THEN '{"fail_reason": {"text": "' || source || '"}, "how_to_fix": "x", "logs": {}}'
  WHEN 1 THEN '{"fail_reason": "' || source
  WHEN 2 THEN '{"fail_reason": "failure in ' || source || '", "how_to_fix": "' || lang
              || '", "logs": {"build.log": {"snippets": [{"text": "' || source
              || '", "user_comment": "c"}, {"text": "x"}, 7, {"text": "", "user_comment": "d"}]}, "root.log": "junk"}}'
  WHEN 3 THEN '{"fail_reason": "a", "how_to_fix": "' || lang || '", "logs": ["build.log"]}'
  WHEN 4 THEN '{"fail_reason": "a", "how_to_fix": "b", "logs": {"x.log": {"snippets": [{"text": "' || source
              || '", "user_comment": ""}]}}}'
  ELSE '[{"fail_reason": "' || source || '"}]' END AS raw FROM documents),
v AS (SELECT source_path, raw, json_valid(raw) AS ok FROM d),
items AS (SELECT source_path, unnest(json_extract(raw, '$.logs.*.snippets[*]')) AS it FROM v
          WHERE ok AND json_type(raw) = 'OBJECT' AND json_type(raw, '$.logs') = 'OBJECT'),
good AS (SELECT source_path, count(*) AS n FROM items
         WHERE json_type(it) = 'OBJECT' AND json_type(it, '$.text') = 'VARCHAR' AND length(it ->> '$.text') > 0
           AND json_type(it, '$.user_comment') = 'VARCHAR' AND length(it ->> '$.user_comment') > 0 GROUP BY 1),
r AS (SELECT v.source_path, CASE
  WHEN NOT ok THEN 'malformed json'
  WHEN json_type(raw) <> 'OBJECT' THEN 'not an object'
  WHEN coalesce(json_type(raw, '$.fail_reason'), '') <> 'VARCHAR' OR length(raw ->> '$.fail_reason') = 0 THEN 'bad fail_reason'
  WHEN coalesce(json_type(raw, '$.how_to_fix'), '') <> 'VARCHAR' OR length(raw ->> '$.how_to_fix') = 0 THEN 'bad how_to_fix'
  WHEN coalesce(json_type(raw, '$.logs'), '') <> 'OBJECT' THEN 'logs must be an object'
  WHEN coalesce(g.n, 0) = 0 THEN 'no valid snippets found' END AS reason, CAST(coalesce(g.n, 0) AS INTEGER) AS n
  FROM v LEFT JOIN good g USING (source_path))
"""


@register("validate_contributions", _RAW_SQL + """
SELECT source_path, coalesce(reason, 'ok') AS status, CASE WHEN reason IS NULL THEN n ELSE 0 END AS n_snippets FROM r""")
def q_validate_contrib(spark, sf):
    builds, rejects = parse_contributions(_raw_contrib(spark, sf))
    ok = builds.select("source_path", F.lit("ok").alias("status"), F.size("snippets").alias("n_snippets"))
    bad = rejects.select("source_path", F.col("reason").alias("status"), F.lit(0).alias("n_snippets"))
    return ok.unionByName(bad)


@register("report_snippets_ll", with_views(",\n" + DIAG_SQL + f""",
ds AS (SELECT artifact_id, line_number, text, {_SRC_SQL} AS source_file FROM diag)
SELECT artifact_id, line_number, text FROM ds WHERE NOT {noise_sql('text', C.DEFAULT_NOISE_RULES, 'source_file')}""",
                                            LOG_LINES_SQL))
def q_report_snippets(spark, sf):
    """Compiler errors written out as defect-report JSON, parsed back (FAILFAST) and turned into
    snippets: the report path of the diagnostic extractor."""
    d = compiler_errors(log_lines(table(spark, sf, "events")))
    ev = F.struct(F.col("file_name").alias("file_name"), F.col("src_line").alias("line"),
                  F.lit("error").alias("event"), F.col("text").alias("message"),
                  F.lit("build.log").alias("input_file"), F.col("line_number").cast("int").alias("input_line"),
                  F.lit(0).alias("verbosity_level"))
    rep = d.select("artifact_id", F.to_json(F.struct(F.array(F.struct(
        F.lit("COMPILER_WARNING").alias("checker"), F.lit("c/c++").alias("language"), F.lit("gcc").alias("tool"),
        F.lit(0).alias("key_event_idx"), F.array(ev).alias("events"))).alias("defects"))).alias("json"))
    parsed = ll_source(read_diagnostic_reports(rep, "json"))
    return report_snippets(parsed, ["artifact_id"], C.DEFAULT_NOISE_RULES, "source_file").drop("source_file")
