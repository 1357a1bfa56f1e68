"""Annotated-snippet corpus: ingest and merge (O59a, O59b, O61, O67, O71, O72). The lookups of the nearest
snippets (O68, O69, O74) lie in ``operators.nearest`` and can be imported from here, too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift import constants as C
from logsift.operators.nearest import (  # noqa: F401
    build_index, index_quality, l2, nearest_one, nearest_snippets, nearest_snippets_approx, pivot_share, probe_quality,
    search_index)
from logsift.sources.batches import compact, publish, read_batches, remove
from logsift.sources.contributions import parse_contributions

# --- O59a / O59b counts ------------------------------------------------------------------------------

def table_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(name).alias("what"), "n")


def latest_update(updates: DataFrame) -> DataFrame:
    """Latest archive date (by highest id) and the number of update records."""
    return updates.agg(F.max_by("archive_date", "id").alias("archive_date"),
                       F.count(F.lit(1)).cast("bigint").alias("updates"))


def update_log_summary(updates: DataFrame) -> DataFrame:
    return updates.agg(F.coalesce(F.sum("file_count"), F.lit(0)).cast("bigint").alias("total_files"),
                       F.max_by("archive_date", "id").alias("latest_archive"))


# --- O61 / O59b / O67 ingest -----------------------------------------------------------------------------

def new_annotations(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch(seq, source_path, fail_reason, how_to_fix, snippets)``: the first row per
    ``source_path`` (lowest seq) whose path is not in ``existing(source_path)``, snippets nested."""
    first = batch.groupBy("source_path").agg(
        F.min_by(F.struct("seq", "fail_reason", "how_to_fix", "snippets"),
                 F.struct("seq", F.xxhash64("fail_reason", "how_to_fix", "snippets"))).alias("b"))
    return first.select("source_path", "b.*").join(existing.select("source_path"), "source_path", "left_anti")


def builds_of(annotations: DataFrame) -> DataFrame:
    return annotations.select("source_path", "seq", F.col("fail_reason").alias("problem"),
                              F.col("how_to_fix").alias("solution"))


def snippets_of(annotations: DataFrame) -> DataFrame:
    return annotations.select("source_path", F.posexplode("snippets").alias("pos", "s")).select(
        "source_path", F.col("pos").cast("int").alias("pos"), F.col("s.log_name").alias("source_artifact_name"),
        F.col("s.text").alias("text"), F.col("s.user_comment").alias("annotation"))


def insert_new_builds(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new_builds, new_snippets)`` of ``new_annotations``; snippets only of builds really inserted."""
    new = new_annotations(existing, batch)
    return builds_of(new), snippets_of(new)


def run_report(batch: DataFrame, new_builds: DataFrame) -> DataFrame:
    """One row: processed, added, snippets, skipped = processed - added.

    Joined on path and seq, each pair once, so a seq that full and delta archive share counts once."""
    added = new_builds.select("source_path", "seq").distinct().withColumn("added", F.lit(1))
    once = batch.withColumn("__n", F.row_number().over(Window.partitionBy("source_path", "seq").orderBy(
        F.xxhash64("fail_reason", "how_to_fix", "snippets"))))
    marked = once.join(added, ["source_path", "seq"], "left").withColumn("added", F.when(F.col("__n") == 1, F.col("added")))
    return marked.agg(
        F.count(F.lit(1)).cast("bigint").alias("processed"),
        F.count("added").cast("bigint").alias("added"),
        F.coalesce(F.sum(F.when(F.col("added").isNotNull(), F.size("snippets"))), F.lit(0)).cast("bigint")
        .alias("snippets")).withColumn("skipped", F.col("processed") - F.col("added"))


SNIPPET = "struct<log_name:string,text:string,user_comment:string,text_embedding:array<float>>"
ANNOTATIONS = f"source_path string, seq long, fail_reason string, how_to_fix string, snippets array<{SNIPPET}>"
UPDATES = "id long, file_count int, archive_date date"


def annotated_builds(spark: SparkSession, root: str) -> DataFrame:
    return builds_of(read_batches(spark, f"{root}/annotations", ANNOTATIONS))


def annotated_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Snippets with their embedding, ready for the nearest-snippet lookups."""
    rows = read_batches(spark, f"{root}/annotations", ANNOTATIONS)
    return rows.select("source_path", F.posexplode("snippets").alias("pos", "s")).select(
        F.xxhash64("source_path", "pos").alias("id"), "source_path", F.col("pos").cast("int").alias("pos"),
        F.col("s.log_name").alias("source_artifact_name"), F.col("s.text").alias("text"),
        F.col("s.user_comment").alias("annotation"), F.col("s.text_embedding").alias("text_embedding"))


def with_embeddings(annotations: DataFrame, model=None) -> DataFrame:
    """Annotations whose nested snippets carry the embedding of their text."""
    flat = annotations.select("source_path", F.posexplode("snippets").alias("pos", "s")).select(
        "source_path", "pos", "s", F.coalesce("s.text", F.lit("")).alias("text"))
    told = embed(flat, "text", model=model, whole=("source_path",)).select("source_path", F.struct("pos", F.struct(
        F.col("s.log_name").alias("log_name"), F.col("s.text").alias("text"), F.col("s.user_comment").alias("user_comment"),
        F.col("text_embedding")).alias("s")).alias("p"))
    nested = told.groupBy("source_path").agg(F.array_sort(F.collect_list("p")).alias("ps")).select(
        "source_path", F.transform("ps", lambda p: p["s"]).alias("__snippets"))
    return annotations.join(nested, "source_path", "left").select(
        "source_path", F.col("seq").cast("long").alias("seq"), "fail_reason", "how_to_fix",
        F.coalesce("__snippets", F.array().cast(f"array<{SNIPPET}>")).alias("snippets"))


def write_annotations(new: DataFrame, root: str, batch_id: int, model=None, reset: bool = False,
                      dry_run: bool = False) -> DataFrame | None:
    """Embeds and publishes the rows of ``new_annotations`` as one batch, builds and snippets
    together. ``reset`` removes what was there first; ``dry_run`` writes nothing and returns the planned
    counts. Running it again with the same batch id leaves the same table."""
    if dry_run:
        return new.agg(F.count(F.lit(1)).cast("bigint").alias("builds"),
                       F.coalesce(F.sum(F.size("snippets")), F.lit(0)).cast("bigint").alias("snippets"))
    if reset:
        remove(new.sparkSession, f"{root}/annotations")
    publish(with_embeddings(new, model), f"{root}/annotations", batch_id)
    return None


def sync_annotations(spark: SparkSession, root: str, full: DataFrame | None, delta: DataFrame,
                     last_date, archive_date, model=None, today=None) -> DataFrame:
    """bootstrap = full archive then delta; later runs delta only. Returns the run report.

    ``full`` and ``delta`` hold parsed contributions, or raw ones ``(source_path, raw)`` that are
    validated first. A stale archive (older than the limit, against ``today``) is an error. New builds
    are embedded and published as one batch; its id follows from the update log, whose record is
    written after it and only when something was processed. A run stopped in between is made good by
    the next, which publishes the same batch again.
    """
    from logsift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    if today is not None and (today - archive_date).days > C.ARCHIVE_MAX_AGE_DAYS:
        raise ValueError(f"the archive of {archive_date} is older than {C.ARCHIVE_MAX_AGE_DAYS} days")

    def parsed(df: DataFrame, part: int) -> DataFrame:
        if "raw" in df.columns:
            df = parse_contributions(df)[0].withColumn("seq", F.abs(F.xxhash64("source_path")) % F.lit(1 << 40))
        return df.withColumn("seq", F.lit(part << 48) + F.col("seq"))  # the full archive comes first

    batch = parsed(delta, 1)
    if last_date is None and full is not None:
        batch = parsed(full, 0).unionByName(batch)
    batch = batch.checkpoint()
    updates = read_batches(spark, f"{root}/annotation_updates", UPDATES)
    number = (updates.agg(F.max("id")).first()[0] or 0) + 1
    existing = read_batches(spark, f"{root}/annotations", ANNOTATIONS, before=number)
    new = new_annotations(existing, batch).checkpoint()
    report = run_report(batch, new).checkpoint()
    write_annotations(new, root, number, model)
    processed = report.first()["processed"]
    if processed:
        record = spark.createDataFrame([(number, int(processed), archive_date)], UPDATES)
        publish(record, f"{root}/annotation_updates", number)
    compact(spark, f"{root}/annotations", ANNOTATIONS, before=number)
    compact(spark, f"{root}/annotation_updates", UPDATES, before=number)
    return report


# --- O71 embeddings --------------------------------------------------------------------------------------

def embed(df: DataFrame, text_col: str = "text", dim: int = C.EMBEDDING_DIM,
          model: Callable[[list[str]], np.ndarray] | None = None, out_col: str = "text_embedding",
          whole: Sequence[str] = (), most: int = 64) -> DataFrame:
    """Add ``array<float>`` embeddings.

    Default (no model): JVM-side hashing of word tokens into ``dim`` buckets, L2-normalised
    (``HashingTF`` + ``Normalizer``). A ``model`` is a picklable callable ``list[str] -> ndarray``
    applied to Arrow batches (``mapInPandas``), e.g. a sentence-embedding model loaded per task.

    ``whole`` names columns (those of a build) whose rows go to the model in one call: a call takes whole builds
    of together at most ``most`` texts, a build with more texts is a call by itself. Rows are then dealt out
    and sorted by these columns; a task holds one call and one build at a time.
    """
    if model is None:
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array
        tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="\\W+", toLowercase=True)
        tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
        nm = Normalizer(inputCol="__tf", outputCol="__vec", p=2.0)
        out = nm.transform(tf.transform(tok.transform(df)))
        return out.withColumn(out_col, vector_to_array("__vec", "float32")).drop("__tok", "__tf", "__vec")
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def told(pdf):
        vecs = model(pdf[text_col].fillna("").tolist())
        return pdf.assign(**{out_col: [np.asarray(v, dtype=np.float32) for v in vecs]})

    def builds(batches):
        """Rows of one build each, wherever Arrow batches begin and end."""
        held, key = [], None
        for pdf in batches:
            for values, part in pdf.groupby(list(whole), sort=False, dropna=False):
                values = tuple(None if pd.isna(v) else v for v in values)
                if held and values != key:
                    yield pd.concat(held)
                    held = []
                held.append(part)
                key = values
        if held:
            yield pd.concat(held)

    def packed(batches):
        call, n = [], 0
        for build in builds(batches):
            if call and n + len(build) > most:
                yield told(pd.concat(call))
                call, n = [], 0
            call.append(build)
            n += len(build)
        if call:
            yield told(pd.concat(call))

    if whole:
        return df.repartition(*whole).sortWithinPartitions(*whole).mapInPandas(packed, schema)
    return df.mapInPandas(lambda batches: map(told, batches), schema)
