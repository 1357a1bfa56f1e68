"""Training-corpus pipeline: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows as
Parquet below the folder named in ``spark.checkpoint.dir`` and reads them back as the next stage's
documents, so a lost executor costs at most the stage at hand. All stages but the last return the
columns of ``documents``; other columns of the input pass through them unchanged, whatever their names:
stages work beside the whole row, held in one column.

Every stage takes null ids, texts, sources and languages, empty and very long texts, repeated rows and
empty tables: a null text is judged as an empty one and stays null, repeated rows are judged one by
one (near-duplicate removal keeps one of them), an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import bpe, mixing, secrets, simhash, toxicity
from logsift.llm.common import shared_folder, table


def _beside(docs: DataFrame) -> DataFrame:
    """The columns that stages work on, and the whole row in ``row``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the rows that are not held out, scores as toxic go. Rows without an
    id are scored, too, but teach nothing."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(_beside(docs), model).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (null last; of equal ids
    the text with the smallest fingerprint, of those the row with the smallest hash)."""
    return simhash.drop_near_duplicates(_beside(docs), "doc_id", "text", shingle=4, threshold=4, seed=42).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark that names its kind; all documents stay, ``n_chars`` follows the text."""
    words = secrets.dictionary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    clean = secrets.with_secrets(_beside(docs), words, out="spans", redacted="clean")
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean").cast("long"))
    return clean.select(row.alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is a source of its own;
    documents without words are never taken more often than their source's whole epochs."""
    sized = mixing.sized(_beside(docs), "text", "size")
    mixed = mixing.mix(mixing.quality_weights(sized.drop("row", "text"), table(spark, sf_dir, "labels")))
    return mixing.repeat_documents(sized.drop("text"), mixed).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (null text: none), decoded again to prove that they hold the whole text."""
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.with_decoded(bpe.with_tokens(docs.select("doc_id", "source", "text"), vocabulary), vocabulary)
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded").cast("string") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_near_copies), ("secret_scan", redact_secrets),
          ("source_mix", mix_sources), ("byte_bpe", encode)]

#: The stages train a classifier, hash shingles with XXH64 and run a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. The folder of a run stays for those who resume from it; its owner removes it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
