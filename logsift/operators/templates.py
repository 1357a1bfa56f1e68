"""Template mining (O31) and representative snippets.

``mine_templates`` (signature mode): mask variable parts (ids, IPs, hex, numbers, commands),
tokenise, and turn any token still holding a digit into ``<*>``; the template is the joined
token list and clusters are exact template matches inside one artifact. Because the template is
a function of the message, an LRU of capacity k over clusters keeps exactly the k templates
whose *last* occurrence is latest, and emitting the first member of each survivor in line order
is one aggregate plus a per-artifact top-k — no sequential scan.

``cluster_templates`` (similarity mode) joins signatures that share enough tokens: messages that differ in a
name, not only in digits or masks, become one template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.functions.text import mask, mask_column, tokens


def template_of(text_col: str = "text", masked: bool = False):
    toks = tokens(F.col(text_col) if masked else mask(text_col))
    sig = F.transform(toks, lambda t: F.when(t.rlike("[0-9]"), F.lit(C.WILDCARD)).otherwise(t))
    return F.array_join(sig, " ")


def mine_templates(chunks: DataFrame, keys: tuple[str, ...] = ("artifact_id",),
                   text_col: str = "text") -> DataFrame:
    """Adds ``template`` and ``template_id`` (64-bit hash of artifact keys + template).

    Computed in place as a few narrow projections (guarded masks, then tokens): no shuffle, and
    the upstream (message assembly) is evaluated once."""
    out = mask_column(chunks, text_col, "__masked") \
        .withColumn("template", template_of("__masked", masked=True)).drop("__masked")
    return out.withColumn("template_id", F.xxhash64(*[F.col(k) for k in keys], F.col("template")))


def _written(df: DataFrame) -> DataFrame:
    from logsift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _shared_lists(sigs: DataFrame, bucket: list[str]) -> DataFrame:
    """``(*bucket, pos, tok, id)``: lists of signatures by a token at a position, such that any two that agree in
    ``need`` positions meet in a list.

    Of its tokens a signature leaves out the ``need - 1`` commonest ones of the bucket: two signatures with
    ``need`` tokens in common cannot both have left out all of them. A token that nobody shares makes no list.
    """
    own = sigs.select(*bucket, "id", "need", F.posexplode("toks").alias("pos", "tok")).filter(F.col("tok") != C.WILDCARD)
    often = own.groupBy(*bucket, "pos", "tok").agg(F.count(F.lit(1)).alias("often"))
    ordered = own.join(often, [*bucket, "pos", "tok"]).groupBy(*bucket, "id", "need").agg(
        F.array_sort(F.collect_list(F.struct("often", "pos", "tok"))).alias("ts")).filter(F.size("ts") >= F.col("need"))
    kept = ordered.select(*bucket, "id", F.explode(F.slice("ts", F.lit(1), F.size("ts") - F.col("need") + 1)).alias("t"))
    return kept.filter("t.often > 1").select(*bucket, "t.pos", "t.tok", "id")


def elect_leaders(sigs: DataFrame, bucket: list[str]) -> tuple[DataFrame, int]:
    """``(*bucket, id, leader)`` of every signature that a leader takes, and the number of rounds.

    ``sigs``: ``(*bucket, id, need, toks)``. Going by ``id``, a signature leads unless it agrees in ``need`` positions
    with an earlier leader; it belongs to the earliest one. That is the lexicographically first maximal
    independent set of the agreement graph, found without listing the graph: in every round each list names
    its smallest undecided members, and a signature is compared with those of its own lists only. It leads if it is
    named in all of them and agrees with no smaller one. All such lead at once and take whom they agree with.
    Lists name twice as many each round, so two signatures that merely share a list soon stop waiting for
    each other; what is left is the longest chain of agreeing signatures, logarithmic unless their order is contrived.
    """
    at, toks = [*bucket, "pos", "tok"], sigs.select(*bucket, "id", "need", "toks")
    lists = _written(_shared_lists(sigs, bucket))
    asking, told, named, rounds = lists, None, 1, 0
    while not asking.isEmpty():
        rounds += 1
        first = Window.partitionBy(*at).orderBy("id")
        heads = asking.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= named).select(*at, F.col("id").alias("head"))
        pairs = lists.join(heads, at).filter(F.col("head") < F.col("id")).select(*bucket, "id", "head").distinct()
        agree = F.size(F.filter(F.zip_with("toks", "head_toks", lambda a, b: (a == b) & (a != C.WILDCARD)), lambda x: x))
        near = _written(pairs.join(toks, [*bucket, "id"])
                        .join(toks.select(*bucket, F.col("id").alias("head"), F.col("toks").alias("head_toks")), [*bucket, "head"])
                        .filter(agree >= F.col("need")).select(*bucket, "id", "head"))
        seen = asking.groupBy(*bucket, "id").agg(F.count(F.lit(1)).alias("n")).join(
            heads.groupBy(*bucket, F.col("head").alias("id")).agg(F.count(F.lit(1)).alias("n")), [*bucket, "id", "n"])
        lead = _written(seen.select(*bucket, "id").join(near, [*bucket, "id"], "left_anti"))
        taken = _written(near.join(lead.select(*bucket, F.col("id").alias("head")), [*bucket, "head"], "left_semi"))
        told = taken if told is None else told.unionByName(taken)
        asking = _written(asking.join(lead.unionByName(taken.select(*bucket, "id")).distinct(), [*bucket, "id"], "left_anti"))
        named *= 2
    if told is None:
        return sigs.select(*bucket, "id", F.col("id").alias("leader")).limit(0), rounds
    return told.groupBy(*bucket, "id").agg(F.min("head").alias("leader")), rounds


def merged_templates(members: DataFrame, cluster: list[str]) -> DataFrame:
    """``(*cluster, template)`` over ``(*cluster, toks)``: positions at which members differ become ``<*>``.

    Least and greatest token per position merge in any order, so a large cluster is combined before the shuffle."""
    per = members.select(*cluster, F.posexplode("toks").alias("pos", "tok")).groupBy(*cluster, "pos").agg(
        F.min("tok").alias("low"), F.max("tok").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(C.WILDCARD)
    return per.groupBy(*cluster).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("tok")))).alias("ts")).select(
        *cluster, F.array_join(F.transform("ts", lambda t: t["tok"]), " ").alias("template"))


def cluster_templates(mined: DataFrame, threshold: float = C.TEMPLATE_SIM_TH,
                      keys: tuple[str, ...] = ("artifact_id",)) -> DataFrame:
    """Clusters of similar signatures: ``(*keys, template, line_number, text, last_seen, n)`` per cluster.

    Signatures (one row each, however many messages have it) are compared only within a bucket of the
    same artifact, token count and first token. Going by first occurrence, a signature leads a new cluster
    unless it agrees with an earlier leader in at least ``threshold`` of its token positions (wildcards never
    agree); else it joins the earliest such leader. ``template`` is the merge of all members.
    """
    if threshold <= 0:
        raise ValueError("the share of agreeing tokens must be positive")
    sigs = mined.groupBy(*keys, "template").agg(
        F.min_by(F.struct("line_number", "text"), F.col("line_number")).alias("first"),
        F.max("line_number").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    toks = F.split("template", " ")
    sigs = _written(sigs.select(*keys, F.size(toks).alias("__size"), toks[0].alias("__head"),
                                F.struct(F.col("first.line_number").alias("line"), "template").alias("id"),
                                F.ceil(F.size(toks) * F.lit(threshold)).cast("int").alias("need"), toks.alias("toks"),
                                "first", "last_seen", "n"))
    bucket = [*keys, "__size", "__head"]
    told, _ = elect_leaders(sigs, bucket)
    led = sigs.join(told, [*bucket, "id"], "left").withColumn("leader", F.coalesce("leader", "id"))
    cluster = [*keys, "leader"]
    per = led.groupBy(*cluster).agg(F.min_by("first", F.col("first.line_number")).alias("first"),
                                    F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))
    out = per.join(merged_templates(led, cluster), cluster)
    return out.select(*keys, "template", F.col("first.line_number").alias("line_number"), F.col("first.text").alias("text"),
                      "last_seen", "n")


def latest_clusters(clusters: DataFrame, k: int = C.DEFAULT_MAX_CLUSTERS,
                    keys: tuple[str, ...] = ("artifact_id",)) -> DataFrame:
    """The first chunk of each of the ``k`` most recently seen clusters, per artifact."""
    w = Window.partitionBy(*keys).orderBy(F.col("last_seen").desc())
    return clusters.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select(*keys, "line_number", "text")


def representative_snippets(mined: DataFrame, k: int = C.DEFAULT_MAX_CLUSTERS,
                            keys: tuple[str, ...] = ("artifact_id",)) -> DataFrame:
    """The first chunk of each of the ``k`` most recently seen templates, per artifact."""
    keys = list(keys)
    per = mined.groupBy(*keys, "template").agg(
        F.min_by(F.struct("line_number", "text"), F.col("line_number")).alias("first"),
        F.max("line_number").alias("last_seen"))
    w = Window.partitionBy(*keys).orderBy(F.col("last_seen").desc())
    top = per.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    return top.select(*keys, F.col("first.line_number").alias("line_number"), F.col("first.text").alias("text"))
