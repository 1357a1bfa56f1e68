"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Two kinds of entries are listed. A prefix entry, a host and a path, covers the host and all its
subdomains on paths that start with its path. An exact entry covers one canonical URL. A URL can be
covered only by ``suffix of its host + prefix of its path``, for the path lengths that occur among
prefix entries, or by its own canonical form. These few candidates are tested against the filter;
possible hits go to a hash join with the list, which drops false positives. The longest prefix entry
decides, then the exact entry, then the default.

The filter has blocks of 256 bits. A key sets four bits of one block, so a block is one row of four
64-bit words, built by a bitwise aggregation. The number of blocks follows from the number of
entries up to ``MOST_BLOCKS``: the filter is broadcast and its size is bounded by that (at most
about 12 MB); a longer list raises the share of false positives, never the number of errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import checkpoint

BLOCK_BITS, HASHES, BITS_PER_KEY, MOST_BLOCKS = 256, 4, 12, 1 << 17
SEEDS = ("block", "bits")


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    at = F.instr(c, "://")
    return F.when(at > 0, c.substr(at + 3, F.length(c))).otherwise("")


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return _lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: str | Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One name for the common spellings of a URL: no leading ``www.``, no slashes at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first (empty host: none)."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _bits(key: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """Block number of a key and its four words of bits."""
    block = F.pmod(F.xxhash64(F.lit(SEEDS[0]), key), blocks)
    h = F.xxhash64(F.lit(SEEDS[1]), key)
    at = [F.pmod(F.shiftrightunsigned(h, 8 * i), F.lit(64)).cast("int") for i in range(HASHES)]
    # One bit in each 64-bit word of the block.
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at]


def bloom_filter(keys: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """Blocks ``(block, w0..w3)`` of the distinct non-null keys, and the number of blocks."""
    n = keys.select(key).distinct().count()
    blocks = max(1, min(MOST_BLOCKS, -(-n * BITS_PER_KEY // BLOCK_BITS)))
    block, words = _bits(F.col(key), F.lit(blocks))
    rows = keys.filter(F.col(key).isNotNull()).select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(HASHES)]), blocks


def possible(df: DataFrame, key: str, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter; the filter's size is bounded by ``MOST_BLOCKS`` rows."""
    block, words = _bits(F.col(key), F.lit(blocks))
    named = df.withColumn("__block", block)
    hit = named.join(F.broadcast(filter_blocks.withColumnRenamed("block", "__fb")), F.col("__block") == F.col("__fb"))
    for i, w in enumerate(words):
        hit = hit.filter(F.col(f"w{i}").bitwiseAND(w) != 0)
    return hit.select(*df.columns)


def listed_entries(prefixes: DataFrame, exact: DataFrame) -> DataFrame:
    """``(key, host_len, path_len, verdict, rule)`` of both kinds of entries, each key once.

    ``prefixes``: host, path, verdict, rule; ``exact``: host, path, verdict. Hosts are lower-cased
    (A-Z). Null or empty hosts name nothing and are left out; null paths are empty. Of entries that
    repeat a key, ``block`` wins over ``allow``.
    """
    path = F.coalesce("path", F.lit(""))
    p = prefixes.select(F.concat(F.lit("p "), _lower("host"), path).alias("key"), _lower("host").alias("h"),
                        F.length("host").alias("host_len"), F.length(path).alias("path_len"), "verdict", "rule")
    e = exact.select(F.concat(F.lit("e "), canonical(_lower("host"), path)).alias("key"), _lower("host").alias("h"),
                     F.lit(-1).alias("host_len"), F.lit(-1).alias("path_len"), "verdict",
                     F.lit(None).cast("string").alias("rule"))
    both = p.union(e).filter("h is not null and h <> ''")
    return both.groupBy("key", "host_len", "path_len").agg(F.max_by(
        F.struct("verdict", "rule"), F.struct("verdict", F.coalesce("rule", F.lit("")))).alias("e")).select(
        "key", "host_len", "path_len", "e.verdict", "e.rule")


def judge(urls: DataFrame, prefixes: DataFrame, exact: DataFrame, id_col: str = "page_id", url: str = "url",
          otherwise: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict, listed)`` per row of ``urls``.

    rule and verdict: those of the longest prefix entry (longest host, then longest path) that covers
    the URL; where none does, rule is null and the verdict that of the exact entry, else ``otherwise``.
    listed: an entry of either kind covers the URL. Null URLs and those without ``://`` have empty
    host and path and get ``otherwise``. Repeated ids and URLs are judged row by row; other columns
    are ignored, whatever their names. Any of the tables may be empty.
    """
    u = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    listed = checkpoint(listed_entries(prefixes, exact))
    # Distinct path lengths of prefix entries: at most as many as the longest path has characters.
    lens = [r.path_len for r in listed.filter("host_len >= 0").select("path_len").distinct().collect()]
    cuts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lens])
                    if lens else F.array().cast("array<string>"), lambda p: p.isNotNull())
    tried = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(
        cuts, lambda p: F.concat(F.lit("p "), h, p))))
    tried = F.concat(tried, F.array(F.concat(F.lit("e "), canonical(F.col("host"), F.col("path")))))
    pairs = u.filter("host <> ''").select("host", "path").distinct()
    tried = pairs.select("host", "path", F.explode(tried).alias("key"))
    blocks, n = bloom_filter(listed)
    maybe = possible(tried, "key", blocks, n)
    hits = maybe.join(listed.hint("shuffle_hash"), "key")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"),
                                                     F.struct("host_len", "path_len")).alias("best"))
    return u.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"), F.col("best").isNotNull().alias("listed"))
