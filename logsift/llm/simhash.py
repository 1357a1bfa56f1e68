"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked when they differ in few bits. Anchors are the words of a
covering code; every fingerprint is replicated to all anchors within the covering radius plus the
threshold and compared per anchor, so two linked fingerprints always meet: the home anchor of one
lies within the covering radius of it, hence within radius plus threshold of the other.

The code is taken per stretch of bits. With threshold t the 64 bits are cut into ``t // 2 + 1``
stretches; two fingerprints within t bits differ in at most one bit on one of them (for t = 4:
stretches of 22, 21 and 21 bits). On a stretch the anchors are the words of the perfect
[15,11] Hamming code (covering radius 1) times all words of the remaining bits (radius 0), so
each fingerprint has one home anchor per stretch and 8 + 6 further ones on average in reach.

Only the fingerprint of a text travels. Equal fingerprints are one node. Per anchor, home
fingerprints are compared with those that reach the anchor; a task links what it finds to the
smallest fingerprint of each group it has joined (a spanning forest), never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logsift.llm.common import bounded_batches, checkpoint, partitions_for, text_or_empty
from logsift.llm.components import components

#: Rows of one comparison group; anchors with more are cut into blocks compared pairwise.
GROUP_ROWS = 1 << 16
#: Home fingerprints and reaching fingerprints of one block of a large anchor.
HOME_BLOCK, REACH_BLOCK = 2048, 1 << 15
#: Pairs compared at once inside a task (bounds its memory).
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = len(words)
    if n <= shingle:
        return np.uint64(h64(b" ".join(words), seed)).astype(np.int64).item()
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = np.zeros(64, np.int64)
    total = n - shingle + 1
    for at in range(0, total, 1 << 16):
        a, b = starts[at:min(at + (1 << 16), total)].tolist(), ends[at + shingle - 1:at + shingle - 1 + (1 << 16)].tolist()
        h = np.fromiter((h64(line[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > total, bitorder="little").view("<i8").item()


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 4,
                     seed: int = 42) -> DataFrame:
    """``docs`` plus the signed 64-bit SimHash of the whole text (null text: as empty, zero)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(LongType())
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([fingerprint(t, shingle, seed) for t in s], dtype="int64")

    return docs.withColumn(out, simhash(text_or_empty(text)))


def stretches(threshold: int) -> list[tuple[int, int]]:
    """(first bit, width) of each stretch: on one of them a linked pair differs in at most 1 bit."""
    n = threshold // 2 + 1
    if 64 // n < 15:
        raise ValueError("threshold must leave stretches of 15 bits or more (at most 6)")
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _nearest_codeword(v15: np.ndarray) -> np.ndarray:
    """Nearest word of the [15,11] Hamming code: flip the bit that the syndrome names."""
    syndrome = np.zeros_like(v15)
    for i in range(15):
        syndrome ^= np.where((v15 >> i) & 1, i + 1, 0)
    return np.where(syndrome > 0, v15 ^ (1 << np.maximum(syndrome - 1, 0)), v15)


def anchors(fp: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint on a stretch, and (row, anchor) of all anchors in reach.

    An anchor is in reach when it is the home of a word at most one bit away, which for this code
    is every anchor within covering radius plus one.
    """
    code = _nearest_codeword(np.arange(1 << 15))
    part = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    low, high = part & 0x7FFF, part >> 15
    home = (high << 15) | code[low]
    near = [home] + [(high << 15) | code[low ^ (1 << i)] for i in range(15)]
    near += [((high ^ (1 << i)) << 15) | code[low] for i in range(width - 15)]
    reach = np.sort(np.stack(near, axis=1), axis=1)
    new = np.ones(reach.shape, bool)
    new[:, 1:] = reach[:, 1:] != reach[:, :-1]
    row, col = np.nonzero(new)
    return home, row, reach[row, col]


def _replicas(fps: DataFrame, threshold: int) -> DataFrame:
    """(stretch, anchor, fp, home) for every anchor in reach of every fingerprint."""
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fp = pdf["fp"].to_numpy(np.int64)
            for k, (first, width) in enumerate(stretches(threshold)):
                home, row, anchor = anchors(fp, first, width)
                yield pd.DataFrame({"place": (np.int64(k) << 32) | anchor, "fp": fp[row],
                                    "home": anchor == home[row]})

    return fps.mapInPandas(emit, "place long, fp long, home boolean")


class _Forest:
    """Union-find over positions of one group's sorted fingerprints; smaller position wins."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while len(a):
            ra, rb = self._roots(a), self._roots(b)
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            left = lo != hi
            if not left.any():
                return
            a, b = lo[left], hi[left]
            np.minimum.at(up, b, a)

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = y

    def all_roots(self) -> np.ndarray:
        return self._roots(np.arange(len(self.up)))


def link_group(place: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its local group) within one comparison group."""
    names, at = np.unique(fp, return_inverse=True)
    order = np.lexsort((~home, place))
    place, at, home = place[order], at[order], home[order]
    begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    end = np.append(begin[1:], len(place))
    homes = np.add.reduceat(home.astype(np.int64), begin)
    forest = _Forest(len(names))
    bits = names.view(np.uint64)
    # Each home row is compared with every row of its anchor: rows of the pair list are cut at PAIRS_AT_ONCE.
    left = np.concatenate([np.arange(b, b + h) for b, h in zip(begin, homes) if h] or [np.empty(0, np.int64)])
    size = np.repeat(end - begin, homes)
    start = np.repeat(begin, homes)
    done = np.cumsum(size)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        n = size[lo:hi]
        x = np.repeat(left[lo:hi], n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[lo:hi], n)
        i, j = at[x], at[y]
        near = np.bitwise_count(bits[i] ^ bits[j]) <= threshold
        near &= i != j
        forest.join(i[near], j[near])
        lo = hi
    root = forest.all_roots()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]


def links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` within ``threshold`` bits.

    Transitively complete: fingerprints are connected by the result exactly when a chain of pairs
    within the threshold connects them. Null fingerprints take no part.

    Anchors go to comparison groups of about ``GROUP_ROWS`` rows. An anchor with more than
    ``HOME_BLOCK`` home rows or ``REACH_BLOCK`` rows in reach is cut into blocks of both, and every
    block of one meets every block of the other in a group of its own: groups stay bounded however
    many fingerprints crowd around one anchor.
    """
    fps = checkpoint(fps.select("fp").filter("fp is not null").distinct())
    n = fps.count()
    rows = _replicas(fps, threshold)
    sizes = rows.groupBy("place").agg(F.sum(F.col("home").cast("int")).alias("h"), F.count("*").alias("g"))
    large = sizes.filter((F.col("h") > HOME_BLOCK) | (F.col("g") > REACH_BLOCK)).select(
        "place", F.greatest(F.lit(1), F.ceil(F.col("h") / HOME_BLOCK)).cast("int").alias("nh"),
        F.ceil(F.col("g") / REACH_BLOCK).cast("int").alias("ng"))
    groups = partitions_for(n * 16 * len(stretches(threshold)), GROUP_ROWS)

    # On a large anchor a home row meets every block of reaching rows, a reaching row every block of homes.
    def block(home, bh, br):
        return F.struct(F.lit(home).alias("home"), bh.cast("int").alias("bh"), br.cast("int").alias("br"))

    own_h, own_r = F.pmod(F.xxhash64("fp"), F.col("nh")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("ng"))
    as_home = F.transform(F.sequence(F.lit(0), F.col("ng") - 1), lambda br: block(True, own_h, br))
    as_reach = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda bh: block(False, bh, own_r))
    dealt = rows.join(large, "place", "left").select(
        "place", "fp", F.explode(F.when(F.col("nh").isNull(), F.array(F.struct(
            "home", F.lit(-1).alias("bh"), F.lit(-1).alias("br"))))
            .when(F.col("home"), F.concat(as_home, as_reach)).otherwise(as_reach)).alias("x"))
    dealt = dealt.select("place", "fp", "x.home", F.when(
        F.col("x.bh") < 0, F.pmod(F.xxhash64("place"), F.lit(groups)))
        .otherwise(F.lit(groups) + F.pmod(F.xxhash64("place", "x.bh", "x.br"), F.lit(1 << 40))).alias("grp"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = link_group(pdf["place"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64),
                          pdf["home"].to_numpy(bool), threshold)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("grp").applyInPandas(compare, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, threshold: int = 4,
            seed: int = 42) -> DataFrame:
    """``(id, fp, root, component_id)`` per row; root: smallest fingerprint of the row's group."""
    marked = checkpoint(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")),
                                         "text", "fp", shingle, seed).select("id", "fp"))
    least = marked.groupBy("fp").agg(F.min("id").alias("id"))
    roots = components(links(least, threshold))
    placed = checkpoint(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("fp", "id", F.coalesce("root", "fp").alias("root")))
    first = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return marked.join(placed.join(first, "root").select("fp", "root", "component_id"), "fp") \
        .select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
                    threshold: int = 4, seed: int = 42) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``docs``.

    component_id: smallest non-null id reachable over links of at most ``threshold`` differing bits,
    the row itself included. Null or empty texts have fingerprint zero, linked like any other; rows
    that repeat an id are judged each by its text; a group whose ids are all null has component null.
    Other columns of ``docs`` are ignored, whatever their names; an empty table gives no rows.
    """
    return grouped(docs, id_col, text, shingle, threshold, seed).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
                         threshold: int = 4, seed: int = 42) -> DataFrame:
    """One document of each group stays: that with the smallest id (of several texts under it, the one
    with the smallest fingerprint). A row without an id stays only where no row of its group has one.
    """
    rows = checkpoint(grouped(docs, id_col, text, shingle, threshold, seed))
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("w")).select("w.id", "w.fp")
    # An id tells its row apart unless it is null or repeated; those rows are told apart by their fingerprint, too.
    vague = checkpoint(rows.groupBy("id").count().filter("count > 1 or id is null").select("id"))
    plain = stay.join(vague, stay["id"].eqNullSafe(vague["id"]), "left_anti")
    kept = docs.join(plain.select(F.col("id").alias("__id")), F.col(id_col) == F.col("__id"), "left_semi")
    if vague.isEmpty():
        return kept
    odd = docs.join(vague.select(F.col("id").alias("__id")), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    # Of rows with one id and fingerprint the one with the smallest hash, so that reruns agree.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    odd = with_fingerprint(odd, text, "__fp", shingle, seed).groupBy(F.col(id_col).alias("__own"), "__fp").agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")).select("__row.*", "__fp")
    odd = odd.join(stay.select(F.col("id").alias("__id"), F.col("fp").alias("__f")),
                   F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__f")), "left_semi")
    return kept.unionByName(odd.drop("__fp"))
