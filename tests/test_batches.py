"""Batch tables: compaction and buckets by size."""

import datetime as dt
import os

import pytest

from logsift.sources import batches as B
from logsift.streaming import ops as S


def test_folders_grow_with_the_logarithm():
    """A thousand batches by the merge rule alone: few pieces, each row rewritten at most three times."""
    live, rewritten = [], 0
    for i in range(1000):
        live = B.current([*live, B.Piece(i, i, 0, str(i))])
        while run := B.due([p for p in live if p.last < i], 16):
            rewritten += run[-1].last - run[0].first + 1
            live = B.current([*live, B.Piece(run[0].first, run[-1].last, run[0].level + 1, "m")])
        assert len(live) <= 16 * 3 + 1
        assert [x for p in live for x in range(p.first, p.last + 1)] == list(range(i + 1))
    assert rewritten <= 3 * 1000


def test_compaction_keeps_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    batch = lambda i: spark.createDataFrame([(i, k) for k in range(3)], "b long, k long").coalesce(1)
    rows = lambda **kw: sorted(map(tuple, B.read_batches(spark, root, "b long, k long", **kw).collect()))
    for i in range(14):
        for _ in range(2 if i in (4, 9) else 1):  # replays, before and after a compaction
            assert rows(before=i) == [(j, k) for j in range(i) for k in range(3)]
            B.publish(batch(i), root, i)
            B.compact(spark, root, "b long, k long", before=i, fan=3)
        assert rows() == [(j, k) for j in range(i + 1) for k in range(3)]
        assert len(B.published(spark, root)) <= 7 and len(os.listdir(root)) <= 14
    with pytest.raises(ValueError):
        rows(before=1)
    # A merge that was stopped before its marker does not count, and is done again.
    live = B.published(spark, root)
    merged = next(p for p in live if p.level)
    os.remove(f"{merged.path}/_SUCCESS")
    B.publish(batch(14), root, 14)
    assert not any(p.path == merged.path for p in B.published(spark, root))


def test_buckets_double_with_the_table(spark, tmp_path, monkeypatch):
    """The number of buckets follows the rows; old manifests and folders go; a replay of the widening batch is the same."""
    monkeypatch.setattr(S, "BUCKET_ROWS", 5)
    monkeypatch.setattr(S, "LEAST_BUCKETS", 2)
    root, at = str(tmp_path / "r"), dt.datetime(2024, 5, 1)
    sink, want = S.reaction_sync_sink(root), {}
    schema = "comment_id long, snapshot_time timestamp, reactions array<struct<reaction_type string, cnt long>>"
    for i, ids in enumerate([range(0, 8), range(8, 20), range(20, 50), [3], [], range(0, 5)]):
        change = spark.createDataFrame([(c, at, [("up", i)]) for c in ids], schema)
        for _ in range(2 if i == 2 else 1):
            sink(change, i)
        want |= {c: i for c in ids}
        assert {(r.comment_id, r.cnt) for r in S.read_reactions(spark, root).collect()} == set(want.items())
        assert len(B.folders(spark, f"{root}/manifest", "batch=")) <= 2
    places, buckets = S._places(spark, root)
    assert buckets == 16 and sum(n for _, n in places.values()) == 50
