"""Trees that are worked out by stretch: as the steps of trees.py give them one after the other, and without a row for each window."""

import random

import pytest
from test_trees import BLOCK, EVENT, chain, stale, unknown

from pegtrail.operators import trees as T
from pegtrail.operators import window_trees


@pytest.fixture(scope="module")
def tables(spark):
    """A spine with a gap and a double height, branches, a cycle with a tail, unknown blocks and parents that few sources saw."""
    r = random.Random(7)
    more = [stale(f"s{h}", r.choice((f"c{h - 1}", f"s{h - 1}")), h, r.choice((None, f"c{h}"))) for h in range(1, 60) if r.random() < 0.5]
    more += [("x1", "x3", 21, "stale", 0, None, "c21", None, False), ("x2", "x1", 22, "stale", 0, None, "c22", None, False), ("x3", "x2", 23, "stale", 0, None, "c23", None, False), ("a0", "x2", 24, "stale", 0, None, "c24", None, False), ("c40b", "c39", 40, "canonical", 24_000, None, None, None, True)]
    more += [unknown(f"u{i}", f"c{i}", i * 700, r.choice(("weak", "strict", "excluded", None)), r.choice((None, None, i))) for i in range(0, 60, 3)]
    more += [(f"e{h}", f"c{h - 1}", h, "error_block", h * 600, None, None, None, False) for h in range(5, 60, 11)]
    blocks = [b for b in chain(60, more) if b[0] != "c50"]
    names = [b[0] for b in blocks if b[3] != "canonical"] * 2 + [f"c{h}" for h in range(0, 60, 7)] + ["n1", "n2", "n3"]
    events = [(i, r.randrange(1, 4), n, f"p{i % 5}", r.randrange(36_000), "unknown" if n[0] == "u" else r.choice(("near", "unknown")) if n[0] == "n" else "stale", r.random() < 0.95, None if r.random() < 0.9 else 5) for i, n in enumerate(names)]
    windows = [(i, low, low + size, low * 600 if i % 2 else None, (low + size) * 600 if i % 2 else None) for i, (low, size) in enumerate((r.randrange(0, 58), r.choice((4, 9, 30))) for _ in range(40))] + [(90, None, None, 0, 9_000), (91, None, None, None, None), (92, 9, 3, None, None)]
    source = spark.createDataFrame([(1, "auxpow:a", "auxpow"), (2, "auxpow:b", "auxpow"), (3, "live:t", "live-chaintip")], "source_id long, code string, source_kind string")
    return spark.createDataFrame(windows, "window_id long, low long, high long, first long, last long"), spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(events, EVENT), source


@pytest.mark.parametrize(("f", "limit", "loose"), [(T.TreeFilter(classes=("strict", "pending"), near=True), 12, 3), (T.TreeFilter(min_sources=2), 30, 250)])
def test_as_the_steps_give_them(tables, f, limit, loose, monkeypatch):
    monkeypatch.setattr(window_trees, "HEIGHTS", 8)
    monkeypatch.setattr(window_trees, "SECONDS", 4000)
    monkeypatch.setattr(window_trees, "WINDOWS", 3)
    windows, block, event, source = tables
    cd = T.tree_candidates(windows, block, event, source, f).checkpoint()
    placed = T.reduced(cd.where("shown"), limit).checkpoint()
    judged = T.window_verdicts(windows, block, cd, placed, limit, loose)
    want = T.connected(placed.join(judged.where("refused is null"), "window_id", "left_semi"))
    nodes, verdicts = T.tree_windows(windows, block, event, source, f, limit, loose)
    rows = lambda df, like: sorted(map(repr, df.select(*like.columns).collect()))
    assert rows(verdicts, judged) == rows(judged, judged)
    assert rows(nodes, want) == rows(want, want) and nodes.count()


def test_windows_share_their_rows(spark, tables):
    """A hundred windows of the same heights take each block once."""
    block, source = spark.createDataFrame(chain(64), BLOCK), tables[3]
    windows = spark.range(100).selectExpr("id as window_id", "0L as low", "63L as high", "cast(null as long) as first", "cast(null as long) as last")
    nodes, _ = T.tree_windows(windows, block, tables[2].limit(0), source)
    assert nodes.count() == 6400
    rows = T.judged_blocks(block, T.seen_by(block, tables[2].limit(0), source), T.competing(block), T.TreeFilter())
    assert window_trees.stretches(windows, rows, block.where("false").select("hash", "time")).where("tag = 'b'").count() == 64
