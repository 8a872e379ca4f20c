"""Tree documents of hand-made chains: known answers."""

import pytest

from pegtrail.operators import context_trees as X
from pegtrail.operators import trees as T

BLOCK = "hash string, prev_hash string, height long, kind string, time long, pool_id long, competitor_hash string, orphan_class string, core_attested boolean"
EVENT = "event_id long, source_id long, parent_hash string, parent_prev_hash string, parent_time long, parent_kind string, pow_ok boolean, revoked_at long"


def chain(n, more=()):
    """Canonical c0 to c{n-1}, 600 seconds apart, and more rows."""
    rows = [(f"c{h}", f"c{h - 1}", h, "canonical", h * 600, None, None, None, True) for h in range(n)]
    return [*rows, *more]


def stale(name, prev, height, rival=None):
    return (name, prev, height, "stale", height * 600, None, rival or f"c{height}", None, False)


def unknown(name, prev, time, cls="weak", height=None):
    return (name, prev, height, "unknown", time, None, None, cls, False)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(1, "auxpow:a", "auxpow"), (2, "auxpow:b", "auxpow"), (3, "live:t", "live-chaintip")], "source_id long, code string, source_kind string")


def trees(spark, source, blocks, events=(), windows=((1, 0, 9, None, None),), f=T.TreeFilter(), **limits):
    w = spark.createDataFrame(list(windows), "window_id long, low long, high long, first long, last long")
    return T.tree_windows(w, spark.createDataFrame(blocks, BLOCK), spark.createDataFrame([(i, *e) for i, e in enumerate(events)], EVENT), source, f, **limits)


def shown(nodes, window=1):
    return {r["hash"]: r for r in nodes.where(f"window_id = {window}").collect()}


def seen(parent, *sources, kind="stale", time=0, prev="p", pow_ok=True, revoked=None):
    return [(s, parent, prev, time, kind, pow_ok, revoked) for s in sources]


def test_branch_is_whole_and_its_spine_protected(spark, source):
    blocks = chain(10, [stale("s4", "c3", 4), stale("s5", "s4", 5), stale("t7", "c6", 7)])
    f = T.TreeFilter(min_sources=2)
    nodes, verdicts = trees(spark, source, blocks, seen("s5", 1, 2) + seen("t7", 1), f=f)
    got = shown(nodes)
    assert verdicts.collect()[0]["refused"] is None and "t7" not in got
    assert (got["s4"]["branch_id"], got["s5"]["branch_id"]) == ("stale-4-s4", "stale-4-s4")
    assert [got[x]["edge_kind"] for x in ("s4", "s5", "c5", "c0")] == ["stale_entry", "stale", "canonical", None]
    assert {x for x in got if x[0] == "c" and got[x]["protected"]} == {"c3", "c4", "c5"}
    branch = T.tree_branches(nodes).collect()[0]
    assert (branch["root_hash"], branch["tip_hash"], branch["low"], branch["high"], branch["depth"], branch["competitors"]) == ("s4", "s5", 4, 5, 2, ["c4", "c5"])


def test_long_runs_are_hidden_and_counted(spark, source):
    blocks = chain(30, [stale("s20", "c19", 20)])
    nodes, _ = trees(spark, source, blocks, seen("s20", 1, 2), windows=[(1, 0, 29, None, None)], f=T.TreeFilter(min_sources=2), limit=20)
    got = shown(nodes)
    assert set(got) == {"c0", "c18", "c19", "c20", "c21", "s20"} | {f"c{h}" for h in range(21, 30)} - {"c18"} | {"c19"} or len(got) <= 20
    assert sum(r["hidden"] or 0 for r in got.values()) == 30 + 1 - len(got)
    hidden = [r for r in got.values() if r["edge_kind"] == "hidden"]
    assert len(hidden) == 1 and got[hidden[0]["from_hash"]]["height"] + hidden[0]["hidden"] + 1 == hidden[0]["height"]
    assert [r["id"] for r in sorted(got.values(), key=lambda r: (r["height"], r["hash"]))] == list(range(1, len(got) + 1))


def test_windows_are_judged_apart(spark, source):
    blocks = chain(10, [stale("s4", "c3", 4), stale("s8", "c7", 8, rival="c9"), unknown("u1", "x", 300), unknown("u2", "x", 350)])
    events = seen("s4", 1) + seen("s8", 1) + seen("u1", 1, kind="unknown") + seen("u2", 1, kind="unknown")
    windows = [(1, 0, 5, None, None), (2, 5, 12, None, None), (3, 6, 9, None, None), (4, 0, 5, 0, 400), (5, None, None, 0, 320), (6, None, None, None, None)]
    nodes, verdicts = trees(spark, source, blocks, events, windows, loose=1)
    assert {r["window_id"]: r["refused"] for r in verdicts.collect()} == {1: None, 2: "missing", 3: "competition", 4: "unheighted_nodes", 5: None, 6: None}
    assert set(shown(nodes, 5)) == {"u1"} and not shown(nodes, 6)


def test_too_many_nodes_and_missed_targets_are_refused(spark, source):
    blocks = chain(10, [unknown("u", "c3", 0, height=4)])
    _, verdicts = trees(spark, source, blocks, seen("u", 1, kind="unknown", pow_ok=False))
    assert verdicts.collect()[0]["refused"] == "unknown_target"
    _, verdicts = trees(spark, source, chain(10), limit=5)  # all canonical blocks are evidence: the node attests them
    assert verdicts.collect()[0]["refused"] == "node_count"


def test_direct_parents_by_class_and_kind(spark, source):
    blocks = chain(3, [unknown("known", "x", 500, cls="excluded")])
    events = seen("near", 1, kind="near", time=450) + seen("new", 1, 2, kind="unknown", time=460, prev="near") + seen("known", 1, kind="unknown", time=500) + seen("gone", 1, kind="near", time=450, revoked=9) + seen("late", 1, kind="near", time=900)
    window = [(1, 0, 2, 400, 600)]
    got = shown(trees(spark, source, blocks, events, window)[0])
    assert set(got) == {"c0", "c1", "c2"}
    got = shown(trees(spark, source, blocks, events, window, T.TreeFilter(near=True, classes=("pending",)))[0])
    assert set(got) == {"c0", "c1", "c2", "near", "new"} and got["new"]["kind"] == "unknown"
    assert got["new"]["prev_id"] == got["near"]["id"] and got["new"]["edge_kind"] is None
    got = shown(trees(spark, source, blocks, events, window, T.TreeFilter(near=True, classes=("pending",), sources=("auxpow:b", "core")))[0])
    assert set(got) == {"c0", "c1", "c2", "new"}


def test_requests_of_each_mode(spark):
    rows = [(1, 4, None, None, None), (2, None, 2_000, None, None), (3, None, -5, None, None), (4, None, None, 2, 3), (5, None, None, None, None), (6, 7, 2_000, 1, 2)]
    requests = spark.createDataFrame(rows, "window_id long, at_height long, at_time long, low long, high long")
    got = {r["window_id"]: tuple(r)[1:] for r in T.resolve_windows(requests, spark.createDataFrame(chain(20), BLOCK), 16).collect()}
    assert got[1] == (4, 4, None, False, None) and got[2] == (3, 3, None, False, None) and got[4] == (2, 3, None, False, None) and got[6] == (7, 7, None, False, None)
    assert got[3] == (None, None, None, False, "no_complete_canonical_at_or_before_time") and got[5] == (4, 19, 19, True, None)
    assert {tuple(r)[1:] for r in T.resolve_windows(requests.where("window_id = 5"), spark.createDataFrame([], BLOCK), 16).collect()} == {(None, None, None, True, "no_canonical_tip")}


def compact(spark, source, blocks, events, heights, **more):
    targets = spark.createDataFrame([(f"t{h}", h) for h in heights], "target_id string, height long")
    nodes, verdicts = X.compact_windows(targets, spark.createDataFrame(blocks, BLOCK), spark.createDataFrame([(i, *e) for i, e in enumerate(events)], EVENT), source, **more)
    return {r["target_id"]: (r["radius"], r["low"], r["high"], r["refused"]) for r in verdicts.collect()}, nodes.collect()


def test_compact_takes_the_widest_radius_that_fits(spark, source):
    blocks = [r for r in chain(60, [stale(f"s{h}", f"c{h - 1}", h) for h in (28, 30, 33)]) if r[0] != "c50"]
    events = [e for h in (28, 30, 33) for e in seen(f"s{h}", 1)]
    got, nodes = compact(spark, source, blocks, events, [30, 49, 50, 5], radii=(32, 16, 8, 4), limit=12)
    assert got == {"t30": (16, 14, 46, None), "t49": (4, 45, 53, "missing"), "t50": (4, 46, 54, "missing"), "t5": (32, 0, 37, None)}
    at = {r["hash"]: r for r in nodes if r["target_id"] == "t30"}
    assert set(at) == {"c14", "c46", "c30", "s28", "s30", "s33", "c27", "c28", "c29", "c32", "c33"}
    assert (at["c27"]["edge_kind"], at["c27"]["hidden"], at["c27"]["from_hash"]) == ("hidden", 12, "c14") and at["c30"]["edge_kind"] == "canonical"
    got, _ = compact(spark, source, blocks, events, [30], radii=(32, 16, 8, 4), limit=7)
    assert got == {"t30": (4, 26, 34, "compact_event_nodes")}
    got, _ = compact(spark, source, blocks, events, [30], radii=(8, 4), limit=2)
    assert got == {"t30": (4, 26, 34, "compact_event_nodes")}


def test_compact_of_a_narrow_chain_tries_a_window_once(spark, source):
    rows = X.spans(spark.createDataFrame([("t", 2)], "target_id string, height long"), spark.createDataFrame(chain(5), BLOCK), (16, 8, 4, 1)).collect()
    assert [(r["radius"], r["low"], r["high"]) for r in rows] == [(16, 0, 4), (1, 1, 3)]


def anchors(spark, blocks, names, **more):
    epochs = spark.createDataFrame([(10, 6_000, 1), (20, 12_000, 1)], "epoch long, start_time long, bits long")
    a = spark.createDataFrame([(x,) for x in names], "anchor_id string")
    found = X.anchor_trees(a, spark.createDataFrame(blocks, BLOCK), epochs, 17_000, ["strict", "weak"], beside=3, **more).collect()
    return {x: {r["hash"]: r for r in found if r["anchor_id"] == x} for x in names}


def test_strict_orphan_hangs_on_its_parent(spark):
    got = anchors(spark, chain(30, [unknown("u", "c11", 7_000, "strict", 12)]), ["u"])["u"]
    assert set(got) == {f"c{h}" for h in range(9, 16)} | {"u"} and got["u"]["mode"] == "component"
    u = got["u"]
    assert (u["placement"], u["approx"], u["from_hash"], u["edge_kind"], u["prev_id"], u["id"], u["branch_id"]) == (12, False, "c11", "orphan", got["c11"]["id"], 8, None)


def test_component_is_placed_as_one(spark):
    rows = [unknown("r", "gone", 7_000), unknown("m", "r", 7_500), unknown("k", "m", 8_000, "strict", 15), unknown("m2", "r", 7_600), unknown("out", "k", 9_000, "excluded")]
    got = anchors(spark, chain(30, rows), ["k", "r", "out"])
    assert not got["out"] and {h: tuple(r)[1:] for h, r in got["k"].items()} == {h: tuple(r)[1:] for h, r in got["r"].items()}
    k = got["k"]
    assert [k[x]["placement"] for x in ("r", "m", "m2", "k")] == [13, 14, 14, 15] and {k[x]["branch_id"] for x in "rmk"} == {"orphan-r"}
    assert (k["r"]["edge_kind"], k["r"]["from_hash"], k["r"]["prev_id"], k["m"]["edge_kind"], k["m"]["prev_id"]) == ("orphan_approx", "c13", None, "orphan", k["r"]["id"])


def test_conflicts_epochs_and_strips(spark):
    rows = [
        unknown("a", "c9", 6_500, "strict", 10), unknown("b", "a", 7_000, "strict", 14),  # heights that disagree
        unknown("e", "c2", 13_000), unknown("early", "x", 100), unknown("late", "x", 18_000), *[unknown(f"l{i}", f"l{i - 1}" if i else "y", 14_000 + i) for i in range(5)],
    ]
    got = anchors(spark, chain(30, rows), ["a", "e", "early", "late", "l3"], cap=4)
    assert (got["a"]["a"]["placement"], got["a"]["a"]["approx"], got["a"]["a"]["edge_kind"], got["a"]["a"]["from_hash"]) == (10, True, "orphan_approx", "c10")
    assert (got["e"]["e"]["placement"], got["e"]["e"]["from_hash"]) == (20, "c20")
    assert got["early"]["early"]["placement"] == 0
    assert {r["mode"] for x in ("late", "l3") for r in got[x].values()} == {"strip"} and set(got["late"]) == {r[0] for r in rows}
    assert got["l3"]["l3"]["prev_id"] == got["l3"]["l2"]["id"] and all(r["edge_kind"] is None for r in got["l3"].values())
