"""Tree documents of windows, worked out where a stretch of heights and times is read: one shuffle brings its blocks, parents and windows together.

A window's tree is made of few rows, which windows of near heights share. Rows go to stretches of windows once, not to each window,
and a window's nodes are only made where it is judged.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from pegtrail.session import importable

#: Heights and seconds of a stretch, and the most windows that are worked out together.
HEIGHTS, SECONDS, WINDOWS = 1024, 1024 * 600, 1024

NODES = "id long, hash string, height long, kind string, orphan_class string, prev_id long, prev_hash string, evidence boolean, protected boolean, canonical_hash string, branch_id string, from_hash string, edge_kind string, hidden long"


def _needed(windows: DataFrame, low: str, high: str, size: int) -> DataFrame:
    """(tile, part, bucket, a, z): what each part of a tile needs of each bucket of heights or times."""
    bucket = lambda c: F.floor(F.col(c) / size)
    each = windows.where(F.col(low) <= F.col(high)).select("tile", "part", low, high, F.explode(F.sequence(bucket(low), bucket(high))).alias("bucket"))
    return each.groupBy("tile", "part", "bucket").agg(F.min(low).alias("a"), F.max(high).alias("z"))


def _brought(rows: DataFrame, at: str, need: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col(at) / size)).join(need, "bucket").where(F.col(at).between(F.col("a"), F.col("z"))).drop("bucket", "a", "z")


def stretches(windows: DataFrame, rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Windows (window_id, low, high, first, last), blocks and parents' events by (tile, part), told apart by `tag`.

    A tile is where a window starts; tiles of very many windows are cut into parts, each with the rows that it needs.
    """
    tile = F.coalesce(F.when(F.col("low") <= F.col("high"), F.floor(F.col("low") / HEIGHTS) * 2), F.when(F.col("first") <= F.col("last"), F.floor(F.col("first") / SECONDS) * 2 + 1), F.lit(-1))
    dealt = windows.select("window_id", "low", "high", "first", "last").distinct().withColumn("tile", tile).withColumn("part", F.floor((F.row_number().over(W.partitionBy("tile").orderBy("low", "first", "window_id")) - 1) / WINDOWS))
    by_height, by_time = _needed(dealt, "low", "high", HEIGHTS), _needed(dealt, "first", "last", SECONDS)
    loose = rows.where("kind = 'unknown' and height is null")
    blocks = _brought(rows.where("height is not null"), "height", by_height, HEIGHTS).unionByName(_brought(loose, "time", by_time, SECONDS)).withColumn("tag", F.lit("b"))
    events = _brought(parents, "time", by_time, SECONDS).withColumn("tag", F.lit("e"))
    return dealt.withColumn("tag", F.lit("w")).unionByName(blocks, allowMissingColumns=True).unionByName(events, allowMissingColumns=True)


def _branches(stale: dict[str, dict]) -> dict[str, tuple[str, int]]:
    """(root, its height) of the stale blocks of each branch that has a selected one; on or above a cycle the least hash reached is the root."""
    root: dict[str, str] = {}
    for name in stale:
        path, seen, at = [], set(), name
        while at in stale and at not in root and at not in seen:
            seen.add(at)
            path.append(at)
            at = stale[at]["prev_hash"]
        if at in seen:  # a cycle
            least = min(path[path.index(at) :])
            for x in path[path.index(at) :]:
                root[x] = least
            path = path[: path.index(at)]
        known = root.get(at)
        for x in reversed(path):
            cyclic = known is not None and _on_cycle(known, stale)
            known = root[x] = x if known is None else min(x, known) if cyclic else known
    some = {root[x] for x, r in stale.items() if r["selected"]}
    return {x: (root[x], stale[root[x]]["height"]) for x in stale if root[x] in some}


def _on_cycle(root: str, stale: dict[str, dict]) -> bool:
    """Whether a root's parent is among the stale blocks, as only that of a cycle is."""
    return stale[root]["prev_hash"] in stale


def _fault(low: int, high: int, spine: dict[int, list[dict]]) -> str | None:
    """The first fault of the spine from low to high."""
    below = None
    for h in range(low, high + 1):
        here = spine.get(h, ())
        if len(here) != 1:
            return "duplicate" if here else "missing"
        if h > low and (here[0]["prev_hash"] is None or here[0]["prev_hash"] != below):
            return "link"
        below = here[0]["hash"]
    return None


def _direct(events: list[dict], blocks: set[str], f) -> Iterator[dict]:
    """Near and unknown parents that are no blocks of the window, as candidates."""
    of: dict[str, list[dict]] = {}
    for e in events:
        if e["hash"] not in blocks:
            of.setdefault(e["hash"], []).append(e)
    for name, es in of.items():
        first = min(es, key=lambda e: (e["event_id"], e["prev_hash"] is not None, e["prev_hash"] or "", e["time"]))
        unknown = any(e["kind"] == "unknown" for e in es)
        kind = "unknown" if unknown else "near"
        selected = kind in f.kinds and len({e["code"] for e in es}) >= f.min_sources and (("pending" in f.classes) if unknown else f.near)
        missed = unknown and any(e["missed"] for e in es)
        if selected or missed:
            yield {"hash": name, "prev_hash": first["prev_hash"], "height": None, "kind": kind, "orphan_class": None, "canonical_hash": None, "missed": missed, "evidence": selected, "protected": True, "shown": selected, "branch": None}


def _candidates(members: list[dict]) -> Iterator[dict]:
    branch = _branches({r["hash"]: r for r in members if r["kind"] == "stale" and r["height"] is not None})
    canonical = {r["hash"] for r in members if r["kind"] == "canonical"}
    inside = [r for r in members if r["hash"] in branch]
    kept = {r["prev_hash"] for r in inside if r["prev_hash"] not in branch and r["prev_hash"] in canonical} | {r["canonical_hash"] for r in inside if r["canonical_hash"] is not None}
    for r in members:
        spine, heighted, of = r["kind"] == "canonical", r["height"] is not None, branch.get(r["hash"])
        shown = (heighted and spine) or of is not None or (heighted and r["kind"] == "error_block" and r["selected"]) or (not heighted and r["selected"])
        # an unknown block with a height is loaded, and so must meet the target, but is no node
        missed = r["missed"] and r["kind"] == "unknown"
        if shown or missed:
            yield {**r, "missed": missed, "evidence": r["selected"], "protected": (r["selected"] or r["hash"] in kept) if spine else True, "shown": shown, "branch": of}


def reduce(nodes: list[dict], limit: int) -> None:
    """Marks nodes in their order as spine.reduce_nodes() leaves them: visible, id, and near: the last visible one so far, and the steps to it."""
    runs: list[list[dict]] = []
    before = None
    for n in nodes:
        n["visible"] = True
        if n["height"] is None:
            continue
        if n["kind"] == "canonical":
            if before is not None and before["kind"] == "canonical" and n["prev_hash"] is not None and before["hash"] == n["prev_hash"]:
                runs[-1].append(n)
            else:
                runs.append([n])
        before = n
    inner = [gone for run in runs if (gone := [n for n in run[1:-1] if not n["protected"] and not n["evidence"]])]
    left = len(nodes)
    for gone in sorted(inner, key=lambda g: (-len(g), g[0]["hash"])):
        if left <= limit:
            break
        left -= len(gone)
        for n in gone:
            n["visible"] = False
    near, shown, steps = None, 0, 0
    for n in nodes:
        if n["visible"]:
            near, shown, steps = n, shown + 1, 0
        else:
            steps += 1
        n["id"], n["near"], n["steps"] = shown, near, steps


def connected(nodes: list[dict]) -> Iterator[dict]:
    """Visible nodes with the edge that leads to each, as trees.connected()."""
    by_hash = {n["hash"]: n for n in nodes}
    for n in nodes:
        if not n["visible"]:
            continue
        p = by_hash.get(n["prev_hash"]) if n["prev_hash"] is not None else None
        kind, there = None, False
        if p is not None and p["visible"]:
            there = True
            if n["kind"] == "stale":
                kind = "stale" if p["kind"] == "stale" else "stale_entry"
            elif n["kind"] == "canonical" and p["kind"] == "canonical":
                kind = "canonical"
        elif p is not None and p["near"] is not None and n["kind"] != "error_block":
            there, kind = True, "hidden"
        yield {
            **n, "prev_id": p["near"]["id"] if there else None, "branch_id": f"stale-{n['branch'][1]}-{n['branch'][0]}" if n["branch"] else None, "from_hash": p["near"]["hash"] if kind else None, "edge_kind": kind, "hidden": p["steps"] if kind == "hidden" else None,
        }


def _between(rows: list[dict], times: list[int], first: int | None, last: int | None) -> list[dict]:
    return rows[bisect_left(times, first) : bisect_right(times, last)] if first is not None and last is not None and first <= last else []


def _judge(rows: list[dict], f, limit: int, most_loose: int) -> Iterator[tuple[Any, str | None, list[dict]]]:
    """(window_id, refused, nodes) of the windows of a stretch."""
    heights: dict[int, list[dict]] = {}
    spine: dict[int, list[dict]] = {}
    for r in rows:
        if r["tag"] == "b" and r["height"] is not None:
            heights.setdefault(r["height"], []).append(r)
            if r["kind"] == "canonical":
                spine.setdefault(r["height"], []).append(r)
    timed = lambda keep: sorted((r for r in rows if keep(r) and r["time"] is not None), key=lambda r: r["time"])
    loose, events = timed(lambda r: r["tag"] == "b" and r["height"] is None), timed(lambda r: r["tag"] == "e")
    loose_times, event_times = [r["time"] for r in loose], [r["time"] for r in events]
    for w in rows:
        if w["tag"] != "w":
            continue
        low, high = w["low"], w["high"]
        covered = low is not None and high is not None and low <= high
        members = [r for h in range(low, high + 1) for r in heights.get(h, ())] if covered else []
        free = _between(loose, loose_times, w["first"], w["last"])
        if "unknown" in f.kinds:
            members += [r for r in free if ("pending" if r["orphan_class"] is None else r["orphan_class"]) in f.classes]
        cd = list(_candidates(members))
        cd += _direct(_between(events, event_times, w["first"], w["last"]), {r["hash"] for r in members} | {r["hash"] for r in free}, f)
        nodes = sorted((dict(c) for c in cd if c["shown"]), key=lambda n: (n["height"] is None, n["height"] or 0, n["hash"]))
        reduce(nodes, limit)
        why = _fault(low, high, spine) if covered else None
        if why is None and any(c["missed"] for c in cd):
            why = "unknown_target"
        if why is None and sum(n["height"] is None for n in nodes) > most_loose:
            why = "unheighted_nodes"
        if why is None and any(n["kind"] == "stale" and n["canonical_hash"] is None for n in nodes):
            why = "competition"
        if why is None and (sum(n["protected"] for n in nodes) > limit or sum(n["visible"] for n in nodes) > limit):
            why = "node_count"
        yield w["window_id"], why, nodes


def trees(windows: DataFrame, rows: DataFrame, parents: DataFrame, f, limit: int, loose: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, verdicts) as trees.tree_windows().

    rows: blocks with canonical_hash, missed and selected; parents: live events of near and unknown parents, as hash, prev_hash,
    time, kind, missed, event_id and code.
    """
    importable(windows.sparkSession)
    together = stretches(windows, rows, parents).groupBy("tile", "part")
    key = windows.schema["window_id"]
    node_schema, verdict_schema = StructType([key, *StructType.fromDDL(NODES).fields]), StructType([key, StructField("refused", StringType())])
    node_arrow, verdict_arrow = to_arrow_schema(node_schema), to_arrow_schema(verdict_schema)

    def nodes(table: pa.Table) -> pa.Table:
        found = [{**n, "window_id": name} for name, why, shown in _judge(table.to_pylist(), f, limit, loose) if why is None for n in connected(shown)]
        return pa.Table.from_arrays([pa.array([n[c.name] for n in found], c.type) for c in node_arrow], schema=node_arrow)

    def verdicts(table: pa.Table) -> pa.Table:
        found = [(name, why) for name, why, _ in _judge(table.to_pylist(), f, limit, loose)]
        return pa.Table.from_arrays([pa.array([x[i] for x in found], c.type) for i, c in enumerate(verdict_arrow)], schema=verdict_arrow)

    return together.applyInArrow(nodes, node_schema), together.applyInArrow(verdicts, verdict_schema)
