"""Tree documents of many height windows at once: candidates, protection, reduction, edges and branches by window.

A window is (window_id, low, high, first, last): heights low to high (null: none), and times first to last from which blocks
and parents without a height are taken (null: none). Nodes are chosen once and joined to windows by height or by day, so
windows may overlap; every later step works inside a window, which has few nodes beside the table. A window that can't be
shown isn't an error for the others: it is a row with the reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegtrail.operators import joins as J
from pegtrail.operators import spine as S
from pegtrail.operators import window_trees
from pegtrail.operators.graph import _folder, roots

DAY = 86_400
#: Most nodes of a tree, most of them without a height, heights of the window at the tip.
NODES, UNHEIGHTED, TIP_HEIGHTS = 500, 250, 16


class TreeFilter(NamedTuple):
    """What is evidence: kinds, source codes (none: all), a least number of sources, orphan classes of parents without a height
    (`pending` stands for null), and whether near parents are taken."""

    kinds: tuple[str, ...] = ("canonical", "stale", "error_block", "unknown", "near")
    sources: tuple[str, ...] = ()
    min_sources: int = 1
    classes: tuple[str, ...] = ("strict", "weak")
    near: bool = False


def resolve_windows(requests: DataFrame, block: DataFrame, n: int = TIP_HEIGHTS) -> DataFrame:
    """window_id, low, high, tip, defaulted, empty_reason of requests (window_id, at_height, at_time, low, high).

    A height is its own window; a time is that of the canonical block at or before it; then the bounds asked for; then the
    last n heights up to the default tip.
    """
    times = requests.where("at_height is null and at_time is not null").select(F.col("at_time").alias("t"))
    at = J.height_at_time(block, times).select(F.col("t").alias("at_time"), F.col("height").alias("found"))
    tip = S.default_tip(block, n, n).select(F.col("tip").alias("top"))
    r = requests.join(at, "at_time", "left").crossJoin(F.broadcast(tip))  # one row on the right
    by_time = F.col("at_height").isNull() & F.col("at_time").isNotNull()
    bounds = F.col("low").isNotNull() & F.col("high").isNotNull()
    to_tip = F.col("at_height").isNull() & F.col("at_time").isNull() & ~bounds
    pick = lambda asked, top: F.when(F.col("at_height").isNotNull(), F.col("at_height")).when(by_time, F.col("found")).when(bounds, F.col(asked)).otherwise(top)
    reason = F.when(by_time & F.col("found").isNull(), "no_complete_canonical_at_or_before_time").when(to_tip & F.col("top").isNull(), "no_canonical_tip")
    return r.select("window_id", pick("low", F.when(F.col("top").isNotNull(), F.greatest(F.col("top") - (n - 1), F.lit(0)))).alias("low"), pick("high", F.col("top")).alias("high"), F.when(to_tip, F.col("top")).alias("tip"), to_tip.alias("defaulted"), reason.alias("empty_reason"))


def in_heights(windows: DataFrame, block: DataFrame) -> DataFrame:
    """window_id and the blocks whose height is in the window."""
    heights = windows.where("low <= high").select("window_id", F.explode(F.sequence("low", "high")).alias("height"))
    return heights.join(block, "height")


def in_times(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """window_id and the rows whose `time` is in the window's times: they meet day by day."""
    days = windows.where("first <= last").select("window_id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / DAY), F.floor(F.col("last") / DAY))).alias("day"))
    return days.join(rows.withColumn("day", F.floor(F.col("time") / DAY)), "day").where("time between first and last").drop("day", "first", "last")


def competing(block: DataFrame) -> DataFrame:
    """(hash, canonical_hash) of stale blocks that lost to a canonical one of their height."""
    stale = block.where("kind = 'stale'").select("hash", F.col("competitor_hash").alias("canonical_hash"), "height")
    canonical = block.where("kind = 'canonical'").select(F.col("hash").alias("canonical_hash"), "height")
    return stale.join(canonical, ["canonical_hash", "height"]).select("hash", "canonical_hash")


def seen_by(block: DataFrame, event: DataFrame, source: DataFrame, codes: tuple[str, ...] = ()) -> DataFrame:
    """(hash, sources, missed): distinct sources of a parent's live events and of the node, and whether an event misses the target."""
    e = J.filter_sources(event.where("revoked_at is null").join(F.broadcast(source.select("source_id", "code")), "source_id"), list(codes))
    seen = e.select(F.col("parent_hash").alias("hash"), "code", (~F.coalesce("pow_ok", F.lit(False))).alias("missed"))
    own = J.filter_sources(block.where("core_attested").select("hash", F.lit("core").alias("code"), F.lit(False).alias("missed")), list(codes))
    # a set holds no more codes than there are sources, and is gathered before the shuffle
    return seen.unionByName(own).groupBy("hash").agg(F.size(F.collect_set("code")).cast("long").alias("sources"), F.bool_or("missed").alias("missed"))


def tree_events(windows: DataFrame, members: DataFrame, event: DataFrame, source: DataFrame, codes: tuple[str, ...] = ()) -> DataFrame:
    """window_id and live events: of the window's blocks (window_id, hash), and of near and unknown parents in its times."""
    live = J.filter_sources(event.where("revoked_at is null").join(F.broadcast(source.select("source_id", "code")), "source_id"), list(codes))
    of_blocks = members.select("window_id", F.col("hash").alias("parent_hash")).join(live, "parent_hash")
    direct = in_times(windows, live.where("parent_kind in ('near', 'unknown')").withColumn("time", F.col("parent_time"))).drop("time")
    again = members.select("window_id", F.col("hash").alias("parent_hash"))
    return of_blocks.unionByName(direct.join(again, ["window_id", "parent_hash"], "left_anti"))


def _key(column: str) -> Column:
    return F.concat(F.col(column), F.lit("|"), F.col("window_id").cast("string"))


def stale_members(members: DataFrame) -> DataFrame:
    """(window_id, hash, root, root_height): stale blocks of each branch, of the window's blocks alone, that has a selected one.

    members: window_id, hash, prev_hash, height, kind, selected. Windows cut branches: a root is a block whose parent isn't
    among the window's stale blocks.
    """
    stale = members.where("kind = 'stale' and height is not null").select("window_id", "hash", "prev_hash", "height", "selected")
    r = roots(stale.select(_key("hash").alias("hash"), _key("prev_hash").alias("prev_hash"))).select(F.col("hash").alias("key"), "root")
    named = stale.withColumn("key", _key("hash")).join(r, "key")
    taken = named.groupBy(F.col("root").alias("of")).agg(F.bool_or("selected").alias("any"), F.max(F.when(F.col("key") == F.col("root"), F.struct("hash", "height"))).alias("r")).where("any")
    return named.join(taken, F.col("root") == F.col("of")).select("window_id", "hash", F.col("r.hash").alias("root"), F.col("r.height").alias("root_height"))


def protected_nodes(members: DataFrame, branch: DataFrame) -> DataFrame:
    """(window_id, hash): canonical blocks that branches hang off, and the canonical competitors of their members."""
    inside = members.join(branch.select("window_id", "hash"), ["window_id", "hash"], "left_semi")
    below = inside.select("window_id", F.col("prev_hash").alias("hash")).join(branch.select("window_id", "hash"), ["window_id", "hash"], "left_anti")
    attach = below.join(members.where("kind = 'canonical'").select("window_id", "hash"), ["window_id", "hash"], "left_semi")
    rivals = inside.where("canonical_hash is not null").select("window_id", F.col("canonical_hash").alias("hash"))
    return attach.unionByName(rivals).distinct()


def judged_blocks(block: DataFrame, seen: DataFrame, comp: DataFrame, f: TreeFilter) -> DataFrame:
    """Blocks with what they lost to, whether an event misses the target, and whether they are selected."""
    rows = block.select("hash", "prev_hash", "height", "kind", "time", "orphan_class").join(seen, "hash", "left").join(comp, "hash", "left")
    enough = F.col("kind").isin(*f.kinds) & (F.coalesce("sources", F.lit(0)) >= f.min_sources)
    return rows.select("hash", "prev_hash", "height", "kind", "time", "orphan_class", "canonical_hash", F.coalesce("missed", F.lit(False)).alias("missed"), enough.alias("selected"))


def window_members(windows: DataFrame, block: DataFrame, seen: DataFrame, comp: DataFrame, f: TreeFilter) -> DataFrame:
    """window_id and blocks with their sources, what they lost to, and whether they are selected: all of the heights, and unknown
    ones without a height of the times and classes."""
    rows = judged_blocks(block, seen, comp, f)
    found = in_heights(windows, rows)
    if "unknown" in f.kinds:
        found = found.unionByName(in_times(windows, J.filter_orphan_class(rows.where("kind = 'unknown' and height is null"), list(f.classes))).select(*found.columns))
    return found


def direct_nodes(windows: DataFrame, members: DataFrame, block: DataFrame, event: DataFrame, source: DataFrame, comp: DataFrame, f: TreeFilter) -> DataFrame:
    """Near and unknown parents of the times that the window has no block for, as members: unknown if any event says so.

    Those of an unknown block without a height are never shown this way, whatever its class.
    """
    own = members.select("window_id", "hash")
    both = comp.select("hash", F.array("hash", "canonical_hash").alias("both")).unionByName(comp.select(F.col("canonical_hash").alias("hash"), F.array("hash", "canonical_hash").alias("both")))
    rivals = own.join(both, "hash").select("window_id", F.explode("both").alias("hash"))
    loose = in_times(windows, block.where("kind = 'unknown' and height is null").select("hash", "time")).select("window_id", "hash")
    blocks = own.unionByName(rivals).unionByName(loose).select("window_id", F.col("hash").alias("parent_hash")).distinct()
    live = J.filter_sources(event.where("revoked_at is null and parent_kind in ('near', 'unknown')").join(F.broadcast(source.select("source_id", "code")), "source_id"), list(f.sources))
    found = in_times(windows, live.withColumn("time", F.col("parent_time"))).join(blocks, ["window_id", "parent_hash"], "left_anti")
    first = F.min(F.struct("event_id", "parent_prev_hash", "time"))
    g = found.groupBy("window_id", F.col("parent_hash").alias("hash")).agg(first.alias("e"), F.bool_or(F.col("parent_kind") == "unknown").alias("unknown"), F.count_distinct("code").alias("sources"), F.bool_or(~F.coalesce("pow_ok", F.lit(False))).alias("missed"))
    kind = F.when(F.col("unknown"), "unknown").otherwise("near")
    allowed = (F.col("unknown") & F.lit("pending" in f.classes)) | (~F.col("unknown") & F.lit(f.near))
    selected = kind.isin(*f.kinds) & (F.col("sources") >= f.min_sources) & allowed
    none = F.lit(None)
    return g.select(
        "window_id", "hash", F.col("e.parent_prev_hash").alias("prev_hash"), none.cast("long").alias("height"), kind.alias("kind"), F.col("e.time").alias("time"), none.cast("string").alias("orphan_class"), none.cast("string").alias("canonical_hash"),
        (F.col("missed") & F.col("unknown")).alias("missed"), selected.alias("selected"),
    )


def tree_candidates(windows: DataFrame, block: DataFrame, event: DataFrame, source: DataFrame, f: TreeFilter = TreeFilter()) -> DataFrame:
    """window_id and the nodes that may be shown, with evidence, protected, branch root, and whether an unknown one misses the target.

    Canonical blocks of the heights always may; stale ones with a selected one in their branch, error blocks, parents without a
    height and direct parents if they are selected. Protected is what is evidence, hangs in a branch, carries one or beat one.
    """
    _folder(block)
    comp = competing(block).checkpoint()
    members = window_members(windows, block, seen_by(block, event, source, f.sources), comp, f).checkpoint()
    branch = stale_members(members).checkpoint()
    kept = protected_nodes(members, branch).withColumn("kept", F.lit(True))
    rows = members.join(branch, ["window_id", "hash"], "left").join(kept, ["window_id", "hash"], "left")
    heighted, canonical = F.col("height").isNotNull(), F.col("kind") == "canonical"
    shown = (heighted & canonical) | F.col("root").isNotNull() | (heighted & (F.col("kind") == "error_block") & F.col("selected")) | (~heighted & F.col("selected"))
    # an unknown block with a height is loaded, and so must meet the target, but is no node
    rows = rows.withColumn("missed", F.col("missed") & (F.col("kind") == "unknown")).where(shown | F.col("missed")).withColumn("shown", shown)
    rows = rows.withColumn("protected", F.when(canonical, F.col("selected") | F.coalesce("kept", F.lit(False))).otherwise(True)).drop("kept")
    direct = direct_nodes(windows, members, block, event, source, comp, f).where("selected or missed")
    direct = direct.withColumn("shown", F.col("selected")).withColumn("protected", F.lit(True))
    return rows.unionByName(direct, allowMissingColumns=True).select("window_id", "hash", "prev_hash", "height", "kind", "time", "orphan_class", "canonical_hash", "root", "root_height", F.col("selected").alias("evidence"), "protected", "missed", "shown")


def reduced(candidates: DataFrame, limit: int = NODES) -> DataFrame:
    """Candidates with `visible`, and for hidden ones the nearest visible block of their run below, and how many steps it is away."""
    nodes = candidates.select("window_id", "hash", "prev_hash", "height", "kind", (~F.col("protected") & ~F.col("evidence")).alias("removable"))
    left = S.reduce_nodes(nodes, limit).select("window_id", "hash", F.lit(True).alias("visible"))
    marked = candidates.join(left, ["window_id", "hash"], "left").withColumn("visible", F.coalesce("visible", F.lit(False)))
    order = W.partitionBy("window_id").orderBy(F.col("height").isNull(), "height", "hash")
    placed = marked.withColumn("place", F.row_number().over(order)).withColumn("id", F.sum(F.col("visible").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("visible"), F.struct("hash", "place", "id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("last", last).select(*marked.columns, "id", F.col("last.hash").alias("near_hash"), F.col("last.id").alias("near_id"), (F.col("place") - F.col("last.place")).cast("long").alias("steps"))


def connected(placed: DataFrame) -> DataFrame:
    """Visible nodes of reduced() with id, prev_id and the one edge that leads to each: from_hash, edge_kind and hidden.

    A parent that is shown gives an edge to stale blocks and between canonical ones; one that is hidden gives a hidden edge
    from the nearest visible block below it, but not to error blocks.
    """
    below = placed.select("window_id", F.col("hash").alias("prev_hash"), F.col("kind").alias("below"), F.col("visible").alias("below_visible"), F.col("near_hash").alias("from_hash"), F.col("near_id").alias("from_id"), F.col("steps").alias("below_steps"))
    joined = placed.where("visible").drop("near_hash", "near_id", "steps", "visible").join(below, ["window_id", "prev_hash"], "left")
    there = F.coalesce("below_visible", F.lit(False)) | (F.col("from_hash").isNotNull() & ~F.coalesce("below_visible", F.lit(True)) & (F.col("kind") != "error_block"))
    kind = F.when(F.col("below_visible"), F.when(F.col("kind") == "stale", F.when(F.col("below") == "stale", "stale").otherwise("stale_entry")).when((F.col("kind") == "canonical") & (F.col("below") == "canonical"), "canonical")).when(there, "hidden")
    return joined.select(
        "window_id", "id", "hash", "height", "kind", "orphan_class", F.when(there, F.col("from_id")).alias("prev_id"), "prev_hash", "evidence", "protected", "canonical_hash", F.when(F.col("root").isNotNull(), F.concat(F.lit("stale-"), F.col("root_height").cast("string"), F.lit("-"), F.col("root"))).alias("branch_id"),
        F.when(kind.isNotNull(), F.col("from_hash")).alias("from_hash"), kind.alias("edge_kind"), F.when(kind == "hidden", F.col("below_steps")).alias("hidden"),
    )


def window_verdicts(windows: DataFrame, block: DataFrame, candidates: DataFrame, placed: DataFrame, limit: int = NODES, loose: int = UNHEIGHTED) -> DataFrame:
    """(window_id, refused): null, or the first reason: the spine's (missing, duplicate, link), unknown_target, unheighted_nodes, competition, node_count."""
    spine = S.coverage_verdict(windows.where("low <= high").select("window_id", "low", "high"), block).where("verdict <> 'ok'").select("window_id", "verdict")
    of = candidates.groupBy("window_id").agg(
        F.bool_or("missed").alias("missed"), F.count_if(F.col("shown") & F.col("height").isNull()).alias("loose"), F.bool_or(F.col("shown") & (F.col("kind") == "stale") & F.col("canonical_hash").isNull()).alias("alone"), F.count_if(F.col("shown") & F.col("protected")).alias("kept"),
    )
    left = placed.where("visible").groupBy("window_id").agg(F.count("*").alias("nodes"))
    j = windows.select("window_id").distinct().join(spine, "window_id", "left").join(of, "window_id", "left").join(left, "window_id", "left")
    why = F.coalesce("verdict", F.when(F.col("missed"), "unknown_target"), F.when(F.col("loose") > loose, "unheighted_nodes"), F.when(F.col("alone"), "competition"), F.when((F.col("kept") > limit) | (F.col("nodes") > limit), "node_count"))
    return j.select("window_id", why.alias("refused"))


def tree_windows(windows: DataFrame, block: DataFrame, event: DataFrame, source: DataFrame, f: TreeFilter = TreeFilter(), limit: int = NODES, loose: int = UNHEIGHTED) -> tuple[DataFrame, DataFrame]:
    """(nodes, verdicts): connected() nodes of all windows that can be shown, and (window_id, refused) of every window.

    block: hash, prev_hash, height, kind, time, orphan_class, competitor_hash, core_attested. event: as elsewhere, with
    parent_time and parent_prev_hash.
    """
    rows = judged_blocks(block, seen_by(block, event, source, f.sources), competing(block), f)
    live = J.filter_sources(event.where("revoked_at is null and parent_kind in ('near', 'unknown')").join(F.broadcast(source.select("source_id", "code")), "source_id"), list(f.sources))
    parents = live.select(F.col("parent_hash").alias("hash"), F.col("parent_prev_hash").alias("prev_hash"), F.col("parent_time").alias("time"), F.col("parent_kind").alias("kind"), (~F.coalesce("pow_ok", F.lit(False))).alias("missed"), "event_id", "code")
    return window_trees.trees(windows, rows, parents, f, limit, loose)


def tree_branches(nodes: DataFrame) -> DataFrame:
    """Branches of tree_windows() nodes: window_id, branch_id, root, tip, low, high, depth, members and competitors by height."""
    member = F.struct(F.coalesce("height", F.lit(0)).alias("h"), "id", "hash", "canonical_hash")
    g = nodes.where("branch_id is not null").groupBy("window_id", "branch_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    first, last = F.element_at("m", 1), F.element_at("m", -1)
    return g.select(
        "window_id", "branch_id", first["hash"].alias("root_hash"), last["hash"].alias("tip_hash"), first["h"].alias("low"), last["h"].alias("high"), F.size("m").cast("long").alias("depth"), F.transform("m", lambda x: x["hash"]).alias("members"),
        F.filter(F.transform("m", lambda x: x["canonical_hash"]), lambda x: x.isNotNull()).alias("competitors"),
    )


def tree_documents(windows: DataFrame, nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a window: its bounds, why it is refused, hidden blocks in all, and nodes, edges and branches as lists.

    Nodes are in the order of their ids, edges in that of the node that they lead to, branches by height and root.
    """
    shown = nodes.groupBy("window_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "hash", "height", "kind", "orphan_class", "prev_id", "prev_hash", "branch_id"))).alias("nodes"),
        F.array_sort(F.collect_list(F.when(F.col("edge_kind").isNotNull(), F.struct(F.col("id").alias("to_id"), "from_hash", F.col("hash").alias("to_hash"), F.col("hidden").alias("hidden_count"), "edge_kind")))).alias("edges"),
        F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden_blocks"),
    )
    branches = tree_branches(nodes).groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("low", "root_hash", "branch_id", "tip_hash", "high", "depth", "members", "competitors"))).alias("branches"))
    return windows.join(verdicts, "window_id").join(shown, "window_id", "left").join(branches, "window_id", "left")
