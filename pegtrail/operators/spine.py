"""Windows over the height-ordered spine, paging, and interval operations.

An ordered window without partitions would put all rows in one task. Where the axis is long, heights are dealt out in
segments and what a segment needs from its neighbours is joined on: the rows one height below, or the segments' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Heights of a segment.
SEGMENT = 100_000


def clean_spine(block: DataFrame) -> DataFrame:
    """(height, hash, prev_hash, n): canonical heights, how many rows each has, and its least hash."""
    return block.where("kind = 'canonical' and height is not null").groupBy("height").agg(F.count("*").alias("n"), F.min("hash").alias("hash"), F.min("prev_hash").alias("prev_hash"))


def linked_spine(block: DataFrame) -> DataFrame:
    """The spine with `linked`: the height is alone, and so is the one below, whose hash it names."""
    s = clean_spine(block)
    below = s.select((F.col("height") + 1).alias("height"), F.col("hash").alias("below_hash"), F.col("n").alias("below_n"))
    return s.join(below, "height", "left").withColumn("linked", F.coalesce((F.col("n") == 1) & (F.col("below_n") == 1) & (F.col("prev_hash") == F.col("below_hash")), F.lit(False)))


def islands(block: DataFrame) -> DataFrame:
    """(height, hash, island): runs of linked heights; an island is named by its first height.

    Within segments the last break is a running maximum; a segment that has no break goes on from the segments before.
    """
    rows = linked_spine(block).where("n = 1").withColumn("seg", F.floor(F.col("height") / SEGMENT))
    broken = F.when(~F.col("linked"), F.col("height"))
    own = rows.withColumn("start", F.max(broken).over(W.partitionBy("seg").orderBy("height")))
    last = rows.groupBy("seg").agg(F.max(broken).alias("b"))
    before = last.select("seg", F.max("b").over(W.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    return own.join(F.broadcast(before), "seg", "left").select("height", "hash", F.coalesce("start", "carried").alias("island"))


def sparse_tip(block: DataFrame, n: int) -> DataFrame:
    """One row: the greatest height that ends n contiguous linked heights, or all of them from genesis."""
    i = islands(block)
    return i.where((F.col("height") - F.col("island") + 1 >= n) | (F.col("island") == 0)).agg(F.max("height").alias("tip"))


def contiguous_prefix(block: DataFrame) -> DataFrame:
    """One row: the last height of the linked run from genesis, or null."""
    return islands(block).where("island = 0").agg(F.max("height").alias("prefix_tip"))


def contiguous_tip(block: DataFrame, n: int) -> DataFrame:
    """One row: the greatest height, if the n heights that end there are complete and linked, else null."""
    top = clean_spine(block).agg(F.max("height").alias("top"))
    ends = islands(block).select(F.col("height").alias("top"), "island")
    return top.join(ends, "top", "left").select(F.when(F.col("top") - F.col("island") + 1 >= n, F.col("top")).alias("tip"))


def default_tip(block: DataFrame, n: int, lenient: int) -> DataFrame:
    """One row: the strict contiguous tip, else the sparse one, else a contiguous one of fewer heights."""
    a, b, c = contiguous_tip(block, n).toDF("a"), sparse_tip(block, n).toDF("b"), contiguous_tip(block, lenient).toDF("c")
    return a.crossJoin(b).crossJoin(c).select(F.coalesce("a", "b", "c").alias("tip"))  # one row each


def coverage_verdict(windows: DataFrame, block: DataFrame) -> DataFrame:
    """For each window: ok, or what is wrong at its first offending height: missing, duplicate or link."""
    heights = windows.select("window_id", "low", F.explode(F.sequence("low", "high")).alias("height"))
    spine = linked_spine(block)
    what = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(~F.col("linked") & (F.col("height") > F.col("low")), "link")
    bad = heights.join(spine, "height", "left").withColumn("what", what)
    first = bad.groupBy("window_id").agg(F.min(F.when(F.col("what").isNotNull(), F.struct("height", "what"))).alias("b"))
    return first.select("window_id", F.coalesce("b.what", F.lit("ok")).alias("verdict"), F.col("b.height").alias("at"))


def verify_tip_window(block: DataFrame, tip_hash: str, n: int) -> DataFrame:
    """One row: whether n linked heights end at the block `tip_hash`."""
    tip = islands(block).where(F.col("hash") == tip_hash)
    return tip.agg(F.coalesce(F.max((F.col("height") - F.col("island") + 1 >= n)), F.lit(False)).alias("verified"))


def spine_conflicts(block: DataFrame) -> DataFrame:
    """Heights with several canonical rows, and heights that don't name the one below."""
    s = linked_spine(block)
    return s.where("n > 1 or (below_hash is not null and not linked)").select("height", F.when(F.col("n") > 1, "duplicate").otherwise("link").alias("conflict"))


def hidden_edges(visible: DataFrame, block: DataFrame) -> DataFrame:
    """For each visible canonical height: the nearest visible one below on the same island, and how many lie between.

    visible: (height). The nearest one below comes from a running maximum in segments, as islands do.
    """
    v = visible.distinct().join(islands(block), "height").withColumn("seg", F.floor(F.col("height") / SEGMENT))
    own = v.withColumn("below", F.max("height").over(W.partitionBy("seg").orderBy("height").rowsBetween(W.unboundedPreceding, -1)))
    tops = v.groupBy("seg").agg(F.max("height").alias("top"))
    before = tops.select("seg", F.max("top").over(W.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    near = own.join(F.broadcast(before), "seg", "left").withColumn("below", F.coalesce("below", "carried"))
    return near.where(F.col("below") >= F.col("island")).select("height", F.col("below").alias("from_height"), (F.col("height") - F.col("below") - 1).alias("hidden"))


def reduce_nodes(nodes: DataFrame, limit: int = 500) -> DataFrame:
    """Nodes of each window, without removable interiors of its longest canonical runs while there are more than `limit`.

    nodes: (window_id, height, hash, prev_hash, kind, removable). In the order of height and hash, a run is canonical nodes
    each of which names the one before; its two ends stay, and of what is between the removable ones go. Runs with most to
    remove go first, ties by the first hash that would go. A removed run leaves ends that nothing links, so that runs are
    found once. `too_large` marks windows that stay above the limit. Nodes without a height are in no run.
    """
    w = W.partitionBy("window_id").orderBy("height", "hash")
    placed = nodes.where("height is not null")
    follows = (F.col("kind") == "canonical") & F.coalesce((F.lag("kind").over(w) == "canonical") & (F.lag("hash").over(w) == F.col("prev_hash")), F.lit(False))
    run = placed.withColumn("step", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("step").over(w)).withColumn("place", F.row_number().over(w)).where("kind = 'canonical'")
    by_run = W.partitionBy("window_id", "run")
    inside = run.withColumn("first", F.min("place").over(by_run)).withColumn("last", F.max("place").over(by_run)).where("place > first and place < last and removable")
    sizes = inside.groupBy("window_id", "run").agg(F.count("*").alias("size"), F.min_by("hash", "place").alias("h"))
    count = nodes.groupBy("window_id").agg(F.count("*").alias("nodes"))
    order = W.partitionBy("window_id").orderBy(F.col("size").desc(), "h").rowsBetween(W.unboundedPreceding, -1)
    gone = sizes.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(count, "window_id").where(F.col("nodes") - F.col("before") > limit).select("window_id", "run", "size")
    dropped = inside.join(gone, ["window_id", "run"], "left_semi").select("window_id", "hash")
    left = count.join(gone.groupBy("window_id").agg(F.sum("size").alias("gone")), "window_id", "left").select("window_id", (F.col("nodes") - F.coalesce("gone", F.lit(0)) > limit).alias("too_large"))
    return nodes.join(dropped, ["window_id", "hash"], "left_anti").join(left, "window_id")


def page(df: DataFrame, keys: list[Column], after: Column | None, n: int) -> DataFrame:
    """The first n + 1 rows in the order of `keys` past the predicate `after`; the extra row tells of a next page."""
    return (df if after is None else df.where(after)).orderBy(*keys).limit(n + 1)


def navigate_stale(block: DataFrame, n: int, height: int | None = None, hash_: str | None = None, newer: bool = False) -> DataFrame:
    """A page of stale blocks by height descending, hash ascending, older or newer than a cursor."""
    h, x = F.col("height"), F.col("hash")
    stale = block.where("kind = 'stale'")
    if height is None:
        return page(stale, [h.desc(), x.asc()], None, n)
    if newer:
        return page(stale, [h.asc(), x.desc()], (h > height) | ((h == height) & (x < hash_)), n)
    return page(stale, [h.desc(), x.asc()], (h < height) | ((h == height) & (x > hash_)), n)


def navigate_error(block: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """A page of error blocks that some source has seen."""
    return page(block.where("kind = 'error_block'").join(seen, "hash", "left_semi"), [F.col("height").desc(), F.col("hash").asc()], None, n)


def navigate_orphan(block: DataFrame, n: int, classes: list[str], time: int | None = None, hash_: str | None = None) -> DataFrame:
    """A page of unknown blocks by time and hash, both descending."""
    from pegtrail.operators.joins import filter_orphan_class

    rows = filter_orphan_class(block.where("kind = 'unknown'"), classes)
    after = None if time is None else (F.col("time") < time) | ((F.col("time") == time) & (F.col("hash") < hash_))
    return page(rows, [F.col("time").desc(), F.col("hash").desc()], after, n)


def has_edge(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: whether any row satisfies the predicate."""
    return df.where(predicate).limit(1).agg((F.count("*") > 0).alias("found"))


def placed_strips(block: DataFrame, anchors: DataFrame, classes: list[str], k: int = 249, step: int = 604_800) -> DataFrame:
    """nearest_strip() with each row's number in its strip (id), and that of its parent if the strip holds it (prev_id).

    Blocks are numbered week by week over the weeks' totals, and an anchor's neighbours are the numbers around its own, so that no
    window is opened for it. Anchors and numbers meet by buckets of k + 1 numbers; what they give isn't shuffled again.
    """
    from pegtrail.operators.joins import filter_orphan_class

    rows = filter_orphan_class(block.where("kind = 'unknown'"), classes).select("hash", "prev_hash", "time", F.floor(F.col("time") / step).alias("week"))
    weeks = rows.groupBy("week").agg(F.count("*").alias("n"))
    before = weeks.select("week", F.coalesce(F.sum("n").over(W.orderBy("week").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("own", F.row_number().over(W.partitionBy("week").orderBy("time", "hash"))).join(before, "week").select("hash", "prev_hash", "time", (F.col("before") + F.col("own") - 1).alias("place"))
    total = weeks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    at = numbered.join(anchors.select(F.col("anchor_id").alias("hash")).distinct(), "hash").select(F.col("hash").alias("anchor_id"), F.col("place").alias("own")).crossJoin(F.broadcast(total))
    newer, older = F.least(F.col("total") - 1 - F.col("own"), F.lit(k)), F.least(F.col("own"), F.lit(k))
    first = F.least(newer, F.lit((k + 1) // 2))
    below = F.least(older, k - first)
    bucket = lambda c: F.floor(F.col(c) / (k + 1))
    around = at.select("anchor_id", (F.col("own") - below).alias("low"), (F.col("own") + F.least(newer, k - below)).alias("high")).select("*", F.explode(F.sequence(bucket("low"), bucket("high"))).alias("bucket"))
    named = numbered.join(numbered.select(F.col("hash").alias("prev_hash"), F.col("place").alias("under")), "prev_hash", "left").withColumn("bucket", bucket("place"))
    found = around.hint("shuffle_merge").join(named, "bucket").where("place between low and high")
    return found.select("anchor_id", "time", "hash", (F.col("place") - F.col("low") + 1).alias("id"), F.when(F.col("under").between(F.col("low"), F.col("high")), F.col("under") - F.col("low") + 1).alias("prev_id"))


def nearest_strip(block: DataFrame, anchors: DataFrame, classes: list[str], k: int = 249, step: int = 604_800) -> DataFrame:
    """For each anchor, itself and its k nearest unknown blocks in the order of time and hash, balanced: half of them newer, and a
    side that runs short gives its share to the other.

    anchors: (anchor_id), hashes of unknown blocks of the classes; others have no strip.
    """
    return placed_strips(block, anchors, classes, k, step).select("anchor_id", "time", "hash")


def merge_windows(df: DataFrame, by: str = "group_id") -> DataFrame:
    """(low, high) intervals of each group, merged where they overlap or adjoin."""
    w = W.partitionBy(by).orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(F.coalesce(F.col("low") > reach + 1, F.lit(True)), 1).otherwise(0)).withColumn("isle", F.sum("new").over(w))
    return marked.groupBy(by, "isle").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("isle")


def navigation_windows(targets: DataFrame, block: DataFrame, budget: int, pad: int = 16) -> DataFrame:
    """For each target height: the first window (low rising, then high falling) that is covered and has few side blocks.

    targets: (target_id, height). A window goes from height - i to height + j, 0 <= i, j <= pad, cut at 0. Each target meets
    the heights around it once; which ends fit is read off running sums over them, within the target's row.
    """
    counts = block.where("height is not null and kind in ('canonical', 'stale', 'error_block')").groupBy("height").agg(F.bool_or(F.col("kind") == "canonical").alias("here"), F.count_if(F.col("kind") != "canonical").alias("side"))
    around = targets.select("target_id", F.col("height").alias("own"), F.posexplode(F.sequence(F.col("height") - pad, F.col("height") + pad)).alias("at", "height"))
    # heights below 0 are no gap: a window that starts there is one from 0
    gap = (~F.coalesce("here", F.lit(False)) & (F.col("height") >= 0)).cast("int")
    rows = around.join(counts, "height", "left").groupBy("target_id", "own").agg(F.array_sort(F.collect_list(F.struct("at", gap.alias("gap"), F.coalesce("side", F.lit(0)).alias("side")))).alias("a"))
    zero = F.array(F.struct(F.lit(0).alias("gap"), F.lit(0).cast("long").alias("side")))
    grown = lambda acc, x: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["gap"] + x["gap"]).alias("gap"), (F.element_at(acc, -1)["side"] + x["side"]).alias("side"))))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value that `use` names often

    def fits(s, i, k):
        low, high = F.get(s, i), F.get(s, k + 1)
        return (high["gap"] == low["gap"]) & (high["side"] - low["side"] <= budget)

    # what fits up to a height fits up to every lower one, so that the first low is the first that fits up to the target
    first = lambda s: F.get(F.filter(F.sequence(F.lit(0), F.lit(pad)), lambda i: fits(s, i, F.lit(pad))), F.lit(0))
    last = lambda s, i: F.array_max(F.filter(F.sequence(F.lit(pad), F.lit(2 * pad)), lambda k: fits(s, i, k)))
    ends = once(F.aggregate("a", zero, grown), lambda s: once(first(s), lambda i: F.when(i.isNotNull(), F.struct(i.alias("i"), last(s, i).alias("k")))))
    found = rows.select("target_id", "own", F.explode(F.filter(F.array(ends), lambda w: w.isNotNull())).alias("w"))
    return found.select("target_id", F.greatest(F.col("own") - pad + F.col("w.i"), F.lit(0)).alias("low"), (F.col("own") - pad + F.col("w.k")).alias("high"))


def navigate_branches(branches: DataFrame, n: int, cursor: tuple | None = None, newer: bool = False, anchor: str | None = None) -> DataFrame:
    """A page of branches (root, low, high, members): the greatest `high` first, then the greatest `low`, then the least root.

    A cursor (high, low, root) gives the branches behind it, or with `newer` those before it, nearest first; an anchor
    gives the branch that it is a member of.
    """
    if anchor is not None:
        return branches.where(F.array_contains("members", anchor))
    keys = [F.col("high"), F.col("low"), F.col("root")]
    if cursor is None:
        return page(branches, [keys[0].desc(), keys[1].desc(), keys[2].asc()], None, n)
    high, low, root = (F.lit(x) for x in cursor)
    if newer:
        after = (keys[0] > high) | (keys[0] == high) & ((keys[1] > low) | (keys[1] == low) & (keys[2] < root))
        return page(branches, [keys[0].asc(), keys[1].asc(), keys[2].desc()], after, n)
    after = (keys[0] < high) | (keys[0] == high) & ((keys[1] < low) | (keys[1] == low) & (keys[2] > root))
    return page(branches, [keys[0].desc(), keys[1].desc(), keys[2].asc()], after, n)
