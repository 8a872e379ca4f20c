"""Joins of events, blocks and their context; filters that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegtrail.operators.rollups import active


def filter_kinds(block: DataFrame, kinds: list[str]) -> DataFrame:
    return block.where(F.col("kind").isin(kinds))


def filter_orphan_class(block: DataFrame, classes: list[str]) -> DataFrame:
    """Blocks of these orphan classes; `pending` stands for null."""
    some = F.col("orphan_class").isin([c for c in classes if c != "pending"])
    return block.where(F.coalesce(some, F.lit(False)) | (F.lit("pending" in classes) & F.col("orphan_class").isNull() & (F.col("kind") == "unknown")))


def filter_sources(df: DataFrame, codes: list[str], column: str = "code") -> DataFrame:
    """Rows of these sources, or all if there are none named."""
    return df.where(F.col(column).isin(codes)) if codes else df


def min_sources(df: DataFrame, n: int) -> DataFrame:
    """Evidence rows with at least n sources; canonical context always stays."""
    return df.where((F.col("kind") == "canonical") | (F.col("sources") >= n))


def window_blocks(block: DataFrame, low: int, high: int, first: int, last: int) -> DataFrame:
    """Blocks in a height window, or without a height but in a time window."""
    return block.where(F.col("height").between(low, high) | (F.col("height").isNull() & F.col("time").between(first, last)))


def event_details(event: DataFrame, source: DataFrame, pool: DataFrame) -> DataFrame:
    """Events with their source's code and, where known, the child pool's slug."""
    return event.join(F.broadcast(source), "source_id").join(pool.select(F.col("pool_id").alias("child_pool_id"), F.col("slug").alias("child_slug")), "child_pool_id", "left").select("event_id", "code", "parent_hash", "child_height", "child_slug")


def known_stale(block: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks whose hash is in a published list of stale ones."""
    return block.join(known.select("hash").distinct(), "hash", "left_semi")


def removed_events(event: DataFrame, provenance: DataFrame) -> DataFrame:
    """Events that the present snapshot no longer has."""
    return event.join(provenance.select("event_id").distinct(), "event_id", "left_anti")


def linked_orphans(block: DataFrame) -> DataFrame:
    """Unknown blocks of a class (not excluded) that have a parent or a child among them."""
    c = block.where("kind = 'unknown' and coalesce(orphan_class, 'pending') <> 'excluded'")
    has_parent = c.join(c.select(F.col("hash").alias("prev_hash")), "prev_hash", "left_semi").select("hash")
    has_child = c.join(c.select(F.col("prev_hash").alias("hash")), "hash", "left_semi").select("hash")
    return c.join(has_parent.unionByName(has_child).distinct(), "hash", "left_semi")


def direct_parents(event: DataFrame, block: DataFrame) -> DataFrame:
    """Near or unknown parents of live events that have no block."""
    e = event.where("revoked_at is null and parent_kind in ('near', 'unknown')").join(block.select(F.col("hash").alias("parent_hash")), "parent_hash", "left_anti")
    return e.groupBy("parent_hash").agg(F.count("*").alias("events"), F.count_distinct("source_id").alias("sources"), F.max(F.when(F.col("parent_kind") == "unknown", 1).otherwise(0)).alias("unknown"))


#: Seconds in which epochs and times stand in one order: about those of an epoch.
EPOCH_STEP = 14 * 86_400


def _last_so_far(given: DataFrame, asked: DataFrame, ties: list[Column], step: int) -> DataFrame:
    """(at, b) of each time asked for (at): the last of `given` (at, b) at or before it, of equal times the last by `ties`."""
    day = F.floor(F.col("at") / step).alias("d")
    wanted = asked.select("at").distinct().select(day, "at", F.lit(None).cast(given.schema["b"].dataType).alias("b"))
    w = W.partitionBy("d").orderBy("at", F.col("b").isNull(), *ties)
    upto = lambda end: F.last("b", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, end))
    rows = given.select(day, "at", "b").unionByName(wanted).select("d", "at", "b", upto(W.currentRow).alias("own"), upto(W.unboundedFollowing).alias("late"), F.row_number().over(w).alias("n"))
    before = rows.where("n = 1").select("d", F.last("late", ignorenulls=True).over(W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    return rows.where("b is null").select("d", "at", "own").join(before, "d", "left").select("at", F.coalesce("own", "earlier").alias("b"))


def epoch_asof(df: DataFrame, epochs: DataFrame, horizon: int) -> DataFrame:
    """Each row's difficulty epoch: the latest that starts at or before its time, or null after the horizon.

    A row reads none of the epochs but its own: times and starts stand in one order, as in `height_at_time`.
    """
    starts = epochs.where("start_time is not null").select(F.col("start_time").alias("at"), F.struct("epoch").alias("b"))
    found = _last_so_far(starts, df.where(F.col("time") <= horizon).select(F.col("time").alias("at")), [F.col("b.epoch")], EPOCH_STEP)
    return df.join(found.select(F.col("at").alias("time"), F.col("b.epoch").alias("epoch")), "time", "left").select(*df.columns, "epoch")


def allowed_bits(epochs: DataFrame) -> DataFrame:
    """Each epoch's bits with those of its neighbours."""
    return epochs.alias("e").join(epochs.alias("p"), F.col("e.epoch") == F.col("p.epoch") + 2016, "left").join(epochs.alias("n"), F.col("e.epoch") == F.col("n.epoch") - 2016, "left").select("e.epoch", F.col("e.bits").alias("bits"), F.col("p.bits").alias("bits_before"), F.col("n.bits").alias("bits_after"))


def height_at_time(block: DataFrame, times: DataFrame, step: int = 86400) -> DataFrame:
    """For each time: the canonical block at or before it (ties: greater height, then least hash).

    Times and blocks of a day stand in one order, in which the last block so far is a time's own; a time before the first block
    of its day takes the last one of the days before, from a running maximum over days. No time is paired with every block.
    """
    canonical = block.where("kind = 'canonical' and time is not null").select(F.col("time").alias("at"), F.struct("height", F.col("hash").alias("h")).alias("b"))
    # of blocks of one time the last is that of the greatest height, then of the least hash
    found = _last_so_far(canonical, times.select(F.col("t").alias("at")), [F.col("b.height"), F.col("b.h").desc()], step)
    return found.select(F.col("at").alias("t"), F.col("b.height").alias("height"), F.col("b.h").alias("hash"))


def window_coverage(windows: DataFrame, block: DataFrame) -> DataFrame:
    """For each (low, high) window: heights wanted and heights that canonical blocks cover, and blocks in all."""
    heights = windows.select("window_id", F.explode(F.sequence("low", "high")).alias("height"))
    spine = block.where("kind = 'canonical'").groupBy("height").agg(F.count("*").alias("n"))
    return heights.join(spine, "height", "left").groupBy("window_id").agg(F.count("*").alias("wanted"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"))


def window_budget(windows: DataFrame, block: DataFrame) -> DataFrame:
    """For each window: stale and error blocks in it."""
    heights = windows.select("window_id", F.explode(F.sequence("low", "high")).alias("height"))
    side = block.where("kind in ('stale', 'error_block')").groupBy("height").agg(F.count("*").alias("n"))
    return heights.join(side, "height", "left").groupBy("window_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("side_blocks"))


def match_tags(df: DataFrame, tags: DataFrame, text: str = "text") -> DataFrame:
    """Each row's pool tag: the longest that its text contains, then the first in order. `tags` is small."""
    hit = df.join(F.broadcast(tags), F.contains(F.col(text), F.col("tag")), "left")
    return hit.groupBy("row_id").agg(F.min_by("tag", F.when(F.col("tag").isNotNull(), F.struct((-F.octet_length("tag")).alias("size"), "tag"))).alias("tag"))


def match_tags_fast(df: DataFrame, tags: list[str], text: str = "text") -> DataFrame:
    """As match_tags, in one pass over each text by an automaton of all tags."""
    import ahocorasick
    import pyarrow as pa

    from pegtrail.session import importable

    importable(df.sparkSession)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for tag in tags:
            automaton.add_word(tag, (-len(tag.encode()), tag))
        if tags:
            automaton.make_automaton()
        for batch in batches:
            found = [min((hit for _, hit in automaton.iter(x or "")), default=(0, None))[1] if tags else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row_id", "tag"])

    return df.select("row_id", text).mapInArrow(run, "row_id long, tag string")


def match_payout(outputs: DataFrame, addresses: DataFrame) -> DataFrame:
    """(row_id, pool): the pool of the first output whose address is known. outputs: (row_id, addresses array)."""
    one = outputs.select("row_id", F.posexplode("addresses").alias("pos", "address"))
    return one.join(F.broadcast(addresses), "address").groupBy("row_id").agg(F.min_by("pool", "pos").alias("pool"))


def attribute_child(event: DataFrame, identity: DataFrame) -> DataFrame:
    """Identifiers looked up by namespace; those that no registry maps stay, without a pool."""
    return event.join(F.broadcast(identity), ["namespace", "identifier"], "left")


def compact_seed(block: DataFrame, event: DataFrame, heights: list[int], low: int, high: int) -> DataFrame:
    """Blocks a compact tree starts from: anchors on the spine, side blocks of a window, canonical ones with evidence there."""
    seen = event.where(active()).select(F.col("parent_hash").alias("hash"))
    anchors = block.where((F.col("kind") == "canonical") & F.col("height").isin(heights))
    side = block.where(F.col("kind").isin("stale", "error_block") & F.col("height").between(low, high))
    proven = block.where((F.col("kind") == "canonical") & F.col("height").between(low, high)).join(seen, "hash", "left_semi").select(*block.columns)
    return anchors.unionByName(side).unionByName(proven).select("hash", "kind", "height").distinct()


def with_context(some: DataFrame, block: DataFrame) -> DataFrame:
    """The blocks with their competitors and parents, each once."""
    keys = some.select("hash").unionByName(some.select(F.col("competitor_hash").alias("hash"))).unionByName(some.select(F.col("prev_hash").alias("hash")))
    return block.join(keys.where("hash is not null").distinct(), "hash", "left_semi")


def unlinked_dependents(block: DataFrame) -> DataFrame:
    """Blocks whose parent isn't known at all."""
    return block.join(block.select(F.col("hash").alias("prev_hash")).distinct(), "prev_hash", "left_anti")



def nearest_canonical(block: DataFrame, times: DataFrame, step: int = 86400) -> DataFrame:
    """(t, height, off) for each time: the canonical block nearest in time, ties by the least height.

    As in `height_at_time`, times and blocks of a day stand in one order, in which the last block so far and the next one are a
    time's own; the last block before the day and the first after it are tried too.
    """
    day = lambda c: F.floor(F.col(c) / step)
    best = block.where("kind = 'canonical' and height is not null and time is not null").groupBy(F.col("time").alias("at")).agg(F.min("height").alias("height"))
    rows = best.unionByName(times.select(F.col("t").alias("at")).where("at is not null").distinct(), allowMissingColumns=True).select(day("at").alias("d"), "at", F.when(F.col("height").isNotNull(), F.struct("at", "height")).alias("b"))
    # both ways: a frame up to the end of the day, or of all days, would be read anew for each row
    up, down = (W.partitionBy("d").orderBy(at, F.col("b").isNull()) for at in (F.col("at").asc(), F.col("at").desc()))
    upto = lambda w, end: F.last("b", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, end))
    placed = rows.select("d", "at", "b", upto(up, W.currentRow).alias("below"), upto(down, W.currentRow).alias("above"), upto(up, W.unboundedFollowing).alias("late"), upto(down, W.unboundedFollowing).alias("early"), F.row_number().over(up).alias("n"))
    days = lambda c, order: F.last(c, ignorenulls=True).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ends = placed.where("n = 1").select("d", days("late", F.col("d").asc()).alias("before"), days("early", F.col("d").desc()).alias("after"))
    near = placed.where("b is null").select("d", F.col("at").alias("t"), "below", "above").join(ends, "d")
    off = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("t")).alias("off"), F.col(f"{c}.height").alias("height")))
    found = near.select("t", F.array_min(F.filter(F.array(*[off(c) for c in ("below", "above", "before", "after")]), lambda x: x.isNotNull())).alias("b"))
    return found.select("t", "b.height", "b.off")


#: Reasons of publications that name a row part of a stale branch.
STALE_REASONS = ("valid_direct_stale", "valid_stale_descendant")


def published_stale(event: DataFrame, provenance: DataFrame) -> DataFrame:
    """Live events that a publication attests as part of a stale branch. provenance: (event_id, relevance_reason)."""
    return event.where("revoked_at is null").join(provenance.where(F.col("relevance_reason").isin(*STALE_REASONS)), "event_id", "left_semi")


def stale_targets(event: DataFrame, provenance: DataFrame, block: DataFrame) -> DataFrame:
    """(hash): parents of published stale branches that have no block or an unknown one."""
    named = published_stale(event, provenance).select(F.col("parent_hash").alias("hash")).distinct()
    return named.join(block.where("kind <> 'unknown'").select("hash"), "hash", "left_anti")


def sources_base(source: DataFrame, cursor: DataFrame, backbone: DataFrame) -> DataFrame:
    """Sources with their cursor (source_id, cursor, target, updated_at) and contiguous backbone (source_id, contiguous, tip, error), where they have one."""
    return source.join(F.broadcast(cursor), "source_id", "left").join(F.broadcast(backbone), "source_id", "left")  # one row a source each


def attribute_parent(tagged: DataFrame, paid: DataFrame, pool: DataFrame) -> DataFrame:
    """(row_id, basis, slug, pool_id): the tag's slug, else the payout's; a slug that no pool has gives no pool.

    tagged: (row_id, tag_slug), paid: (row_id, payout_slug); the second only counts where no tag matched at all.
    """
    j = tagged.join(paid, "row_id", "full_outer").withColumn("slug", F.coalesce("tag_slug", "payout_slug"))
    basis = F.when(F.col("tag_slug").isNotNull(), "tag").when(F.col("payout_slug").isNotNull(), "payout")
    return j.withColumn("basis", basis).join(F.broadcast(pool.select("slug", "pool_id")), "slug", "left").select("row_id", "basis", "slug", "pool_id")  # registries have some hundred pools
