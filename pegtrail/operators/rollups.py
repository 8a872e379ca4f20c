"""Aggregations of events into parents, proofs and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active() -> Column:
    """Not revoked, not near, and meeting the parent's target."""
    return F.col("revoked_at").isNull() & (F.col("parent_kind") != "near") & F.col("pow_ok")


def attested() -> Column:
    """Not revoked and not near, whether or not the event itself meets the parent's target."""
    return F.col("revoked_at").isNull() & (F.col("parent_kind") != "near")


def parent_rollup(event: DataFrame, source: DataFrame) -> DataFrame:
    """One row for each attested parent: attestations, sources, auxiliary chains, first and last sight, and whether any event
    meets the target (`pow`) and any has the epoch's bits (`epoch_ok`, null if none says).

    Events are summed by parent and source first, so that no distinct count multiplies them.
    """
    by_source = event.where(attested()).groupBy("parent_hash", "source_id").agg(F.count("*").alias("n"), F.bool_or("pow_ok").alias("pow"), F.bool_or("epoch_ok").alias("epoch_ok"), F.min("discovered_at").alias("first"), F.max("confirmed_at").alias("last"))
    return by_source.join(F.broadcast(source), "source_id").groupBy("parent_hash").agg(
        F.sum("n").alias("attestations"), F.count("*").alias("sources"), F.size(F.collect_set(F.when(F.col("source_kind") == "auxpow", F.col("code")))).cast("long").alias("chains"),
        F.bool_or(F.col("source_kind") == "live-chaintip").alias("live"), F.coalesce(F.bool_or("pow"), F.lit(False)).alias("pow"), F.bool_or("epoch_ok").alias("epoch_ok"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )


def build_proofs(event: DataFrame) -> DataFrame:
    """One row for each parent and source: live with its sorted active ids, or else a revoked tombstone with all of them.

    First sight is that of all events; confirmation and proof of work are of the active ones, for a tombstone of all. Its
    reason is that of the last revocation, ties by the least id.
    """
    on = F.col("revoked_at").isNull()
    last = F.struct("revoked_at", (-F.col("event_id")).alias("id"))
    g = event.where("parent_kind <> 'near'").groupBy("parent_hash", "source_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", on.alias("on")))).alias("every"), F.bool_or(on).alias("live"), F.min("discovered_at").alias("first_seen"), F.min(F.when(on, F.col("confirmed_at"))).alias("live_confirmed"),
        F.min("confirmed_at").alias("any_confirmed"), F.bool_or(F.when(on, F.col("pow_ok"))).alias("live_pow"), F.bool_or("pow_ok").alias("any_pow"), F.max("revoked_at").alias("last_revoked"), F.max_by("reason", F.when(~on, last)).alias("last_reason"),
    )
    ids = F.transform(F.filter("every", lambda e: e["on"] | ~F.col("live")), lambda e: e["event_id"])
    pick = lambda a, b: F.when(F.col("live"), F.col(a)).otherwise(F.col(b))
    return g.select(
        "parent_hash", "source_id", "live", ids.alias("ids"), "first_seen", pick("live_confirmed", "any_confirmed").alias("confirmed_at"), F.coalesce(pick("live_pow", "any_pow"), F.lit(False)).alias("pow"),
        F.when(~F.col("live"), F.col("last_revoked")).alias("revoked_at"), F.when(~F.col("live"), F.col("last_reason")).alias("reason"),
    )


def representative(event: DataFrame) -> DataFrame:
    """Each attested parent's event with a coinbase script first, then the least child height (nulls last), then the least id."""
    order = F.struct(F.col("coinbase").isNull().alias("a"), F.col("child_height").isNull().alias("b"), "child_height", "event_id")
    return event.where(attested()).groupBy("parent_hash").agg(F.min(order).alias("o"), F.min_by("source_id", order).alias("source_id")).select("parent_hash", F.col("o.event_id").alias("event_id"), "source_id", F.col("o.child_height").alias("child_height"))


def source_health(event: DataFrame, block: DataFrame, source: DataFrame) -> DataFrame:
    """Per source: events, last sight, and distinct parents by their present kind and orphan class.

    A parent's kind is its block's; without a block it is unknown if any event says so, else near.
    """
    live = event.where("revoked_at is null")
    counts = live.groupBy("source_id").agg(F.count("*").alias("events"), F.max("confirmed_at").alias("last_seen"))
    pairs = live.groupBy("source_id", "parent_hash").agg(F.bool_or(F.col("parent_kind") == "unknown").alias("some_unknown"))
    kinds = pairs.join(block.select(F.col("hash").alias("parent_hash"), "kind", "orphan_class"), "parent_hash", "left")
    kind = F.coalesce("kind", F.when(F.col("some_unknown"), "unknown").otherwise("near"))
    named = kinds.withColumn("now", kind)
    parents = named.groupBy("source_id").agg(
        *[F.count_if(F.col("now") == k).alias(k) for k in ("near", "unknown", "canonical", "stale", "error_block")], F.count_if((F.col("now") == "unknown") & (F.col("orphan_class") == "strict")).alias("strict_orphan"),
        F.count_if((F.col("now") == "unknown") & (F.col("orphan_class") == "weak")).alias("weak_orphan"),
    )
    numbers = [c for c in parents.columns if c != "source_id"]
    joined = source.select("source_id", "code").join(counts.join(parents, "source_id", "full_outer"), "source_id", "left")
    return joined.select("source_id", "code", F.coalesce("events", F.lit(0)).alias("events"), "last_seen", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def health_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes of every count of `source_health`, sources that come or go included."""
    numbers = [c for c in before.columns if c not in ("source_id", "code", "last_seen")]
    joined = before.alias("b").join(after.alias("a"), "source_id", "full_outer")
    return joined.select("source_id", *[(F.coalesce(f"a.{c}", F.lit(0)) - F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in numbers], F.col("a.last_seen").alias("last_seen"))


def invalid_unknown(event: DataFrame, block: DataFrame) -> DataFrame:
    """One row: parents that are unknown though no active event of theirs meets the target."""
    parents = event.where("revoked_at is null and parent_kind = 'unknown'").groupBy("parent_hash").agg(F.bool_or("pow_ok").alias("met"))
    known = block.where("kind <> 'unknown'").select(F.col("hash").alias("parent_hash"))
    return parents.join(known, "parent_hash", "left_anti").agg(F.count_if(~F.col("met")).alias("violations"))


def child_miner(event: DataFrame) -> DataFrame:
    """Each parent's child-chain pool if its active events name exactly one, else null."""
    return event.where(active()).groupBy("parent_hash").agg(F.count_distinct("child_pool_id").alias("n_pools"), F.min("child_pool_id").alias("p")).select("parent_hash", "n_pools", F.when(F.col("n_pools") == 1, F.col("p")).alias("child_pool"))


def display_miner(block: DataFrame, event: DataFrame) -> DataFrame:
    """The pool to show: the block's own, else the only one its events name, else unknown; and why."""
    b = block.select("hash", "pool_id").join(child_miner(event).withColumnRenamed("parent_hash", "hash"), "hash", "left")
    basis = F.when(F.col("pool_id").isNotNull(), "strict").when(F.col("child_pool").isNotNull(), "inferred").otherwise("unknown")
    return b.select("hash", F.coalesce("pool_id", "child_pool").alias("pool_id"), basis.alias("basis"))


def child_chain_evidence(event: DataFrame, source: DataFrame) -> DataFrame:
    """Each parent's list of (code, n, least and greatest child height), by code."""
    g = event.where(active()).join(F.broadcast(source), "source_id").groupBy("parent_hash", "code").agg(F.count("*").alias("n"), F.min("child_height").alias("low"), F.max("child_height").alias("high"))
    return g.groupBy("parent_hash").agg(F.array_sort(F.collect_list(F.struct("code", "n", "low", "high"))).alias("chains"))


def source_summary(event: DataFrame, block: DataFrame, source: DataFrame) -> DataFrame:
    """Each block's sources with the node's own attestation as `core`: how many, their codes, auxiliary chains, live."""
    seen = event.where(active()).join(F.broadcast(source), "source_id").select(F.col("parent_hash").alias("hash"), "code", "source_kind").distinct()
    own = block.where("core_attested").select("hash", F.lit("core").alias("code"), F.lit("core").alias("source_kind"))
    return seen.unionByName(own).groupBy("hash").agg(F.count("*").alias("sources"), F.array_sort(F.collect_set("code")).alias("codes"), F.count_if(F.col("source_kind") == "auxpow").alias("chains"), F.bool_or(F.col("source_kind") == "live-chaintip").alias("live"))


def orphan_facets(block: DataFrame) -> DataFrame:
    """Unknown blocks by orphan class; null is pending."""
    return block.where("kind = 'unknown'").groupBy(F.coalesce("orphan_class", F.lit("pending")).alias("orphan_class")).agg(F.count("*").alias("n"))


def totals(block: DataFrame, event: DataFrame) -> DataFrame:
    """One row: stale blocks whose competitor is canonical (heights aren't compared), and error blocks with a source."""
    canonical = block.where("kind = 'canonical'").select(F.col("hash").alias("competitor_hash"))
    stale = block.where("kind = 'stale'").join(canonical, "competitor_hash", "left_semi").agg(F.count("*").alias("stale"))
    seen = event.where(active()).select(F.col("parent_hash").alias("hash"))
    error = block.where("kind = 'error_block'").join(seen, "hash", "left_semi").agg(F.count("*").alias("error_block"))
    return stale.crossJoin(error)  # one row each


def duplicate_identities(event: DataFrame) -> DataFrame:
    """Child hashes that a source has more than once."""
    return event.where("child_hash is not null").groupBy("source_id", "child_hash").agg(F.count("*").alias("n")).where("n > 1")


def weekly_series(event: DataFrame, source: DataFrame) -> DataFrame:
    """(code, week, n): events by Monday week from each source's first to the last week of all, empty weeks as 0."""
    week = F.unix_seconds(F.date_trunc("WEEK", F.timestamp_seconds("discovered_at")))
    n = event.groupBy("source_id", week.alias("week")).agg(F.count("*").alias("n"))
    span = n.groupBy("source_id").agg(F.min("week").alias("a")).crossJoin(n.agg(F.max("week").alias("z")))  # one row on the right
    weeks = span.select("source_id", F.explode(F.sequence("a", "z", F.lit(7 * 86400).cast("long"))).alias("week"))
    return weeks.join(n, ["source_id", "week"], "left").join(F.broadcast(source), "source_id").select("code", "week", F.coalesce("n", F.lit(0)).alias("n"))


def parent_gaps(event: DataFrame, step: int = 86400) -> DataFrame:
    """Seconds between consecutive distinct full-target sights of each source.

    A source's sights are ordered day by day; the first of a day follows the last of the days before, a running maximum
    over one row a day.
    """
    seen = event.where("pow_ok and revoked_at is null").select("source_id", "discovered_at", F.floor(F.col("discovered_at") / step).alias("day")).distinct()
    own = seen.withColumn("before", F.lag("discovered_at").over(W.partitionBy("source_id", "day").orderBy("discovered_at")))
    days = seen.groupBy("source_id", "day").agg(F.max("discovered_at").alias("last"))
    carried = days.select("source_id", "day", F.max("last").over(W.partitionBy("source_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    return own.join(carried, ["source_id", "day"]).select("source_id", "discovered_at", (F.col("discovered_at") - F.coalesce("before", "carried")).alias("gap_s"))
