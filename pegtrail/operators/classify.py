"""Classification of parents and orphans, and the decisions that depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegtrail.operators.joins import allowed_bits, epoch_asof
from pegtrail.operators.rollups import active

#: The height from which a coinbase script must name its height, and chains whose strict claims count.
BIP34_ACTIVATION = 227_931
STRICT_CHAINS = (
    "argentum", "bitcoin-vault", "bitmark", "coiledcoin", "crown", "devcoin", "doichain", "elastos", "emercoin", "fractal", "geistgeld", "groupcoin", "huntercoin", "i0coin", "ixcoin", "myriadcoin", "namecoin",
    "syscoin", "terracoin", "unobtanium",
)
STRICT_SOURCES = tuple(f"auxpow:{chain}" for chain in STRICT_CHAINS)
#: Seconds and heights after which a block beyond the epoch table is held or taken as made up.
FAR_HEIGHTS = 144


def classify_parents(parents: DataFrame, header: DataFrame, errors: DataFrame) -> DataFrame:
    """(hash, kind, height, competitor_hash) of distinct parents: (hash, meets_target).

    In this order: a missed target is near; a catalogued hash is an error block; an active header is canonical; an
    indexed inactive one is stale if another active header has its height; anything else is unknown.
    header: (hash, height, is_active). errors: (hash, error_height), small.
    """
    own = header.select("hash", F.col("height").alias("h"), "is_active")
    active_at = header.where("is_active").select(F.col("height").alias("h"), F.col("hash").alias("competitor"))
    joined = parents.join(F.broadcast(errors), "hash", "left").join(own, "hash", "left").join(active_at, "h", "left")
    distinct = F.col("competitor").isNotNull() & (F.col("competitor") != F.col("hash"))
    kind = (
        F.when(~F.col("meets_target"), "near").when(F.col("error_height").isNotNull(), "error_block").when(F.col("is_active"), "canonical").when((F.col("is_active") == F.lit(False)) & distinct, "stale").otherwise("unknown")
    )
    return joined.withColumn("kind", kind).select("hash", "kind", F.when(F.col("kind") == "error_block", F.col("error_height")).when(F.col("kind").isin("canonical", "stale"), F.col("h")).alias("height"), F.when(F.col("kind") == "stale", F.col("competitor")).alias("competitor_hash"))


def effective(new: DataFrame, old: DataFrame, errors: DataFrame) -> DataFrame:
    """New verdicts that never demote a proven state: unknown yields to what the block was.

    A stale block stays stale only while its competitor is canonical by the new verdicts or the old blocks; an error
    block only while it is catalogued.
    """
    o = old.select("hash", F.col("kind").alias("old_kind"), F.col("height").alias("old_height"), F.col("competitor_hash").alias("old_competitor"))
    standing = old.where("kind = 'canonical'").select(F.col("hash").alias("old_competitor"), F.lit(True).alias("stands")).distinct()
    listed = errors.select("hash", F.lit(True).alias("listed")).distinct()
    j = new.join(o, "hash", "left").join(standing, "old_competitor", "left").join(F.broadcast(listed), "hash", "left")
    keep = (F.col("kind") == "unknown") & ((F.col("old_kind") == "canonical") | ((F.col("old_kind") == "stale") & F.col("stands")) | ((F.col("old_kind") == "error_block") & F.col("listed")))
    keep = F.coalesce(keep, F.lit(False))
    return j.select("hash", F.when(keep, F.col("old_kind")).otherwise(F.col("kind")).alias("kind"), F.when(keep, F.col("old_height")).otherwise(F.col("height")).alias("height"), F.when(keep, F.col("old_competitor")).otherwise(F.col("competitor_hash")).alias("competitor_hash"), keep.alias("kept"))


def apply_classification(event: DataFrame, verdict: DataFrame) -> DataFrame:
    """Events with the verdict on their parent: near and revoked ones stay, and unknown overwrites only unknown and error."""
    v = verdict.select(F.col("hash").alias("parent_hash"), F.col("kind").alias("new_kind"))
    may = F.col("revoked_at").isNull() & (F.col("parent_kind") != "near") & F.col("new_kind").isNotNull() & ((F.col("new_kind") != "unknown") | F.col("parent_kind").isin("unknown", "error_block"))
    return event.join(v, "parent_hash", "left").withColumn("parent_kind", F.when(may, F.col("new_kind")).otherwise(F.col("parent_kind"))).drop("new_kind")


def orphan_verdict(orphans: DataFrame, epochs: DataFrame, height_horizon: int, time_horizon: int) -> DataFrame:
    """(hash, verdict, reason) of unknown blocks: (hash, height, time, bits).

    Pending comes first (above either horizon). A script height from activation on that agrees with the epoch of the time
    is strict if the bits are that epoch's, else excluded. Without one, or if it doesn't agree, bits of the time's epoch or
    a neighbour are weak, others excluded.
    """
    b = allowed_bits(epochs)
    placed = epoch_asof(orphans, epochs, time_horizon).join(F.broadcast(b.withColumnRenamed("bits", "epoch_bits")), "epoch", "left")  # a row for 2016 heights
    has = F.col("height").isNotNull() & (F.col("height") >= BIP34_ACTIVATION)
    agrees = has & F.coalesce(F.floor(F.col("height") / 2016) * 2016 == F.col("epoch"), F.lit(False))
    same = F.col("bits") == F.col("epoch_bits")
    near = same | (F.col("bits") == F.col("bits_before")) | (F.col("bits") == F.col("bits_after"))
    rules = [
        (has & (F.col("height") > height_horizon), "pending", "above_height"), (F.col("time") > time_horizon, "pending", "above_time"), (agrees & same, "strict", "height_and_bits"), (agrees, "excluded", "wrong_bits"),
        (F.col("epoch").isNull(), "excluded", "before_table"), (F.coalesce(near, F.lit(False)), "weak", "nearby_bits"),
    ]
    verdict, reason = F.lit("excluded"), F.lit("foreign_bits")
    for test, v, r in reversed(rules):
        verdict, reason = F.when(test, v).otherwise(verdict), F.when(test, r).otherwise(reason)
    return placed.select("hash", verdict.alias("verdict"), reason.alias("reason"))


def classify_nbits(df: DataFrame, epochs: DataFrame) -> DataFrame:
    """Whether a row's bits are those of its height's epoch: valid, contaminant, below or above the table."""
    span = epochs.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    known = epochs.select(F.col("epoch").alias("own"), F.col("bits").alias("expected"))
    j = df.withColumn("own", F.floor(F.col("height") / 2016) * 2016).join(F.broadcast(known), "own", "left").crossJoin(F.broadcast(span))
    return j.withColumn("nbits", F.when(F.col("own") < F.col("lo"), "below").when(F.col("expected").isNull(), "above").when(F.col("expected") == F.col("bits"), "valid").otherwise("contaminant")).drop("own", "expected", "lo", "hi")


def strict_height(event: DataFrame, source: DataFrame) -> DataFrame:
    """Each parent's first claimed height (by event id) from activation on, of chains whose claims count."""
    e = event.where(active() & (F.col("script_height") >= BIP34_ACTIVATION)).join(F.broadcast(source.where(F.col("code").isin(*STRICT_SOURCES))), "source_id")
    return e.groupBy("parent_hash").agg(F.min_by("script_height", "event_id").alias("strict_height"))


def orphan_class(unknown: DataFrame) -> DataFrame:
    """The class by gates in order: published stale, no proof of absence (keeps the old class), known stale, wrong epoch, verdict.

    unknown: (hash, published_stale, absence, known_stale, wrong_epoch, verdict, old_class).
    """
    rule = F.when(F.col("published_stale"), "excluded").when(~F.col("absence"), F.col("old_class")).when(F.col("known_stale") | F.col("wrong_epoch"), "excluded").otherwise(F.when(F.col("verdict") != "pending", F.col("verdict")))
    return unknown.select("hash", rule.alias("orphan_class"))


def build_blocks(event: DataFrame, source: DataFrame, verdict: DataFrame, core: DataFrame) -> DataFrame:
    """One row for each parent with active events or a node's own header: kind, height and counters (the node counts as a source)."""
    from pegtrail.operators.rollups import parent_rollup

    r = parent_rollup(event, source).withColumnRenamed("parent_hash", "hash")
    c = core.select("hash", F.lit(True).alias("core_attested"))
    j = r.join(c, "hash", "full_outer").join(verdict, "hash", "left")
    own = F.coalesce("core_attested", F.lit(False)).cast("int")
    return j.select(
        "hash", F.coalesce("kind", F.when(F.col("core_attested"), "canonical").otherwise("unknown")).alias("kind"), "height", "competitor_hash", (F.coalesce("attestations", F.lit(0)) + own).alias("total_attestations"),
        (F.coalesce("sources", F.lit(0)) + own).alias("distinct_sources"), F.coalesce("chains", F.lit(0)).alias("chains"), F.coalesce("live", F.lit(False)).alias("live"), F.coalesce("core_attested", F.lit(False)).alias("core_attested"), "first_seen", "last_seen",
    )


def block_miner(block: DataFrame, core_pool: DataFrame, event_pool: DataFrame) -> DataFrame:
    """The pool of a block: the node's coinbase, else what a canonical block had, else the events' coinbase."""
    j = block.select("hash", "kind", F.col("pool_id").alias("old_pool")).join(core_pool, "hash", "left").join(event_pool, "hash", "left")
    return j.select("hash", F.coalesce("core_pool", F.when(F.col("kind") == "canonical", F.col("old_pool")), "event_pool").alias("pool_id"))


def demote_inactive(block: DataFrame, event: DataFrame) -> DataFrame:
    """Blocks without active events: those of the node keep the spine, others become empty unknowns."""
    seen = event.where(active()).select(F.col("parent_hash").alias("hash"), F.lit(True).alias("seen")).distinct()
    j = block.join(seen, "hash", "left")
    gone = F.col("seen").isNull() & ~F.col("core_attested")
    return j.select("hash", F.when(gone, "unknown").otherwise(F.col("kind")).alias("kind"), F.when(~gone, F.col("height")).alias("height"), F.when(~gone, F.col("competitor_hash")).alias("competitor_hash"), gone.alias("demoted"))


def known_stale_demotion(block: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown blocks of the published stale list whose class is strict or weak become excluded."""
    listed = known.select("hash", F.lit(True).alias("listed")).distinct()
    j = block.where("kind = 'unknown'").join(listed, "hash", "left")
    hit = F.col("listed") & F.col("orphan_class").isin("strict", "weak")
    return j.select("hash", F.when(hit, "excluded").otherwise(F.col("orphan_class")).alias("orphan_class"), F.coalesce(hit, F.lit(False)).alias("changed"))


def reclassify_unknown(block: DataFrame, verdict: DataFrame) -> DataFrame:
    """Transitions of unknown blocks under new verdicts: (old, new, n), real changes only."""
    v = verdict.select("hash", F.col("kind").alias("new"))
    return block.where("kind = 'unknown'").join(v, "hash").where("new <> kind").groupBy(F.col("kind").alias("old"), "new").agg(F.count("*").alias("n"))


def horizon_gate(df: DataFrame, tip: DataFrame, now: int | Column, fresh_s: int = 86400) -> DataFrame:
    """Rows beyond the epoch table: resolved at or below the tip, far_future well above a fresh tip, else held.

    tip: one row (tip_height, tip_time); without it every row is held.
    """
    j = df.join(F.broadcast(tip), F.lit(True), "left")
    far = (F.col("height") > F.col("tip_height") + FAR_HEIGHTS) & (F.lit(now) - F.col("tip_time") <= fresh_s)
    return j.withColumn("gate", F.when(F.col("height") <= F.col("tip_height"), "resolve").when(far, "far_future").otherwise("hold")).drop("tip_height", "tip_time")


def import_decision(df: DataFrame, classifier: bool = True, allow_unclassified: bool = False) -> DataFrame:
    """`decision` on a published row, and `skip_reason` if it is skipped: (published, selection, orphan_verdict, verdict,
    core_attested, absent, catalogued).

    A catalogued error block is never taken. Without a classifier, rows other than unknown ones are, if that is allowed. Else the
    present verdict decides: canonical needs a row published as such; stale one published as stale or selected as a known
    stale, or a canonical one where the node itself attests the stale block; unknown is taken where a known stale branch
    is selected, whose absence then isn't attested, or as an orphan, strict or weak, that the node attests absent.
    """
    published, verdict = F.col("published"), F.col("verdict")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = F.coalesce(F.col("selection").isin("known_direct_stale", "known_stale_descendant"), F.lit(False))
    take_stale = published.isin("stale", "stale_descendant") | known | ((published == "canonical") & yes("core_attested"))
    orphan = yes("absent") & (published == "unknown") & F.coalesce(F.col("orphan_verdict").isin("strict", "weak"), F.lit(False))
    by_verdict = (
        F.when(verdict == "canonical", F.when(published == "canonical", "capture").otherwise("!classification_mismatch")).when(verdict == "stale", F.when(take_stale, "capture").otherwise("!classification_mismatch"))
        .when(verdict == "error_block", "!unsupported_classification").when((verdict == "unknown") & known, "capture_known_branch").when((verdict == "unknown") & orphan, "capture").otherwise("!unclassified")
    )
    without = F.when(F.lit(allow_unclassified) & (published != "unknown"), "capture_unclassified").otherwise("!unclassified")
    rule = F.when(yes("catalogued"), "!unsupported_classification").otherwise(by_verdict if classifier else without)
    skipped = F.startswith(rule, F.lit("!"))
    return df.withColumn("decision", F.when(skipped, "skip").otherwise(rule)).withColumn("skip_reason", F.when(skipped, F.substring(rule, 2, 100)))


def source_sync(df: DataFrame, fresh_s: int = 3600) -> DataFrame:
    """The state of a source: (lifecycle, source_kind, cursor, tip, error, updated_at, now).

    A lifecycle other than live is the state itself. The node's own source goes by its backbone: an error first, then a
    stale update, then its height against the tip; a capture by its cursor: a stale update before a height below the tip.
    """
    stale = F.col("now") - F.col("updated_at") > fresh_s
    behind = F.coalesce(F.col("cursor") < F.col("tip"), F.lit(False))
    backbone = (
        F.when(F.col("cursor").isNull(), "not_started").when(F.col("error").isNotNull(), "error").when(stale, "stale").when(F.col("tip").isNull() | (F.col("cursor") < 0), "not_started")
        .when(behind, "catching_up").otherwise("live")
    )
    capture = F.when(F.col("cursor").isNull(), "not_started").when(stale, "stale").when(behind, "catching_up").otherwise("live")
    state = F.when(F.col("lifecycle") != "live", F.col("lifecycle")).when(F.col("source_kind") == "live-chaintip", backbone).when(F.col("source_kind") == "auxpow", capture).otherwise("unknown")
    return df.withColumn("state", state)


def publication_category(df: DataFrame) -> DataFrame:
    """`category` of a published row by (classification, relevance, relevance_reason, status), or `skip_reason`.

    Published stale branches are told by the reason, canonical rows and orphans by class and relevance. Only direct
    stales need a status that begins with the word VALID, and descendants one of their own.
    """
    c = F.coalesce(F.trim("classification"), F.lit(""))
    relevance, reason, status = (F.coalesce(x, F.lit("")) for x in ("relevance", "relevance_reason", "status"))
    found = (
        F.when(c.isin("stale", "unknown") & (relevance == "") & (reason == "valid_direct_stale"), "stale").when(c.isin("stale_descendant", "unknown") & (relevance == "") & (reason == "valid_stale_descendant"), "stale_descendant")
        .when(reason.isin("valid_direct_stale", "valid_stale_descendant"), "!taxonomy_mismatch").when((c == "canonical") & (relevance == ""), "canonical")
        .when((c == "unknown") & relevance.isin("strict_btc_orphan", "weak_btc_orphan"), relevance).when(c == "near", "!near").when(c.isin("canonical", "stale", "stale_descendant", "unknown"), "!taxonomy_mismatch")
        .otherwise("!unsupported_classification")
    )
    fits = F.when(found == "stale", status.rlike(r"^VALID($|\s|\()")).when(found == "stale_descendant", status == "VALID_STALE_DESCENDANT").otherwise(True)
    found = F.when(fits, found).otherwise("!taxonomy_mismatch")
    good = ~F.startswith(found, F.lit("!"))
    return df.withColumn("category", F.when(good, found)).withColumn("skip_reason", F.when(~good, F.substring(found, 2, 100)))


def filter_unknown(df: DataFrame) -> DataFrame:
    """`skip_reason` of unknown published rows: (verdict, selection); null if the row is taken.

    Published stale branches are taken whatever the verdict. An orphan is taken if the verdict is the published class;
    a weak one may be published as strict, a strict one never as weak.
    """
    v, s = F.col("verdict"), F.coalesce("selection", F.lit(""))
    rule = (
        F.when(s.isin("stale", "stale_descendant"), None).when((s == "strict_btc_orphan") & v.isin("strict", "weak"), None).when((s == "weak_btc_orphan") & (v == "weak"), None)
        .when((s == "weak_btc_orphan") & (v == "strict"), "taxonomy_mismatch").when(v.isin("strict", "weak"), "orphan_not_selected").when(v == "excluded", "orphan_excluded").otherwise("orphan_pending")
    )
    return df.withColumn("skip_reason", rule)


def should_write(policy: Column, old: Column, new: Column, old_rank: Column, new_rank: Column) -> Column:
    """Whether a value may be replaced: fill_null, overwrite, or promote (never to a lower rank, never to null)."""
    changed = ~old.eqNullSafe(new) & new.isNotNull()
    return changed & F.when(policy == "fill_null", old.isNull()).when(policy == "overwrite", True).when(policy == "promote", old.isNull() | (new_rank > old_rank)).otherwise(False)
