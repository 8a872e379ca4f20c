"""Classification and merge jobs over the chain view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pegtrail.operators import classify as K
from pegtrail.operators import merge as M
from pegtrail.operators import rollups as R
from pegtrail.plans import chain_view as V
from pegtrail.plans.core import ACTIVE, ATTESTED, EPOCHS, _epochs


def _parents(spark, sf):
    """Distinct parents of events, with whether any event of theirs meets the target."""
    return V.events(spark, sf).groupBy(F.col("parent_hash").alias("hash")).agg(F.max("pow_ok").alias("meets_target"))


def _header(spark, sf):
    """The node's headers: canonical ones active, two thirds of the stale ones known but not active."""
    b = V.blocks(spark, sf).where("kind = 'canonical' or (kind = 'stale' and height % 3 <> 0)")
    return b.select("hash", "height", (F.col("kind") == "canonical").alias("is_active"))


def _errors(spark, sf):
    return V.blocks(spark, sf).where("kind = 'error_block' and height % 2 = 0").select("hash", F.col("height").alias("error_height"))


def _verdict(spark, sf):
    return K.classify_parents(_parents(spark, sf), _header(spark, sf), _errors(spark, sf))


PAR = """
, par as (select parent_hash as hash, max(pow_ok) as meets_target from event group by 1),
hd as (select hash, height, kind = 'canonical' as is_active from block where kind = 'canonical' or (kind = 'stale' and height % 3 <> 0)),
er as (select hash, height as error_height from block where kind = 'error_block' and height % 2 = 0),
vj as (select p.hash, case when not meets_target then 'near' when error_height is not null then 'error_block' when hd.is_active then 'canonical' when hd.is_active = false and a.hash <> hd.hash then 'stale' else 'unknown' end as kind, hd.height as h, error_height, a.hash as competitor
  from par p left join er on er.hash = p.hash left join hd on hd.hash = p.hash left join hd a on a.is_active and a.height = hd.height),
verdict as (select hash, kind, case when kind = 'error_block' then error_height when kind in ('canonical', 'stale') then h end as height, case when kind = 'stale' then competitor end as competitor_hash from vj)
"""


def classify_parents(spark, sf):
    return _verdict(spark, sf)


def effective(spark, sf):
    return K.effective(_verdict(spark, sf), V.blocks(spark, sf).where("height % 7 <> 0"), _errors(spark, sf))


def apply_classification(spark, sf):
    e = K.apply_classification(V.events(spark, sf), _verdict(spark, sf))
    return e.groupBy("source_id", "parent_kind").agg(F.count("*").alias("n"))


#: Epochs are moved up by so many heights, so that scripts of the view's heights are above the activation height.
MOVED = 113 * 2016


def orphan_verdict(spark, sf):
    """A third of the unknown blocks claim a height of their time's epoch, a third one of other epochs, a third none."""
    b = V.blocks(spark, sf)
    third = F.col("time") % 3
    height = F.when(third == 0, F.floor((F.col("time") - V.GENESIS_TIME) / 600) + MOVED).when(third == 1, F.col("height") * 5 + MOVED)
    bits = F.lit(486604799) - F.coalesce(F.length("orphan_class"), F.lit(0)) * 5
    o = b.where("kind = 'unknown'").select("hash", height.alias("height"), "time", bits.alias("bits"))
    return K.orphan_verdict(o, _epochs(b).withColumn("epoch", F.col("epoch") + MOVED), MOVED + 14_000, V.GENESIS_TIME + 7_000_000)


def classify_nbits(spark, sf):
    b = V.blocks(spark, sf)
    rows = b.where("kind = 'stale'").select("hash", "height", (F.lit(486604799) - F.col("pool_id") % 5).alias("bits"))
    return K.classify_nbits(rows, _epochs(b).where("epoch >= 2016 or epoch = 0"))


def strict_height(spark, sf):
    e = V.events(spark, sf).withColumn("script_height", F.col("parent_height") + 227_000 + F.col("child_height") % 2)
    return K.strict_height(e, V.sources(spark))


def orphan_class(spark, sf):
    u = V.blocks(spark, sf).where("kind = 'unknown'").select(
        "hash", (F.col("time") % 11 == 0).alias("published_stale"), (F.col("time") % 3 != 0).alias("absence"), (F.col("time") % 7 == 0).alias("known_stale"), (F.col("time") % 13 == 0).alias("wrong_epoch"),
        F.when(F.col("time") % 5 == 0, "pending").when(F.col("time") % 2 == 0, "strict").otherwise("weak").alias("verdict"), F.col("orphan_class").alias("old_class"),
    )
    return K.orphan_class(u)


def build_blocks(spark, sf):
    core = V.blocks(spark, sf).where("core_attested").select("hash")
    return K.build_blocks(V.events(spark, sf), V.sources(spark), _verdict(spark, sf), core)


def block_miner(spark, sf):
    b = V.blocks(spark, sf)
    core = b.where("kind = 'canonical' and height % 2 = 0").select("hash", F.col("pool_id").alias("core_pool"))
    event = R.child_miner(V.events(spark, sf)).select(F.col("parent_hash").alias("hash"), F.col("child_pool").alias("event_pool"))
    return K.block_miner(b, core, event)


def demote_inactive(spark, sf):
    return K.demote_inactive(V.blocks(spark, sf), V.events(spark, sf))


def known_stale_demotion(spark, sf):
    b = V.blocks(spark, sf)
    return K.known_stale_demotion(b, b.where("time % 3 = 0").select("hash"))


def reclassify_unknown(spark, sf):
    b = V.blocks(spark, sf)
    return K.reclassify_unknown(b.withColumn("kind", F.when(F.col("height") % 4 == 0, "unknown").otherwise(F.col("kind"))), _verdict(spark, sf))


def horizon_gate(spark, sf):
    """Stale blocks, half of which claim heights around and above the spine's tip, an hour after the tip's time."""
    b = V.blocks(spark, sf)
    tip = b.where("kind = 'canonical'").agg(F.max("height").alias("tip_height"), F.max("time").alias("tip_time"))
    top = tip.select(F.col("tip_height").alias("top"))
    claimed = F.col("height") + F.col("time") % 300 + F.when(F.col("time") % 2 == 0, 0).otherwise(F.col("top") - 100)
    rows = b.where("kind = 'stale'").crossJoin(F.broadcast(top)).select("hash", claimed.alias("height"))  # one row on the right
    return K.horizon_gate(rows, tip, F.col("tip_time") + 3600)


def import_decision(spark, sf):
    """Each parent published in four ways, so that every class meets every verdict."""
    v = _verdict(spark, sf).select("hash", F.col("kind").alias("verdict"))
    h = F.conv(F.substring("hash", 1, 6), 16, 10).cast("long")
    ways = F.explode(F.array(*[F.lit(x) for x in ("canonical", "stale", "stale_descendant", "unknown")])).alias("published")
    rows = v.select("hash", "verdict", ways, F.when(h % 5 == 0, "known_direct_stale").when(h % 5 == 1, "known_stale_descendant").when(h % 5 == 2, "strict_btc_orphan").alias("selection"), F.when(h % 7 < 2, "strict").when(h % 7 < 4, "weak").when(h % 7 == 4, "excluded").alias("orphan_verdict"), F.when(h % 3 > 0, h % 3 == 1).alias("core_attested"), (h % 2 == 0).alias("absent"), (h % 41 == 0).alias("catalogued"))
    every = K.import_decision(rows).withColumn("mode", F.lit("classified")).unionByName(K.import_decision(rows, False, True).withColumn("mode", F.lit("unclassified"))).unionByName(K.import_decision(rows, False).withColumn("mode", F.lit("off")))
    return every.select("hash", "published", "mode", "decision", "skip_reason")


def source_sync(spark, sf):
    """Cursors from the events of each source, so that every state of either path is there."""
    h = R.source_health(V.events(spark, sf), V.blocks(spark, sf), V.sources(spark)).join(V.sources(spark).select("source_id", "source_kind"), "source_id")
    i = F.col("source_id")
    rows = h.select(
        "code", F.when(i == 1, "historical").otherwise("live").alias("lifecycle"), "source_kind", F.when(i != 5, F.col("events")).alias("cursor"), (F.col("events") + i.isin(2, 4).cast("int")).alias("tip"),
        F.when(i.isin(3, 6), "x").alias("error"), F.col("last_seen").alias("updated_at"), (F.col("last_seen") + F.when(i == 4, 10_000).otherwise(60)).alias("now"),
    )
    return K.source_sync(rows).select("code", "state")


def publication_category(spark, sf):
    """Rows of every class, with reasons and states by the block's time."""
    t = F.col("time")
    kind = F.col("kind")
    rows = V.blocks(spark, sf).select(
        "hash", F.when(kind == "error_block", F.when(t % 2 == 0, "near").otherwise("other")).when((kind == "stale") & (t % 5 == 0), "stale_descendant").otherwise(kind).alias("classification"),
        F.when((kind == "canonical") & (t % 10 == 0), "x").when(kind == "unknown", F.when(F.col("orphan_class").isin("strict", "weak"), F.concat("orphan_class", F.lit("_btc_orphan")))).alias("relevance"),
        F.when(kind == "stale", F.when(t % 5 == 0, "valid_stale_descendant").when(t % 3 != 1, "valid_direct_stale")).when(t % 11 == 0, "valid_direct_stale").alias("relevance_reason"),
        F.when(t % 4 == 0, "INVALID").when(t % 4 == 1, "VALID (late)").when(t % 4 == 2, "VALID_STALE_DESCENDANT").otherwise("VALID").alias("status"),
    )
    return K.publication_category(rows).select("hash", "category", "skip_reason")


def filter_unknown(spark, sf):
    """Unknown blocks whose class is the verdict, published under one by their time."""
    t = F.col("time") % 5
    rows = V.blocks(spark, sf).where("kind = 'unknown'").select("hash", F.coalesce("orphan_class", F.lit("pending")).alias("verdict"), F.when(t == 0, "stale").when(t == 1, "strict_btc_orphan").when(t == 2, "weak_btc_orphan").when(t == 3, "stale_descendant").alias("selection"))
    return K.filter_unknown(rows)


def fill_child_coinbase(spark, sf):
    """Scripts recovered for two thirds of the events, a quarter of which have one already."""
    e = V.events(spark, sf).select("event_id", "child_height", F.when(F.col("child_height") % 4 == 0, "own").alias("coinbase_txid"), F.col("coinbase").alias("coinbase_script"), F.when(F.col("child_height") % 7 == 0, "out").alias("coinbase_outputs"))
    late = e.where("child_height % 3 <> 0").select("event_id", F.lit("t").alias("coinbase_txid"), F.lit("s").alias("coinbase_script"), F.lit("o").alias("coinbase_outputs"))
    return M.fill_child_coinbase(e, late).groupBy("coinbase_txid", F.col("coinbase_script").isNull().alias("no_script"), "coinbase_outputs", "filled").agg(F.count("*").alias("n"))


def _halves(spark, sf):
    e = V.events(spark, sf)
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


HALVES = ", e0 as (select * from event where event_id % 2 = 0), e1 as (select * from event where event_id % 2 = 1)"


def merge_events(spark, sf):
    old, new = _halves(spark, sf)
    return M.merge_events(old, new).select("event_id", "match_id", "disposition")


def fill_event(spark, sf):
    e = V.events(spark, sf).where("child_hash is not null").groupBy("source_id", "child_hash").agg(F.min_by(F.struct("child_pool_id", "parent_hash", "confirmed_at"), "event_id").alias("a"), F.max_by(F.struct("child_pool_id", "parent_hash", "confirmed_at"), "event_id").alias("b"))
    key = F.concat_ws("/", F.col("source_id").cast("string"), "child_hash").alias("id")
    old, new = (e.select(key, f"{c}.child_pool_id", f"{c}.parent_hash", f"{c}.confirmed_at") for c in "ab")
    return M.fill_event(old, new, "id", ["child_pool_id", "parent_hash"])


def merge_attributions(spark, sf):
    old, new = _halves(spark, sf)
    att = lambda e: e.groupBy("source_id", "child_height").agg(F.min("child_pool_id").alias("pool"), F.max("confirmed_at").alias("last_seen"))
    return M.merge_attributions(att(old), att(new), ["source_id", "child_height"])


def prune_attributions(spark, sf):
    e = V.events(spark, sf).select("source_id", "child_height", "child_pool_id").distinct()
    return M.prune_attributions(e, e.where("source_id in (2, 4) and child_height % 3 = 0"), ["source_id"], ["source_id", "child_height"])


def merge_blocks(spark, sf):
    b = V.blocks(spark, sf)
    new = b.where("height % 5 = 0 and kind = 'unknown'")
    return M.merge_blocks(b.where("time % 2 = 0"), new.withColumn("pool_id", F.lit(7).cast("long")), "core").select("hash", "kind", "core_attested", "orphan_class", "pool_id")


def reconcile_snapshot(spark, sf):
    e = V.events(spark, sf).withColumn("by_operator", F.col("child_height") % 10 == 0)
    life = V.sources(spark).select("source_id", F.when(F.col("source_id") <= 2, "historical").when(F.col("source_id") == 3, "surveyed").otherwise("live").alias("lifecycle"))
    return M.reconcile_snapshot(e, e.where("child_height % 4 <> 0"), life).groupBy("source_id", "action").agg(F.count("*").alias("n"))


def revoke_restore(spark, sf):
    e = V.events(spark, sf)
    out = M.restore(M.revoke(e, e.where("child_height % 6 = 0"), "manual", 5), e.where("child_height % 12 = 0"))
    return out.groupBy("source_id", "reason").agg(F.count("*").alias("n"), F.count("revoked_at").alias("revoked"))


def supersede(spark, sf):
    return M.supersede(V.events(spark, sf))


def repair_candidates(spark, sf):
    """Blocks as built, of which one in nine is missing and one in seventeen counts one attestation too many."""
    core = V.blocks(spark, sf).where("core_attested").select("hash")
    built = K.build_blocks(V.events(spark, sf), V.sources(spark), _verdict(spark, sf), core)
    number = F.conv(F.substring("hash", 1, 6), 16, 10).cast("long")
    stored = built.where(number % 9 != 0).withColumn("total_attestations", F.col("total_attestations") + (number % 17 == 0).cast("int"))
    return M.repair_candidates(V.events(spark, sf), stored, V.sources(spark))


def diff_pools(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("slug"), F.col("s_nationkey").cast("string").alias("name"), "s_suppkey")
    return M.diff_pools(s.where("s_suppkey % 5 <> 0").select("slug", "name"), s.where("s_suppkey % 7 <> 0").select("slug", F.when(F.col("s_suppkey") % 11 == 0, "x").otherwise(F.col("name")).alias("name")))


def check_inventory(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return M.check_inventory(p.select(F.col("p_name").alias("item")), p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("item"))).groupBy("item", "problem").agg(F.count("*").alias("n"))


def import_summary(spark, sf):
    rows = V.events(spark, sf).select(F.when(F.col("revoked_at").isNull(), "inserted").otherwise("updated").alias("disposition"), F.col("parent_kind").alias("classification"), F.when(F.col("child_hash").isNull(), "no_child_hash").alias("skip_reason"))
    return M.import_summary(rows)


QUERIES = {
    f.__name__: f
    for f in (
        classify_parents, effective, apply_classification, orphan_verdict, classify_nbits, strict_height, orphan_class, build_blocks, block_miner, demote_inactive, known_stale_demotion, reclassify_unknown, horizon_gate,
        import_decision, source_sync, publication_category, filter_unknown, fill_child_coinbase, merge_events, fill_event, merge_attributions, prune_attributions, merge_blocks, reconcile_snapshot, revoke_restore, supersede, repair_candidates, diff_pools,
        check_inventory, import_summary,
    )
}

_ROLL = f", roll as (select parent_hash as hash, count(*) as n, count(distinct e.source_id) as s, count(distinct case when source_kind = 'auxpow' then e.source_id end) as c, bool_or(source_kind = 'live-chaintip') as l, min(discovered_at) as a, max(confirmed_at) as z from event e join source s on s.source_id = e.source_id where {ATTESTED} group by 1)"

ORACLE = {
    "classify_parents": V.oracle(PAR + "select * from verdict"),
    "effective": V.oracle(PAR + """
, old as (select * from block where height % 7 <> 0),
k as (select v.*, o.kind as ok, o.height as oh, o.competitor_hash as oc, coalesce(v.kind = 'unknown' and (o.kind = 'canonical' or (o.kind = 'stale' and o.competitor_hash in (select hash from old where kind = 'canonical')) or (o.kind = 'error_block' and v.hash in (select hash from er))), false) as kept
  from verdict v left join old o on o.hash = v.hash)
select hash, case when kept then ok else kind end as kind, case when kept then oh else height end as height, case when kept then oc else competitor_hash end as competitor_hash, kept from k"""),
    "apply_classification": V.oracle(PAR + "select source_id, case when revoked_at is null and parent_kind <> 'near' and v.kind is not null and (v.kind <> 'unknown' or parent_kind in ('unknown', 'error_block')) then v.kind else parent_kind end as parent_kind, count(*) as n from event e left join verdict v on v.hash = e.parent_hash group by 1, 2"),
    "orphan_verdict": V.oracle(EPOCHS + """
, ep as (select epoch + 227808 as epoch, start_time, bits from epochs),
og as (select hash, case time % 3 when 0 then cast(floor((time - 1231006505) / 600) as bigint) + 227808 when 1 then height * 5 + 227808 end as height, time, 486604799 - coalesce(length(orphan_class), 0) * 5 as bits from block where kind = 'unknown'),
p as (select og.*, case when time <= 1238006505 then (select arg_max(epoch, start_time) from ep where start_time <= time) end as epoch from og),
q as (select p.*, e.bits as eb, b.bits as bb, n.bits as nb from p left join ep e on e.epoch = p.epoch left join ep b on b.epoch = p.epoch - 2016 left join ep n on n.epoch = p.epoch + 2016),
r as (select *, coalesce(height >= 227931, false) as has, coalesce(height >= 227931 and height // 2016 * 2016 = epoch, false) as agrees from q),
x as (select hash, case when has and height > 241808 then 'pending:above_height' when time > 1238006505 then 'pending:above_time' when agrees and coalesce(bits = eb, false) then 'strict:height_and_bits' when agrees then 'excluded:wrong_bits'
  when epoch is null then 'excluded:before_table' when coalesce(bits = eb, false) or coalesce(bits = bb, false) or coalesce(bits = nb, false) then 'weak:nearby_bits' else 'excluded:foreign_bits' end as v from r)
select hash, split_part(v, ':', 1) as verdict, split_part(v, ':', 2) as reason from x"""),
    "classify_nbits": V.oracle(EPOCHS + ", s as (select hash, height, 486604799 - pool_id % 5 as bits, height // 2016 * 2016 as own from block where kind = 'stale') select s.hash, s.height, s.bits, case when own < (select min(epoch) from epochs) then 'below' when e.bits is null then 'above' when e.bits = s.bits then 'valid' else 'contaminant' end as nbits from s left join epochs e on e.epoch = s.own"),
    "strict_height": V.oracle(f", x as (select e.*, parent_height + 227000 + child_height % 2 as sh from event e join source s on s.source_id = e.source_id where s.code in ('auxpow:namecoin', 'auxpow:fractal', 'auxpow:elastos') and {ACTIVE}), k as (select parent_hash, sh, row_number() over (partition by parent_hash order by event_id) as k from x where sh >= 227931) select parent_hash, sh as strict_height from k where k = 1"),
    "orphan_class": V.oracle("select hash, case when time % 11 = 0 then 'excluded' when time % 3 = 0 then orphan_class when time % 7 = 0 or time % 13 = 0 then 'excluded' when time % 5 = 0 then null when time % 2 = 0 then 'strict' else 'weak' end as orphan_class from block where kind = 'unknown'"),
    "build_blocks": V.oracle(PAR + _ROLL + """
, cr as (select hash from block where core_attested),
j as (select coalesce(r.hash, cr.hash) as hash, r.n, r.s, r.c, r.l, r.a, r.z, cr.hash is not null as core from roll r full join cr on cr.hash = r.hash)
select j.hash, coalesce(v.kind, case when core then 'canonical' else 'unknown' end) as kind, v.height, v.competitor_hash, coalesce(n, 0) + core::int as total_attestations, coalesce(s, 0) + core::int as distinct_sources, coalesce(c, 0) as chains, coalesce(l, false) as live, core as core_attested, a as first_seen, z as last_seen
from j left join verdict v on v.hash = j.hash"""),
    "block_miner": V.oracle(f", m as (select parent_hash, case when count(distinct child_pool_id) = 1 then min(child_pool_id) end as p from event where {ACTIVE} group by 1) select b.hash, coalesce(case when kind = 'canonical' and height % 2 = 0 then pool_id end, case when kind = 'canonical' then pool_id end, m.p) as pool_id from block b left join m on m.parent_hash = b.hash"),
    "demote_inactive": V.oracle(f", s as (select distinct parent_hash from event where {ACTIVE}), d as (select b.*, s.parent_hash is null and not core_attested as demoted from block b left join s on s.parent_hash = b.hash) select hash, case when demoted then 'unknown' else kind end as kind, case when not demoted then height end as height, case when not demoted then competitor_hash end as competitor_hash, demoted from d"),
    "known_stale_demotion": V.oracle(", u as (select *, coalesce(time % 3 = 0 and orphan_class in ('strict', 'weak'), false) as changed from block where kind = 'unknown') select hash, case when changed then 'excluded' else orphan_class end as orphan_class, changed from u"),
    "reclassify_unknown": V.oracle(PAR + "select 'unknown' as old, v.kind as new, count(*) as n from block b join verdict v on v.hash = b.hash where (b.height % 4 = 0 or b.kind = 'unknown') and v.kind <> 'unknown' group by 2"),
    "horizon_gate": V.oracle(", t as (select max(height) as th from block where kind = 'canonical'), c as (select hash, height + time % 300 + case when time % 2 = 0 then 0 else th - 100 end as height from block cross join t where kind = 'stale') select hash, height, case when height <= th then 'resolve' when height > th + 144 then 'far_future' else 'hold' end as gate from c cross join t"),
    "import_decision": V.oracle(PAR + """
, i as (select hash, kind, published, ('0x' || substr(hash, 1, 6))::bigint as h from verdict, (values ('canonical'), ('stale'), ('stale_descendant'), ('unknown')) p(published)),
r as (select *, h % 5 in (0, 1) as known, h % 7 < 4 as orphan, h % 3 = 1 as node, h % 2 = 0 as absent, h % 41 = 0 as listed from i),
d as (
  select hash, published, 'classified' as mode, case when listed or kind = 'error_block' then 'skip unsupported_classification'
    when kind = 'canonical' then case published when 'canonical' then 'capture' else 'skip classification_mismatch' end
    when kind = 'stale' then case when published like 'stale%' or known or published = 'canonical' and node then 'capture' else 'skip classification_mismatch' end
    when kind = 'unknown' and known then 'capture_known_branch' when kind = 'unknown' and published = 'unknown' and absent and orphan then 'capture' else 'skip unclassified' end as x from r
  union all select hash, published, 'unclassified', case when listed then 'skip unsupported_classification' when published = 'unknown' then 'skip unclassified' else 'capture_unclassified' end from r
  union all select hash, published, 'off', case when listed then 'skip unsupported_classification' else 'skip unclassified' end from r)
select hash, published, mode, split_part(x, ' ', 1) as decision, nullif(split_part(x, ' ', 2), '') as skip_reason from d"""),
    "source_sync": V.oracle("select code, case s.source_id when 1 then 'historical' when 2 then 'catching_up' when 3 then 'live' when 4 then 'stale' when 5 then 'not_started' else 'error' end as state from source s join (select distinct source_id from event) e on e.source_id = s.source_id"),
    "publication_category": V.oracle("""
, rw as (select hash, case when kind = 'error_block' then case when time % 2 = 0 then 'near' else 'other' end when kind = 'stale' and time % 5 = 0 then 'stale_descendant' else kind end as c,
  coalesce(case when kind = 'canonical' and time % 10 = 0 then 'x' when kind = 'unknown' and orphan_class in ('strict', 'weak') then orphan_class || '_btc_orphan' end, '') as r,
  coalesce(case when kind = 'stale' then case when time % 5 = 0 then 'valid_stale_descendant' when time % 3 <> 1 then 'valid_direct_stale' end when time % 11 = 0 then 'valid_direct_stale' end, '') as why, time % 4 as st from block),
g as (select hash, st, case when why = 'valid_direct_stale' then case when c in ('stale', 'unknown') and r = '' then 'stale' else '-taxonomy_mismatch' end
  when why = 'valid_stale_descendant' then case when c in ('stale_descendant', 'unknown') and r = '' then 'stale_descendant' else '-taxonomy_mismatch' end
  when c = 'canonical' and r = '' then 'canonical' when c = 'unknown' and r <> '' then r when c = 'near' then '-near' when c = 'other' then '-unsupported_classification' else '-taxonomy_mismatch' end as v from rw),
f as (select hash, case when v = 'stale' and st not in (1, 3) or v = 'stale_descendant' and st <> 2 then '-taxonomy_mismatch' else v end as v from g)
select hash, case when v[1] <> '-' then v end as category, case when v[1] = '-' then v[2:] end as skip_reason from f"""),
    "filter_unknown": V.oracle("""
, u as (select hash, coalesce(orphan_class, 'pending') as verdict, case time % 5 when 0 then 'stale' when 1 then 'strict_btc_orphan' when 2 then 'weak_btc_orphan' when 3 then 'stale_descendant' end as selection from block where kind = 'unknown')
select *, case when selection in ('stale', 'stale_descendant') then null when verdict = 'excluded' then 'orphan_excluded' when verdict = 'pending' then 'orphan_pending' when selection = 'strict_btc_orphan' or selection = verdict || '_btc_orphan' then null
  when selection = 'weak_btc_orphan' then 'taxonomy_mismatch' else 'orphan_not_selected' end as skip_reason from u"""),
    "fill_child_coinbase": V.oracle("""
, e as (select child_height % 3 <> 0 as late, case when child_height % 4 = 0 then 'own' end as t, coinbase as s, case when child_height % 7 = 0 then 'out' end as o from event),
f as (select coalesce(t, case when late then 't' end) as coinbase_txid, coalesce(s, case when late then 's' end) is null as no_script, coalesce(o, case when late then 'o' end) as coinbase_outputs, late and (t is null or s is null or o is null) as filled from e)
select *, count(*) as n from f group by all"""),
    "merge_events": V.oracle(HALVES + """
, x as (select source_id, child_hash, min(event_id) as xid, arg_min(parent_hash, event_id) as xp from e0 where child_hash is not null group by 1, 2),
q as (select source_id, child_height, parent_hash, min(event_id) filter (child_hash is null) as oid, count(*) filter (child_hash is null) as no, min(event_id) filter (child_hash is not null) as fid, count(*) filter (child_hash is not null) as nf from e0 group by 1, 2, 3),
j as (select n.*, xid, xp, oid, coalesce(no, 0) as no, fid, coalesce(nf, 0) as nf from e1 n left join x on x.source_id = n.source_id and x.child_hash = n.child_hash left join q on q.source_id = n.source_id and q.child_height = n.child_height and q.parent_hash = n.parent_hash),
d as (select *, case when child_hash is not null then case when xid is not null and xp <> parent_hash then 'contradictory' when xid is not null then 'updated' when no > 1 then 'ambiguous' when oid is not null then 'promoted' else 'inserted' end
  else case when nf > 1 then 'ambiguous' when fid is not null then 'satisfied' when oid is not null then 'updated' else 'inserted' end end as disposition from j)
select event_id, case when disposition <> 'inserted' then coalesce(case when child_hash is not null then xid end, case when child_hash is not null then oid end, fid, oid) end as match_id, disposition from d"""),
    "fill_event": V.oracle("""
, e as (select *, source_id || '/' || child_hash as id, row_number() over (partition by source_id, child_hash order by event_id) as a, row_number() over (partition by source_id, child_hash order by event_id desc) as z from event where child_hash is not null)
select o.id, coalesce(o.child_pool_id, n.child_pool_id) as child_pool_id, o.parent_hash, greatest(o.confirmed_at, n.confirmed_at) as confirmed_at, coalesce(o.child_pool_id <> n.child_pool_id, false) or o.parent_hash <> n.parent_hash as contradicts from e o join e n on n.id = o.id and n.z = 1 where o.a = 1"""),
    "merge_attributions": V.oracle(HALVES + """
, a as (select source_id, child_height, min(child_pool_id) as pool, max(confirmed_at) as last_seen from e0 group by 1, 2), b as (select source_id, child_height, min(child_pool_id) as pool, max(confirmed_at) as last_seen from e1 group by 1, 2)
select coalesce(a.source_id, b.source_id) as source_id, coalesce(a.child_height, b.child_height) as child_height, coalesce(b.pool, a.pool) as pool, case when a.last_seen is null then b.last_seen when b.last_seen is null then a.last_seen else greatest(a.last_seen, b.last_seen) end as last_seen from a full join b on a.source_id = b.source_id and a.child_height = b.child_height"""),
    "prune_attributions": V.oracle(", a as (select distinct source_id, child_height, child_pool_id from event) select * from a where source_id not in (2, 4) or child_height % 3 = 0"),
    "merge_blocks": V.oracle("""
, ol as (select * from block where time % 2 = 0), nw as (select *, 7 as p from block where height % 5 = 0 and kind = 'unknown')
select coalesce(a.hash, b.hash) as hash, case when b.hash is not null then 'canonical' else a.kind end as kind, coalesce(a.core_attested, false) or b.hash is not null as core_attested, case when b.hash is null then a.orphan_class end as orphan_class, coalesce(a.pool_id, b.p) as pool_id from ol a full join nw b on b.hash = a.hash"""),
    "reconcile_snapshot": V.oracle("select source_id, case when child_height % 4 = 0 and source_id <= 2 and child_height % 10 <> 0 then 'remove' when source_id = 3 then 'unexpected' else 'keep' end as action, count(*) as n from event group by 1, 2"),
    "revoke_restore": V.oracle(", x as (select source_id, case when child_height % 12 = 0 then null when revoked_at is not null then reason when child_height % 6 = 0 then 'manual' end as reason, case when child_height % 12 = 0 then null when revoked_at is not null then revoked_at when child_height % 6 = 0 then 5 end as r from event) select source_id, reason, count(*) as n, count(r) as revoked from x group by 1, 2"),
    "supersede": V.oracle(", x as (select event_id, child_hash, first_value(child_hash) over (partition by source_id, child_height order by confirmed_at desc, event_id desc, child_hash desc) as l from event where child_hash is not null and revoked_at is null) select event_id, child_hash <> l as superseded from x"),
    "repair_candidates": V.oracle(_ROLL.lstrip() + """
, cr as (select hash from block where core_attested),
j as (select coalesce(r.hash, cr.hash) as hash, r.hash is not null as seen, cr.hash is not null as core from roll r full join cr on cr.hash = r.hash),
k as (select *, cast('0x' || substr(hash, 1, 6) as bigint) as number from j)
select hash, case when number % 9 = 0 then 'no_block' else 'counters' end as problem from k where (number % 9 = 0 and seen) or (number % 9 <> 0 and number % 17 = 0)"""),
    "diff_pools": "with a as (select s_name as slug, cast(s_nationkey as varchar) as name from supplier where s_suppkey % 5 <> 0), b as (select s_name as slug, case when s_suppkey % 11 = 0 then 'x' else cast(s_nationkey as varchar) end as name from supplier where s_suppkey % 7 <> 0), j as (select coalesce(a.slug, b.slug) as slug, case when a.slug is null then 'added' when b.slug is null then 'removed' when a.name <> b.name then 'changed' end as change from a full join b on a.slug = b.slug) select * from j where change is not null",
    "check_inventory": "with h as (select p_name as item, count(*) as n from part group by 1), w as (select p_name as item, count(*) as n from part where p_partkey % 2 = 0 group by 1) select h.item, 'unexpected' as problem, h.n - coalesce(w.n, 0) as n from h left join w on w.item = h.item where h.n > coalesce(w.n, 0)",
    "import_summary": V.oracle("select * from (select 'disposition' as measure, case when revoked_at is null then 'inserted' else 'updated' end as value, count(*) as n from event group by 2 union all select 'classification', parent_kind, count(*) from event group by 2 union all select 'skip_reason', 'no_child_hash', count(*) from event where child_hash is null) where n > 0"),
}
