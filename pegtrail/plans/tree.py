"""Spine windows, paging, branches and trees over the chain view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pegtrail.operators import graph as G
from pegtrail.operators import rollups as R
from pegtrail.operators import spine as S
from pegtrail.plans import chain_view as V
from pegtrail.plans.core import ACTIVE, EPOCHS, WINDOWS, _epochs, _windows


def _gappy(spark, sf):
    """The blocks without the canonical rows of every 97th height, so that the spine has gaps."""
    return V.blocks(spark, sf).where("kind <> 'canonical' or height % 97 <> 13")


#: The heights of _shown, of the table that is put in.
SHOWN = "(select height from {0} where kind = 'stale' union select height - 1 from {0} where kind = 'stale')"
GAPPY = ", gappy as (select * from block where kind <> 'canonical' or height % 97 <> 13)"
ISLANDS = """
, sp as (select height, count(*) as n, min(hash) as hash, min(prev_hash) as prev_hash from gappy where kind = 'canonical' group by 1),
lk as (select a.*, b.height is not null as has_below, coalesce(a.n = 1 and b.n = 1 and a.prev_hash = b.hash, false) as linked from sp a left join sp b on b.height = a.height - 1),
isle as (select height, hash, max(case when not linked then height end) over (order by height) as island from lk where n = 1)
"""


def islands(spark, sf):
    return S.islands(_gappy(spark, sf))


def sparse_tip(spark, sf):
    return S.sparse_tip(_gappy(spark, sf), 90)


def contiguous_prefix(spark, sf):
    return S.contiguous_prefix(_gappy(spark, sf))


def contiguous_tip(spark, sf):
    return S.contiguous_tip(_gappy(spark, sf), 5)


def default_tip(spark, sf):
    return S.default_tip(_gappy(spark, sf), 96, 5)


def coverage_verdict(spark, sf):
    b = _gappy(spark, sf)
    return S.coverage_verdict(_windows(b), b)


def spine_conflicts(spark, sf):
    """The blocks with every 211th canonical row named by a wrong parent."""
    b = V.blocks(spark, sf).withColumn("prev_hash", F.when((F.col("kind") == "canonical") & (F.col("height") % 211 == 7), F.lit("0")).otherwise(F.col("prev_hash")))
    return S.spine_conflicts(b)


def _shown(block):
    """Canonical heights that a tree shows: those where a stale block stands, and the ones below."""
    stale = block.where("kind = 'stale'").select("height")
    wanted = stale.unionByName(stale.select((F.col("height") - 1).alias("height"))).distinct()
    return block.where("kind = 'canonical'").join(wanted, "height", "left_semi")


def hidden_edges(spark, sf):
    b = _gappy(spark, sf)
    return S.hidden_edges(_shown(b).select("height"), b)


def _nodes(spark, sf):
    """All blocks with a height, in windows of 500 heights; canonical ones with evidence of their own can't be removed."""
    b = _gappy(spark, sf).where("height is not null")
    return b.select(F.floor(F.col("height") / 500).alias("window_id"), "height", "hash", "prev_hash", "kind", ((F.col("height") % 37 != 0) & (F.col("height") % 41 != 0)).alias("removable"))


def reduce_nodes(spark, sf):
    return S.reduce_nodes(_nodes(spark, sf), 500).select("window_id", "height", "hash", "too_large")


def navigate_stale(spark, sf):
    return S.navigate_stale(V.blocks(spark, sf), 50, 900, "8").select("hash", "height")


def navigate_newer(spark, sf):
    return S.navigate_stale(V.blocks(spark, sf), 50, 300, "8", newer=True).select("hash", "height")


def navigate_error(spark, sf):
    seen = V.events(spark, sf).where(R.active()).select(F.col("parent_hash").alias("hash"))
    return S.navigate_error(V.blocks(spark, sf), seen, 20).select("hash", "height")


def navigate_orphan(spark, sf):
    return S.navigate_orphan(V.blocks(spark, sf), 40, ["strict", "weak"], V.GENESIS_TIME + 700_000, "8").select("hash", "time")


def has_edge(spark, sf):
    return S.has_edge(V.blocks(spark, sf).where("kind = 'stale'"), F.col("height") > 1000)


def nearest_strip(spark, sf):
    b = _gappy(spark, sf)
    return S.nearest_strip(b, b.where("kind = 'unknown'").select(F.col("hash").alias("anchor_id")), ["strict", "weak", "pending"])


def merge_windows(spark, sf):
    w = _windows(V.blocks(spark, sf)).withColumn("group_id", F.floor(F.col("low") / 1000))
    return S.merge_windows(w)


def navigation_windows(spark, sf):
    b = _gappy(spark, sf)
    return S.navigation_windows(b.where("kind = 'stale'").select(F.col("hash").alias("target_id"), "height"), b, 2)


def stale_branches(spark, sf):
    return G.stale_branches(V.blocks(spark, sf)).withColumn("members", F.array_join("members", ",")).withColumn("tips", F.array_join("tips", ","))


def orphan_branches(spark, sf):
    return G.orphan_branches(V.blocks(spark, sf)).withColumn("members", F.array_join("members", ",")).withColumn("tips", F.array_join("tips", ","))


def branch_detail(spark, sf):
    return G.branch_detail(V.blocks(spark, sf))


def orphan_component(spark, sf):
    return G.orphan_component(V.blocks(spark, sf), 1)


def place_components(spark, sf):
    b = V.blocks(spark, sf)
    return G.place_components(b, _epochs(b))


def attach_roots(spark, sf):
    b = V.blocks(spark, sf)
    return G.attach_roots(G.place_components(b, _epochs(b)), b)


def include_branches(spark, sf):
    b = V.blocks(spark, sf)
    return G.include_branches(b, b.where("kind = 'stale' and pool_id % 10 = 3").select("hash"))


def tree_edges(spark, sf):
    every = V.blocks(spark, sf)
    b = every.where("kind <> 'canonical'").unionByName(_shown(every).select(*every.columns)).select("hash", "prev_hash", "kind", "height")
    return G.tree_edges(b, S.hidden_edges(b.where("kind = 'canonical'").select("height"), every))


def cascade(spark, sf):
    """What the canonical blocks of every 500th height make stale, along the whole spine."""
    b = V.blocks(spark, sf)
    return G.cascade(b.where("kind = 'canonical' and height % 500 = 5").select("hash"), b)


def _branches(spark, sf):
    return G.stale_branches(V.blocks(spark, sf)).select("root", "low", "high", "members")


def navigate_branches(spark, sf):
    """The page of branches behind a cursor in the middle of the spine."""
    return S.navigate_branches(_branches(spark, sf), 50, (3000, 2990, "8")).select("root", "low", "high")


def navigate_branches_newer(spark, sf):
    return S.navigate_branches(_branches(spark, sf), 50, (3000, 2990, "8"), newer=True).select("root", "low", "high")


def infer_stale(spark, sf):
    """Unknown blocks named onto the stale row below, where there is one."""
    b = V.blocks(spark, sf)
    above = b.where("kind = 'stale'").select((F.col("height") + 1).alias("height"), F.col("hash").alias("stale_below"))
    return G.infer_stale(b.join(above, "height", "left").withColumn("prev_hash", F.when(F.col("kind") == "unknown", F.coalesce("stale_below", "prev_hash")).otherwise(F.col("prev_hash"))).drop("stale_below"))


QUERIES = {
    f.__name__: f
    for f in (
        islands, sparse_tip, contiguous_prefix, contiguous_tip, default_tip, coverage_verdict, spine_conflicts, hidden_edges, reduce_nodes, navigate_stale, navigate_newer, navigate_error, navigate_orphan,
        has_edge, nearest_strip, merge_windows, navigation_windows, stale_branches, orphan_branches, branch_detail, orphan_component, place_components, attach_roots, include_branches, tree_edges, cascade, infer_stale, navigate_branches,
        navigate_branches_newer,
    )
}

#: Ancestors within a set of rows `rs`: root and steps of each.
ROOTS = """
, up as (
  select hash, hash as root, 0 as steps from rs where prev_hash not in (select hash from rs)
  union all select rs.hash, up.root, up.steps + 1 from rs join up on rs.prev_hash = up.hash)
"""
_BRANCH = """
, m as (select rs.hash, up.root, rs.k, rs.hash not in (select prev_hash from rs) as tip from rs join up on up.hash = rs.hash)
select root, count(*) as depth, string_agg(hash, ',' order by hash) as members, string_agg(hash, ',' order by k desc, hash) filter (tip) as tips, min(k) as low, max(k) as high from m group by 1 having count(*) >= 2
"""
_BRANCHES = ", br as (select root, min(rs.k) as low, max(rs.k) as high from up join rs on rs.hash = up.hash group by 1 having count(*) >= 2)"
_STALE = ", rs as (select hash, prev_hash, height as k from block where kind = 'stale')"
_UNKNOWN = ", rs as (select hash, prev_hash, time as k, height, orphan_class, time from block where kind = 'unknown')"
_PLACED = (
    EPOCHS + _UNKNOWN + ROOTS + """
, imp as (select up.root, min(case when orphan_class = 'strict' then height - steps end) as low, max(case when orphan_class = 'strict' then height - steps end) as high, min(case when up.hash = up.root then time end) as time
  from up join rs on rs.hash = up.hash group by 1),
placed as (select root, coalesce(low, e) as root_height, case when low = high then 'exact' when low is not null then 'approximate' when e is not null then 'epoch' end as basis
  from (select imp.*, (select max(epoch) from epochs where start_time <= imp.time) as e from imp))
"""
)

ORACLE = {
    "islands": V.oracle(GAPPY + ISLANDS + "select * from isle"),
    "sparse_tip": V.oracle(GAPPY + ISLANDS + "select max(height) as tip from isle where height - island + 1 >= 90 or island = 0"),
    "contiguous_prefix": V.oracle(GAPPY + ISLANDS + "select max(height) as prefix_tip from isle where island = 0"),
    "contiguous_tip": V.oracle(GAPPY + ISLANDS + "select case when height - island + 1 >= 5 then height end as tip from (select height, island from isle order by height desc limit 1)"),
    "default_tip": V.oracle(GAPPY + ISLANDS + ", top as (select height, island from isle order by height desc limit 1) select coalesce((select case when height - island + 1 >= 96 then height end from top), (select max(height) from isle where height - island + 1 >= 96 or island = 0), (select case when height - island + 1 >= 5 then height end from top)) as tip"),
    "coverage_verdict": V.oracle(GAPPY + ISLANDS + WINDOWS + """
, x as (select window_id, low, unnest(generate_series(low, high)) as height from win),
y as (select x.window_id, x.height, case when n is null then 'missing' when n > 1 then 'duplicate' when not linked and x.height > low then 'link' end as what from x left join lk on lk.height = x.height),
f as (select window_id, min(case when what is not null then height end) as at_height from y group by 1)
select f.window_id, coalesce(y.what, 'ok') as verdict, f.at_height as at from f left join y on y.window_id = f.window_id and y.height = f.at_height"""),
    "spine_conflicts": V.oracle(", c as (select height, hash, case when height % 211 = 7 then '0' else prev_hash end as prev_hash from block where kind = 'canonical') select a.height, 'link' as conflict from c a join c b on b.height = a.height - 1 where a.prev_hash <> b.hash"),
    "hidden_edges": V.oracle(GAPPY + ISLANDS + ", v as (select height, island, lag(height) over (order by height) as below from isle where height in " + SHOWN.format("gappy") + ") select height, below as from_height, height - below - 1 as hidden from v where below >= island"),
    "reduce_nodes": V.oracle(GAPPY + """
, nd as (select height // 500 as window_id, height, hash, prev_hash, kind, height % 37 <> 0 and height % 41 <> 0 as removable from gappy where height is not null),
s1 as (select *, case when kind = 'canonical' and lag(kind) over w = 'canonical' and lag(hash) over w = prev_hash then 0 else 1 end as step, row_number() over w as place from nd window w as (partition by window_id order by height, hash)),
r as (select *, sum(step) over (partition by window_id order by place rows unbounded preceding) as run from s1),
i as (select *, min(place) over (partition by window_id, run) as a, max(place) over (partition by window_id, run) as z from r where kind = 'canonical'),
ins as (select * from i where place > a and place < z and removable),
sz as (select window_id, run, count(*) as size, arg_min(hash, place) as h from ins group by 1, 2),
bf as (select *, coalesce(sum(size) over (partition by window_id order by size desc, h rows between unbounded preceding and 1 preceding), 0) as before from sz),
c as (select window_id, count(*) as nodes from nd group by 1),
gone as (select bf.window_id, run, size from bf join c on c.window_id = bf.window_id where nodes - before > 500),
lf as (select c.window_id, nodes - coalesce(sum(size), 0) > 500 as too_large from c left join gone g on g.window_id = c.window_id group by c.window_id, nodes)
select nd.window_id, height, hash, too_large from nd join lf on lf.window_id = nd.window_id where hash not in (select ins.hash from ins join gone on gone.window_id = ins.window_id and gone.run = ins.run)"""),
    "navigate_stale": V.oracle("select hash, height from block where kind = 'stale' and (height < 900 or (height = 900 and hash > '8')) order by height desc, hash limit 51"),
    "navigate_newer": V.oracle("select hash, height from block where kind = 'stale' and (height > 300 or (height = 300 and hash < '8')) order by height, hash desc limit 51"),
    "navigate_error": V.oracle(f"select hash, height from block where kind = 'error_block' and hash in (select parent_hash from event where {ACTIVE}) order by height desc, hash limit 21"),
    "navigate_orphan": V.oracle("select hash, time from block where kind = 'unknown' and orphan_class in ('strict', 'weak') and (time < 1231706505 or (time = 1231706505 and hash < '8')) order by time desc, hash desc limit 41"),
    "has_edge": V.oracle("select count(*) > 0 as found from block where kind = 'stale' and height > 1000"),
    "nearest_strip": V.oracle("""
, u as (select hash, time, row_number() over (order by time, hash) - 1 as p, count(*) over () as n from block where kind = 'unknown' and coalesce(orphan_class, 'pending') in ('strict', 'weak', 'pending')),
a as (select *, least(n - 1 - p, 249) as newer, least(p, 249) as older from u),
b as (select *, least(older, 249 - least(newer, 125)) as below from a)
select b.hash as anchor_id, u.time, u.hash from b join u on u.p between b.p - b.below and b.p + least(b.newer, 249 - b.below)"""),
    "merge_windows": V.oracle(WINDOWS + """
, g as (select *, low // 1000 as group_id, max(high) over (partition by low // 1000 order by low, high rows between unbounded preceding and 1 preceding) as reach from win),
m as (select *, sum(case when reach is null or low > reach + 1 then 1 else 0 end) over (partition by group_id order by low, high rows unbounded preceding) as isle from g)
select group_id, min(low) as low, max(high) as high from m group by group_id, isle"""),
    "navigation_windows": V.oracle(GAPPY + """
, t as (select hash as target_id, height from gappy where kind = 'stale'),
c as (select distinct target_id, greatest(height - 16 + i, 0) as low, height + 16 - j as high from t cross join (select unnest(generate_series(0, 16)) as i) a cross join (select unnest(generate_series(0, 16)) as j) b),
h as (select height, count(*) filter (kind = 'canonical') as here, count(*) filter (kind in ('stale', 'error_block')) as side from gappy where height is not null group by 1),
s as (select c.target_id, c.low, c.high, sum(case when here > 0 then 1 else 0 end) as here, sum(side) as side from c join h on h.height between c.low and c.high group by 1, 2, 3),
f as (select *, row_number() over (partition by target_id order by low, high desc) as k from s where here = high - low + 1 and side <= 2)
select target_id, low, high from f where k = 1"""),
    "stale_branches": V.oracle(_STALE + ROOTS + _BRANCH),
    "orphan_branches": V.oracle(", c as (select hash, prev_hash, time from block where kind = 'unknown' and coalesce(orphan_class, 'pending') <> 'excluded'), rs as (select hash, prev_hash, time as k from c where prev_hash in (select hash from c) or hash in (select prev_hash from c))" + ROOTS + _BRANCH),
    "branch_detail": V.oracle(_STALE + ROOTS + ", d as (select root, count(*) as depth from up group by 1) select up.hash, up.root, d.depth, case when up.hash = up.root and up.hash not in (select prev_hash from rs) then 'root_and_tip' when up.hash = up.root then 'root' when up.hash not in (select prev_hash from rs) then 'tip' else 'interior' end as position from up join d on d.root = up.root"),
    "orphan_component": V.oracle(_UNKNOWN + ROOTS + ", d as (select root, count(*) as size from up group by 1) select up.hash, up.root, d.size, d.size > 1 as capped from up join d on d.root = up.root"),
    "place_components": V.oracle(_PLACED + "select * from placed"),
    "attach_roots": V.oracle(_PLACED + """
, sp as (select height, hash from block where kind = 'canonical'),
n as (select root, sp.hash, row_number() over (partition by root order by abs(sp.height - root_height + 1), sp.height, sp.hash) as k from placed join sp on sp.height between root_height - 16 and root_height + 16),
s as (select p.root, sp.hash from placed p join rs on rs.hash = p.root join sp on sp.height = p.root_height - 1 and sp.hash = rs.prev_hash)
select n.root, coalesce(s.hash, n.hash) as to_hash, s.hash is not null as verified from n left join s on s.root = n.root where n.k = 1"""),
    "include_branches": V.oracle(_STALE + ROOTS + "select hash, root from up where root in (select root from up join block b on b.hash = up.hash where b.pool_id % 10 = 3)"),
    "tree_edges": V.oracle("""
, nd as (select hash, prev_hash, kind, height from block where kind <> 'canonical' or height in """ + SHOWN.format("block") + """),
d as (select p.hash as from_hash, n.hash as to_hash, case when n.kind = 'canonical' and p.kind = 'canonical' then 'canonical' when n.kind = 'stale' and p.kind = 'canonical' then 'stale_entry' else n.kind end as edge_kind, 0 as hidden from nd n join nd p on p.hash = n.prev_hash),
v as (select hash, height, lag(height) over (order by height) as b, lag(hash) over (order by height) as bh from nd where kind = 'canonical')
select * from d union all select bh, hash, 'hidden', height - b - 1 from v where height - b > 1"""),
    "cascade": V.oracle("""
, ln as (select prev_hash as src, hash from block union select competitor_hash, hash from block where competitor_hash is not null),
sd as (select height as seed from block where kind = 'canonical' and height % 500 = 5),
sp as (select b.hash, b.height - s.seed as round from (select hash, height from block where kind = 'canonical') b asof join sd s on b.height >= s.seed),
w as (select ln.hash, sp.round + 1 as round from ln join sp on sp.hash = ln.src where ln.hash not in (select hash from block where kind = 'canonical') union select ln.hash, w.round + 1 from ln join w on w.hash = ln.src)
select hash, round from sp union all select hash, min(round) from w where hash not in (select hash from sp) group by 1"""),
    "infer_stale": V.oracle("""
, bl as (select b.hash, b.kind, b.height, case when b.kind = 'unknown' then coalesce(s.hash, b.prev_hash) else b.prev_hash end as prev_hash from block b left join block s on s.kind = 'stale' and s.height = b.height - 1),
w as (select hash, height from bl where kind = 'stale' union all select bl.hash, w.height + 1 from bl join w on bl.prev_hash = w.hash join block c on c.kind = 'canonical' and c.height = w.height + 1 where bl.kind = 'unknown')
select w.hash, w.height, c.hash as competitor_hash from w join block c on c.kind = 'canonical' and c.height = w.height where w.hash in (select hash from bl where kind = 'unknown')"""),
    "navigate_branches": V.oracle(_STALE + ROOTS + _BRANCHES + "select root, low, high from br where high < 3000 or (high = 3000 and (low < 2990 or (low = 2990 and root > '8'))) order by high desc, low desc, root limit 51"),
    "navigate_branches_newer": V.oracle(_STALE + ROOTS + _BRANCHES + "select root, low, high from br where high > 3000 or (high = 3000 and (low > 2990 or (low = 2990 and root < '8'))) order by high, low, root desc limit 51"),
}
