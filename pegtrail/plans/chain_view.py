"""The domain tables, derived from the driver's tables by integer and string arithmetic that DuckDB repeats.

Heights are the dense order keys; a hash is the sha256 of a tagged height, as hex. SQL is the same derivation for
DuckDB, as common table expressions to put before a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENESIS_TIME = 1231006505


def _hash(tag: str, height: Column) -> Column:
    return F.sha2(F.concat(F.lit(tag), height.cast("string")), 256)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, cust, prio) of each order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("h"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, prev_hash, height, kind, time, pool_id, competitor_hash, orphan_class, core_attested."""
    o = orders(spark, sf_dir)
    kind = lambda tag, name, here: F.struct(F.lit(tag).alias("tag"), F.lit(name).alias("kind"), here.alias("here"))
    every = F.array(kind("c", "canonical", F.lit(True)), kind("s", "stale", F.col("cust") % 17 == 0), kind("u", "unknown", F.col("cust") % 13 == 1), kind("e", "error_block", F.col("cust") % 101 == 3))
    kinds = F.filter(every, lambda k: k["here"])
    before = o.select((F.col("h") + 1).alias("h"), (F.col("cust") % 17 == 0).alias("prev_stale"), (F.col("cust") % 13 == 1).alias("prev_unknown"))
    rows = o.join(before, "h", "left").select("h", "cust", "prio", F.coalesce("prev_stale", F.lit(False)).alias("ps"), F.coalesce("prev_unknown", F.lit(False)).alias("pu"), F.explode(kinds).alias("k")).select("*", "k.tag", "k.kind").drop("k")
    h, cust, tag = F.col("h"), F.col("cust"), F.col("tag")
    offset = F.when(tag == "c", cust % 1200).when(tag == "s", cust * 7 % 1200).otherwise(cust * 11 % 1200)
    pool = F.when(tag == "c", F.when(cust % 5 == 0, None).otherwise(cust % 100)).when(tag == "s", cust * 3 % 100)
    parent = F.when((tag == "s") & F.col("ps"), "s").when((tag == "u") & F.col("pu"), "u").otherwise("c")
    prio = F.substring("prio", 1, 1)
    orphan = F.when(tag == "u", F.when(prio == "1", "strict").when(prio == "2", "weak").when(prio == "3", "excluded").when(prio == "5", "weak"))
    return rows.select(
        F.sha2(F.concat(tag, h.cast("string")), 256).alias("hash"),
        F.sha2(F.concat(parent, (h - 1).cast("string")), 256).alias("prev_hash"),
        F.when((tag != "u") | (cust % 2 == 0), h).alias("height"),
        "kind",
        (F.lit(GENESIS_TIME) + h * 600 + offset - 600).alias("time"),
        pool.alias("pool_id"),
        F.when(tag == "s", _hash("c", h)).alias("competitor_hash"),
        orphan.alias("orphan_class"),
        (tag == "c").alias("core_attested"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each lineitem row, its parent being a block of the order's height."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o = orders(spark, sf_dir).select("h", "cust")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("int").cast("string"))
    e = line.join(o, line["l_orderkey"] == o["h"])
    source = F.col("l_suppkey") % 6 + 1
    pick = F.col("l_partkey") % 3
    tag = F.when((F.col("cust") % 17 == 0) & (pick == 0), "s").when((F.col("cust") % 13 == 1) & (pick == 0), "u").when((F.col("cust") % 101 == 3) & (pick == 0), "e").when(F.col("l_partkey") % 29 == 0, "n").otherwise("c")
    kind = F.when(tag == "s", "stale").when(tag == "u", "unknown").when(tag == "e", "error_block").when(tag == "n", "near").otherwise("canonical")
    seen = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    return e.select(
        F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long").alias("event_id"),
        source.alias("source_id"),
        F.col("l_partkey").alias("child_height"),
        F.when(F.col("l_linestatus") == "O", None).otherwise(F.sha2(F.concat_ws(":", source.cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 256)).alias("child_hash"),
        F.sha2(F.concat(tag, F.col("h").cast("string")), 256).alias("parent_hash"),
        F.col("h").alias("parent_height"),
        kind.alias("parent_kind"),
        F.when(F.col("l_suppkey") % 7 == 0, None).otherwise(F.col("l_suppkey") % 100).alias("child_pool_id"),
        ((tag != "n") & (F.col("l_partkey") % 31 != 0)).alias("pow_ok"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey") % 5 != 0).alias("epoch_ok"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("cb"), F.col("l_partkey").cast("string"))).alias("coinbase"),
        seen.alias("discovered_at"),
        (seen + F.col("l_linenumber") * 60).alias("confirmed_at"),
        F.when(F.col("l_returnflag") == "R", seen + 86400).alias("revoked_at"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("reason-"), (F.col("l_linenumber") % 3).cast("string"))).alias("reason"),
    )


def sources(spark: SparkSession) -> DataFrame:
    """Six sources: five merge-mined chains and a live tip."""
    codes = ("auxpow:namecoin", "auxpow:rsk", "auxpow:hathor", "auxpow:elastos", "auxpow:fractal", "live:tips")
    return spark.createDataFrame([(i + 1, c, "auxpow" if c.startswith("auxpow") else "live-chaintip") for i, c in enumerate(codes)], "source_id long, code string, source_kind string")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pool_id, slug) for the ids 0 to 99 that suppliers give."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.groupBy((F.col("s_suppkey") % 100).alias("pool_id")).agg(F.min("s_name").alias("slug"))


#: The same tables for DuckDB: block, event, source, pool.
SQL = """
o as (select o_orderkey as h, o_custkey as cust, o_orderpriority as prio from orders),
ob as (select o.*, coalesce(p.cust % 17 = 0, false) as ps, coalesce(p.cust % 13 = 1, false) as pu from o left join o p on p.h = o.h - 1),
tagged as (
  select *, 'c' as tag, 'canonical' as kind from ob union all select *, 's', 'stale' from ob where cust % 17 = 0
  union all select *, 'u', 'unknown' from ob where cust % 13 = 1 union all select *, 'e', 'error_block' from ob where cust % 101 = 3),
block as (
  select sha256(tag || cast(h as varchar)) as hash,
    sha256((case when tag = 's' and ps then 's' when tag = 'u' and pu then 'u' else 'c' end) || cast(h - 1 as varchar)) as prev_hash,
    case when tag <> 'u' or cust % 2 = 0 then h end as height, kind,
    1231006505 + h * 600 + (case tag when 'c' then cust % 1200 when 's' then cust * 7 % 1200 else cust * 11 % 1200 end) - 600 as time,
    case tag when 'c' then case when cust % 5 = 0 then null else cust % 100 end when 's' then cust * 3 % 100 end as pool_id,
    case when tag = 's' then sha256('c' || cast(h as varchar)) end as competitor_hash,
    case when tag = 'u' then case substr(prio, 1, 1) when '1' then 'strict' when '2' then 'weak' when '3' then 'excluded' when '5' then 'weak' end end as orphan_class,
    tag = 'c' as core_attested
  from tagged),
le as (
  select l.*, o.h, o.cust, case when cust % 17 = 0 and l_partkey % 3 = 0 then 's' when cust % 13 = 1 and l_partkey % 3 = 0 then 'u' when cust % 101 = 3 and l_partkey % 3 = 0 then 'e'
    when l_partkey % 29 = 0 then 'n' else 'c' end as tag, cast(epoch(l_shipdate) as bigint) as seen
  from lineitem l join o on l.l_orderkey = o.h),
event as (
  select cast('0x' || substr(sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || cast(l_quantity as integer)), 1, 15) as bigint) as event_id,
    l_suppkey % 6 + 1 as source_id, l_partkey as child_height,
    case when l_linestatus = 'O' then null else sha256((l_suppkey % 6 + 1) || ':' || l_orderkey || ':' || l_linenumber) end as child_hash,
    sha256(tag || cast(h as varchar)) as parent_hash, h as parent_height,
    case tag when 's' then 'stale' when 'u' then 'unknown' when 'e' then 'error_block' when 'n' then 'near' else 'canonical' end as parent_kind,
    case when l_suppkey % 7 = 0 then null else l_suppkey % 100 end as child_pool_id, tag <> 'n' and l_partkey % 31 <> 0 as pow_ok, case when l_partkey % 4 <> 0 then l_partkey % 5 <> 0 end as epoch_ok,
    case when l_linenumber % 3 <> 0 then 'cb' || l_partkey end as coinbase, seen as discovered_at, seen + l_linenumber * 60 as confirmed_at,
    case when l_returnflag = 'R' then seen + 86400 end as revoked_at, case when l_returnflag = 'R' then 'reason-' || (l_linenumber % 3) end as reason
  from le),
source as (
  select * from (values (1, 'auxpow:namecoin', 'auxpow'), (2, 'auxpow:rsk', 'auxpow'), (3, 'auxpow:hathor', 'auxpow'), (4, 'auxpow:elastos', 'auxpow'), (5, 'auxpow:fractal', 'auxpow'),
    (6, 'live:tips', 'live-chaintip')) as v(source_id, code, source_kind)),
pool as (select s_suppkey % 100 as pool_id, min(s_name) as slug from supplier group by 1)
"""


def oracle(body: str) -> str:
    """A DuckDB query over the derived tables; further expressions may come first in `body`, each ending in a comma before `select`."""
    return f"with recursive {SQL}{body}"
