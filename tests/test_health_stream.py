"""Source health kept up to date by batches equals the one that is rebuilt."""

from pyspark.sql import functions as F

from pegtrail.operators import rollups
from pegtrail.plans import chain_view as V
from pegtrail.streaming import streams


def health(df):
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


def test_batches_equal_a_rebuild(spark, small, tmp_path):
    block = V.blocks(spark, small).where("height % 3 <> 0 or height is null").select("hash", "kind", "orphan_class").cache()
    live = V.events(spark, small).where("revoked_at is null").dropDuplicates(["event_id"]).cache()
    write = streams.health_diff_batch(str(tmp_path), lambda spark: block)
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for i in range(3):
        batch = live.where(part.isin(i, i - 1))  # half of each batch has landed before
        write(batch.unionByName(batch.where("event_id % 2 = 0")), i)
        if i == 1:
            write(batch, i)  # tried again
        done = live.where(part <= i)
        assert health(streams.health_now(spark, str(tmp_path), V.sources(spark))) == health(rollups.source_health(done, block, V.sources(spark)))


def test_a_parent_moves_from_near_to_unknown(spark, tmp_path):
    block = spark.createDataFrame([("c", "canonical", None)], "hash string, kind string, orphan_class string")
    source = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, code string")
    write = streams.health_diff_batch(str(tmp_path), lambda spark: block)
    land = lambda rows: spark.createDataFrame(rows, "event_id long, source_id long, parent_hash string, parent_kind string, confirmed_at long")
    now = lambda: {r["source_id"]: (r["events"], r["near"], r["unknown"], r["canonical"], r["last_seen"]) for r in streams.health_now(spark, str(tmp_path), source).collect()}
    assert now() == {1: (0, 0, 0, 0, None), 2: (0, 0, 0, 0, None)}
    write(land([(1, 1, "p", "near", 10), (2, 1, "c", "near", 20)]), 0)
    assert now()[1] == (2, 1, 0, 1, 20)
    write(land([(3, 1, "p", "unknown", 15), (1, 1, "p", "near", 10), (4, 2, "p", "near", 5)]), 1)
    assert now() == {1: (3, 0, 1, 1, 20), 2: (1, 1, 0, 0, 5)}
    write(land([]), 2)
    assert now() == {1: (3, 0, 1, 1, 20), 2: (1, 1, 0, 0, 5)}
