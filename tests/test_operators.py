import pytest
from pyspark.sql import functions as F

from pegtrail.operators import competitions as C
from pegtrail.operators import classify, graph, joins, merge, rollups, spine
from pegtrail.sources import readers, validation
from pegtrail.streaming import streams


def test_quantiles_and_bins(spark):
    comp = spark.createDataFrame([(-5,), (12,), (None,)], "delta_s long")
    s = C.delta_stats(comp, 10).first()
    assert (s["median"], s["usable"], s["unavailable"], s["share_within"]) == (3.5, 2, 1, 0.5)
    ties = spark.createDataFrame([(-15,), (15,), (-14,), (900,), (-2000,)], "delta_s long")
    bins = {r["bin"]: r["n"] for r in C.delta_histogram(ties, 600, 30).collect()}
    assert bins[-1] == 1 and bins[1] == 1 and bins[0] == 1 and bins[21] == 1 and bins[-21] == 1 and len(bins) == 43 and sum(bins.values()) == 5
    assert C.step_width(600) == 15 and 2 * 600 / C.step_width(600) <= C.GOAL_BINS


def test_cycles_and_forks(spark):
    rows = [("a", "x", 1), ("b", "a", 2), ("c", "b", 3), ("d", "b", 3), ("p", "r", 5), ("q", "p", 6), ("r", "q", 7), ("s", "r", 8), ("z", "none", 9)]
    df = spark.createDataFrame(rows, "hash string, prev_hash string, k long")
    roots = {r["hash"]: (r["root"], r["steps"]) for r in graph.roots(df).collect()}
    assert roots["a"] == ("a", 0) and roots["d"] == ("a", 2) and roots["z"] == ("z", 0)
    assert roots["p"] == roots["q"] == roots["r"] == ("p", -1) and roots["s"] == ("p", -1)
    b = {r["root"]: r for r in graph.branch_components(df, "k").collect()}
    assert b["a"]["depth"] == 4 and list(b["a"]["tips"]) == ["c", "d"] and list(b["p"]["members"]) == ["p", "q", "r", "s"] and "z" not in b


def test_identity_dispositions(spark):
    schema = "event_id long, source_id long, child_height long, child_hash string, parent_hash string"
    old = spark.createDataFrame([(1, 1, 5, "h1", "p"), (2, 1, 6, None, "p"), (3, 1, 7, None, "p"), (4, 1, 7, None, "p"), (5, 1, 8, "h8", "p")], schema)
    new = spark.createDataFrame([(10, 1, 5, "h1", "p"), (11, 1, 5, "h1", "other"), (12, 1, 6, "h6", "p"), (13, 1, 7, "h7", "p"), (14, 1, 8, None, "p"), (15, 1, 6, None, "p"), (16, 1, 99, None, "p"), (17, 2, 5, "h1", "p")], schema)
    got = {r["event_id"]: (r["disposition"], r["match_id"]) for r in merge.merge_events(old, new).collect()}
    assert got == {10: ("updated", 1), 11: ("contradictory", 1), 12: ("promoted", 2), 13: ("ambiguous", 3), 14: ("satisfied", 5), 15: ("updated", 2), 16: ("inserted", None), 17: ("inserted", None)}


def test_spine_over_segments(spark, monkeypatch):
    monkeypatch.setattr(spine, "SEGMENT", 4)
    rows = [(f"h{i}", f"h{i - 1}", i, "canonical") for i in range(20) if i != 9]
    b = spark.createDataFrame(rows, "hash string, prev_hash string, height long, kind string")
    isle = {r["height"]: r["island"] for r in spine.islands(b).collect()}
    assert all(isle[h] == (0 if h < 9 else 10) for h in isle)
    visible = b.where("height in (1, 8, 11, 18)").select("height")
    assert {r["height"]: (r["from_height"], r["hidden"]) for r in spine.hidden_edges(visible, b).collect()} == {8: (1, 6), 18: (11, 6)}
    assert spine.sparse_tip(b, 9).first()["tip"] == 18 or spine.sparse_tip(b, 9).first()["tip"] == 19
    assert spine.verify_tip_window(b, "h19", 10).first()["verified"] and not spine.verify_tip_window(b, "h19", 11).first()["verified"]


def test_tags(spark):
    df = spark.createDataFrame([(1, "xx antpool and ant"), (2, "nothing"), (3, None), (4, "bb aa")], "row_id long, text string")
    tags = ["ant", "antpool", "aa", "bb"]
    slow = {r["row_id"]: r["tag"] for r in joins.match_tags(df, spark.createDataFrame([(t,) for t in tags], "tag string")).collect()}
    fast = {r["row_id"]: r["tag"] for r in joins.match_tags_fast(df, tags).collect()}
    assert slow == fast == {1: "antpool", 2: None, 3: None, 4: "aa"}


def test_publication(spark, tmp_path):
    columns = readers.PUBLICATION_COLUMNS
    header = "01000000" + "00" * 32 + "3ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a" + "29ab5f49" + "ffff001d" + "1dac2b7c"
    fine = {"chain": "namecoin", "source_row_number": "1", "btc_header_hex": header, "btc_header_hash": "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f", "btc_prev_hash": "0" * 64, "btc_time": "1231006505", "classification": "canonical"}
    rows = [fine, fine | {"source_row_number": "0"}, fine | {"btc_header_hash": "1" * 64}, fine | {"btc_time": "5"}, fine | {"btc_header_hex": "zz"}, fine | {"classification": ""}]
    path = tmp_path / "namecoin.csv"
    path.write_text("\n".join([",".join(columns), *[",".join(r.get(c, "") for c in columns) for r in rows]]) + "\n")
    got = [r["skip_reason"] for r in validation.validate_rows(readers.read_publication(spark, str(path), "namecoin")).collect()]
    assert got == [None, "row_number", "hash_mismatch", "time_mismatch", "header_hex", "classification"]
    import hashlib
    import json

    data = path.read_bytes()
    manifest = {"total_event_rows": 6, "artifacts": [{"chain": "namecoin", "csv_path": "x/namecoin.csv", "role": "event", "row_count": 6, "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "counts": {"canonical": 6}}]}
    (tmp_path / "m").mkdir()
    where = tmp_path / "m" / "manifest.json"
    where.write_text(json.dumps(manifest))
    m = readers.read_manifest(spark, str(where))
    assert readers.preflight(spark, m, str(path)).count() == 0
    assert [r["problem"] for r in readers.preflight(spark, m.withColumn("row_count", F.lit(7)), str(path)).collect()] == ["rows"]


def test_known_stales(spark):
    raw = spark.createDataFrame([("A" * 64, "5"), ("b" * 64, None), ("bad", "1"), ("a" * 64, "5"), ("c" * 64, "x")], "hash string, height string")
    known = spark.createDataFrame([("b" * 64,)], "hash string")
    assert [tuple(r) for r in readers.import_known_stales(raw, known, False).collect()] == [("a" * 64, 5)]
    with pytest.raises(Exception, match="malformed"):
        readers.import_known_stales(raw, known, True).collect()


def _landed(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, streams.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}")


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 1, 5) + dt.timedelta(days=n)
    batches = [[(1, day(0), 1, 5, None, "p", 10), (2, day(1), 1, 6, "x", "p", 11)], [(3, day(8), 1, 5, "h", "p", 20), (2, day(1), 1, 6, "x", "p", 11)], [(4, day(9), 1, 6, "y", "p", 30), (5, day(40), 2, 1, None, "q", 1)]]
    path = str(tmp_path / "landed")
    _landed(spark, path, batches)
    source = lambda: streams.capture_stream(spark, path, files=1)
    _run(streams.dedupe_stream(source()), "deduped")
    assert sorted(r["event_id"] for r in spark.table("deduped").collect()) == [1, 2, 3, 4, 5]
    _run(streams.weekly_stream(source()), "weekly", "complete")
    assert sorted((r["week"].day, r["source_id"], r["n"]) for r in spark.table("weekly").collect()) == [(5, 1, 3), (9, 2, 1), (12, 1, 2)]
    _run(streams.supersede_stream(source()), "superseded")
    assert {(r["child_height"], r["child_hash"]) for r in spark.table("superseded").collect()} >= {(5, "h"), (6, "y")}
    _run(streams.identity_stream(source()), "identities")
    got = {r["event_id"]: r["disposition"] for r in spark.table("identities").collect()}
    assert got[1] == "inserted" and got[3] == "promoted" and got[4] == "contradictory" and got[5] == "inserted"
    _run(streams.hold_stream(source()), "holds")
    assert {(r["event_id"], r["outcome"]) for r in spark.table("holds").collect()} >= {(1, "resolved")}
    table = str(tmp_path / "health")
    q = source().writeStream.foreachBatch(streams.health_batch(table)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["source_id"], r["events"], r["last_seen"]) for r in streams.health_of(spark, table).collect()} == {(1, 5, 30), (2, 1, 1)}


def test_spine_stream(spark, tmp_path):
    write = streams.spine_batch(str(tmp_path / "spine"))
    rows = lambda *h: spark.createDataFrame([(f"h{i}", f"h{i - 1}", i) for i in h], "hash string, prev_hash string, height long")
    write(rows(0, 1, 2), 0)
    write(rows(3, 4), 1)
    assert spark.read.parquet(str(tmp_path / "spine")).count() == 5
    with pytest.raises(ValueError, match="conflict"):
        write(spark.createDataFrame([("k5", "other", 5)], "hash string, prev_hash string, height long"), 2)


def test_cascade_and_infer_stale_follow_long_chains(spark):
    n = 60
    chain = [(f"c{i}", f"c{i - 1}", "canonical", i, None, 7) for i in range(1, n)]
    block = spark.createDataFrame(chain + [("s30", "c29", "stale", 30, f"c{n - 1}", 7)], "hash string, prev_hash string, kind string, height long, competitor_hash string, bits long")
    got = {r["hash"]: r["round"] for r in graph.cascade(block.where("hash = 'c1'").select("hash"), block).collect()}
    assert got == {f"c{i}": i - 1 for i in range(1, n)} | {"s30": 29}
    side = [("u1", "s0", "unknown", None, None, 7), *[(f"u{i}", f"u{i - 1}", "unknown", None, None, 8 if i == 55 else 7) for i in range(2, n)]]
    block = spark.createDataFrame([*chain, ("s0", "x", "stale", 0, None, 7), *side], block.schema)
    got = {(r["hash"], r["height"], r["competitor_hash"]) for r in graph.infer_stale(block).collect()}
    assert got == {(f"u{i}", i, f"c{i}") for i in range(1, 55)}


def test_histogram_widths():
    assert C.step_width(10_000_000, 1) == 86400 and C.step_width(600, 30) == 30 and 2 * 2**31 / C.step_width(2**31) + 1 <= C.MOST_BINS


def test_orphan_verdicts_fall_through(spark):
    epochs = spark.createDataFrame([(227808, 1000, 5), (229824, 2000, 6)], "epoch long, start_time long, bits long")
    rows = [("strict", 227932, 1500, 5), ("bits", 227932, 1500, 9), ("other_epoch", 229825, 1500, 6), ("far", 400000, 1500, 5), ("late", None, 9000, 5), ("early", 227932, 500, 5), ("low", 100, 1500, 5), ("foreign", None, 1500, 9)]
    o = spark.createDataFrame(rows, "hash string, height long, time long, bits long")
    got = {r["hash"]: r["verdict"] for r in classify.orphan_verdict(o, epochs, 240_000, 3000).collect()}
    assert got == {"strict": "strict", "bits": "excluded", "other_epoch": "weak", "far": "pending", "late": "pending", "early": "excluded", "low": "weak", "foreign": "excluded"}


def test_no_tip_holds_every_row(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 900)], "hash string, height long")
    tip = spark.createDataFrame([], "tip_height long, tip_time long")
    assert {r["gate"] for r in classify.horizon_gate(rows, tip, 10).collect()} == {"hold"}
    one = spark.createDataFrame([(10, 0)], "tip_height long, tip_time long")
    assert [r["gate"] for r in classify.horizon_gate(rows, one, 10).orderBy("hash").collect()] == ["resolve", "far_future"]


def test_proofs_and_rollups(spark):
    schema = "event_id long, source_id long, parent_hash string, parent_kind string, pow_ok boolean, epoch_ok boolean, discovered_at long, confirmed_at long, revoked_at long, reason string"
    e = spark.createDataFrame([(3, 1, "p", "stale", False, None, 5, 9, None, None), (1, 1, "p", "stale", True, True, 2, 3, 7, "x"), (2, 2, "p", "stale", True, None, 4, 4, 8, "b"), (4, 2, "p", "stale", False, None, 6, 6, 8, "c"), (5, 1, "q", "near", True, None, 1, 1, None, None)], schema)
    source = spark.createDataFrame([(1, "auxpow:a", "auxpow"), (2, "live:t", "live-chaintip")], "source_id long, code string, source_kind string")
    r = rollups.parent_rollup(e, source).collect()
    assert [(x["parent_hash"], x["attestations"], x["sources"], x["chains"], x["live"], x["pow"], x["epoch_ok"]) for x in r] == [("p", 1, 1, 1, False, False, None)]
    got = {x["source_id"]: (x["live"], list(x["ids"]), x["first_seen"], x["confirmed_at"], x["pow"], x["revoked_at"], x["reason"]) for x in rollups.build_proofs(e).collect()}
    assert got == {1: (True, [3], 2, 9, False, None, None), 2: (False, [2, 4], 4, 4, True, 8, "b")}


def test_reduced_trees(spark):
    line = [(1, i, f"c{i:02}", f"c{i - 1:02}", "canonical", i != 5) for i in range(20)]
    nodes = spark.createDataFrame([*line, (1, 12, "x", "c11", "stale", False)], "window_id long, height long, hash string, prev_hash string, kind string, removable boolean")
    left = {r["hash"] for r in spine.reduce_nodes(nodes, 12).collect()}
    assert left == {"c00", "c05", "c12", "x", *(f"c{i}" for i in range(13, 20))}  # the stale node at 12 ends the first run
    assert {r["too_large"] for r in spine.reduce_nodes(nodes, 3).collect()} == {True}


def test_sync_states(spark):
    rows = [("a", "historical", "auxpow", 1, 2, None, 0, 10), ("b", "live", "auxpow", 1, 9, None, 0, 4000), ("c", "live", "auxpow", 1, 9, "x", 0, 10), ("d", "live", "live-chaintip", 1, 9, "x", 0, 4000), ("e", "live", "live-chaintip", -1, 9, None, 0, 10), ("f", "live", "live-chaintip", 9, 9, None, 0, 10), ("g", "live", "other", 9, 9, None, 0, 10)]
    df = spark.createDataFrame(rows, "code string, lifecycle string, source_kind string, cursor long, tip long, error string, updated_at long, now long")
    assert {r["code"]: r["state"] for r in classify.source_sync(df).collect()} == {"a": "historical", "b": "stale", "c": "catching_up", "d": "error", "e": "not_started", "f": "live", "g": "unknown"}


def test_cycles_end_a_cascade(spark):
    block = spark.createDataFrame([("a", "c", None), ("b", "a", None), ("c", "b", None), ("d", "zz", "b")], "hash string, prev_hash string, competitor_hash string")
    assert {r["hash"]: r["round"] for r in graph.cascade(block.where("hash = 'a'").select("hash"), block).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}
