"""Readers, writers and small rules on files and rows made here."""

import json

import pytest
from pyspark.sql import functions as F

from pegtrail.functions import scalars as C
from pegtrail.operators import classify, joins, merge
from pegtrail.sources import readers as R
from pegtrail.sources import validation
from pegtrail.streaming import streams


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content) if isinstance(content, bytes) else path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_epochs(spark, tmp_path):
    doc = {"epoch_interval": 2016, "covered_max_height": 4031, "covered_max_time": 99, "nbits_by_epoch": {"0": "1d00ffff", "2016": "0x1b0404cb"}, "time_by_epoch": {"0": 5}}
    assert rows(R.read_epochs(spark, put(tmp_path / "e.json", doc))) == [(0, 0x1D00FFFF, 5), (2016, 0x1B0404CB, None)]


def test_error_blocks(spark, tmp_path):
    a, b = "AB" * 32, "cd" * 32
    good = put(tmp_path / "a.csv", f"# a list\nheight,hash,rejection_reason\n5,{a},why\n# between\n5,{b},\n")
    assert rows(R.read_error_blocks(spark, good)) == [(5, a.lower(), "why"), (5, b, None)]
    with pytest.raises(Exception, match="listed twice"):
        R.read_error_blocks(spark, put(tmp_path / "b.csv", f"height,hash,rejection_reason\n5,{b},x\n6,{b},y\n")).collect()


def test_pools_and_their_problems(spark, tmp_path):
    pool = lambda slug, tags=(), paid=(): {"slug": slug, "canonical_name": slug.upper(), "coinbase_tags": list(tags), "payout_addresses": list(paid)}
    names, tags, paid = R.read_pools(spark, put(tmp_path / "p.json", {"schema_version": 1, "pools": [pool("a", ["/a/", "/b/"], ["x"]), pool("b")]}))
    assert (rows(names), rows(tags), rows(paid)) == ([("a", "A"), ("b", "B")], [("a", "/a/"), ("a", "/b/")], [("a", "x")])
    assert R.pool_problems(spark, str(tmp_path / "p.json")).isEmpty()
    bad = put(tmp_path / "q.json", {"schema_version": 2, "pools": [pool("a", ["/a/"], ["x"]), pool("a", ["/c/"]), pool("", ["/a/", " "], ["x"])]})
    assert rows(R.pool_problems(spark, bad)) == [("address", "x", "repeated"), ("schema_version", "2", "unsupported"), ("slug", "", "empty"), ("slug", "a", "repeated"), ("tag", " ", "empty"), ("tag", "/a/", "repeated")]
    assert rows(R.pool_problems(spark, put(tmp_path / "r.json", {"schema_version": 1, "pools": []}))) == [("pools", None, "empty")]


def test_identities(spark, tmp_path):
    entries = [{"miner_address": x, "pool_slug": s, "pool_canonical_name": "n"} for x, s in ((" 0xAa ", "p"), ("0xaa", "p"), ("b", "p"), ("B", "q"), ("", "p"), ("c", "r"))]
    got = {(r["identifier"], r["problem"]) for r in R.read_identities(spark, put(tmp_path / "i.json", {"entries": entries}), "miner_address").collect()}
    assert got == {("0xAa", "repeated"), ("0xaa", "repeated"), ("b", "conflict"), ("B", "conflict"), ("", "empty"), ("c", None)}


def test_hathor_archive_order_and_hex(spark, tmp_path):
    line = lambda h, x="ab" * 32, aux="00": f"{h},{x},1,00,{aux}"
    text = "\n".join(["hathor_height,hathor_block_hash,hathor_timestamp,funds_graph_hex,aux_pow_hex", line(5), line(7), line(7), line(6), line(9, x="zz"), line(10, aux="0")])
    got = R.read_hathor_archive(spark, put(tmp_path / "h.csv", text + "\n"))
    assert [(r["hathor_height"], r["problem"]) for r in got.collect()] == [(5, None), (7, None), (7, "order"), (6, "order"), (9, "hex"), (10, "hex")]
    with pytest.raises(Exception, match="(?i)header"):
        R.read_hathor_archive(spark, put(tmp_path / "w.csv", "height,hash,time,graph,aux\n" + line(5))).collect()


def test_rsk_and_elastos_documents(spark, tmp_path):
    block = {"hash": "0x1", "number": "0x2", "miner": "0x3"}
    path = put(tmp_path / "r.json", block | {"uncles": [block | {"hash": "0xu"}, block | {"hash": "0xv"}]})
    assert [(r["hash"], r["uncle_index"], r["number"]) for r in R.read_rsk_blocks(spark, path).orderBy("hash").collect()] == [("0x1", None, "0x2"), ("0xu", 0, "0x2"), ("0xv", 1, "0x2")]
    doc = {"hash": "h", "height": 7, "bits": 4294967295, "auxpow": None, "tx": [{"payload": {"coinbasedata": "c"}, "vout": [{"value": "1", "n": 0, "address": "E"}]}], "other": 1}
    (r,) = R.read_elastos_blocks(spark, put(tmp_path / "e.json", doc)).collect()
    assert (r["height"], r["bits"], r["tx"][0]["vout"][0]["address"], r["tx"][0]["payload"]["coinbasedata"], r["auxpow"]) == (7, 4294967295, "E", "c", None)


def test_blobs_as_hex_and_raw(spark, tmp_path):
    put(tmp_path / "b" / "a.hex", "00FFab\n")
    put(tmp_path / "b" / "b.hex", "xyz")
    put(tmp_path / "b" / "c.bin", b"\x00\xff\x01\xfe")
    got = {r["file"]: r["blob"] and bytes(r["blob"]) for r in R.read_blobs(spark, str(tmp_path / "b")).collect()}
    assert got == {"a.hex": b"\x00\xff\xab", "b.hex": None, "c.bin": None}
    got = {r["file"]: bytes(r["blob"]) for r in R.read_blobs(spark, str(tmp_path / "b"), raw=True).collect()}
    assert got == {"a.hex": b"00FFab\n", "b.hex": b"xyz", "c.bin": b"\x00\xff\x01\xfe"}


def test_headers_snapshots_and_payloads(spark, tmp_path):
    spark.createDataFrame([("h", "p", 5, True, 7, 9, b"x")], "hash string, prev_hash string, height long, is_active boolean, bits long, time long, coinbase_script binary").write.parquet(str(tmp_path / "c"))
    assert R.read_core_headers(spark, str(tmp_path / "c")).collect()[0]["height"] == 5
    table = str(tmp_path / "t")
    frame = lambda *x: spark.createDataFrame(list(x), "v int, chain string")
    R.write_snapshot(frame((1, "a"), (2, "b")), table, ["chain"])
    R.write_snapshot(frame((3, "b")), table, ["chain"])
    assert rows(spark.read.parquet(table).select("v", "chain")) == [(1, "a"), (3, "b")]
    R.write_payload(frame((1, "a")), str(tmp_path / "p"))
    assert rows(spark.read.json(str(tmp_path / "p")).select("v", "chain")) == [(1, "a")]
    assert json.loads(R.to_payload(frame((1, None))).collect()[0]["payload"]) == {"v": 1}


def test_child_bundles(spark):
    header = bytes(68) + (77).to_bytes(4, "little") + (88).to_bytes(4, "little") + bytes(4)
    own = spark.createDataFrame([(header,)], "h binary").select(F.lower(F.hex(C.sha256d(F.col("h"))))).first()[0]
    cases = [
        (header.hex(), None, 77, 88, "x", None), (header.hex(), own.upper(), None, None, "x", None), (header[:79].hex(), None, 77, 88, "x", "length"), (header.hex(), "ab" * 32, 77, 88, "x", "hash"), (header.hex(), own, 78, 88, "x", "time"), (header.hex(), own, 77, 89, "x", "bits"), (header.hex(), own, 77, 89, "xaya", None), (None, None, 1, 1, "x", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, child_header_hex string, child_block_hash string, child_block_time long, child_nbits long, chain string, want string")
    got = validation.validate_child(df).orderBy("i").collect()
    assert [r["child_problem"] for r in got] == [r["want"] for r in got] and got[0]["child_block_hash"] == own and got[7]["child_block_hash"] is None


def test_small_rules(spark):
    df = spark.createDataFrame([("EReserved", 1), ("Eother", 2)], "address string, v int")
    assert [r["v"] for r in validation.exclude_reserved(df, ["ERes"]).collect()] == [2]
    bad = spark.createDataFrame([("unknown", True), ("stale", False)], "kind string, pow_ok boolean")
    assert validation.assert_unknown_pow(bad).count() == 2
    with pytest.raises(Exception, match="misses its target"):
        validation.assert_unknown_pow(bad.withColumn("pow_ok", F.lit(False))).collect()
    one = spark.createDataFrame([(b"\x01\x02", "0xAbC", "AB" * 32, 0x20240100, 1)], "b binary, a string, h string, v long, w long")
    got = one.select(
        C.child_display(F.lit("auxpow:rsk"), F.col("b")), C.child_display(F.lit("auxpow:namecoin"), F.col("b")), C.normalize_rsk(F.col("a")), C.normalize_hash(F.col("h")), C.normalize_hash(F.col("a")), C.is_merge_mined(F.col("v")), C.is_merge_mined(F.col("w")), C.is_merge_mined(F.col("v"), 0x20240100), C.is_merge_mined(F.lit(0x100), 0x20240100),
        C.pow_child_valid(F.lit(None).cast("binary"), F.lit(1)), C.pow_child_valid(F.unhex(F.lit("00" * 32)), F.lit(0x1D00FFFF)), C.pow_child_valid(F.unhex(F.lit("ff" * 32)), F.lit(0x1D00FFFF)),
    ).first()
    assert tuple(got) == ("0102", "0201", "abc", "ab" * 32, None, True, False, True, False, None, True, False)


def test_lookups_and_merges(spark):
    paid = joins.match_payout(spark.createDataFrame([(1, ["z", "b", "a"]), (2, ["z"]), (3, None)], "row_id int, addresses array<string>"), spark.createDataFrame([("a", 1), ("b", 2)], "address string, pool int"))
    assert rows(paid) == [(1, 2)]
    known = spark.createDataFrame([("n", "x", 7)], "namespace string, identifier string, pool_id int")
    assert rows(joins.attribute_child(spark.createDataFrame([("n", "x", 1), ("m", "x", 2)], "namespace string, identifier string, e int"), known).select("e", "pool_id")) == [(1, 7), (2, None)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(merge.merge_provenance(old, spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string"), ["k"], "v")) == [(1, "a", "unchanged"), (2, "c", "contradictory"), (3, "d", "inserted")]
    pools = lambda *x: spark.createDataFrame(list(x), "slug string, name string")
    assert rows(merge.merge_pools(pools(("a", "A"), ("b", "B")), pools(("b", "B2"), ("c", "C")))) == [("a", "A"), ("b", "B2"), ("c", "C")]
    ids = spark.createDataFrame([("p", "P", 3), ("p", "P", 1), ("q", "Q", 2), ("q", "Z", 5)], "slug string, name string, pos int")
    assert rows(merge.pool_definitions(ids)) == [("p", "P", 1, False), ("q", "Q", 2, True)]
    policy = spark.createDataFrame([(p, o, n, a, b) for p in ("fill_null", "overwrite", "promote") for o, n, a, b in ((None, 1, 0, 1), (1, 2, 1, 2), (1, 2, 2, 1), (1, None, 1, 2), (1, 1, 1, 2))], "policy string, o int, n int, ra int, rb int")
    got = [r[0] for r in policy.select(classify.should_write(*map(F.col, ("policy", "o", "n", "ra", "rb")))).collect()]
    assert got == [True, False, False, False, False, True, True, True, False, False, True, True, False, False, False]
    batch = spark.createDataFrame([(1, 5), (1, 9), (2, None)], "source_id int, child_height int")
    assert rows(streams.progress(batch)) == [(1, 9), (2, None)]
