import glob
import hashlib
import os
import random
import re
import uuid

import duckdb
import pytest

from pegtrail.llm import warc

SCHEMA = "payload string, page_id long, url string, html string, same int, last long, record_type string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([("x", i, u, h, 1, 2, "y", "z") for i, u, h in rows], SCHEMA)


def plain(rows):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(last.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = data in last and i != last[data]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[data] if again else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pages(n=40, seed=1):
    rng = random.Random(seed)
    hot = "<p>" + "same " * 300
    rows = [(k, f"http://h/{k}\r\n?q=ä b", rng.choice([hot, hot, "short", "é" * 499 + "xx", "é" * 499 + "x", f"<b>{rng.random()}</b>" * rng.randint(1, 200), "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 60, ""])) for k in range(n)]
    return [*rows, (None, None, hot), (None, "", None), (n, None, None), *rows[:4], (-5, "u", hot)]


def archive(rows, compress=True):
    """The records of an archive's rows, each by itself."""
    each = [warc.record(f"urn:page:{i}", u, (h or "").encode()) for i, u, h in rows]
    return [warc.members(x) for x in each] if compress else each


def test_whole_table_and_sql(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet")
    got = result(warc.round_trip(table))
    assert got == plain([tuple(r) for r in table.select("page_id", "url", "html").collect()])
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert sorted(con.execute(warc.ORACLE).fetchall(), key=repr) == got


def test_hard_rows(spark):
    rows = pages()
    assert result(warc.round_trip(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_archives_hold_payloads_and_no_gap(spark, tmp_path, compress):
    rows = pages(20)
    warc.write_archives(warc.record_types(frame(spark, rows)), f"{tmp_path}/a", compress=compress, rows=7)
    found = warc.salvage(spark, f"{tmp_path}/a").collect()
    assert len(glob.glob(f"{tmp_path}/a/part-*")) > 3 and {r["kind"] for r in found} == {"record"}
    want = sorted(((h or "").encode() for _, _, h in rows), key=lambda x: hashlib.sha1(x).hexdigest())
    assert sorted(r["payload_digest"] for r in found) == [hashlib.sha1(x).hexdigest() for x in want]
    assert all(bytes(r["payload"]) in want for r in found if r["record_type"] == "response")


def test_long_record_is_several_members(spark, tmp_path):
    rows = [(1, "u", "x" * 17_000_000 + "\n" * 17), (2, "u", "short"), (3, "u", "x" * 17_000_000 + "\n" * 17)]
    warc.write_archives(warc.record_types(frame(spark, rows).coalesce(1)), f"{tmp_path}/a")
    found = warc.salvage(spark, f"{tmp_path}/a").collect()
    assert {r["kind"] for r in found} == {"record"} and sorted(r["payload_bytes"] or 0 for r in found) == [0, 5, 17_000_017]
    assert result(warc.round_trip(frame(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []


def covers(found, data):
    at = 0
    for r in found:
        assert r["offset"] == at or r["kind"] == "record" and r["offset"] + r["length"] == at
        at = r["offset"] + r["length"]
    assert at == len(data)


@pytest.mark.parametrize("compress", [True, False])
def test_broken_record_is_a_gap_and_later_ones_are_read(compress):
    each = archive([(k, "u", f"page {k} " * 50) for k in range(9)], compress)
    for what in ("flip", "cut", "remove", "insert", "truncate", "magic"):
        broken = list(each)
        x = broken[4]
        broken[4] = {"flip": x[:-60] + bytes([x[-60] ^ 1]) + x[-59:], "cut": x[: len(x) // 2], "remove": x[:50] + x[60:], "insert": b"garbage" + x, "truncate": b"", "magic": b"\0" + x[1:]}[what]
        data = b"".join(broken)
        found = list(warc.scan(data))
        covers(found, data)
        read = [r["record_id"] for r in found if r["kind"] == "record"]
        lost = set() if what == "insert" else {4}
        assert read == [f"urn:page:{k}" for k in range(9) if k not in lost], what
        gaps = [(r["offset"], r["length"]) for r in found if r["kind"] == "gap"]
        begin = sum(map(len, each[:4]))
        assert gaps == ([] if what == "truncate" else [(begin, 7 if what == "insert" else len(broken[4]))]), what


def test_last_record_cut_short_is_a_gap():
    each = archive([(k, "u", "text " * 100) for k in range(3)])
    data = b"".join(each)[:-5]
    found = list(warc.scan(data))
    covers(found, data)
    assert [r["kind"] for r in found] == ["record", "record", "gap"] and found[-1]["reason"] == "cut short"


def test_checks():
    good = warc.record("urn:page:1", "u", b"payload")
    for bad, reason in [
        (good.replace(b"payload", b"Payload"), "block digest"), (good.replace(b"WARC-Date", b"WARC-Data"), "no warc-date"), (good.replace(b"WARC-Type: ", b"WARC Type: "), "malformed field"),
        (good[:-1], "cut short"), (good[:-4] + b"\n\n\n\n", "block without two line ends"), (re.sub(rb"Length: [0-9]+(\r\n\r\nHTTP)", rb"Length: x\1", good), "malformed content-length"), (good.replace(b"WARC/1.1", b"WARC/2.0"), "no version line"),
    ]:
        assert [(r["kind"], r["reason"]) for r in warc.scan(bad)] == [("gap", reason)]
    assert [r["kind"] for r in warc.scan(good.replace(b"WARC/1.1", b"WARC/1.0"))] == ["record"]
    assert list(warc.scan(b"")) == []


def test_random_damage_never_costs_more_than_what_it_touches():
    rng = random.Random(9)
    for trial in range(60):
        each = archive([(k, "u", str(uuid.UUID(int=rng.getrandbits(128))) * rng.randint(1, 80)) for k in range(12)], trial % 2 == 0)
        data = bytearray(b"".join(each))
        hit = set()
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hit.add(next(k for k in range(12) if at < sum(map(len, each[: k + 1]))))
        found = list(warc.scan(bytes(data)))
        covers(found, data)
        assert {f"urn:page:{k}" for k in range(12) if k not in hit} <= {r["record_id"] for r in found if r["kind"] == "record"}
