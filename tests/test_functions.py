import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from pegtrail.functions import scalars as S

GENESIS = bytes.fromhex("01000000" + "00" * 32 + "3ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a" + "29ab5f49" + "ffff001d" + "1dac2b7c")
DISPLAY = "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"


def one(spark, value, expression, kind="binary"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def dsha(data):
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def test_genesis(spark):
    h = one(spark, GENESIS, S.decode_header)
    assert (h["version"], h["time"], h["bits"], h["nonce"]) == (1, 1231006505, 0x1D00FFFF, 2083236893)
    assert one(spark, GENESIS, lambda x: S.to_display(S.sha256d(x))) == DISPLAY
    assert bytes(one(spark, DISPLAY, S.to_stored, "string")) == dsha(GENESIS)
    assert one(spark, GENESIS, lambda x: S.pow_valid(S.sha256d(x), F.lit(0x1D00FFFF))) is True
    assert one(spark, GENESIS, lambda x: S.pow_valid(S.sha256d(x), F.lit(0x1B00FFFF))) is False
    assert one(spark, GENESIS[:79], S.decode_header) is None and one(spark, None, S.decode_header) is None


@pytest.mark.parametrize(("bits", "target"), [(0x1D00FFFF, 0xFFFF << 208), (0x03123456, 0x123456), (0x01120000, 0x12), (0x20000001, 1 << 232), (0x04800001, None), (0x00123456, None), (0x1D000000, None), (0x21000001, None)])
def test_targets(spark, bits, target):
    got = one(spark, bits, S.target_hex, "long")
    assert (got and int(got, 16)) == target and (got is None or len(got) == 64)


@pytest.mark.parametrize(("script", "height"), [(b"\x03\x4b\x7a\x03xyz", 0x037A4B), (b"\x01\x05", 5), (b"\x05\x01\x02\x03\x04\x05", None), (b"\x03\x01\x02", None), (b"\x04\xff\xff\xff\x7f", None), (b"", None), (None, None)])
def test_script_heights(spark, script, height):
    assert one(spark, script, S.bip34_height) == height


def test_marker_and_tag(spark):
    root = bytes(range(32))
    script = b"\x03abc" + b"\xfa\xbe\x6d\x6d" + root + struct.pack("<II", 8, 77) + b"/Pool tag/\x00ab\x01 spaced \x02"
    m = one(spark, script, S.aux_marker)
    assert bytes(m["root"]) == root and (m["size"], m["nonce"]) == (8, 77)
    assert one(spark, script[:30], S.aux_marker) is None and one(spark, b"nothing", S.aux_marker) is None
    assert one(spark, b"\x01/Pool tag/\x00ab\x01 spaced \x02", S.coinbase_tag) == "/Pool tag/ spaced"
    assert one(spark, b"\x01ab\x02", S.coinbase_tag) is None
    assert one(spark, " /x y/ ", S.normalize_tag, "string") == "x y" and one(spark, "//", S.normalize_tag, "string") is None


def test_merkle_fold(spark):
    leaf, a, b = dsha(b"leaf"), dsha(b"a"), dsha(b"b")
    want = dsha(b + dsha(leaf + a))
    got = spark.createDataFrame([(leaf, [a, b], 2)], "l binary, br array<binary>, i int").select(S.merkle_fold(F.col("l"), F.col("br"), F.col("i")).alias("r")).first()["r"]
    assert bytes(got) == want


def test_slots(spark):
    def plain(nonce, chain, height):
        r = (nonce * 1103515245 + 12345) % 2**32
        r = ((r + chain) * 1103515245 + 12345) % 2**32
        return r % (1 << height)

    rows = [(n, c, h) for n in (0, 7, 2**32 - 1) for c in (1, 16, 97) for h in (0, 3, 20)]
    got = spark.createDataFrame(rows, "n long, c long, h int").select("n", "c", "h", S.expected_slot(F.col("n"), F.col("c"), F.col("h")).alias("s")).collect()
    assert all(r["s"] == plain(r["n"], r["c"], r["h"]) for r in got)


def test_deltas_and_dates(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a long, b long").select(S.header_time_delta(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert f(10, 25) == -15 and f(2**31, 0) is None and f(2**63 - 1, -(2**63)) is None and f(None, 1) is None
    assert one(spark, 1231006505, S.era_year, "long") == 2009 and one(spark, 5, S.era_year, "long") is None
    assert one(spark, 86401, S.day_start, "long") == 86400 and one(spark, 4033, S.epoch_start, "long") == 4032
    assert one(spark, [1, 2, 9], S.contributing_ids, "array<long>") == [1, 2, 9] and one(spark, [1, 1], S.contributing_ids, "array<long>") is None
