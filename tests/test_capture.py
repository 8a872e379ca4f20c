"""Documents and proofs built byte by byte here, read by the capture jobs."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from pegtrail.functions import scalars
from pegtrail.operators import capture as K
from pegtrail.operators import classify, payloads

MAGIC = bytes.fromhex("fabe6d6d")
EASY = 0x207FFFFF


def sha(x):
    return hashlib.sha256(x).digest()


def dsha(x):
    return sha(sha(x))


def fold(leaf, branch, index):
    for k, other in enumerate(branch):
        leaf = dsha(other + leaf) if index >> k & 1 else dsha(leaf + other)
    return leaf


def slot(nonce, chain, depth):
    return ((nonce * 1103515245 + 12345 + chain) * 1103515245 + 12345) % 2**32 % 2**depth


def tx(script, outputs=((50, b"\x51"),)):
    out = b"".join(struct.pack("<Q", v) + bytes([len(s)]) + s for v, s in outputs)
    return struct.pack("<I", 1) + b"\x01" + bytes(32) + b"\xff" * 4 + bytes([len(script)]) + script + b"\xff" * 4 + bytes([len(outputs)]) + out + bytes(4)


def proof(child, chain=1224, depth=3, nonce=77, bits=EASY, height=500_000, good=True, outputs=((50, b"\x51"),)):
    """A whole proof whose parent header's hash meets (or misses) the target of easy bits, and that hash."""
    branch, above = [dsha(bytes([i])) for i in range(depth)], [dsha(b"x"), dsha(b"y")]
    index = slot(nonce, chain, depth)
    root = fold(child[::-1], branch, index)[::-1]
    t = tx(b"\x03" + height.to_bytes(3, "little") + MAGIC + root + struct.pack("<II", 1 << depth, nonce), outputs)
    for n in range(1000):
        header = bytes(36) + fold(dsha(t), above, 0) + struct.pack("<III", 9, bits, n)
        if bits != EASY or (dsha(header)[31] < 0x7F) == good:
            break
    side = lambda hashes, i: bytes([len(hashes)]) + b"".join(hashes) + struct.pack("<i", i)
    return t + bytes(32) + side(above, 0) + side(branch, index) + header, dsha(header)


def elastos(height=1000, bits=EASY, auxpow=True, **more):
    fields = {"version": 0, "previousblockhash": sha(b"p").hex(), "merkleroot": sha(b"m").hex(), "time": 77, "bits": bits, "nonce": 5, "height": height}
    head = struct.pack("<I", 0) + bytes.fromhex(fields["previousblockhash"])[::-1] + bytes.fromhex(fields["merkleroot"])[::-1] + struct.pack("<III", 77, bits, 5)
    child = dsha(head + struct.pack("<I", height))
    blob, parent = proof(child, **more)
    return fields | {"hash": child[::-1].hex(), "auxpow": blob.hex() if auxpow else None, "requested": height}, child, parent


def test_elastos_gates_in_order(spark):
    low = 0x03000001  # a target that nothing meets
    cases = [
        ("written", elastos()[0]), ("malformed", elastos()[0] | {"requested": 999}), ("malformed", elastos()[0] | {"nonce": 6}), ("malformed", elastos()[0] | {"merkleroot": "x"}), ("non_auxpow", elastos(auxpow=False)[0]), ("non_auxpow", elastos()[0] | {"auxpow": "  "}),
        ("malformed", elastos()[0] | {"auxpow": elastos()[0]["auxpow"] + "00"}), ("malformed", elastos()[0] | {"auxpow": "zz"}), ("non_auxpow", elastos(height=1, depth=0)[0] | {"auxpow": proof(b"c" * 32, bits=0)[0].hex()}), ("non_auxpow", elastos(outputs=())[0]),
        ("malformed", elastos(chain=1)[0]), ("near", elastos(good=False)[0]), ("child_target", elastos(bits=low)[0]), ("non_btc", elastos(height=2)[0] | {"auxpow": proof(elastos(height=2)[1], height=2016 * 3)[0].hex()}), ("hold", elastos(height=3)[0] | {"auxpow": proof(elastos(height=3)[1], height=1_500_000)[0].hex()}),
    ]
    names = "version long, previousblockhash string, merkleroot string, time long, bits long, nonce long, height long, hash string, auxpow string, requested long, minerinfo string, tx array<struct<payload:struct<coinbasedata:string>,vout:array<struct<value:string,n:int,address:string>>>>, at int"
    pay = [({"coinbasedata": "tagged"}, [("1", 0, "Ea"), ("2", 1, "Eb"), ("3", 2, "Ea"), ("4", 3, None)])]
    rows = [(*[d[c.split()[0]] for c in names.split(", ")[:10]], None, pay, i) for i, (_, d) in enumerate(cases)]
    epochs = spark.createDataFrame([(2016 * i, EASY if i > 10 else 1) for i in range(300)], "epoch long, bits long")
    docs = spark.createDataFrame(rows, names)
    got = {r["hash"]: r for r in K.capture_elastos(docs.where("at = 0"), epochs).collect()}
    (row,) = got.values()
    assert (row["outcome"], row["child_height"], row["script_height"], row["parent_bits"], row["addresses"], row["minerinfo"], row["commitment"]) == ("written", 1000, 500_000, EASY, ["Ea", "Eb"], "tagged", None)
    assert bytes(row["child_hash"]) == elastos()[1] and bytes(row["parent_hash"]) == elastos()[2]
    counted = [r["outcome"] for r in K.capture_elastos(docs.withColumn("minerinfo", F.col("at").cast("string")).withColumn("hash", F.col("hash")), epochs).withColumn("k", F.col("hash")).collect()]
    assert sorted(counted) == sorted(want for want, _ in cases)


def test_commitments_equal_the_byte_reader(spark):
    from pegtrail.functions.proofs import commitment_problem, read_proof

    rng, rows = random.Random(4), []
    child = dsha(b"child")
    for depth in (0, 1, 5):
        whole = proof(child, chain=3, depth=depth)[0]
        rows.append((whole, child, 3))
        for _ in range(25):  # a flipped bit anywhere
            data = bytearray(whole)
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
            rows.append((bytes(data), child, 3))
    rows += [(None, child, 3), (b"", child, 3), (whole, dsha(b"other"), 3), (whole, child, 4), (whole + b"\0", child, 3)]
    got = K.verify_commitments(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, proof binary, child_hash binary, chain_id int")).orderBy("i").collect()
    want = [commitment_problem(read_proof(p) if p else None, c, n) for p, c, n in rows]
    assert [r["reason"] for r in got] == want and want[0] is None and len(set(want)) >= 4


def hathor(i, size, cut, steps, magic=b"Hath", head=7):
    rng = random.Random(i)
    prefix, path = rng.randbytes(size), [rng.randbytes(32) for _ in range(steps)]
    first, last, a, b = rng.randbytes(36), rng.randbytes(12), rng.randbytes(head) + magic, rng.randbytes(9)
    coinbase = a + dsha(sha(prefix[:cut]) + sha(prefix[cut:]))[::-1] + b
    header = first + fold(dsha(coinbase), [x[::-1] for x in path], 0) + last
    size_of = lambda n: bytes([n]) if n < 253 else b"\xfd" + struct.pack("<H", n)
    return prefix, first + size_of(len(a)) + a + size_of(len(b)) + b + size_of(steps) + b"".join(path) + last, dsha(header)[::-1].hex(), header, coinbase


def test_hathor_split_is_found(spark):
    rows, want = [], {}

    def add(outcome, made, raw=None, funds=None, aux=None, hash_=None, cut=None):
        prefix, own, block, header, coinbase = made
        i = len(rows)
        rows.append((i, hash_ or block, prefix + own + b"tail" if raw is None else raw or None, funds, own if aux is None else aux))
        want[i] = (outcome, cut, header if outcome == "ok" else None, coinbase if outcome == "ok" else None)

    for i, (size, cut, steps) in enumerate([(3, 2, 0), (80, 35, 4), (200, 199, 1), (60, 2, 12)]):
        add("ok", hathor(i, size, cut, steps), cut=cut)
    add("ok", hathor(9, 50, 20, 2, head=300), cut=20)
    one = hathor(10, 50, 20, 2)
    add("ok", one, raw=b"", funds=one[0], cut=20)
    add("no_marker", hathor(11, 50, 20, 2, magic=b"hath"))
    add("no_split", one, hash_=sha(b"?").hex())
    add("no_split", hathor(12, 2, 2, 1))
    add("malformed", one, aux=one[1] + b"\0")
    add("malformed", one, aux=one[1][:-1])
    add("malformed", one, aux=one[1][:30])
    add("malformed", one, aux=one[1][:36] + b"\xff" * 9 + one[1][37:])
    add("too_large", one, aux=b"\0" * (16 * 1024 + 1))
    add("no_prefix", one, raw=one[0])
    add("prefix_size", one, raw=one[1])
    df = spark.createDataFrame(rows, "block_id int, block_hash string, raw binary, funds_graph binary, aux_pow binary")
    as_bytes = lambda x: None if x is None else bytes(x)
    assert {r["block_id"]: (r["outcome"], r["split"], as_bytes(r["header"]), as_bytes(r["coinbase"])) for r in K.reconstruct_hathor(df).collect()} == want


def root_of(ids):
    while len(ids) > 1:
        ids = [dsha(ids[i] + ids[min(i + 1, len(ids) - 1)]) for i in range(0, len(ids), 2)]
    return ids[0]


def test_child_coinbases_of_blocks_of_any_size(spark):
    blocks, proofs, want = [], [], {}
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 33):
        ids = [dsha(bytes([n, k])) for k in range(n)]
        header = bytes(36) + root_of(ids) + bytes(12)
        blocks.append((header, ids, True, b"\x02\x10\x27", b"o"))
        proofs.append((n, dsha(header), None))
        want[n] = ("attached", 10_000, ids[0])
    bad = (bytes(36) + sha(b"r") + bytes(12), ids, True, b"\x01\x05", b"")
    late = (bytes(36) + root_of(ids[:2]) + bytes(11) + b"\1", ids[:2], False, b"\x01\x05", b"")
    blocks += [bad, late, blocks[0], (blocks[1][0], ids, True, b"", b"")]  # landed again, once with other transactions
    proofs += [(100, dsha(bad[0]), 6), (101, dsha(late[0]), None), (102, dsha(b"none"), None), (103, None, 9)]
    want |= {100: ("merkle_root", 6, None), 101: ("not_coinbase", None, None), 102: ("no_block", None, None), 103: ("no_block", 9, None)}
    b = spark.createDataFrame(blocks, "header binary, txids array<binary>, first_is_coinbase boolean, coinbase_script binary, coinbase_outputs binary")
    got = K.attach_child_coinbase(spark.createDataFrame(proofs, "proof_id int, child_hash binary, child_height long"), b).collect()
    assert {r["proof_id"]: (r["outcome"], r["child_height"], r["child_coinbase_txid"] and bytes(r["child_coinbase_txid"])) for r in got} == want
    assert spark.range(1).select(K.merkle_root(F.array().cast("array<binary>")).alias("x")).collect()[0]["x"] is None


def test_rsk_quantities_and_widths(spark):
    good = {"hash": "0x" + "ab" * 32, "number": "0xb1fa8", "timestamp": "0x6553f100", "miner": "0x" + "AB" * 20, "bitcoinMergedMiningHeader": "0x" + bytes(68).hex() + "0900000000000000" + "00000000", "bitcoinMergedMiningCoinbaseTransaction": None, "bitcoinMergedMiningMerkleProof": "0x12", "hashForMergedMining": "0x" + "cd" * 32, "uncle_index": None}
    changes = [
        ("ready", {}), ("ready", {"number": "0x0"}), ("ready", {"number": "0x7fffffff"}), ("malformed", {"number": "0x80000000"}), ("malformed", {"number": "0x"}), ("ready", {"timestamp": "0x7fffffffffffffff"}), ("malformed", {"timestamp": "0x8000000000000000"}), ("ready", {"timestamp": "0x00000000000000000001"}),
        ("pre_rskip92", {"bitcoinMergedMiningHeader": None}), ("pre_rskip92", {"bitcoinMergedMiningHeader": "0x"}), ("pre_rskip92", {"bitcoinMergedMiningHeader": "0xab"}), ("malformed", {"bitcoinMergedMiningHeader": "0xabc"}), ("malformed", {"miner": "0x" + "ab" * 19}), ("malformed", {"hashForMergedMining": None}), ("malformed", {"bitcoinMergedMiningMerkleProof": "0xabc"}), ("ready", {"bitcoinMergedMiningMerkleProof": None}),
    ]
    rows = [(i, *(good | change).values()) for i, (_, change) in enumerate(changes)]
    schema = "i int, " + ", ".join(f"{c} string" for c in list(good)[:-1]) + ", uncle_index int"
    known = spark.createDataFrame([("ab" * 20, 7, 3)], "identifier string, identity_id long, pool_id long")
    frame = spark.createDataFrame(rows, schema)
    got = [K.capture_rsk(frame.where(F.col("i") == i), known).collect()[0] for i in (0, 7)]
    assert (got[0]["child_height"], got[0]["child_time"], got[0]["parent_time"], got[0]["pool_id"], got[0]["is_uncle"], bytes(got[0]["child_hash"])) == (729_000, 0x6553F100, 9, 3, False, b"\xab" * 32) and got[1]["child_time"] == 1
    assert sorted(r["outcome"] for r in K.capture_rsk(frame, known).collect()) == sorted(w for w, _ in changes)


def test_height_push_of_a_long_script(spark):
    rows = [(b"\xfe" + b"\xff" * 300,), (b"\x03\x01\x02\x03" + b"x" * 90,), (b"\x09" + b"\xff" * 9,), (b"",)]
    assert [r[0] for r in spark.createDataFrame(rows, "s binary").select(scalars.bip34_height(F.col("s"))).collect()] == [None, 197_121, None, None]


def test_node_decides_over_a_published_class(spark):
    schema = "published string, selection string, orphan_verdict string, verdict string, core_attested boolean, absent boolean, catalogued boolean"
    rows = [("canonical", None, None, "stale", True, False, False), ("canonical", None, None, "stale", False, False, False), ("stale_descendant", None, None, "stale", None, None, None), ("unknown", None, "weak", "unknown", None, True, None), ("unknown", None, "weak", "unknown", None, False, None), ("unknown", None, "excluded", "unknown", None, True, None), ("stale", "known_direct_stale", None, "unknown", None, None, None), ("stale", None, "strict", "unknown", None, True, None), ("canonical", None, None, "near", True, True, False), ("stale", None, None, "error_block", None, None, None), ("canonical", None, None, "canonical", True, None, True)]
    got = classify.import_decision(spark.createDataFrame(rows, schema)).collect()
    want = ["capture", "classification_mismatch", "capture", "capture", "unclassified", "unclassified", "capture_known_branch", "unclassified", "unclassified", "unsupported_classification", "unsupported_classification"]
    assert [r["skip_reason"] or r["decision"] for r in got] == want


def test_sources_document_is_refused(spark):
    event = spark.createDataFrame([(1, 1, "u", "unknown", False, None, 5)], "event_id long, source_id long, parent_hash string, parent_kind string, pow_ok boolean, revoked_at long, confirmed_at long")
    block = spark.createDataFrame([], "hash string, kind string, orphan_class string")
    source = spark.createDataFrame([(1, "a", "auxpow")], "source_id long, code string, source_kind string")
    shown = payloads.sources_payload(event, block, source, 10, strict=False).collect()
    assert [(r["violations"], r["counts"]) for r in shown] == [(1, None)]
    with pytest.raises(Exception, match="miss their target"):
        payloads.sources_payload(event, block, source, 10).collect()


def test_hathor_splits_are_no_rows(spark):
    """Splits are tried in place, so that a block is one row throughout: none is exploded, shuffled or joined back."""
    schema = "block_id int, block_hash string, raw binary, funds_graph binary, aux_pow binary"
    plan = K.reconstruct_hathor(spark.createDataFrame([], schema))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Generate", "Join", "Aggregate"))
