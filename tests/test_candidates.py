"""Published rows, one for each rule that they can break."""

import struct

from test_capture import EASY, dsha, tx

from pegtrail.functions.proofs import script_address
from pegtrail.sources import candidates, readers

PAY = b"\x76\xa9\x14" + bytes(range(20)) + b"\x88\xac"
HEIGHT = 240_000


def header(time, bits=EASY, good=True):
    for n in range(1000):
        h = b"\1\0\0\0" + dsha(b"prev") + dsha(b"root") + struct.pack("<III", time, bits, n)
        if (dsha(h)[31] < 0x7F) == good:
            return h


def row(**changes):
    """A canonical row that is sound in all of its parts, with changes."""
    time = changes.pop("time", 5_000)
    h = changes.pop("parent", None) or header(time)
    child = bytes(68) + struct.pack("<III", 77, EASY, 0)
    script = b"\x03" + changes.pop("height", HEIGHT).to_bytes(3, "little")
    base = {
        "chain": "namecoin", "source_kind": "k", "source_path": "p", "source_row_number": "1", "artifact_scope": "s", "provenance": "v", "child_height": "7", "child_block_hash": dsha(child).hex(), "child_header_hex": child.hex(), "child_block_time": "77", "child_nbits": f"{EASY:x}", "btc_height": "9",
        "btc_header_hash": dsha(h)[::-1].hex(), "btc_prev_hash": dsha(b"prev")[::-1].hex(), "btc_time": str(struct.unpack("<I", h[68:72])[0]), "btc_bits": f"0x{struct.unpack('<I', h[72:76])[0]:x}", "btc_nonce": str(struct.unpack("<I", h[76:])[0]), "btc_header_hex": h.hex(), "coinbase_scriptsig_hex": script.hex(),
        "coinbase_outputs": None, "full_coinbase_hex": None, "classification": "canonical", "validation_status": None, "expected_nbits": None, "rejection_reason": None, "btc_stale_relevance": None, "relevance_reason": None,
    }
    return base | changes


UNKNOWN = {"classification": "unknown", "btc_stale_relevance": "strict_btc_orphan"}
WEAK = {"classification": "unknown", "btc_stale_relevance": "weak_btc_orphan"}
STALE = {"classification": "stale", "relevance_reason": "valid_direct_stale"}
SCRIPT = b"\x03" + HEIGHT.to_bytes(3, "little")
WHOLE = tx(SCRIPT, [(5, PAY)]).hex()
CASES = [
    (None, {}), (None, {"child_height": None, "child_header_hex": ""}), (None, {"child_block_hash": " "}), ("malformed", {"chain": "elastos"}), ("malformed", {"child_height": "-1"}), ("malformed", {"child_block_hash": "ab"}), ("empty_field", {"child_height": "", "child_block_hash": None, "child_header_hex": None}),
    ("malformed", {"child_nbits": "123456789"}), ("malformed", {"child_header_hex": "00" * 79}), ("hash_mismatch", {"child_block_hash": "ab" * 32}), ("evidence_mismatch", {"child_block_time": "78"}), ("evidence_mismatch", {"child_nbits": "1d00ffff"}),
    ("empty_field", {"classification": " "}), ("near", {"classification": "near", "relevance_reason": "valid_direct_stale"}), ("unsupported_classification", {"classification": "other"}), ("taxonomy_mismatch", {"classification": "stale"}), ("taxonomy_mismatch", STALE | {"validation_status": "VALIDATED"}),
    (None, STALE | {"validation_status": "VALID (checked)"}), ("empty_field", {"source_path": None}), ("malformed", {"source_row_number": "0"}), ("empty_field", {"provenance": ""}), ("malformed", {"btc_height": "x"}),
    ("empty_field", {"btc_header_hex": None}), ("malformed", {"btc_header_hex": "0"}), ("empty_field", {"btc_header_hash": None}), ("hash_mismatch", {"btc_header_hash": "ab" * 32}), ("hash_mismatch", {"btc_prev_hash": "ab" * 32}), ("malformed", {"btc_time": "x"}), ("evidence_mismatch", {"btc_time": "6"}),
    ("evidence_mismatch", {"btc_nonce": "x"}), ("evidence_mismatch", {"btc_bits": "1d00ffff"}), ("evidence_mismatch", {"expected_nbits": "1"}), ("target_invalid", {"parent": header(5_000, good=False)}),
    ("malformed", {"coinbase_scriptsig_hex": "0"}), ("malformed", {"full_coinbase_hex": "00"}), (None, {"full_coinbase_hex": WHOLE}), ("malformed", {"full_coinbase_hex": WHOLE + "00"}), ("evidence_mismatch", {"full_coinbase_hex": WHOLE, "coinbase_scriptsig_hex": "00"}),
    (None, {"full_coinbase_hex": WHOLE, "coinbase_outputs": f"{script_address(PAY, 'bitcoin')}:5"}), ("evidence_mismatch", {"full_coinbase_hex": WHOLE, "coinbase_outputs": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa:5"}),
    (None, UNKNOWN), ("taxonomy_mismatch", WEAK), (None, UNKNOWN | {"height": 5}), (None, WEAK | {"height": 5}), ("orphan_excluded", UNKNOWN | {"parent": header(5_000, bits=0x207FFFFE)}), ("orphan_pending", UNKNOWN | {"time": 999_999}), (None, {"classification": "unknown"} | STALE | {"classification": "unknown", "validation_status": "VALID", "time": 999_999}),
]


def test_each_rule_and_their_order(spark):
    names = readers.PUBLICATION_COLUMNS
    rows = [tuple(row(**(changes | {"rejection_reason": str(i)}))[c] for c in names) for i, (_, changes) in enumerate(CASES)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    start = HEIGHT // 2016 * 2016
    epochs = spark.createDataFrame([(start - 2016, 1_000, EASY), (start, 4_000, EASY), (start + 2016, 90_000, EASY)], "epoch long, start_time long, bits long")
    got = {int(r["rejection_reason"]): r for r in candidates.candidate_rows(raw, "namecoin", epochs, 10**7, 500_000).collect()}
    assert {i: r["skip_reason"] for i, r in got.items()} == {i: want for i, (want, _) in enumerate(CASES)}
    assert (got[0]["category"], got[0]["script_height"], got[0]["parent_bits"], got[0]["orphan_verdict"]) == ("canonical", HEIGHT, EASY, None)
    assert got[2]["child_hash"] == got[0]["child_hash"] and bytes(got[35]["coinbase"]["txid"]) == dsha(bytes.fromhex(WHOLE)) and got[35]["coinbase"]["addresses"] == [script_address(PAY, "bitcoin")]
    assert [got[i]["orphan_verdict"] for i in (40, 42, 45)] == ["strict", "weak", "pending"]


def test_published_file_as_text(spark, tmp_path):
    names = readers.PUBLICATION_COLUMNS
    line = ",".join("" if row()[c] is None else row()[c] for c in names)
    (tmp_path / "n.csv").write_text(",".join(names) + "\n" + line + "\n" + line.replace("namecoin,", "other,", 1) + "\n")
    raw = readers.read_publication(spark, str(tmp_path / "n.csv"), "namecoin", typed=False)
    epochs = spark.createDataFrame([(0, 0, EASY)], "epoch long, start_time long, bits long")
    assert sorted(str(r["skip_reason"]) for r in candidates.candidate_rows(raw, "namecoin", epochs, 10**7, 500_000).collect()) == ["None", "malformed"]
