"""Live Hathor blocks of every outcome, and what each does to the events of its height."""

import random
import struct

from test_capture import EASY, dsha, fold, sha, tx

from pegtrail.operators import hathor_live as H


def block(seed, claim=100_000, bits=EASY, good=True, trailing=b""):
    """(tx_id, raw, aux_pow) of a block whose parent claims a height."""
    rng = random.Random(seed)
    prefix, path = rng.randbytes(60), [rng.randbytes(32) for _ in range(3)]
    whole = sha(prefix[:25]) + sha(prefix[25:])
    commit = dsha(whole)[::-1]
    coinbase = tx(b"\x03" + claim.to_bytes(3, "little") + b"Hath" + commit) + trailing
    at = coinbase.index(commit)
    head, tail = coinbase[:at], coinbase[at + 32 :]
    root = fold(dsha(coinbase), [x[::-1] for x in path], 0)
    first = rng.randbytes(36)
    for n in range(1000):
        last = struct.pack("<III", 7, bits, n)
        hashed = dsha(first + root + last)
        if (hashed[31] < 0x7F) == good:
            break
    aux = first + bytes([len(head)]) + head + bytes([len(tail)]) + tail + b"\x03" + b"".join(path) + last
    return hashed[::-1].hex(), prefix + aux, aux


def test_outcomes_and_actions(spark):
    rows, want = [], {}

    def land(height, outcome, made, version=3, voided=False, tx_hash="same", tx_id=None):
        own, raw, aux = made
        rows.append((height, tx_id or own, version, voided, (tx_id or own) if tx_hash == "same" else tx_hash, raw, aux))
        want[height] = outcome

    land(1, "written", block(1))
    land(2, "voided", block(2), voided=True)
    land(3, "malformed", block(3), tx_id="xyz")
    land(4, "non_auxpow", block(4), version=0)
    land(5, "absent_hold", block(5), tx_hash=None)
    land(6, "malformed", block(6), tx_hash="0" * 64)
    land(7, "malformed", block(7, good=False))
    land(8, "malformed", block(8, trailing=b"\0"))
    land(9, "non_btc", block(9, bits=0x207FFFFE))
    land(10, "hold", block(10, claim=500_100))
    land(11, "non_btc", block(11, claim=900_000))
    land(12, "malformed", block(12), tx_id=dsha(b"other")[::-1].hex())
    land(13, "written", block(13), voided=None)
    documents = spark.createDataFrame(rows, "height long, tx_id string, version int, is_voided boolean, tx_hash string, raw binary, aux_pow binary")
    epochs = spark.createDataFrame([(2016 * i, EASY) for i in range(248)], "epoch long, bits long")
    tip = spark.createDataFrame([(500_000, 1_000)], "tip_height long, tip_time long")
    got = H.hathor_outcomes(documents, epochs, tip, 2_000).cache()
    found = {r["height"]: r for r in got.collect()}
    assert {h: r["outcome"] for h, r in found.items()} == want
    assert (found[1]["script_height"], found[1]["bits"]) == (100_000, EASY) and dsha(bytes(found[1]["header"]))[::-1].hex() == rows[0][1] and found[7]["header"] is None
    stale = {r["height"]: r["outcome"] for r in H.hathor_outcomes(documents, epochs, tip, 10**9).collect()}
    assert stale[11] == "hold" and stale[10] == "hold"  # the tip is old
    assert {r["height"]: r["outcome"] for r in H.hathor_outcomes(documents, epochs, tip.limit(0), 2_000).collect()}[11] == "hold"

    ids = {r[0]: r[1] for r in rows}
    events = []
    for h in (1, 2, 4, 5, 6, 9, 11):
        events += [(h * 10, h, ids[h], ids[h], None), (h * 10 + 1, h, "other", "other", None), (h * 10 + 2, h, None, ids[h], None), (h * 10 + 3, h, None, "other", None), (h * 10 + 4, h, ids[h], ids[h], "superseded"), (h * 10 + 5, h, ids[h], ids[h], "nbits_conflict"), (h * 10 + 6, h, "other", "other", "superseded")]
    acts = {(r["event_id"], r["action"], r["reason"]) for r in H.hathor_actions(got, spark.createDataFrame(events, "event_id long, height long, child_hash string, parent_hash string, revoked_reason string")).collect()}
    assert acts == {
        (11, "revoke", "superseded"), (13, "revoke", "superseded"), (14, "restore", "superseded"), *[(20 + i, "revoke", "voided") for i in range(4)], *[(40 + i, "revoke", "superseded") for i in (1, 2, 3)],
        *[(h * 10 + i, "revoke", "non_btc" if i == 0 else "superseded") for h in (9, 11) for i in range(4)],
    }
