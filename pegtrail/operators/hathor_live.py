"""Live verdicts of Hathor blocks, and what they do to the events that a height already has."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegtrail.functions import scalars as C
from pegtrail.operators import capture
from pegtrail.operators.classify import FAR_HEIGHTS, classify_nbits
from pegtrail.session import importable

#: Reasons of revocations that a later write of the same block takes back; others stay.
REVERSIBLE = ("superseded", "non_btc", "voided")


def coinbase_script(df: DataFrame, column: str = "coinbase", out: str = "script") -> DataFrame:
    """With the script of a whole transaction's first input; null if it isn't one to the last byte, or has no input."""
    importable(df.sparkSession)

    @F.arrow_udf("binary")
    def parsed(data: pa.Array) -> pa.Array:
        from pegtrail.functions import proofs as P

        rows = []
        for blob in data.to_pylist():
            b, script = P.Bytes(blob or b""), None
            try:
                t = P.read_transaction(b)
                script = t["script"] if b.at == len(b.data) else None
            except P.Short:
                pass
            rows.append(script)
        return pa.array(rows, pa.binary())

    return df.withColumn(out, parsed(F.col(column)))


def hathor_outcomes(documents: DataFrame, epochs: DataFrame, tip: DataFrame, now: int | Column, fresh_s: int = 86_400) -> DataFrame:
    """Documents (height, tx_id, version, is_voided, tx_hash, raw, aux_pow) with `outcome` and the parent's header, script height and bits.

    In order: voided; malformed (no hash); non_auxpow (not version 3); absent_hold (its transaction hasn't landed); malformed
    (another transaction, no split that gives the hash, a parent that misses its target, a coinbase that can't be read); non_btc
    (bits of another chain, no height to tell, or a height well above a fresh tip); hold (above the epochs otherwise); written.
    Heights are the key: one document each. tip: one row (tip_height, tip_time), or none.
    """
    d = documents.select(F.col("height").alias("child_height"), *[c for c in documents.columns if c != "height"])
    named = F.coalesce(F.col("tx_id").rlike("^[0-9a-f]{64}$"), F.lit(False))
    whole = ~F.coalesce("is_voided", F.lit(False)) & named & (F.col("version") == 3) & (F.col("tx_hash") == F.col("tx_id")) & F.col("aux_pow").isNotNull()
    blocks = d.where(whole).select(F.col("child_height").alias("block_id"), F.col("tx_id").alias("block_hash"), "raw", F.lit(None).cast("binary").alias("funds_graph"), "aux_pow")
    made = coinbase_script(capture.reconstruct_hathor(blocks).select(F.col("block_id").alias("child_height"), F.col("outcome").alias("split_outcome"), "header", "coinbase")).drop("coinbase")
    j = d.join(made, "child_height", "left").withColumn("height", C.bip34_height(F.col("script"))).withColumn("bits", C.decode_header(F.col("header"))["bits"])
    j = classify_nbits(j, epochs).join(F.broadcast(tip), F.lit(True), "left")  # one row at most
    met = F.coalesce(C.pow_valid(C.sha256d(F.col("header")), F.col("bits")), F.lit(False))
    far = F.coalesce((F.col("height") > F.col("tip_height") + FAR_HEIGHTS) & (F.lit(now) - F.col("tip_time") <= fresh_s), F.lit(False))
    outcome = (
        F.when(F.coalesce("is_voided", F.lit(False)), "voided").when(~named, "malformed").when(~F.coalesce(F.col("version") == 3, F.lit(False)), "non_auxpow").when(F.col("tx_hash").isNull(), "absent_hold")
        .when(F.coalesce(F.col("split_outcome") != "ok", F.lit(True)) | ~met | F.col("script").isNull(), "malformed").when(F.col("height").isNull() | F.col("nbits").isin("contaminant", "below") | far, "non_btc").when(F.col("nbits") == "above", "hold").otherwise("written")
    )
    kept = lambda c: F.when(outcome.isin("written", "hold", "non_btc"), F.col(c))
    return j.select(F.col("child_height").alias("height"), "tx_id", outcome.alias("outcome"), kept("header").alias("header"), kept("height").alias("script_height"), kept("bits").alias("bits"))


def hathor_actions(outcomes: DataFrame, prior: DataFrame) -> DataFrame:
    """(event_id, action, reason): what the outcomes do to stored events (event_id, height, child_hash, parent_hash, revoked_reason).

    A voided height loses all of its events; one without a proof, those of other blocks; a block of another chain its own as
    non_btc and others as superseded; a written one supersedes others (without a child hash: of other parents) and takes back
    a reversible revocation of its own. Holds and malformed documents change nothing.
    """
    j = prior.join(outcomes.select("height", "tx_id", "outcome"), "height")
    own = F.coalesce(F.col("child_hash") == F.col("tx_id"), F.lit(False))
    other = F.when(F.col("child_hash").isNull(), F.coalesce(F.col("parent_hash") != F.col("tx_id"), F.lit(True))).otherwise(~own)
    o = F.col("outcome")
    reason = F.when(o == "voided", "voided").when((o == "non_auxpow") & ~own, "superseded").when(o == "non_btc", F.when(own, "non_btc").otherwise("superseded")).when((o == "written") & other, "superseded")
    active = F.col("revoked_reason").isNull()
    back = ~active & F.col("revoked_reason").isin(*REVERSIBLE) & (o == "written") & ~other
    rows = j.withColumn("action", F.when(active & reason.isNotNull(), "revoke").when(back, "restore")).withColumn("reason", F.when(active, reason).otherwise(F.col("revoked_reason")))
    return rows.where("action is not null").select("event_id", "action", "reason")
