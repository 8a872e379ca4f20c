"""Published rows to import candidates: the first rule that a row breaks is its `skip_reason`, of the thirteen that imports count.

empty_field, malformed, hash_mismatch, evidence_mismatch, taxonomy_mismatch, target_invalid, unsupported_classification, near,
orphan_not_selected, orphan_excluded and orphan_pending are given here; classification_mismatch and unclassified come from
classify.import_decision(), which knows the node's verdict.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegtrail.functions import scalars as C
from pegtrail.operators import classify as K
from pegtrail.session import importable
from pegtrail.sources.validation import first_of


def _given(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def _whole(column: str, kind: str) -> Column:
    """A number that isn't negative, or null."""
    text = _given(column)
    return F.when(text.rlike("^[+]?[0-9]+$"), F.expr(f"try_cast(trim({column}) as {kind})"))


def _bytes(column: str) -> Column:
    text = _given(column)
    return F.when(text.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(text))


def _target(column: str) -> Column:
    """Compact bits in hex, with or without 0x, of at most eight digits."""
    text = F.regexp_replace(_given(column), "^0x", "")
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(text, 16, 10).cast("long"))


def _wrong(column: str, value: Column) -> Column:
    """A field that is there and isn't what it should be."""
    return _given(column).isNotNull() & value.isNull()


def parent_coinbase(df: DataFrame, tx: str = "full_coinbase_hex", text: str = "coinbase_outputs", script: str = "coinbase_scriptsig_hex") -> DataFrame:
    """With `coinbase` (txid, script, addresses), and `coinbase_problem` where the published parts don't bear each other out.

    A whole transaction must be a coinbase; its script must be the published one, and the published addresses must be among
    those that it pays. Without a transaction the published script and addresses stand.
    """
    importable(df.sparkSession)
    kind = pa.struct([("read", pa.bool_()), ("coinbase", pa.bool_()), ("txid", pa.binary()), ("script", pa.binary()), ("paid", pa.list_(pa.string())), ("told", pa.list_(pa.string()))])

    @F.arrow_udf("struct<read:boolean,coinbase:boolean,txid:binary,script:binary,paid:array<string>,told:array<string>>")
    def parsed(data: pa.Array, told: pa.Array) -> pa.Array:
        from pegtrail.functions import proofs as P

        rows = []
        for blob, listed in zip(data.to_pylist(), told.to_pylist(), strict=True):
            row = {"read": False, "coinbase": False, "txid": None, "script": None, "paid": None, "told": P.parse_outputs_text(listed, "bitcoin")}
            if blob is not None:
                b = P.Bytes(blob)
                try:
                    t = P.read_transaction(b)
                    if b.at == len(blob):
                        row |= {"read": True, "coinbase": t["coinbase"], "txid": t["txid"], "script": t["script"], "paid": P.addresses(t["outputs"], "bitcoin")}
                except P.Short:
                    pass
            rows.append(row)
        return pa.array(rows, kind)

    d = df.withColumn("_tx", _bytes(tx)).withColumn("_script", _bytes(script)).withColumn("_text", F.col(text)).withColumn("_p", parsed("_tx", "_text"))
    has = F.col("_tx").isNotNull()
    rules = [
        (_wrong(script, F.col("_script")) | _wrong(tx, F.col("_tx")), "malformed"), (has & ~(F.col("_p.read") & F.col("_p.coinbase")), "malformed"), (has & F.col("_script").isNotNull() & (F.col("_script") != F.col("_p.script")), "evidence_mismatch"),
        (has & (F.size(F.array_except("_p.told", F.coalesce("_p.paid", F.array().cast("array<string>")))) > 0), "evidence_mismatch"),
    ]
    found = F.struct(F.col("_p.txid").alias("txid"), F.when(has, F.col("_p.script")).otherwise(F.col("_script")).alias("script"), F.when(has, F.col("_p.paid")).otherwise(F.col("_p.told")).alias("addresses"))
    return d.withColumn("coinbase", found).withColumn("coinbase_problem", first_of(rules)).drop("_tx", "_script", "_text", "_p")


def candidate_rows(raw: DataFrame, chain: str, epochs: DataFrame, height_horizon: int, time_horizon: int) -> DataFrame:
    """Publication rows (readers.read_publication(typed=False)) with category, orphan verdict, parent fields, coinbase and
    `skip_reason` (null: a candidate). epochs: (epoch, start_time, bits).

    In order: the chain; the child's fields and whether its header bears them out; the taxonomy and where the row comes from; the
    parent's header, its hashes, time, nonce and bits, and whether it meets its target; the coinbase; and for rows published
    as unknown whether the verdict is the published one. RSK's own columns are judged by capture.capture_rsk().
    """
    child, parent = _bytes("child_header_hex"), _bytes("btc_header_hex")
    own = F.when(F.length(child) == 80, C.sha256d(child))
    c = C.decode_header(child)
    height, time, bits = _whole("child_height", "int"), _whole("child_block_time", "bigint"), _target("child_nbits")
    child_hash = F.when(F.length(_bytes("child_block_hash")) == 32, _bytes("child_block_hash"))
    empty = lambda *names: [(_given(n).isNull(), "empty_field") for n in names]
    child_rules = [
        (F.coalesce(F.trim("chain") != chain, F.lit(True)), "malformed"), (_wrong("child_height", height) | _wrong("child_header_hex", child) | _wrong("child_block_hash", child_hash), "malformed"), (_given("child_height").isNull() & _given("child_block_hash").isNull() & _given("child_header_hex").isNull(), "empty_field"),
        (_wrong("child_block_time", time) | _wrong("child_nbits", bits) | (F.length(child) != 80), "malformed"), (own != child_hash, "hash_mismatch"), ((c["time"] != time) | (F.lit(chain != "xaya") & (c["bits"] != bits)), "evidence_mismatch"),
    ]
    row_number = _whole("source_row_number", "bigint")
    origin_rules = [*empty("source_kind", "source_path", "source_row_number"), (row_number.isNull() | (row_number <= 0), "malformed"), *empty("artifact_scope", "provenance"), (_wrong("btc_height", _whole("btc_height", "int")), "malformed")]
    p, hashed = C.decode_header(parent), C.sha256d(parent)
    shown = C.to_display(hashed)
    nonce = _whole("btc_nonce", "bigint")
    said = lambda column, value, right: [(_wrong(column, value), "malformed"), (value != right, "evidence_mismatch")]
    parent_rules = [
        *empty("btc_header_hex"), (parent.isNull() | (F.length(parent) != 80), "malformed"), *empty("btc_header_hash"), (F.lower(_given("btc_header_hash")) != shown, "hash_mismatch"), *empty("btc_prev_hash"), (F.lower(_given("btc_prev_hash")) != C.to_display(p["prev_hash"]), "hash_mismatch"),
        *said("btc_time", _whole("btc_time", "bigint"), p["time"]), (_given("btc_nonce").isNotNull() & ~F.coalesce(nonce == p["nonce"], F.lit(False)), "evidence_mismatch"), *said("btc_bits", _target("btc_bits"), p["bits"]), *said("expected_nbits", _target("expected_nbits"), p["bits"]), (~C.pow_valid(hashed, p["bits"]), "target_invalid"),
    ]
    d = parent_coinbase(raw)
    named = K.publication_category(d.withColumn("relevance", _given("btc_stale_relevance")).withColumn("status", _given("validation_status")).withColumn("relevance_reason", _given("relevance_reason"))).withColumnRenamed("skip_reason", "_taxonomy").drop("relevance", "status")
    kind = F.trim("classification")
    taxonomy = F.when(_given("classification").isNull(), "empty_field").when(kind == "near", "near").when(~kind.isin("canonical", "stale", "stale_descendant", "unknown"), "unsupported_classification").otherwise(F.col("_taxonomy"))
    first = F.coalesce(first_of(child_rules), taxonomy, first_of(origin_rules), first_of(parent_rules), F.col("coinbase_problem"))
    strict_chain = f"auxpow:{chain}" in K.STRICT_SOURCES
    named = named.withColumn("_first", first).withColumn("parent_hash", shown).withColumn("parent_time", p["time"]).withColumn("parent_bits", p["bits"]).withColumn("script_height", F.when(F.lit(strict_chain), C.bip34_height(F.col("coinbase.script"))))
    # a verdict is of a parent and the height that its script claims, which rows may tell differently
    named = named.withColumn("_key", F.concat_ws("|", "parent_hash", F.col("script_height").cast("string")))
    asked = (kind == "unknown") & F.col("_first").isNull()
    open_ = named.where(asked).select(F.col("_key").alias("hash"), F.col("script_height").alias("height"), F.col("parent_time").alias("time"), F.col("parent_bits").alias("bits")).distinct()
    verdicts = K.orphan_verdict(open_, epochs, height_horizon, time_horizon).select(F.col("hash").alias("_key"), "verdict")
    judged = K.filter_unknown(named.withColumn("selection", F.col("category")).join(verdicts, "_key", "left")).withColumnRenamed("skip_reason", "_orphan")
    reason = F.coalesce("_first", F.when(kind == "unknown", F.col("_orphan")))
    return judged.select(
        *raw.columns, "category", "parent_hash", "parent_time", "parent_bits", "script_height", F.when(kind == "unknown", F.col("verdict")).alias("orphan_verdict"), F.coalesce(F.lower(_given("child_block_hash")), F.lower(F.hex(own))).alias("child_hash"), F.when(bits.isNotNull(), C.pow_valid(hashed, bits)).alias("pow_child_ok"), "coinbase", reason.alias("skip_reason"),
    )
