"""Row rules of a publication: the first rule that a row breaks is its reason to be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegtrail.functions import scalars


def first_of(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])


def validate_rows(df: DataFrame) -> DataFrame:
    """Publication rows with `skip_reason`, null if the row is fine."""
    hex_of = lambda c, n: F.col(c).rlike(f"^[0-9A-Fa-f]{{{2 * n}}}$")
    header = F.when(hex_of("btc_header_hex", 80), F.unhex("btc_header_hex"))
    decoded = scalars.decode_header(header)
    hash_ok = scalars.to_display(scalars.sha256d(header)) == F.lower("btc_header_hash")
    rules = [
        (F.col("corrupt").isNotNull(), "malformed_line"), (F.col("source_row_number").isNull() | (F.col("source_row_number") <= 0), "row_number"), (F.coalesce(F.trim("chain"), F.lit("")) == "", "chain"), (~F.coalesce(hex_of("btc_header_hex", 80), F.lit(False)), "header_hex"),
        (~F.coalesce(hex_of("btc_header_hash", 32), F.lit(False)), "header_hash"), (~hash_ok, "hash_mismatch"), (scalars.to_display(decoded["prev_hash"]) != F.lower("btc_prev_hash"), "prev_mismatch"), (F.col("btc_time").isNotNull() & (decoded["time"] != F.col("btc_time")), "time_mismatch"),
        (F.col("child_block_hash").isNotNull() & ~hex_of("child_block_hash", 32), "child_hash"), (F.col("child_height") < 0, "child_height"), (F.col("child_nbits").isNotNull() & ~F.col("child_nbits").between(0, 4294967295), "child_nbits"),
        (F.col("coinbase_scriptsig_hex").isNotNull() & ~F.col("coinbase_scriptsig_hex").rlike("^([0-9A-Fa-f]{2})*$"), "coinbase_hex"), (F.col("classification").isNull(), "classification"),
    ]
    return df.withColumn("skip_reason", first_of(rules))


def validate_child(df: DataFrame) -> DataFrame:
    """Child bundles with `child_problem`, and the child's hash derived from its header where it has none.

    The header must have 80 bytes and hash to the child hash, both in wire order; its time and bits must agree with the
    columns (one chain keeps other bits in its header, so its bits aren't compared).
    """
    header = F.unhex("child_header_hex")
    d, own = scalars.decode_header(header), F.lower(F.hex(scalars.sha256d(header)))
    has = F.col("child_header_hex").isNotNull()
    rules = [
        (has & (F.length(header) != 80), "length"), (has & F.col("child_block_hash").isNotNull() & (own != F.lower("child_block_hash")), "hash"), (has & (d["time"] != F.col("child_block_time")), "time"), (has & (F.col("chain") != "xaya") & (d["bits"] != F.col("child_nbits")), "bits"),
    ]
    return df.withColumn("child_problem", first_of(rules)).withColumn("child_block_hash", F.coalesce(F.lower("child_block_hash"), F.when(has & F.col("child_problem").isNull(), own)))


def exclude_reserved(df: DataFrame, prefixes: list[str], column: str = "address") -> DataFrame:
    """Rows whose address has none of the prefixes."""
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~F.startswith(F.col(column), F.lit(p))
    return df.where(keep)


def assert_unknown_pow(df: DataFrame) -> DataFrame:
    """The rows; reading one that is unknown without meeting the target raises an error."""
    bad = (F.col("kind") == "unknown") & ~F.col("pow_ok")
    return df.withColumn("kind", F.when(bad, F.raise_error(F.lit("an unknown parent misses its target"))).otherwise(F.col("kind")))
