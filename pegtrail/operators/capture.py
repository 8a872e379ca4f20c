"""Landed documents of child chains to events: every row keeps an `outcome`, so that what is left out is counted and never fatal.

Byte layouts of unknown depth (transactions, proofs) are read by one Arrow function; hashes, folds, slots, targets and all
decisions are column expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegtrail.functions import scalars as C
from pegtrail.session import importable

#: Marker before the hash that a coinbase commits to, and the most bytes and steps of a proof and a block's head.
HATH = "48617468"
MOST_PROOF, MOST_PATH, MOST_PREFIX = 16 * 1024, 32, 64 * 1024
#: Slot number of the Elastos chain, the most hex digits of its proof, and bits of fabricated parents.
ELASTOS_SLOT, MOST_AUXPOW_HEX, DUMMY_BITS = 1224, 8192, (0, 0x7FFFFFFF)

PROOF = "txid:binary,script:binary,outputs:array<struct<value:bigint,script:binary>>,coinbase_branch:array<binary>,coinbase_index:bigint,chain_branch:array<binary>,chain_index:bigint,header:binary"


def swap(data: Column) -> Column:
    """The bytes in reverse order."""
    return F.unhex(C.swap_hex(F.hex(data)))


def _swap32(data: Column) -> Column:
    """The bytes of a hash in reverse order, without a text in between."""
    return _let(data, lambda x: F.concat(*[F.substring(x, i, 1) for i in range(32, 0, -1)]))


def parse_proof(df: DataFrame, column: str = "proof", out: str = "p") -> DataFrame:
    """With `out`: the PROOF fields of a whole proof, null unless every byte of it is used."""
    importable(df.sparkSession)
    kind = pa.struct([
        ("txid", pa.binary()), ("script", pa.binary()), ("outputs", pa.list_(pa.struct([("value", pa.int64()), ("script", pa.binary())]))), ("coinbase_branch", pa.list_(pa.binary())), ("coinbase_index", pa.int64()),
        ("chain_branch", pa.list_(pa.binary())), ("chain_index", pa.int64()), ("header", pa.binary()),
    ])

    @F.arrow_udf(f"struct<{PROOF}>")
    def parsed(data: pa.Array) -> pa.Array:
        from pegtrail.functions.proofs import read_proof

        rows = []
        for blob in data.to_pylist():
            p = read_proof(blob) if blob else None
            rows.append(p and {
                "txid": p["coinbase"]["txid"], "script": p["coinbase"]["script"] or b"", "outputs": [{"value": min(v, (1 << 63) - 1), "script": s} for v, s in p["coinbase"]["outputs"]], "coinbase_branch": p["coinbase_branch"][0], "coinbase_index": p["coinbase_branch"][1],
                "chain_branch": p["chain_branch"][0], "chain_index": p["chain_branch"][1], "header": p["header"],
            })
        return pa.array(rows, kind)

    return df.withColumn(out, parsed(F.col(column)))


def commitment_problem(p: Column, child_hash: Column, chain_id: Column) -> Column:
    """Why a parsed proof doesn't commit to a child hash (wire order) in the chain's slot, or null if it does.

    One marker in the coinbase, with a size of two to the depth of the chain's branch; both indices at least 0, the coinbase's
    0, the chain's that of its slot; the coinbase's id folds to the parent's merkle root, and the child's hash, both reversed,
    to the committed one.
    """
    script = F.hex(p["script"])
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.length(p["script"]) - 4, F.lit(0))), lambda i: F.substring(script, 2 * i + 1, F.lit(8)) == C.AUX_MAGIC)
    rest = F.substring(script, 2 * F.get(places, F.lit(0)) + 9, F.lit(80))
    root, size, nonce = F.unhex(F.substring(rest, 1, 64)), C.le_int(rest, 32, 4), C.le_int(rest, 36, 4)
    depth = F.size(p["chain_branch"])
    rules = (
        (p.isNull(), "malformed"), (F.size(places) == 0, "no_marker"), (F.size(places) > 1, "several_markers"), (F.length(rest) < 80, "short_marker"), ((depth >= 32) | (size != F.call_function("shiftleft", F.lit(1).cast("long"), F.least(depth, F.lit(40)))), "tree_size"),
        ((p["coinbase_index"] < 0) | (p["chain_index"] < 0), "negative_index"), (p["coinbase_index"] != 0, "not_first"), (p["chain_index"] != C.expected_slot(nonce, chain_id, depth), "slot"),
        (C.merkle_fold(p["txid"], p["coinbase_branch"], F.lit(0)) != F.substring(p["header"], 37, 32), "coinbase_root"), (F.coalesce(C.merkle_fold(swap(child_hash), p["chain_branch"], p["chain_index"]) != swap(root), F.lit(True)), "chain_root"),
    )
    why = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        why = F.when(bad, name).otherwise(why)
    return why


def verify_commitments(df: DataFrame) -> DataFrame:
    """Rows (proof, child_hash, chain_id) with `p`, `reason` (null: verified), slot and the parent's hash in wire order."""
    parsed = parse_proof(df)
    return parsed.select("*", commitment_problem(F.col("p"), F.col("child_hash"), F.col("chain_id")).alias("reason"), F.col("p.chain_index").alias("slot"), C.sha256d(F.col("p.header")).alias("parent_hash"))


def merkle_root(ids: Column) -> Column:
    """The root over a block's transaction ids (wire order), levels of odd size ending in their last one twice; null for none."""
    pair = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: C.sha256d(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.get(level, 2 * i)))))
    levels = F.when(F.size(ids) > 1, F.sequence(F.lit(1), F.ceil(F.log2(F.size(ids).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.get(F.aggregate(levels, ids, lambda level, _: F.when(F.size(level) > 1, pair(level)).otherwise(level)), F.lit(0))


def attach_child_coinbase(proofs: DataFrame, blocks: DataFrame, most: int = C.MAX_SCRIPT_HEIGHT) -> DataFrame:
    """Proofs (proof_id, child_hash, child_height) with the coinbase of their full child block, and `outcome`.

    blocks: header (80 bytes), txids (array, wire order), first_is_coinbase, coinbase_script, coinbase_outputs. A block counts if
    its ids fold to its header's root and its first transaction is a coinbase; it joins by its header's own hash. Outcomes:
    attached, no_block, or what is wrong with the block: merkle_root, not_coinbase. A height that the proof lacks is taken from
    the script, up to `most`. Blocks that land again are one.
    """
    bad = F.when(F.coalesce(merkle_root(F.col("txids")) != F.substring("header", 37, 32), F.lit(True)), "merkle_root").when(~F.coalesce("first_is_coinbase", F.lit(False)), "not_coinbase")
    full = blocks.select(C.sha256d(F.col("header")).alias("child_hash"), F.struct(bad.isNotNull().alias("wrong"), bad.alias("problem"), F.get("txids", F.lit(0)).alias("child_coinbase_txid"), F.col("coinbase_script").alias("child_coinbase_script"), F.col("coinbase_outputs").alias("child_coinbase_outputs")).alias("b"))
    one = full.groupBy("child_hash").agg(F.min("b").alias("b"))  # a sound copy before a broken one
    j = proofs.join(one, "child_hash", "left")
    good = F.col("b.wrong") == F.lit(False)
    take = lambda c: F.when(good, F.col(f"b.{c}")).alias(c)
    return j.select(
        *[c for c in proofs.columns if c != "child_height"], F.coalesce("child_height", F.when(good, C.bip34_height(F.col("b.child_coinbase_script"), most))).alias("child_height"), take("child_coinbase_txid"), take("child_coinbase_script"), take("child_coinbase_outputs"),
        F.when(F.col("b").isNull(), "no_block").when(good, "attached").otherwise(F.col("b.problem")).alias("outcome"),
    )


def _let(value: Column, use) -> Column:
    """`use` of a value that is worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _varint(data: Column, at: Column) -> Column:
    """(value, size) of the compact size at a place (from 1); null if it is cut short or of nine bytes."""
    byte = lambda n: F.conv(C.swap_hex(F.hex(F.substring(data, at + 1, F.lit(n)))), 16, 10).cast("long")
    first = F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long")
    left = F.length(data) - at
    pack = lambda value, size: F.struct(value.alias("value"), F.lit(size).alias("size"))
    return F.when(first < 253, pack(first, 1)).when((first == 253) & (left >= 2), pack(byte(2), 3)).when((first == 254) & (left >= 4), pack(byte(4), 5))


def _counted(data: Column, at: Column, unit: int, most: int) -> Column:
    """(bytes, n, end) of a counted run of `unit` bytes each at a place, or null if it doesn't fit."""

    def run(v):
        n = F.when(v["value"] <= most, v["value"]).cast("int")
        start = at + v["size"]
        return F.when(start + n * unit <= F.length(data) + 1, F.struct(F.substring(data, start, n * unit).alias("bytes"), n.alias("n"), (start + n * unit).alias("end")))

    return _let(_varint(data, at), run)


def _hathor_proof(data: Column) -> Column:
    """head, tail and path of a proof with its header's first 36 and last 12 bytes around them; null unless all bytes are used."""
    parts = lambda a, b, c: F.when(c["end"] + 12 == F.length(data) + 1, F.struct(a["bytes"].alias("head"), b["bytes"].alias("tail"), c["bytes"].alias("path"), c["n"].alias("steps")))
    at_tail = lambda a: _let(_counted(data, a["end"], 1, MOST_PROOF), lambda b: _let(_counted(data, b["end"], 32, MOST_PATH), lambda c: parts(a, b, c)))
    return F.when(F.length(data).between(51, MOST_PROOF), _let(_counted(data, F.lit(37), 1, MOST_PROOF), at_tail))


def reconstruct_hathor(blocks: DataFrame) -> DataFrame:
    """Rows (block_id, block_hash as display hex, raw, funds_graph, aux_pow) with the parent header and coinbase that their proof
    implies, the split that gives them, and `outcome`.

    A block's head is `funds_graph`, or what comes before the proof in `raw`. Which of its bytes are funds and which are graph
    isn't said: of all splits the first whose header has the block's hash is taken; they are hashed one after the other where the
    block is read, and nothing is shuffled. Outcomes: ok, too_large, malformed, no_prefix, prefix_size, no_marker, no_split.
    """
    d = blocks.withColumn("_x", _hathor_proof(F.col("aux_pow")))
    latin = lambda c: F.decode(F.col(c), "ISO-8859-1")
    place = F.instr(latin("raw"), latin("aux_pow"))
    d = d.withColumn("_prefix", F.coalesce("funds_graph", F.when(place > 0, F.substring("raw", F.lit(1), place - 1))))
    marked = F.coalesce((F.length("_x.head") >= 4) & (F.hex(F.substring(F.col("_x.head"), F.length("_x.head") - 3, F.lit(4))) == HATH), F.lit(False))
    early = (
        F.when(F.length("aux_pow") > MOST_PROOF, "too_large").when(F.col("_x").isNull(), "malformed").when(F.col("_prefix").isNull(), "no_prefix").when(~F.length("_prefix").between(2, MOST_PREFIX), "prefix_size").when(~marked, "no_marker")
        .when(F.coalesce(F.length("block_hash") != 64, F.lit(True)), "no_split")
    )
    path = F.transform(F.when(F.col("_x.steps") > 0, F.sequence(F.lit(0), F.col("_x.steps") - 1)).otherwise(F.array().cast("array<int>")), lambda i: _swap32(F.substring(F.col("_x.path"), 32 * i + 1, F.lit(32))))

    @F.arrow_udf("struct<split:int,header:binary,coinbase:binary>")
    def searched(prefix: pa.Array, wanted: pa.Array, first: pa.Array, head: pa.Array, tail: pa.Array, last: pa.Array, path: pa.Array) -> pa.Array:
        from pegtrail.functions.proofs import hathor_split

        rows = zip(*[x.to_pylist() for x in (prefix, wanted, first, head, tail, last, path)], strict=True)
        return pa.array([hathor_split(*r) if r[0] and r[1] else None for r in rows], pa.struct([("split", pa.int32()), ("header", pa.binary()), ("coinbase", pa.binary())]))

    importable(blocks.sparkSession)
    open_ = lambda c: F.when(F.col("_early").isNull(), c)
    d = d.withColumn("_early", early).withColumn("f", searched(*[open_(c) for c in (F.col("_prefix"), C.to_stored(F.col("block_hash")), F.substring("aux_pow", 1, 36), F.col("_x.head"), F.col("_x.tail"), F.substring(F.col("aux_pow"), F.length("aux_pow") - 11, F.lit(12)), path)]))
    outcome = F.coalesce("_early", F.when(F.col("f").isNull(), "no_split").otherwise("ok"))
    ok = outcome == "ok"
    return d.select(*blocks.columns, F.length("_prefix").alias("prefix_size"), *[F.when(ok, F.col(f"f.{c}")).alias(c) for c in ("split", "header", "coinbase")], outcome.alias("outcome"))


def _bare(column: str) -> Column:
    return F.regexp_replace(F.trim(column), "^(0x)+", "")


def _hex_bytes(column: str) -> Column:
    """Bytes of a hex text with or without 0x, or null."""
    text = _bare(column)
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def _quantity(column: str, digits: int) -> Column:
    """A hex quantity of so many digits at most that fits in the type, or null."""
    text = F.regexp_replace(_bare(column), "^0+(?=.)", "")
    return F.when(text.rlike(f"^([0-9A-Fa-f]{{1,{digits - 1}}}|[0-7][0-9A-Fa-f]{{{digits - 1}}})$"), F.conv(text, 16, 10).cast("long"))


def capture_rsk(documents: DataFrame, identities: DataFrame) -> DataFrame:
    """RSK documents (readers.read_rsk_blocks columns) as events and their sidecars, with `outcome`: ready, pre_rskip92 or malformed.

    A parent header that is absent, empty or not of 80 bytes is one of the old form; hex that is none, hashes of other than 32
    bytes, miners of other than 20 and numbers that don't fit are malformed. identities: (identifier, identity_id, pool_id) by
    miner in lower-case hex without 0x; miners that nobody knows stay, without a pool.
    """
    h = F.col("bitcoinMergedMiningHeader")
    header = _hex_bytes("bitcoinMergedMiningHeader")
    fixed = lambda c, n: F.when(F.length(_hex_bytes(c)) == n, _hex_bytes(c))
    optional = lambda c: F.col(c).isNotNull() & _hex_bytes(c).isNull()
    number, time = _quantity("number", 8), _quantity("timestamp", 16)
    outcome = (
        F.when(h.isNull() | (_bare("bitcoinMergedMiningHeader") == ""), "pre_rskip92").when(header.isNull(), "malformed").when(F.length(header) != 80, "pre_rskip92")
        .when(fixed("hash", 32).isNull() | fixed("miner", 20).isNull() | fixed("hashForMergedMining", 32).isNull(), "malformed").when(optional("bitcoinMergedMiningMerkleProof") | optional("bitcoinMergedMiningCoinbaseTransaction"), "malformed")
        .when(number.isNull() | time.isNull(), "malformed").otherwise("ready")
    )
    d = documents.withColumn("outcome", outcome)
    ready = lambda c: F.when(F.col("outcome") == "ready", c)
    p = C.decode_header(header)
    rows = d.select(
        "outcome", "hash", ready(number).alias("child_height"), ready(fixed("hash", 32)).alias("child_hash"), ready(time).alias("child_time"), ready(C.sha256d(header)).alias("parent_hash"), ready(p["prev_hash"]).alias("parent_prev_hash"), ready(p["time"]).alias("parent_time"), ready(p["bits"]).alias("parent_bits"),
        ready(C.pow_valid(C.sha256d(header), p["bits"])).alias("pow_ok"), ready(F.lower(F.hex(fixed("miner", 20)))).alias("identifier"), ready(fixed("hashForMergedMining", 32)).alias("merge_mining_hash"), ready(_hex_bytes("bitcoinMergedMiningMerkleProof")).alias("merkle_proof"),
        ready(_hex_bytes("bitcoinMergedMiningCoinbaseTransaction")).alias("coinbase_tail"), "uncle_index", ready(F.col("uncle_index").isNotNull()).alias("is_uncle"),
    )
    return rows.join(identities.select("identifier", "identity_id", "pool_id"), "identifier", "left")


def _le(column: str, size: int = 4) -> Column:
    """A number's little-endian bytes."""
    return F.unhex(C.swap_hex(F.lpad(F.hex(F.col(column).cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")))


def capture_elastos(documents: DataFrame, epochs: DataFrame) -> DataFrame:
    """Elastos documents (readers.read_elastos_blocks columns and `requested`, the height asked for) as events, with `outcome`.

    In order: malformed (another height, a hash that the 84-byte header built from the fields doesn't have, a proof that can't be
    read or commits to something else), non_auxpow (no proof, or a fabricated parent: its bits, or no outputs), near (the parent
    misses its target), child_target (it misses the child's), non_btc (bits of another chain, or no height to tell), hold (the
    height is above the epochs), written. Fabricated parents are told before their commitment is looked at.
    """
    from pegtrail.operators.classify import classify_nbits

    hash_ok = lambda c: F.coalesce(F.col(c).rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))
    prefix = F.concat(_le("version"), C.to_stored(F.col("previousblockhash")), C.to_stored(F.col("merkleroot")), _le("time"), _le("bits"), _le("nonce"))
    shaped = hash_ok("hash") & hash_ok("previousblockhash") & hash_ok("merkleroot")
    d = documents.withColumn("prefix", F.when(shaped, prefix)).withColumn("child_hash", C.sha256d(F.concat("prefix", _le("height"))))
    text = F.nullif(F.trim(F.coalesce("auxpow", F.lit(""))), F.lit(""))
    good_hex = (F.length(text) <= MOST_AUXPOW_HEX) & text.rlike("^([0-9A-Fa-f]{2})+$")
    d = parse_proof(d.withColumn("proof", F.when(good_hex, F.unhex(text))))
    header = F.col("p.header")
    d = d.withColumn("parent", C.decode_header(header)).withColumn("parent_hash", C.sha256d(header)).withColumn("script_height", C.bip34_height(F.col("p.script")))
    named = classify_nbits(d.withColumn("child_height", F.col("height")).withColumn("child_bits", F.col("bits")).drop("height", "bits").withColumnRenamed("script_height", "height").withColumn("bits", F.col("parent.bits")), epochs)
    right = F.coalesce((F.col("child_height") == F.col("requested")) & (C.to_display(F.col("child_hash")) == F.lower("hash")), F.lit(False))
    dummy = F.col("parent.bits").isin(*DUMMY_BITS) | (F.size("p.outputs") == 0)
    why = commitment_problem(F.col("p"), F.col("child_hash"), F.lit(ELASTOS_SLOT))
    outcome = (
        F.when(~right, "malformed").when(text.isNull(), "non_auxpow").when(F.col("p").isNull(), "malformed").when(dummy, "non_auxpow").when(why.isNotNull(), "malformed").when(~C.pow_valid(F.col("parent_hash"), F.col("parent.bits")), "near")
        .when(~C.pow_valid(F.col("parent_hash"), F.col("child_bits")), "child_target").when(F.col("height").isNull() | F.col("nbits").isin("contaminant", "below"), "non_btc").when(F.col("nbits") == "above", "hold").otherwise("written")
    )
    e = named.withColumn("outcome", outcome)
    kept = lambda c: F.when(F.col("outcome").isin("written", "hold"), F.col(c)).alias(c.split(".")[-1])
    addresses = F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce(F.get("tx", F.lit(0))["vout"], F.array().cast("array<struct<value:string,n:int,address:string>>")), lambda v: F.array(v["address"]))), lambda a: a.isNotNull()))
    return e.select(
        "hash", "outcome", F.when(F.col("outcome").isin("written", "hold"), why).alias("commitment"), "child_height", kept("child_hash"), F.when(F.col("outcome").isin("written", "hold"), F.col("time")).alias("child_time"), F.when(F.col("outcome").isin("written", "hold"), F.col("child_bits")).alias("child_bits"),
        kept("parent_hash"), kept("parent.prev_hash"), F.when(F.col("outcome").isin("written", "hold"), F.col("parent.time")).alias("parent_time"), F.when(F.col("outcome").isin("written", "hold"), F.col("parent.bits")).alias("parent_bits"), F.when(F.col("outcome").isin("written", "hold"), F.col("height")).alias("script_height"),
        F.when(F.col("outcome").isin("written", "hold"), addresses).alias("addresses"), F.when(F.col("outcome").isin("written", "hold"), F.coalesce("minerinfo", F.get("tx", F.lit(0))["payload"]["coinbasedata"])).alias("minerinfo"),
    )
