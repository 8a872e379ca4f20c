"""Scalar functions over hashes, headers and coinbase scripts, as plain column expressions.

Hashes are stored in wire order; the display form is the byte-reversed hex. A value of the wrong length gives null,
never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_BLOCKS = 2016
#: The merge-mining marker, and bounds of a height in a coinbase script.
AUX_MAGIC = "FABE6D6D"
MAX_SCRIPT_HEIGHT = 2_000_000
#: Years that are plausible.
FIRST_YEAR, LAST_YEAR = 2009, 2100
MASK32 = (1 << 32) - 1


def swap_hex(hex_text: Column) -> Column:
    """The hex of the bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(hex_text, F.lit("(..)"), F.lit(1))), "")


def to_display(stored: Column) -> Column:
    """Display hex of stored bytes."""
    return F.lower(swap_hex(F.hex(stored)))


def to_stored(display: Column) -> Column:
    """Stored bytes of a display hash."""
    return F.unhex(swap_hex(display))


def child_display(code: Column, stored: Column) -> Column:
    """Display form of a child hash; one chain stores its hashes forward."""
    return F.when(code == "auxpow:rsk", F.lower(F.hex(stored))).otherwise(to_display(stored))


def normalize_hash(text: Column) -> Column:
    """64 hex digits in lower case, or null."""
    return F.when(text.rlike("^[0-9A-Fa-f]{64}$"), F.lower(text))


def sha256d(data: Column) -> Column:
    """sha256 of sha256, as bytes."""
    return F.unhex(F.sha2(F.unhex(F.sha2(data, 256)), 256))


def le_int(hex_text: Column, at: int, size: int) -> Column:
    """A little-endian unsigned number of `size` bytes at byte `at` of a hex text."""
    return F.conv(swap_hex(F.substring(hex_text, 2 * at + 1, 2 * size)), 16, 10).cast("long")


def decode_header(header: Column) -> Column:
    """version, prev_hash, merkle_root, time, bits and nonce of an 80-byte header, or null."""
    h = F.hex(header)
    cut = lambda at, size: F.unhex(F.substring(h, 2 * at + 1, 2 * size))
    fields = F.struct(
        le_int(h, 0, 4).alias("version"), cut(4, 32).alias("prev_hash"), cut(36, 32).alias("merkle_root"), le_int(h, 68, 4).alias("time"), le_int(h, 72, 4).alias("bits"), le_int(h, 76, 4).alias("nonce")
    )
    return F.when(F.length(header) == 80, fields)


def target_hex(bits: Column) -> Column:
    """The 256-bit target of compact bits as 64 hex digits, or null for a negative, zero or too large one."""
    exponent, mantissa = F.shiftright(bits, 24), bits.bitwiseAND(F.lit(0x7FFFFF))
    wide = F.lpad(F.hex(mantissa), 6, "0")
    large = F.lpad(F.concat(wide, F.repeat(F.lit("0"), ((exponent - 3) * 2).cast("int"))), 64, "0")
    small = F.lpad(F.substring(wide, F.lit(1), (exponent * 2).cast("int")), 64, "0")
    target = F.when(exponent >= 3, large).otherwise(small)
    fits = (bits.bitwiseAND(F.lit(0x800000)) == 0) & (mantissa > 0) & exponent.between(1, 32)
    return F.when(fits, target)


def pow_valid(hash_stored: Column, bits: Column) -> Column:
    """Whether a header's hash is at most the target of `bits`; false for bits that give none, null for null."""
    return F.when(hash_stored.isNotNull() & bits.isNotNull(), F.coalesce(swap_hex(F.hex(hash_stored)) <= target_hex(bits), F.lit(False)))


def pow_child_valid(parent_hash: Column, child_bits: Column) -> Column:
    """Whether the parent's hash meets the child chain's target; null where that is unknown."""
    return pow_valid(parent_hash, child_bits)


def bip34_height(script: Column, most: int = MAX_SCRIPT_HEIGHT) -> Column:
    """The height that a coinbase script starts with: a push of 1 to 4 bytes, little-endian, up to the bound `most`."""
    h = F.hex(script)
    size = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    value = F.conv(swap_hex(F.substring(h, F.lit(3), F.least(size, F.lit(4)) * 2)), 16, 10).cast("long")
    return F.when(size.between(1, 4) & (F.length(script) > size) & value.between(0, most), value)


def aux_marker(script: Column) -> Column:
    """root (32 bytes), size and nonce behind the first byte-aligned marker; null without one or if cut short."""
    h = F.hex(script)
    before = F.regexp_extract(h, f"^((?:..)*?){AUX_MAGIC}", 1)
    found = h.rlike(f"^(?:..)*?{AUX_MAGIC}")
    rest = F.substring(h, F.length(before) + 9, F.lit(80))
    fields = F.struct(F.unhex(F.substring(rest, 1, 64)).alias("root"), le_int(rest, 32, 4).alias("size"), le_int(rest, 36, 4).alias("nonce"))
    return F.when(found & (F.length(rest) == 80), fields)


def coinbase_tag(script: Column) -> Column:
    """Printable runs of four characters or more, trimmed, joined by a space; null if there are none."""
    text = F.decode(script, "ISO-8859-1")
    runs = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[ -~]+"), F.lit(0)), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)
    return F.nullif(F.array_join(runs, " "), F.lit(""))


def normalize_tag(tag: Column) -> Column:
    """Without slashes and spaces at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(tag, r"^[/\s]+|[/\s]+$", ""), F.lit(""))


def merkle_fold(leaf: Column, branch: Column, index: Column) -> Column:
    """The root that a leaf and its branch give: bit k of `index` says on which side the k-th hash stands."""
    steps = F.transform(branch, lambda h, i: F.struct(h.alias("h"), F.call_function("shiftright", index.cast("long"), i).bitwiseAND(F.lit(1)).alias("right")))
    return F.aggregate(steps, leaf, lambda acc, s: sha256d(F.when(s["right"] == 1, F.concat(s["h"], acc)).otherwise(F.concat(acc, s["h"]))))


def expected_slot(nonce: Column, chain_id: Column, height: Column) -> Column:
    """The slot of a chain in a tree of 2**height leaves, by the public linear congruential rule modulo 2**32."""
    low = lambda c: c.bitwiseAND(F.lit(MASK32))
    first = low(low(nonce.cast("long") * 1103515245) + 12345)
    second = low(low(first + chain_id) * 1103515245)
    return low(second + 12345) % F.call_function("shiftleft", F.lit(1).cast("long"), height.cast("int"))


def epoch_start(height: Column) -> Column:
    return F.floor(height / EPOCH_BLOCKS) * EPOCH_BLOCKS


def header_time_delta(canonical: Column, stale: Column) -> Column:
    """canonical - stale in seconds; null outside 32 bits, never 0 for unknown."""
    delta = canonical.cast("decimal(38,0)") - stale.cast("decimal(38,0)")
    return F.when(delta.between(-(1 << 31), (1 << 31) - 1), delta.cast("long"))


def source_status(last_seen: Column, now: Column, fresh_days: int = 7) -> Column:
    return F.when(last_seen.isNull(), "not_started").when(now - last_seen <= fresh_days * 86400, "fresh").otherwise("stale")


def day_start(seconds: Column) -> Column:
    """The first second of the UTC day."""
    return F.floor(seconds / 86400) * 86400


def era_year(seconds: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """The UTC year, or null if it isn't plausible."""
    year = F.year(F.timestamp_seconds(seconds))
    return F.when(year.between(first, last), year)


def contributing_ids(ids: Column) -> Column:
    """The ids if they strictly rise (the canonical form), else null."""
    rises = F.forall(F.transform(ids, lambda x, i: (i == 0) | (x > F.get(ids, i - 1))), lambda ok: ok)
    return F.when(rises, ids)


def normalize_rsk(address: Column) -> Column:
    return F.lower(F.regexp_replace(address, "^0[xX]", ""))


def is_merge_mined(version: Column, exact: int | None = None) -> Column:
    """The version's merge-mining bit, or for chains that name one, exactly that version."""
    return version == exact if exact is not None else version.bitwiseAND(F.lit(0x100)) != 0


#: Families of chains by code.
FAMILIES = {"auxpow:namecoin": "namecoin", "auxpow:syscoin": "namecoin", "auxpow:fractal": "namecoin", "auxpow:elastos": "namecoin", "auxpow:xaya": "namecoin", "auxpow:rsk": "rsk", "auxpow:hathor": "hathor"}


def chain_family(code: Column) -> Column:
    pairs = [x for item in FAMILIES.items() for x in map(F.lit, item)]
    return F.try_element_at(F.create_map(*pairs), code)
