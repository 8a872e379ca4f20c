"""Readers of published archives, registries and landed block documents, each with its explicit schema, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a publication's CSV files, in their order, and those that one chain adds.
PUBLICATION_COLUMNS = (
    "chain", "source_kind", "source_path", "source_row_number", "artifact_scope", "provenance", "child_height", "child_block_hash", "child_header_hex", "child_block_time", "child_nbits", "btc_height", "btc_header_hash",
    "btc_prev_hash", "btc_time", "btc_bits", "btc_nonce", "btc_header_hex", "coinbase_scriptsig_hex", "coinbase_outputs", "full_coinbase_hex", "classification", "validation_status", "expected_nbits", "rejection_reason",
    "btc_stale_relevance", "relevance_reason",
)
RSK_COLUMNS = ("rsk_miner", "merge_mining_hash", "is_uncle", "uncle_index", "uncle_parent_height", "rsk_merkle_proof", "rsk_coinbase_tail")
NUMBERS = {"source_row_number": "long", "child_height": "int", "child_block_time": "long", "child_nbits": "long", "btc_height": "int", "btc_time": "long"}


def publication_schema(chain: str) -> T.StructType:
    columns = PUBLICATION_COLUMNS + (RSK_COLUMNS if chain == "rsk" else ())
    return T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("corrupt", T.StringType())])


def read_publication(spark: SparkSession, path: str, chain: str, typed: bool = True) -> DataFrame:
    """A chain's rows, read as strings and then typed; numbers that don't parse are null, and lines that don't fit are in `corrupt`.

    Without `typed` all columns stay the published text, as candidates.candidate_rows() wants them.
    """
    raw = spark.read.schema(publication_schema(chain)).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    return raw.withColumns({c: F.expr(f"try_cast({c} as {t})") for c, t in NUMBERS.items()}) if typed else raw


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chain, csv_path, role, row_count, size_bytes, sha256, counts) of a publication's manifest."""
    schema = "total_event_rows long, artifacts array<struct<chain:string,csv_path:string,role:string,row_count:long,size_bytes:long,sha256:string,counts:map<string,bigint>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("artifacts").alias("a")).select("a.*")


def preflight(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's artifacts whose file is missing or differs by size, hash or rows; none means all is well."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    lines = F.size(F.split(F.rtrim(F.decode("content", "utf-8"), F.lit("\n")), "\n")) - 1
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"), lines.alias("rows"))
    want = manifest.withColumn("file", F.element_at(F.split("csv_path", "/"), -1))
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("size_bytes"), "size").when(F.col("digest") != F.col("sha256"), "sha256").when(F.col("rows") != F.col("row_count"), "rows")
    return want.join(have, "file", "left").select("file", problem.alias("problem")).where("problem is not null")


def import_known_stales(raw: DataFrame, known: DataFrame, strict: bool) -> DataFrame:
    """New (hash, height) rows of a published list: display hashes of 64 hex digits, once each, that `known` lacks.

    With `strict` any malformed row raises an error; else such rows are left out.
    """
    fine = F.coalesce(F.col("hash").rlike("^[0-9A-Fa-f]{64}$") & (F.col("height").isNull() | F.expr("try_cast(height as int)").isNotNull()), F.lit(False))
    rows = raw.withColumn("fine", F.when(fine, True).otherwise(F.raise_error(F.lit("malformed row in a known-stale list"))) if strict else fine).where("fine")
    return rows.groupBy(F.lower("hash").alias("hash")).agg(F.min(F.expr("try_cast(height as int)")).alias("height")).join(known.select("hash"), "hash", "left_anti")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, bits, start_time) of an epoch file."""
    schema = "epoch_interval int, covered_max_height long, covered_max_time long, nbits_by_epoch map<string,string>, time_by_epoch map<string,bigint>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    bits = doc.select(F.explode("nbits_by_epoch").alias("e", "hex"), "time_by_epoch")
    return bits.select(F.col("e").cast("long").alias("epoch"), F.conv(F.regexp_replace("hex", "^0x", ""), 16, 10).cast("long").alias("bits"), F.try_element_at("time_by_epoch", F.col("e")).alias("start_time"))


def read_error_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(height, hash, reason) of the error catalogue; a hash that is listed twice raises an error when the rows are read."""
    rows = spark.read.schema("height int, hash string, reason string").csv(path, comment="#", header=True)
    n = F.count("*").over(W.partitionBy("hash"))
    return rows.withColumn("hash", F.when(n == 1, F.lower("hash")).otherwise(F.raise_error(F.concat(F.lit("listed twice: "), "hash"))))


def read_pools(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slug, name), (slug, tag) and (slug, address) of a pool snapshot."""
    doc = spark.read.schema("schema_version int, pools array<struct<slug:string,canonical_name:string,coinbase_tags:array<string>,payout_addresses:array<string>>>").json(path, multiLine=True)
    p = doc.where("schema_version = 1").select(F.explode("pools").alias("p")).select("p.*")
    return p.select("slug", F.col("canonical_name").alias("name")), p.select("slug", F.explode("coinbase_tags").alias("tag")), p.select("slug", F.explode("payout_addresses").alias("address"))


def pool_problems(spark: SparkSession, path: str) -> DataFrame:
    """(field, value, problem) of a pool snapshot that must not be loaded: another schema, no pools, and slugs, tags or addresses
    that are empty or stand more than once in all of it. None means all is well."""
    doc = spark.read.schema("schema_version int, pools array<struct<slug:string,coinbase_tags:array<string>,payout_addresses:array<string>>>").json(path, multiLine=True)
    p = doc.select(F.explode("pools").alias("p")).select("p.*")
    fields = {"slug": p.select(F.col("slug").alias("v")), "tag": p.select(F.explode("coinbase_tags").alias("v")), "address": p.select(F.explode("payout_addresses").alias("v"))}
    found = doc.where("schema_version is null or schema_version <> 1").select(F.lit("schema_version").alias("field"), F.col("schema_version").cast("string").alias("value"), F.lit("unsupported").alias("problem"))
    found = found.unionByName(doc.where(F.coalesce(F.size("pools"), F.lit(0)) <= 0).select(F.lit("pools").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("empty").alias("problem")))
    for field, values in fields.items():
        bad = not_unique(values, "v").select(F.lit(field).alias("field"), F.col("v").alias("value"), F.when(F.coalesce(F.trim("v"), F.lit("")) == "", "empty").otherwise("repeated").alias("problem"))
        found = found.unionByName(bad)
    return found


def not_unique(df: DataFrame, column: str) -> DataFrame:
    """Values of a column that are empty or stand more than once."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.coalesce(F.trim(column), F.lit("")) == ""))


def read_identities(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(identifier, slug, problem) of a child registry: trimmed; empty, repeated or conflicting entries are marked."""
    doc = spark.read.schema(f"entries array<struct<{field}:string,pool_slug:string,pool_canonical_name:string>>").json(path, multiLine=True)
    e = doc.select(F.explode("entries").alias("e")).select(F.trim(f"e.{field}").alias("identifier"), F.trim("e.pool_slug").alias("slug"))
    w = W.partitionBy(F.lower("identifier"))
    slugs = F.size(F.collect_set("slug").over(w))
    return e.withColumn("problem", F.when(F.col("identifier") == "", "empty").when(slugs > 1, "conflict").when(F.count("*").over(w) > 1, "repeated"))


def read_hathor_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive rows with `problem` where a height doesn't rise from the row before (in file order) or hex is wrong."""
    schema = "hathor_height long, hathor_block_hash string, hathor_timestamp long, funds_graph_hex string, aux_pow_hex string"
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    last = F.lag("hathor_height").over(W.partitionBy("file").orderBy("at"))
    hex_ok = F.col("hathor_block_hash").rlike("^[0-9a-f]{64}$") & F.col("aux_pow_hex").rlike("^([0-9a-f]{2})+$")
    return rows.withColumn("problem", F.when(F.coalesce(last >= F.col("hathor_height"), F.lit(False)), "order").when(~hex_ok, "hex")).drop("file", "at")


_RSK = "hash string, number string, timestamp string, miner string, difficulty string, bitcoinMergedMiningHeader string, bitcoinMergedMiningCoinbaseTransaction string, bitcoinMergedMiningMerkleProof string, hashForMergedMining string"


def read_rsk_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, the canonical block and its uncles as rows: uncle_index is null for the canonical one."""
    doc = spark.read.schema(f"{_RSK}, uncles array<struct<{_RSK.replace(' string', ':string').replace(', ', ',')}>>").json(path, multiLine=True)
    names = [x.split(" ")[0] for x in _RSK.split(", ")]
    own = doc.select(*names, F.lit(None).cast("int").alias("uncle_index"))
    uncles = doc.select(F.posexplode("uncles").alias("uncle_index", "u")).select(*[F.col(f"u.{c}").alias(c) for c in names], "uncle_index")
    return own.unionByName(uncles)


def read_elastos_blocks(spark: SparkSession, path: str) -> DataFrame:
    schema = "hash string, height long, version long, merkleroot string, time long, nonce long, bits long, previousblockhash string, auxpow string, minerinfo string, tx array<struct<payload:struct<coinbasedata:string>,vout:array<struct<value:string,n:int,address:string>>>>"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_blobs(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """(file, blob) of files that hold one hex text each, null where the text isn't hex; with `raw` the files' bytes as they are."""
    text = F.regexp_replace(F.decode("content", "iso-8859-1"), r"^\s+|\s+$", "")
    blob = F.col("content") if raw else F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), blob.alias("blob"))


def read_core_headers(spark: SparkSession, path: str) -> DataFrame:
    """The node's headers as a table."""
    return spark.read.schema("hash string, prev_hash string, height long, is_active boolean, bits long, time long, coinbase_script binary").parquet(path)


def write_snapshot(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace the partitions that `df` has, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_payload(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.write.mode("overwrite").json(path)


def to_payload(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("payload"))
