"""Jaccard self-join of documents on word n-grams, by prefix filters under several global token orders.

A document's set is its distinct n-word shingles, as 64-bit hashes. Two sets that are similar enough share a token
within both prefixes under every order of all tokens; here the orders put rare tokens first, each by counts in a table
of its own. The tables have a fixed size (tokens that share a cell share a count), so they can be broadcast whatever
the corpus; any counts give a valid order, better ones only fewer candidates.

Pairs are made of the first order's prefixes. A token's rows are not paired with each other: each goes to the token's
pivot, the row with the fewest rarer tokens before it. Verified links give components; then pairs that share a token and
are still in different components are made, so none that could link two components is left out. Of either kind of pairs
those remain whose prefixes meet under every other order too; only these are candidates, whose texts are read and whose
sets are compared.

Positions prune further: if a shared token is the rarest shared one, the i tokens before it in one set and the j in
the other are not shared, so the overlap is at most min(n - i, m - j).

Defined cases: equal texts are one node; fewer than n words are one shingle, the whole sequence; a null text or one
without words has an empty set and links with nothing; a null id is never the least; rows that share an id are rows of
their own; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegtrail.llm.batches import map_slices, shared_dir
from pegtrail.llm.components import components
from pegtrail.llm.wordhash import Windows, Words, mix, text_bytes

#: Cells of each order's table of counts, and cells in a block of it; together they bound what is broadcast (8 MB an order).
CELLS, BLOCK = 1 << 21, 1 << 14
ORDERS = 3
#: Groups that the tasks' tables are summed in before all are summed.
SUMMED = 64
#: Up to so many nodes the verification broadcasts their keys (8 bytes each) to pick their texts; beyond it, it joins.
BROADCAST_NODES = 500_000
_SALT = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(*text_bytes(column), lower=True)
    hashes = Windows(words.hashes())
    counts = np.diff(words.first)
    starts = np.flatnonzero(words.left() >= n)
    found = hashes.at(starts, n)
    cut = np.searchsorted(starts, words.first)
    out = [np.unique(found[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        out[i] = hashes.at(words.first[i : i + 1], int(counts[i]))
    return out


def cells(tokens: np.ndarray, order: int) -> np.ndarray:
    return (mix(tokens ^ _SALT[order]) & np.uint64(CELLS - 1)).astype(np.int64)


def ordered(tokens: np.ndarray, table: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under an order: its tokens that may be the rarest shared one, rarest first."""
    n = len(tokens)
    keep = n - -(-percent * n // 100) + 1
    return tokens[np.lexsort((mix(tokens + _SALT[order]), table[cells(tokens, order)]))[:keep]]


def measure(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, node, n_shingles, block, counts): a row for each text, and each task's token counts by block of cells."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pegtrail.llm.batches import slices

        total = np.zeros((ORDERS, CELLS), np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(2), n)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                for order in range(ORDERS):
                    total[order] += np.bincount(cells(every, order), minlength=CELLS).astype(np.int32)
                none = pa.nulls(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        blocks = total.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(1))
        for at in range(0, len(full), 32):
            some = full[at : at + 32]
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(some.astype(np.int32)), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, names = to_arrow_type(texts.schema["doc_id"].dataType), ["doc_id", "node", "n_shingles", "block", "counts"]
    return texts.select("doc_id", "node", "text").mapInArrow(run, f"doc_id {kind}, node long, n_shingles long, block int, counts binary")


def sum_blocks(measured: DataFrame) -> np.ndarray:
    """The orders' tables, summed over all tasks in two levels, so that no group grows with all tasks; their size is fixed."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for packed in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(packed), np.int32)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())})

    tables = np.zeros((ORDERS * CELLS // BLOCK, BLOCK), np.int32)
    first = measured.where("block is not null").select("block", "counts").groupBy("block", F.pmod(F.spark_partition_id(), F.lit(SUMMED)).alias("part")).applyInArrow(add, "block int, counts binary")
    for row in first.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        tables[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
    return tables.reshape(ORDERS, CELLS)


def prefix_rows(texts: DataFrame, tables, n: int, percent: int) -> DataFrame:
    """(node, token, n, i): the first order's prefix of each text, i being the token's place; a task writes equal texts once."""

    def make():
        table, seen = tables.value[0], set()

        def step(part: pa.RecordBatch) -> dict:
            fresh = [i for i, x in enumerate(part.column(0).to_pylist()) if x not in seen and not seen.add(x)]
            if len(seen) > 1_000_000:
                seen.clear()
            part = part.take(pa.array(fresh, pa.int64()))
            sets = shingle_sets(part.column(1), n)
            rows = [ordered(x, table, 0, percent) if len(x) else x for x in sets]
            sizes = np.array([len(x) for x in rows], np.int64)
            tokens = np.concatenate(rows).astype(np.uint64) if rows else np.zeros(0, np.uint64)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return {"node": part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), sizes))), "token": pa.array(tokens.view(np.int64)), "n": pa.array(np.repeat(np.array([len(x) for x in sets], np.int32), sizes)), "i": pa.array(place.astype(np.int32))}

        return step

    return map_slices(texts, ["node", "text"], "text", "node long, token long, n int, i int", make)


def may_link(percent: int, n: str, i: str, m: str, j: str):
    """Whether sets of sizes n and m, whose rarest shared token is at places i and j, can be similar enough."""
    need = f"{percent} * (cast({n} as long) + {m})"
    return F.expr(f"{100 + percent} * (cast({n} as long) - {i}) >= {need} and {100 + percent} * (cast({m} as long) - {j}) >= {need} and 100 * {n} >= {percent} * {m} and 100 * {m} >= {percent} * {n}")


def other_prefixes(texts: DataFrame, tables, n: int, percent: int) -> DataFrame:
    """(node, p1, p2, ...): each text's prefixes under the orders after the first; a task writes equal texts once."""
    orders = range(1, ORDERS)

    def make():
        seen = set()

        def step(part: pa.RecordBatch) -> dict:
            fresh = [i for i, x in enumerate(part.column(0).to_pylist()) if x not in seen and not seen.add(x)]
            if len(seen) > 1_000_000:
                seen.clear()
            part = part.take(pa.array(fresh, pa.int64()))
            sets = shingle_sets(part.column(1), n)
            return {"node": part.column(0)} | {f"p{o}": pa.array([ordered(x, tables.value[o], o, percent).view(np.int64) for x in sets], pa.list_(pa.int64())) for o in orders}

        return step

    return map_slices(texts, ["node", "text"], "text", "node long, " + ", ".join(f"p{o} array<bigint>" for o in orders), make)


def verify(pairs: DataFrame, texts: DataFrame, tables, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: of those that share prefix tokens under every further order too, texts are compared."""

    def texts_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().checkpoint()
        few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        return texts.select("node", "text").join(F.broadcast(nodes) if few else nodes, "node", "left_semi")

    found = other_prefixes(texts_of(pairs), tables, n, percent)
    names = [c for c in found.columns if c != "node"]
    prefix = found.groupBy("node").agg(*[F.first(p).alias(p) for p in names])
    side = lambda c: prefix.select(F.col("node").alias(c), *[F.col(p).alias(p + c) for p in names])
    meet = F.lit(True)
    for p in names:
        meet = meet & F.arrays_overlap(p + "a", p + "b")
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(meet).select("a", "b").checkpoint()
    own = texts_of(near).groupBy("node").agg(F.first("text").alias("text"))
    both = near.join(own.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a"), "a").join(own.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b")

    def make():
        def step(part: pa.RecordBatch) -> dict:
            keep = []
            for i, (x, y) in enumerate(zip(shingle_sets(part.column(2), n), shingle_sets(part.column(3), n))):
                shared = len(np.intersect1d(x, y, True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            return {"a": part.column(0).take(pa.array(keep, pa.int64())), "b": part.column(1).take(pa.array(keep, pa.int64()))}

        return step

    return map_slices(both, ["a", "b", "text_a", "text_b"], "text_a", "a long, b long", make)


def similar_rows(docs: DataFrame, n: int = 5, percent: int = 80, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node, n_shingles, component, `also`) of each row of (doc_id, text): equal texts are one node, linked ones one component."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("node"), text.alias("text"))
    measured = measure(texts, n).checkpoint()
    tables = spark.sparkContext.broadcast(sum_blocks(measured))
    rows = prefix_rows(texts, tables, n, percent)

    token = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    shared = rows.join(token, "token", "left_semi").distinct().checkpoint()
    pivots = shared.groupBy("token").agg(F.min(F.struct("i", "n", "node")).alias("p")).select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"))
    stars = shared.join(pivots, "token").where((F.col("node") != F.col("pivot")) & may_link(percent, "n", "i", "pn", "pi")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct().checkpoint()
    links = verify(stars, texts, tables, n, percent).checkpoint()
    group = components(links).checkpoint()

    placed = shared.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    open_rows = placed.join(mixed, "token", "left_semi").checkpoint()
    other = open_rows.select("token", *[F.col(c).alias(c + "2") for c in ("node", "n", "i", "component")])
    rest = open_rows.join(other, "token").where((F.col("node") < F.col("node2")) & (F.col("component") != F.col("component2")) & may_link(percent, "n", "i", "n2", "i2"))
    pairs = rest.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(stars, ["a", "b"], "left_anti").checkpoint()
    if not pairs.isEmpty():
        links = links.unionByName(verify(pairs, texts, tables, n, percent)).checkpoint()
        group = components(links).checkpoint()

    every = measured.where("block is null").select("doc_id", "node", "n_shingles")
    if also:
        sizes = every.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
        every = docs.select("doc_id", F.xxhash64(text).alias("node"), *also).join(sizes, "node")
    return every.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")).select("doc_id", "node", "n_shingles", "component", *also)


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text): the least id that it reaches by links."""
    every = similar_rows(docs, n, percent)
    linked = every.where("n_shingles > 0")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id")).checkpoint()  # so that the join below shuffles its sides on its own and can be split
    return linked.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
