"""Structured Streaming over landed files: weekly counts, repeats, identities, supersession, holds, health and the spine.

State is keyed by (source, height), so that a hot source is many keys. Stateful processors keep one small row for a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pegtrail.session import importable

EVENT_SCHEMA = "event_id long, ts timestamp, source_id long, child_height long, child_hash string, parent_hash string, confirmed_at long"


def capture_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files: int = 8) -> DataFrame:
    """Landed Parquet files as a stream, `files` a trigger: the checkpoint is the cursor."""
    importable(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def weekly_stream(events: DataFrame, delay: str = "14 days") -> DataFrame:
    """(week, source_id, n) by Monday weeks."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "source_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "source_id", "n")


def dedupe_stream(events: DataFrame, key: str = "event_id", delay: str = "14 days") -> DataFrame:
    """Each landed document once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


class Supersede(StatefulProcessor):
    """Keeps the last confirmed child hash of a (source, height); gives out a row whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "confirmed_at long, event_id long, child_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.last.get()) if self.last.exists() else None
        best = now
        for frame in rows:
            for row in frame[["confirmed_at", "event_id", "child_hash"]].itertuples(index=False, name=None):
                if row[2] is not None and (best is None or row > best):
                    best = (int(row[0]), int(row[1]), row[2])
        if best is not None and best != now:
            self.last.update(best)
            if now is None or now[2] != best[2]:
                yield pd.DataFrame([(key[0], key[1], best[2], now[2] if now else None)], columns=["source_id", "child_height", "child_hash", "superseded"])

    def close(self) -> None:
        pass


def supersede_stream(events: DataFrame) -> DataFrame:
    """(source_id, child_height, child_hash, superseded): the newest hash of each height, again when it changes."""
    return events.groupBy("source_id", "child_height").transformWithStateInPandas(Supersede(), "source_id long, child_height long, child_hash string, superseded string", "Append", "None")


class Identity(StatefulProcessor):
    """Best evidence of a (source, height, parent): a full identity replaces a partial one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "child_hash string, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        have = tuple(self.best.get()) if self.best.exists() else None
        every = sorted(((r.child_hash if isinstance(r.child_hash, str) else None, int(r.event_id)) for frame in rows for r in frame.itertuples()), key=lambda x: x[1])
        for child, event in every:
            if have is None:
                have, what = (child, event), "inserted"
            elif child is None:
                what = "satisfied" if have[0] else "updated"
            elif have[0] is None:
                have, what = (child, have[1]), "promoted"
            else:
                what = "updated" if have[0] == child else "contradictory"
            out.append((event, have[1], what))
        self.best.update(have)
        yield pd.DataFrame(out, columns=["event_id", "match_id", "disposition"])

    def close(self) -> None:
        pass


def identity_stream(events: DataFrame) -> DataFrame:
    """(event_id, match_id, disposition) of each observation as it lands."""
    return events.groupBy("source_id", "child_height", "parent_hash").transformWithStateInPandas(Identity(), "event_id long, match_id long, disposition string", "Append", "None")


class Hold(StatefulProcessor):
    """Holds evidence without a child hash until one lands; counts tries and gives up after `most`."""

    def __init__(self, most: int = 20):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "event_id long, tries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = tuple(self.held.get()) if self.held.exists() else None
        for child, event in sorted(((r.child_hash if isinstance(r.child_hash, str) else None, int(r.event_id)) for frame in rows for r in frame.itertuples()), key=lambda x: x[1]):
            if child is not None:
                out.append((held[0] if held else event, "resolved"))
                held = None
            elif held is None:
                held = (event, 1)
            elif held[1] + 1 >= self.most:
                out.append((held[0], "dead_letter"))
                held = None
            else:
                held = (held[0], held[1] + 1)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        yield pd.DataFrame(out, columns=["event_id", "outcome"])

    def close(self) -> None:
        pass


def hold_stream(events: DataFrame, most: int = 20) -> DataFrame:
    """(event_id, outcome) of held evidence: resolved, or given up after `most` tries."""
    return events.groupBy("source_id", "child_height").transformWithStateInPandas(Hold(most), "event_id long, outcome string", "Append", "None")


def progress(batch: DataFrame) -> DataFrame:
    """(source_id, cursor) of a batch: the greatest height of each source."""
    return batch.groupBy("source_id").agg(F.max("child_height").alias("cursor"))


def health_batch(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds each batch's counts by source to a Parquet table, a folder for each batch id.

    A batch that is tried again writes its own folder anew, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("source_id").agg(F.count("*").alias("events"), F.max("confirmed_at").alias("last_seen"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def health_of(spark: SparkSession, table: str) -> DataFrame:
    """Counts of all batches that health_batch wrote."""
    return spark.read.parquet(table).groupBy("source_id").agg(F.sum("events").alias("events"), F.max("last_seen").alias("last_seen"))


_SEEN = "event_id long, source_id long, parent_hash string, unknown boolean, confirmed_at long"
_KINDS = ("near", "unknown", "canonical", "stale", "error_block")


def _written(spark: SparkSession, folder: str, schema: str, below: int) -> DataFrame:
    """Rows of the batches before `below` in a folder that may not be there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").option("basePath", folder).parquet(folder).where(F.col("batch") < below).drop("batch")


def health_diff_batch(table: str, block: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps source health up to date: what each batch changes, by source, in a folder of its own.

    batch: event_id, source_id, parent_hash, parent_kind, confirmed_at of live events; block: gives (hash, kind, orphan_class). An
    event that lands again, in the same batch or a later one, counts once. Parents are counted before and after the batch,
    and only those that it touches are looked at: one that a source sees again adds nothing, one that turns from near to unknown moves.
    A batch that is tried again writes its own folders anew and reads those before it alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _written(spark, f"{table}/events", _SEEN, batch_id)
        once = batch.groupBy("event_id").agg(F.min("source_id").alias("source_id"), F.min("parent_hash").alias("parent_hash"), F.bool_or(F.col("parent_kind") == "unknown").alias("unknown"), F.max("confirmed_at").alias("confirmed_at"))
        new = once.join(seen.select("event_id"), "event_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/events/batch={batch_id}")
        new = spark.read.schema(_SEEN).parquet(f"{table}/events/batch={batch_id}")
        touched = new.select("source_id", "parent_hash").distinct()
        pairs = lambda rows: rows.groupBy("source_id", "parent_hash").agg(F.bool_or("unknown").alias("unknown"))
        before = pairs(seen.join(touched, ["source_id", "parent_hash"], "left_semi")).select("source_id", "parent_hash", F.col("unknown").alias("was"))
        both = pairs(new).join(before, ["source_id", "parent_hash"], "left")
        named = both.join(block(spark).select(F.col("hash").alias("parent_hash"), "kind", "orphan_class"), "parent_hash", "left")
        kind = lambda flag: F.coalesce("kind", F.when(flag, "unknown").otherwise("near"))
        rows = named.select("source_id", "orphan_class", kind(F.col("unknown") | F.coalesce("was", F.lit(False))).alias("now"), F.when(F.col("was").isNotNull(), kind(F.col("was"))).alias("then"))
        step = lambda test: F.sum(F.coalesce(test("now"), F.lit(False)).cast("long") - F.coalesce(test("then"), F.lit(False)).cast("long"))
        orphan = lambda cls: step(lambda c: (F.col(c) == "unknown") & (F.col("orphan_class") == cls))
        moved = rows.groupBy("source_id").agg(*[step(lambda c, k=k: F.col(c) == k).alias(k) for k in _KINDS], orphan("strict").alias("strict_orphan"), orphan("weak").alias("weak_orphan"))
        counts = new.groupBy("source_id").agg(F.count("*").alias("events"), F.max("confirmed_at").alias("last_seen"))
        counts.join(moved, "source_id").write.mode("overwrite").parquet(f"{table}/diffs/batch={batch_id}")

    return write


def health_now(spark: SparkSession, table: str, source: DataFrame) -> DataFrame:
    """Source health as rollups.source_health() gives it, from the changes that health_diff_batch wrote."""
    numbers = ("events", *_KINDS, "strict_orphan", "weak_orphan")
    diffs = _written(spark, f"{table}/diffs", "source_id long, " + ", ".join(f"{c} long" for c in numbers) + ", last_seen long", 1 << 62)
    sums = diffs.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in numbers], F.max("last_seen").alias("last_seen"))
    return source.select("source_id", "code").join(sums, "source_id", "left").select("source_id", "code", F.coalesce("events", F.lit(0)).alias("events"), "last_seen", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers[1:]])


def spine_batch(spine: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for canonical headers (hash, prev_hash, height): appends a batch, or fails on a conflict with the spine."""
    from pegtrail.operators.spine import spine_conflicts

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select("hash", "prev_hash", "height").distinct()
        low = own.agg(F.min("height").alias("lo")).first()["lo"]
        if low is None:
            return
        before = _written(spark, spine, "hash string, prev_hash string, height long", batch_id).where(F.col("height") >= low - 1)
        both = before.unionByName(own).distinct().withColumn("kind", F.lit("canonical"))
        bad = spine_conflicts(both).limit(1).collect()
        if bad:
            raise ValueError(f"spine conflict at {bad[0]['height']}: {bad[0]['conflict']}")
        own.write.mode("overwrite").parquet(f"{spine}/batch={batch_id}")

    return write
