"""Removal of repeated passages by level-wise doubling.

A passage is a window of 50 words of one document. A word goes if a window that covers it also starts in a document
with a smaller id. Windows of 13 words are looked at first; only those repeated in different texts are extended to 25
words, and only those repeated to 50, where no longer window needs to be known and the levels end.

Level 13 looks at anchors alone: a window of 13 words is one if it has the least hash in some window of 50. Every window
of 50 has one, at the same place wherever it stands, so none is lost, and a twentieth of the words start one. Level 25
has the two windows of 25 that begin or end with the anchor; a window of 50 that holds the anchor holds one of them.
Level 50 has every window of 50 that holds a repeated one of 25.

What is shuffled: anchors and windows as hashes (64 bits on the first levels, which only choose candidates, 128 bits on
the last), and the texts once, by id, for both joins that need them. Repeated keys are found by a grouping with map-side combine and joined back, which
Spark can split; the last level decides within each slice of texts first and sends on what no text there decides.

Defined cases: a null or empty text has no words; texts under 50 words stay whole; a null id counts as larger than all
others; rows that share an id are never smaller than each other; of equal texts all but those with the least id go
whole; other columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegtrail.llm.batches import map_slices, shared_dir
from pegtrail.llm.wordhash import Windows, Words, text_bytes

LONG, MIDDLE, SHORT = 50, 25, 13
#: Bytes of text within which the last level decides before it sends windows on.
DECIDE_BYTES = 4 << 20


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best(x[i : i + n]) for each i, by doubling; shorter at the end."""
    width = 1
    while width * 2 <= n:
        x = np.concatenate([best(x[:-width], x[width:]), x[-width:]]) if len(x) > width else x
        width *= 2
    gap = n - width
    return np.concatenate([best(x[:-gap], x[gap:]), x[-gap:]]) if gap and len(x) > gap else x


def anchors(words: Words, hashes: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the anchors and their hashes."""
    left = words.left()
    short = np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF))
    whole = np.flatnonzero(left >= SHORT)
    short[whole] = hashes.at(whole, SHORT)
    span = LONG - SHORT + 1
    least = sliding(short, span, np.minimum)
    least[left < LONG] = 0
    most = sliding(least[::-1], span, np.maximum)[::-1]  # the greatest of the least hashes of the windows that hold it
    at = np.flatnonzero((short == most) & (left >= SHORT) & (most > 0))
    return at, short[at]


def find_anchors(texts: DataFrame) -> DataFrame:
    """(rk, at, h, more): anchors of texts of 50 words or more; a task writes equal texts once.

    `more` has 32 bits of the hash of the window of 25 that begins with the anchor, and below them of the one that ends
    with it (0: none). With the anchor's own hash they tell such windows apart.
    """

    def make():
        seen: set[int] = set()

        def step(part: pa.RecordBatch) -> dict:
            fresh = [i for i, x in enumerate(part.column(0).to_pylist()) if x not in seen and not seen.add(x)]
            if len(seen) > 500_000:
                seen.clear()
            part = part.take(pa.array(fresh, pa.int64()))
            words = Words(*text_bytes(part.column(1)))
            hashes = Windows(words.hashes())
            at, h = anchors(words, hashes)
            text, place, left = words.text()[at], words.place()[at], words.left()[at]
            back, low = MIDDLE - SHORT, np.uint64(0xFFFFFFFF)
            right_ok, left_ok = left >= MIDDLE, place >= back
            more = np.zeros(len(at), np.uint64)
            more[right_ok] |= np.maximum(hashes.at(at[right_ok], MIDDLE) & low, np.uint64(1)) << np.uint64(32)
            more[left_ok] |= np.maximum(hashes.at(at[left_ok] - back, MIDDLE) & low, np.uint64(1))
            return {"rk": part.column(0).take(pa.array(text)), "at": pa.array(place.astype(np.int32)), "h": pa.array(h.view(np.int64)), "more": pa.array(more.view(np.int64))}

        return step

    return map_slices(texts, ["rk", "text"], "text", "rk long, at int, h long, more long", make)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in different texts."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("rk").alias("a"), F.max("rk").alias("b")).where("a <> b").select(key).checkpoint()  # else the join takes over the grouping's shuffle, and a hot key can't be split
    return df.join(keys, key, "left_semi")


def candidates(texts: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, rk, start, last, h1, h2): windows of 50 to be decided, or runs of starts (h2 null) that a slice has decided.

    `starts`: (id, rk, starts) of windows of 25 that are repeated.
    """
    joined = texts.join(starts.hint("shuffle_hash"), ["id", "rk"], "left")

    def make():
        def step(part: pa.RecordBatch) -> dict:
            rows = np.flatnonzero(np.array(part.column(2).is_valid()))  # doc_id is read for the sake of one exchange for both joins
            part = part.take(pa.array(rows))
            words = Words(*text_bytes(part.column(3)))
            text, left = words.text(), words.left()
            marks = np.zeros(len(words) + LONG + 1, np.int64)
            own = part.column(2)
            at = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at += np.repeat(words.first[:-1], np.diff(np.asarray(own.offsets)))
            begin = words.first[text[at]] if len(at) else at
            np.add.at(marks, np.maximum(at - (LONG - MIDDLE), begin), 1)
            np.add.at(marks, at + 1, -1)
            start = np.flatnonzero((np.cumsum(marks)[: len(words)] > 0) & (left >= LONG))
            h1, h2 = (Windows(words.hashes(i), i).at(start, LONG) for i in (0, 1))
            ids = part.column(0).to_numpy(zero_copy_only=False)[text[start]] if len(start) else np.zeros(0, np.int64)
            order = np.lexsort((ids, h2, h1))
            new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]) if len(start) else np.zeros(0, bool)
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(start) else ids
            decided = np.zeros(len(start), bool)
            decided[order] = ids[order] > least
            open_at, done = start[~decided], start[decided]
            edge = np.concatenate([[True], (np.diff(done) > 1) | (np.diff(text[done]) > 0)]) if len(done) else np.zeros(0, bool)
            run_first = done[edge]
            run_last = done[np.concatenate([np.flatnonzero(edge)[1:] - 1, [len(done) - 1]])] if len(done) else done
            place = words.place()
            firsts, lasts = np.concatenate([open_at, run_first]), np.concatenate([open_at, run_last])
            take = pa.array(text[firsts])
            spread = (run_first * 0x9E3779B1).astype(np.int64)  # decided runs are dealt out by a number of their own
            return {
                "id": part.column(0).take(take), "rk": part.column(1).take(take), "start": pa.array(place[firsts].astype(np.int32)), "last": pa.array(place[lasts].astype(np.int32)),
                "h1": pa.array(np.concatenate([h1[~decided].view(np.int64), spread])), "h2": pa.array(np.concatenate([h2[~decided].view(np.int64), spread]), mask=np.arange(len(firsts)) >= len(open_at)),
            }

        return step

    return map_slices(joined, ["id", "rk", "starts", "text", "doc_id"], "text", "id long, rk long, start int, last int, h1 long, h2 long", make, limit=DECIDE_BYTES)


def remove(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) from (id, rk, runs), each a run of window starts, or -1 for the whole text."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.join(gone.hint("shuffle_hash"), ["id", "rk"], "left")

    def make():
        def step(part: pa.RecordBatch) -> dict:
            out = {"n_words": [], "n_removed": [], "kept": []}
            data, text_at = text_bytes(part.column(2))
            raw = data.tobytes()
            for a, b, runs in zip(text_at[:-1].tolist(), text_at[1:].tolist(), part.column(1).to_pylist()):
                words = raw[a:b].split()
                n = len(words)
                if runs and n >= LONG:
                    if any(r["start"] < 0 for r in runs):
                        words = []
                    else:
                        mark = np.zeros(n + 1, np.int64)
                        np.add.at(mark, [r["start"] for r in runs], 1)
                        np.add.at(mark, [min(n, r["last"] + LONG) for r in runs], -1)
                        words = list(compress(words, (np.cumsum(mark)[:n] == 0).tolist()))
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode())
            return {"doc_id": part.column(0)} | out

        return step

    return map_slices(joined, ["doc_id", "runs", "text"], "text", f"doc_id {kind}, n_words long, n_removed long, kept string", make)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each whole text of (doc_id, text)."""
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))
    keys = texts.select("id", "rk", F.hash("text").alias("rk2"))
    firsts = keys.groupBy("rk", "rk2").agg(F.min("id").alias("least"))
    copies = keys.join(firsts, ["rk", "rk2"]).where("id > least").select("id", "rk").distinct()

    at_13 = repeated(find_anchors(texts), "h").checkpoint()
    right, left = F.shiftrightunsigned("more", 32), F.col("more").bitwiseAND(F.lit(0xFFFFFFFF))
    window = lambda at, bits, side: F.struct(at.alias("at"), F.when(bits != 0, F.xxhash64("h", bits, F.lit(side))).alias("h"))
    two = F.explode(F.array(window(F.col("at"), right, "right"), window(F.col("at") - (MIDDLE - SHORT), left, "left")))
    at_25 = repeated(at_13.select("rk", two.alias("w")).select("rk", "w.at", "w.h"), "h")
    starts = at_25.groupBy("rk").agg(F.collect_set("at").alias("starts")).join(firsts.select("rk", F.col("least").alias("id")), "rk")

    windows = candidates(texts, starts)
    least = F.min("id").over(W.partitionBy("h1", "h2"))
    gone = windows.withColumn("least", least).where(F.col("h2").isNull() | (F.col("least") < F.col("id"))).select("id", "rk", "start", "last")
    whole = copies.select("id", "rk", F.lit(-1).alias("start"), F.lit(-1).alias("last"))
    runs = gone.unionByName(whole).groupBy("id", "rk").agg(F.collect_list(F.struct("start", "last")).alias("runs"))
    return remove(texts, runs)


def digest(df: DataFrame) -> DataFrame:
    """The operator's rows with the kept text's sha256."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
