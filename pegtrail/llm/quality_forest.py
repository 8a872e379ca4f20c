"""Quality rules by an isolation forest over rule statistics.

Each whole text gives rule statistics: words, letters a word, symbols, repeated lines, words in repeated windows,
capitals, words equal to the one before, digits. A forest of random trees, each grown on its own bounded sample of rows as the method asks, scores
every document by the mean length of its path: the shorter, the more anomalous. The threshold is the one that best
separates the labelled rows, counted over all of them, among thresholds that lose at most `lost` of the good ones.

The base rules (too few words, too many repeated ones) fail a document whatever the forest says.

Defined cases: a null or empty text has no words and fails the base rules; with no documents that pass them no forest
is grown; with labels of one kind only, or none, no document is rejected by the forest; a null label is none; an id
with several labels is good if their mean is above a half; repeated rows give equal rows; equal statistics get equal
scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegtrail.llm.batches import map_slices, shared_dir
from pegtrail.llm.wordhash import Windows, Words, text_bytes

WINDOW = 8
#: The forest: trees, and rows that each is grown on. Their product bounds the rows that reach the driver.
TREES, GROWN_ON = 128, 256
#: Score steps in which labelled rows are counted.
STEPS = 2000
#: Most of the good labelled documents that the threshold may reject.
LOST = 0.005

#: Words that a text's rates are drawn towards the sample's rates by, so that short texts aren't anomalous by chance.
PRIOR_WORDS = 60
#: The same for repeated lines, in lines.
PRIOR_LINES = 4

_STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_same_words", "n_digits")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def repeat_words(words: Words) -> np.ndarray:
    """For each text, the words in 8-word windows that it has twice or more."""
    n_texts = len(words.first) - 1
    starts = np.flatnonzero(words.left() >= WINDOW)
    if not len(starts):
        return np.zeros(n_texts, np.int64)
    text = words.text()
    hashes = Windows(words.hashes()).at(starts, WINDOW) + text[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    begin = np.zeros(len(words) + WINDOW + 1, np.int64)
    again = starts[count[back] > 1]
    np.add.at(begin, again, 1)
    np.add.at(begin, again + WINDOW, -1)
    covered = np.cumsum(begin)[: len(words)] > 0
    return np.bincount(text, covered, n_texts).astype(np.int64)


def dup_lines(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the lines with a word that equal an earlier one, and all lines."""
    raw = data.tobytes()
    dup, every = [], []
    for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist()):
        lines = raw[a:b].split(b"\n")
        every.append(len(lines))
        if len(lines) > 1:
            lines = [x for x in lines if x.split(None, 1)]
            dup.append(len(lines) - len(set(lines)))
        else:
            dup.append(0)
    return np.array(dup, np.int64), np.array(every, np.int64)


def rule_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words and the statistics) of each whole text."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def step(part: pa.RecordBatch) -> dict:
            data, text_at = text_bytes(part.column(1))
            words = Words(data, text_at)
            sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[text_at])
            hashes = words.hashes()
            same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) & (words.place() > 0) if len(words) else np.zeros(0, bool)
            space = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
            dup, lines = dup_lines(data, text_at)
            return {
                key: part.column(0), "n_words": np.diff(words.first), "word_chars": sums(((data & 0xC0) != 0x80) & ~space), "n_symbols": sums(_SYMBOLS[data]), "n_dup_lines": dup,
                "n_repeat_words": repeat_words(words), "n_lines": lines, "n_capitals": sums((data >= 65) & (data <= 90)), "n_same_words": np.bincount(words.text(), same, len(part)).astype(np.int64),
                "n_digits": sums((data >= 48) & (data <= 57)),
            }

        return step

    return map_slices(df, [key, text], text, f"`{key}` {kind}, n_words long, " + ", ".join(f"{c} long" for c in _STATS), make)


#: What the trees split on, each a statistic and what it is counted by, and by which words it is drawn towards the mean.
_RATES = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_capitals", "word_chars"), ("n_same_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_digits", "word_chars"))


def splits_on(stats: np.ndarray, means: np.ndarray) -> np.ndarray:
    """What the trees split on: letters, symbols, same words and repeated words a word, capitals and digits a letter,
    repeated lines a line, drawn towards `means`. `stats` has n_words and the statistics as columns.
    """
    at = {c: i for i, c in enumerate(("n_words", *_STATS))}
    column = lambda c: stats[:, at[c]].astype(np.float64)
    of = np.stack([column(a) for a, _ in _RATES], 1)
    by = np.stack([column(b) for _, b in _RATES], 1)
    prior = np.array([PRIOR_LINES if b == "n_lines" else PRIOR_WORDS * (means[0] if b == "word_chars" else 1) for _, b in _RATES])
    return (of + prior * means) / (by + prior)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.RandomState, depth: int) -> list[tuple]:
    """A tree as a list of nodes: (feature, split, left, right), or (-1, path length left, 0, 0)."""
    nodes: list[tuple] = [()]
    todo = [(0, rows, 0)]
    while todo:
        at, own, level = todo.pop()
        low, high = own.min(0), own.max(0)
        varied = np.flatnonzero(high > low)
        if level >= depth or len(own) < 2 or not len(varied):
            nodes[at] = (-1, expected_path(len(own)), level, 0)
            continue
        f = int(rng.choice(varied))
        split = rng.uniform(low[f], high[f])
        below = own[:, f] <= split
        if below.all():
            below = own[:, f] < high[f]
            split = float(own[below, f].max())
        nodes[at] = (f, float(split), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), own[below], level + 1), (len(nodes) + 1, own[~below], level + 1)]
        nodes += [(), ()]
    return nodes


class Forest:
    def __init__(self, rows: np.ndarray, seed: int = 7):
        rng = np.random.RandomState(seed)
        size = min(GROWN_ON, len(rows))
        depth = max(1, math.ceil(math.log2(max(2, size))))
        self.depth, self.norm = depth, max(expected_path(size), 1e-9)
        self.trees = []
        for _ in range(TREES):
            nodes = grow(rows[rng.choice(len(rows), size, replace=False)], rng, depth)
            self.trees.append(tuple(np.array(x) for x in zip(*nodes)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 is anomalous, 0.5 and less is not."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, right in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                down = np.where(rows[every, np.maximum(f, 0)] <= split[at], left[at], right[at]).astype(np.int64)
                at = np.where(f < 0, at, down)
            total += split[at] + left[at]
        return np.exp2(-total / len(self.trees) / self.norm)


def best_threshold(counts: list[tuple[int, bool, int]], lost: float = LOST) -> float | None:
    """The score from which documents are rejected: from counts of (step, good, rows) of all labelled rows."""
    good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    for step, is_good, n in counts:
        (good if is_good else bad)[step] += n
    if not good.sum() or not bad.sum():
        return None
    above_good, above_bad = (x[::-1].cumsum()[::-1] / x.sum() for x in (good, bad))
    gain = np.where(above_good <= lost, above_bad - above_good, -1)
    best = int(np.argmax(gain))
    return best / STEPS if gain[best] > 0 else None


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lost: float = LOST) -> DataFrame:
    """(key, n_words, statistics, base_failed, score, kept) of each whole text; labels: (doc_id, quality)."""
    spark = docs.sparkSession
    shared_dir(spark)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = rule_statistics(docs, key, text).withColumn("base_failed", failed).checkpoint()
    names = ["n_words", *_STATS]
    passed, need = stats.where(~F.col("base_failed")), TREES * GROWN_ON
    summed = passed.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names]).first()
    # twice the need by hash, then the least hashes of those: what reaches the driver doesn't grow with the table
    share = min(1.0, 2 * need / max(1, summed["rows"]))
    by_hash = passed.select(*names, F.xxhash64(F.col(key), F.lit("forest")).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = by_hash.orderBy("h", *names).limit(need).select(*names).collect()
    if not sample:
        return stats.select(key, *names, "base_failed", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    rows = np.array([list(r) for r in sample], np.float64)
    means = np.array([summed[a] / max(1.0, summed[b]) for a, b in _RATES])  # of all rows that pass
    forest = Forest(splits_on(rows, means))
    kind = stats.schema[key].dataType.simpleString()

    def score(batches):
        for batch in batches:
            found = forest.score(splits_on(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 1 + len(names))], 1), means))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    scored = stats.select(key, *names, "base_failed").mapInArrow(score, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, score double").checkpoint()
    label = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg((F.avg("quality") > 0.5).alias("good"))
    rows = scored.where(~F.col("base_failed")).join(label, F.col(key) == F.col("labelled")).groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("step"), "good").count().collect()
    limit = best_threshold([(r["step"], r["good"], r["count"]) for r in rows], lost)
    kept = ~F.col("base_failed") & (F.floor(F.col("score") * STEPS) < F.lit(round((limit or 2) * STEPS)))
    return scored.withColumn("kept", kept)
