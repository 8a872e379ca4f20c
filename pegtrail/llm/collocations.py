"""Phrases whose words stand together more often than apart, mined by shards (SON) and counted exactly.

Texts are split at `.,;:!?` and x0A-x0D into pieces and those at spaces and tabs into words, A-Z taken as a-z. f of a phrase is
its number of occurrences within pieces, overlaps included, n a language's number of words. Candidates are phrases of 2 to
LONGEST words with f of at least `support`. A candidate's cut after k words scores floor(2000000 * f / (f(first) + f(rest)));
the lowest cut counts, ties to the smallest k. A candidate goes if a longer one holds it with at least `held` per cent of its f.

Method: documents fall into `shards` by a hash of their text. A phrase of `support` occurrences has, in one shard at least, its
share of them: support times the shard's words over all words of the language, rounded up. Each shard is mined completely at
that local support, level by level: a phrase is counted where both phrases of a word less are locally frequent. A shard is as
large as the corpus makes it, is spread over all tasks and is never held by one: tasks count by 64-bit keys, Spark sums the
keys. What is frequent in a shard goes to the tasks as a table of fixed size, whatever the corpus's size; keys or bits that
meet let more phrases through and none less. The union of the shards' phrases, without those that can't reach the
support even if all other shards just miss theirs, is then counted over all texts, by the words themselves, and those of
fewer than `support` occurrences go.

Memory: a task holds what Limits says and one such table (16 MB); so does the driver.

Defined cases: a null text is empty, a null language is `und`; empty tables give no rows; repeated rows count each; texts of any
length are whole; ties are ordered by the phrase's bytes; only lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pegtrail.llm.batches import shared_dir, small_batches
from pegtrail.llm.wordhash import Windows, Words, mix, text_bytes

LONGEST = 4


class Limits(NamedTuple):
    """Bytes of text that are counted at a time, keys and phrases that a task holds before it gives its counts, bits of a
    table of frequent phrases (a power of two). Results don't depend on them."""

    chunk: int = 2 << 20
    keys: int = 1_000_000
    phrases: int = 1_200_000
    bits: int = 1 << 27


#: Parts of a language whose best phrases are found before those of all of it.
PARTS = 8
_SHARD = 2654435769
_ORDER = np.array([k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(LONGEST + 1)], np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True


def _chunks(batches, chunk: int):
    """Arrow batches put together to `chunk` bytes of text or a little more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= chunk:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_PART = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 512


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), buffer=padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    out = length.astype(np.uint64) * _PART[which]
    todo, at = np.arange(len(start)), start
    while len(todo):
        left = end[todo] - at
        rare = left > _LONG
        if rare.any():
            for i in todo[rare].tolist():
                out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=bytes([which + 1])).digest(), "little")
            todo, at, left = todo[~rare], at[~rare], left[~rare]
        held = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))))
        out[todo] = mix((out[todo] ^ held) * _PART[which] + np.uint64(1))
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return out


class Phrases:
    """The words of a chunk (lang, text, shard) and keys of its phrases, which hold the language and the length."""

    def __init__(self, chunk: pa.Table):
        texts = chunk.column("text").combine_chunks()
        data, at = text_bytes(texts if isinstance(texts, pa.Array) else pa.array([], pa.string()))
        data = _LOW[data]
        self.words = w = Words(data, at, space=_APART)
        lang = chunk.column("lang").combine_chunks().dictionary_encode()
        self.names = lang.dictionary.to_pylist()
        self.langs = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
        of = w.text()
        self.lang = lang.indices.to_numpy()[of] if len(w) else np.zeros(0, np.int64)
        self.shard = chunk.column("shard").to_numpy()[of] if len(w) else np.zeros(0, np.int64)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        # how many words from each on follow within the piece: phrases of k words start where k - 1 words are joined
        self.joined = (of[1:] == of[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]]) if len(w) else np.zeros(0, bool)
        self.windows: dict[int, Windows] = {}

    def starts(self, k: int) -> np.ndarray:
        """Words at which a phrase of k words starts."""
        ok = np.ones(max(0, len(self.words) - k + 1), bool)
        for i in range(k - 1):
            ok &= self.joined[i : i + len(ok)]
        return np.flatnonzero(ok)

    def keys(self, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        if which not in self.windows:
            w = self.words
            self.windows[which] = Windows(_word_hashes(w.data, w.start, w.end, which), which)
        return self.windows[which].at(at, k) ^ (self.langs[self.lang[at]] + _ORDER[k])

    def text(self, at: int, k: int) -> str:
        w = self.words
        return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, at + k)).decode("utf-8", "replace")


def _known(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit & np.uint64(64 * len(table) - 1)
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _local_bit(keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return keys ^ (shard.astype(np.uint64) * np.uint64(_SHARD))


def _summed(parts: list) -> list:
    """(lang, shard, key, n) arrays with each key of a shard once; a key holds its language."""
    lang, shard, key, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(_local_bit(key, shard))
    lang, shard, key, n = lang[order], shard[order], key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])) if len(key) else np.zeros(0, np.int64)
    return [lang[first], shard[first], key[first], np.add.reduceat(n, first) if len(first) else n[:0]]


def _count_level(docs: DataFrame, k: int, below: np.ndarray | None, limits: Limits) -> DataFrame:
    """lang, shard, key, n: occurrences of phrases of k words both of whose parts are locally frequent, by task."""
    table = None if below is None else docs.sparkSession.sparkContext.broadcast(below)
    schema = pa.schema([("lang", pa.int64()), ("shard", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        def given(part):
            for at in range(0, len(part[2]), 100_000):
                lang, shard, key, n = (x[at : at + 100_000] for x in part)
                yield pa.RecordBatch.from_arrays([pa.array(lang.view(np.int64)), pa.array(shard.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n)], schema=schema)

        held, size = [], 0
        for chunk in _chunks(batches, limits.chunk):
            p = Phrases(chunk)
            at = p.starts(k)
            if table is not None and len(at):
                parts = p.starts(k - 1)
                good = np.zeros(len(p.words), bool)
                good[parts] = _known(table.value, _local_bit(p.keys(parts, k - 1), p.shard[parts]))
                at = at[good[at] & good[at + 1]]
            if len(at):
                held.append(_summed([[p.langs[p.lang[at]], p.shard[at].astype(np.int64), p.keys(at, k), np.ones(len(at), np.int64)]]))
                size += len(held[-1][2])
            if size > limits.keys:
                held = [_summed(held)]
                size = len(held[0][2])
                if size > limits.keys // 2:
                    yield from given(held[0])
                    held, size = [], 0
        if held:
            yield from given(_summed(held))

    return docs.mapInArrow(run, "lang long, shard int, key long, n long").groupBy("lang", "shard", "key").agg(F.sum("n").alias("n"))


def _bits(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """The table of the rows' keys: at most bits / 64 rows come to the driver."""
    words = rows.select(F.expr(f"({key}) & {bits - 1}L").alias("bit")).groupBy(F.shiftrightunsigned("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = np.zeros(bits // 64, np.uint64)
    found = words.toArrow()
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


class _Held:
    """Phrases that a task has counted: two keys and a count each, in the order of the first key, and the phrase itself once."""

    def __init__(self):
        self.key = self.other = np.zeros(0, np.uint64)
        self.n = self.name = np.zeros(0, np.int64)
        self.names: list[str] = []
        self.langs: list[str] = []
        self.words: dict[str, int] = {}

    def add(self, key: np.ndarray, other: np.ndarray, n: np.ndarray, name_of) -> None:
        place = np.searchsorted(self.key, key)
        near = np.minimum(place, max(0, len(self.key) - 1))
        there = (self.key[near] == key) & (self.other[near] == other) if len(self.key) else np.zeros(len(key), bool)
        self.n[place[there]] += n[there]  # keys of one call differ, so no place comes twice
        new = np.flatnonzero(~there)
        at = place[new]
        self.key, self.other, self.n = np.insert(self.key, at, key[new]), np.insert(self.other, at, other[new]), np.insert(self.n, at, n[new])
        self.name = np.insert(self.name, at, len(self.names) + np.arange(len(new)))
        for i in new.tolist():
            lang, phrase = name_of(i)
            self.langs.append(sys.intern(lang))
            self.names.append(phrase)

    def given(self):
        for lang, n in self.words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([""], pa.string()), pa.array([n], pa.int64())], names=["lang", "phrase", "n"])
        for at in range(0, len(self.key), 50_000):
            which = self.name[at : at + 50_000].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([self.langs[i] for i in which], pa.string()), pa.array([self.names[i] for i in which], pa.string()), pa.array(self.n[at : at + 50_000])], names=["lang", "phrase", "n"])


def _count_phrases(docs: DataFrame, wanted: np.ndarray, limits: Limits) -> DataFrame:
    """lang, phrase, n of all phrases that the table lets through; the empty phrase counts the language's words.

    A task gives each of its phrases once, so it takes two splits of the input where there are more than cores: most phrases
    are in many splits.
    """
    splits, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.coalesce(max(1, min(splits, max(cores, splits // 2))))
    table = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        held = _Held()
        for chunk in _chunks(batches, limits.chunk):
            p = Phrases(chunk)
            for i, n in enumerate(np.bincount(p.lang, minlength=len(p.names)).tolist()):
                held.words[p.names[i]] = held.words.get(p.names[i], 0) + n
            for k in range(1, LONGEST + 1):
                at = p.starts(k)
                keys = p.keys(at, k)
                kept = _known(table.value, keys)
                at, keys = at[kept], keys[kept]
                if not len(at):
                    continue
                order = np.argsort(keys)
                at, keys = at[order], keys[order]
                other = p.keys(at, k, 1)
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])]))
                held.add(keys[first], other[first], np.diff(np.append(first, len(at))), lambda i, k=k, at=at[first]: (p.names[p.lang[at[i]]], p.text(at[i], k)))
            if len(held.names) > limits.phrases:
                yield from held.given()
                held = _Held()
        yield from held.given()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(documents: DataFrame, support: int = 30, shards: int = 4, limits: Limits = Limits()) -> DataFrame:
    """lang, phrase, n: phrases of 1 to LONGEST words with at least `support` occurrences; the empty phrase has the language's words."""
    small_batches(documents.sparkSession)
    shared_dir(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"))
    below, least, slack, union = None, None, None, []
    for k in range(1, LONGEST + 1):
        counts = _count_level(docs, k, below, limits)
        if least is None:
            counts = counts.checkpoint()
            own = counts.groupBy("lang", "shard").agg(F.sum("n").cast("decimal(38,0)").alias("own"))
            every = own.groupBy("lang").agg(F.sum("own").cast("decimal(38,0)").alias("every"))
            least = own.join(every, "lang").select("lang", "shard", F.expr(f"cast(({support} * own + every - 1) div every as long)").alias("least")).checkpoint()
            slack = least.groupBy("lang").agg((F.sum("least") - F.count("*")).alias("slack"))
        frequent = counts.join(least, ["lang", "shard"]).where("n >= least").select("lang", "shard", "key", "n", "least").checkpoint()
        # a shard without the phrase among its frequent ones has it less often than its local support
        most = frequent.groupBy("lang", "key").agg(F.sum(F.col("n") - F.col("least") + 1).alias("most")).join(slack, "lang")
        union.append(most.where(F.col("most") + F.col("slack") >= support).select("key"))
        below = _bits(frequent, f"key ^ (cast(shard as bigint) * {_SHARD}L)", limits.bits) if k < LONGEST else None
    keys = union[0]
    for more in union[1:]:
        keys = keys.unionByName(more)
    return _count_phrases(docs, _bits(keys, "key", limits.bits), limits).where(f"n >= {support} or phrase = ''")


def collocations(documents: DataFrame, support: int = 30, held: int = 80, best: int = 2000, shards: int = 4, limits: Limits = Limits()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases by score and a descending, then by phrase."""
    f = phrase_counts(documents, support, shards, limits).checkpoint()
    words = F.split("phrase", " ")
    c = f.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.size(words).alias("m"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    left, right = f.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), f.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r) as long)")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.max("a").alias("a"))
    inner = c.where("m > 2").select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k")).select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)).alias("at"))
    above = inner.groupBy("lang", part(F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(above, ["lang", "phrase"], "left").where(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {held} * cast(a as decimal(20, 0))").select("lang", "phrase", "a", "cut.*")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    total = f.where("phrase = ''").select("lang", "n")
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: collocations() of the table documents: all phrases counted, no shards.
ORACLE = r"""
with w as (select coalesce(lang, 'und') as lang, unnest(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]'), lambda x: regexp_extract_all(x, '[^ \t]+'))) as w from documents),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by 1),
f as (select lang, array_to_string(g, ' ') as phrase, any_value(len(g)) as m, any_value(g) as g, count(*) as a
  from (select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g from w, (values (1), (2), (3), (4)) v(k) where len(w) >= k) group by 1, 2 having count(*) >= 30),
cut as (select c.lang, c.phrase, c.a, k, l.a as l, r.a as r, cast((2000000::hugeint * c.a) // (l.a + r.a) as bigint) as score
  from (select *, unnest(range(1, m)) as k from f where m > 1) c join f l on l.lang = c.lang and l.phrase = array_to_string(c.g[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.g[k + 1:], ' ')),
low as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as best from cut) where best = 1),
ins as (select lang, array_to_string(g[i:i + k - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, m - k + 2)) as i from (select *, unnest(range(2, m)) as k from f where m > 2)) group by 1, 2),
kept as (select low.* from low left join ins on ins.lang = low.lang and ins.phrase = low.phrase where longer is null or 100::hugeint * longer < 80::hugeint * low.a),
top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select top.lang, rank, phrase, a, l, r, n, score from top join n on n.lang = top.lang where rank <= 2000
"""
