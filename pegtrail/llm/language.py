"""Language identification of mixed texts.

Each word is scored under every language by its character trigrams (hashed into a fixed number of buckets, with
add-one-half smoothing). The ranges of its letters' script narrow the languages that it may have to those that the
training texts show in that script. A Viterbi path over the words, with a penalty for each switch, labels spans.

Counts for the model are made by Spark over all training texts; what the driver holds is languages times buckets.

A text whose best language can't be beaten on any stretch of words by more than one switch costs needs no path search
(the path is then constant); the others are searched together, word by word over all texts of a slice.

Defined cases: a null text, or one without a letter, is `und` with score 0 and no spans; without training texts every
text is `und`; words without a letter take the language around them and count for none; equal scores go to the first
language in code point order; repeated rows give equal rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pegtrail.llm.batches import map_slices, strings

BUCKETS = 1 << 16
#: Cost of a switch, in nats.
PENALTY = 12.0
#: A script is open to a language if at least this share of the language's training words is in it.
SCRIPT_SHARE = 0.002
#: Characters scored at a time.
CHUNK = 1 << 20

# Where scripts begin (code point, script), up to the next line. "" is no script of its own.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0xA4D0, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"), (0x323B0, ""),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and the number of its script."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    at = np.searchsorted([a for a, _ in SCRIPTS], np.arange(0x110000), "right") - 1
    return letters, np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int8)[at]


class Slice:
    """Words and trigrams of some texts. `word_text`: the text of each word; `tri`, `tri_word`: bucket and word of each trigram."""

    def __init__(self, texts: list[str]):
        letters, scripts = _tables()
        lowered = [x.lower() for x in texts]
        points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        space = (points <= 32) | (points == 0xA0) | (points == 0x3000)
        points = np.where(space, 32, points)
        at = np.flatnonzero(~space)
        first = space[at - 1]
        self.tri_word = np.cumsum(first) - 1
        key = (points[at - 1] * 0x10001 + points[at]) * 0x10001 + points[at + 1]
        self.tri = ((key * 0x9E3779B1) >> 12) & (BUCKETS - 1)
        starts = np.flatnonzero(first)
        ends = np.cumsum([1 + len(x) for x in lowered])
        self.word_text = np.searchsorted(ends, at[starts], "right")
        letter = letters[points[at]]
        word_letters = np.add.reduceat(letter, starts) if len(starts) else np.zeros(0, np.int64)
        self.has_letter = word_letters > 0
        marked = np.where(letter, scripts[points[at]], -1)
        self.script = np.maximum.reduceat(marked, starts) if len(starts) else np.zeros(0, np.int8)
        self.starts = starts


def chunks(texts: list[str]):
    """Ranges of texts of about CHUNK characters."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > CHUNK:
            yield at, i
            at, held = i, 0
        held += len(x)
    if at < len(texts):
        yield at, len(texts)


def count_training(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigrams by bucket, and words by script as buckets below 0, over all rows with a language."""

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = strings(batch.column(0)), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                own = [x for x, y in zip(texts, langs) if y == name]
                total = found.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                for a, b in chunks(own):
                    s = Slice(own[a:b])
                    keep = s.has_letter[s.tri_word]
                    total[:BUCKETS] += np.bincount(s.tri[keep], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(s.script[s.has_letter], minlength=len(SCRIPT_NAMES))
        for name, total in found.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(np.where(full < BUCKETS, full, BUCKETS - 1 - full).astype(np.int32)), pa.array(total[full])], ["lang", "bucket", "n"])

    part = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    return part.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of buckets under each language, and which languages each script is open to."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((BUCKETS, len(self.langs)))
        words = np.zeros((len(SCRIPT_NAMES), len(self.langs)))
        for name, bucket, n in rows:
            (counts if bucket >= 0 else words)[bucket if bucket >= 0 else -1 - bucket, self.langs.index(name)] = n
        self.log = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32) if self.langs else counts
        share = words / np.maximum(words.sum(0), 1)
        opened = share >= SCRIPT_SHARE
        opened[~opened.any(1)] = True
        self.shut = np.where(opened, 0.0, -1e4).astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words under each language, whether they have a letter, and the words' text."""
        every = [[], [], []]
        for a, b in chunks(texts):
            s = Slice(texts[a:b])
            if not len(s.starts):
                continue
            score = np.stack([np.add.reduceat(self.log[s.tri, i], s.starts) for i in range(len(self.langs))], 1)
            score += self.shut[s.script]
            score[~s.has_letter] = 0
            for out, x in zip(every, (score, s.has_letter, s.word_text + a)):
                out.append(x)
        if not every[0]:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, bool), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in every)

    def label(self, texts: list[str], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The language number of each word on its text's best path; scores, letters and texts of the words."""
        score, has_letter, text = self.scores(texts)
        n = len(texts)
        first = np.searchsorted(text, np.arange(n + 1))
        path = np.zeros(len(text), np.int64)
        if not len(text):
            return path, score, has_letter, text
        total = np.stack([np.bincount(text, score[:, i].astype(np.float64), n) for i in range(score.shape[1])], 1)
        best = total.argmax(1)
        path[:] = best[text]
        if score.shape[1] > 1:
            rest = score.astype(np.float64)
            own = rest[np.arange(len(text)), path]
            rest[np.arange(len(text)), path] = -np.inf
            gain = np.maximum(rest.max(1) - own, -1e6)
            step = 4 * (np.abs(gain).sum() + 1)
            run = np.concatenate([[0.0], np.cumsum(gain)])
            base = np.cumsum(gain) - gain - step * text  # sums before each word, lower for each later text
            low = np.minimum.accumulate(base) + step * text
            most = np.zeros(n)
            np.maximum.at(most, text, run[1:] - low)
            search = np.flatnonzero(most > penalty * 0.999)
            self.search(score, first, search, penalty, path)
        return path, score, has_letter, text

    def search(self, score: np.ndarray, first: np.ndarray, which: np.ndarray, penalty: float, path: np.ndarray) -> None:
        """Viterbi over the texts in `which`, all at once, word by word; writes into `path`."""
        lengths = first[which + 1] - first[which]
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[which][order], lengths[order]
        if not len(begin) or not lengths[0]:
            return
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        value = np.zeros((len(begin), score.shape[1]))
        own = np.arange(score.shape[1], dtype=np.int32)
        back = np.zeros(score.shape, np.int32)
        for t in range(int(lengths[0])):
            k = active[t]
            at = begin[:k] + t
            v = value[:k]
            if t:
                top = v.argmax(1)
                most = v[np.arange(k), top] - penalty
                stay = v >= most[:, None]
                back[at] = np.where(stay, own, top[:, None])
                v = np.where(stay, v, most[:, None])
            value[:k] = v + score[at]
        state = value.argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            k = active[t]
            at = begin[:k] + t
            path[at] = state[:k]
            if t:
                state[:k] = back[at, state[:k]]


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, spans) and the columns in `also` as they are: `spans` are runs of words of one language as (first word, end, lang).

    The prediction is the language of most words with a letter; its score is their share times the softmax of the
    languages' total scores.
    """
    kind = df.schema[key].dataType.simpleString()
    more = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in also)

    def make():
        def step(part: pa.RecordBatch) -> dict:
            texts = strings(part.column(1))
            n, langs = len(texts), model.langs
            lang, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            if langs:
                path, words, has_letter, text_of = model.label(texts)
                counts = np.stack([np.bincount(text_of[(path == i) & has_letter], minlength=n) for i in range(len(langs))], 1)
                total = np.stack([np.bincount(text_of, words[:, i].astype(np.float64), n) for i in range(len(langs))], 1)
                best, every = counts.argmax(1), counts.sum(1)
                soft = 1 / np.exp(np.clip(total - total[np.arange(n), best][:, None], -700, 700)).sum(1)
                lettered = np.flatnonzero(every > 0)
                for i in lettered.tolist():
                    lang[i] = langs[best[i]]
                    score[i] = float(counts[i, best[i]] / every[i] * soft[i])
                first = np.searchsorted(text_of, np.arange(n + 1))
                change = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])])) if len(path) else np.zeros(0, int)
                for a, b in zip(change.tolist(), [*change[1:].tolist(), len(path)]):
                    t = int(text_of[a])
                    if every[t]:
                        spans[t].append({"first": int(a - first[t]), "end": int(b - first[t]), "lang": langs[path[a]]})
            return {key: part.column(0), "lang_pred": lang, "score": score, "spans": spans} | {c: part.column(2 + i) for i, c in enumerate(also)}

        return step

    return map_slices(df, [key, text, *also], text, f"`{key}` {kind}, lang_pred string, score double, spans array<struct<first:bigint,end:bigint,lang:string>>{more}", make)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


#: Languages that a model may have: with 65,536 counts each the driver and every task hold 256 MB at most.
MOST_LANGUAGES = 500


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows of `df`; more than MOST_LANGUAGES values of `lang` raise an error."""
    if df.select(lang).distinct().limit(MOST_LANGUAGES + 2).count() > MOST_LANGUAGES + 1:  # one may be null
        raise ValueError(f"over {MOST_LANGUAGES} values of {lang}: a model of them would not fit in the driver's memory")
    return Model([tuple(r) for r in count_training(df, text, lang).collect()])
