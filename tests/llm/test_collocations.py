import collections
import random
import re

from pegtrail.llm import collocations

SCHEMA = "phrase string, lang string, text string, n long, key long, shard string, rank int, doc_id long"
PIECE, WORD = re.compile("[.,;:!?\n\x0b\f\r]"), re.compile("[^ \t]+")


def frame(spark, rows):
    return spark.createDataFrame([("x", lang, text, 1, 2, "y", 3, 4) for lang, text in rows], SCHEMA)


def plain(rows, support, held=80, best=2000):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in PIECE.split(low):
            words = WORD.findall(piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        c = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        longer = collections.Counter()
        for p, a in c.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in c.items():
            if 100 * longer[p] < held * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def corpus(seed, n):
    rng = random.Random(seed)
    common = ["the", "of", "New", "york", "ÉTÉ", "été", "a", "b", "new york city", "one two three four five", "x"]
    rows = []
    for _ in range(n):
        bits = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), "".join(b + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " "]) for b in bits)))
    return rows


def test_small_corpus_equals_plain_counts(spark):
    rows = [*corpus(1, 250), ("en", None), (None, None), ("de", ""), ("fr", " .,;\n"), ("en", "a " * 5000), ("en", "long" * 50_000 + " tail " + "x" * 100_000)]
    rows += rows[:40]  # repeated rows
    want = plain(rows, 5)
    assert len({r[0] for r in want}) >= 4 and result(collocations.collocations(frame(spark, rows), support=5, shards=3)) == want


def test_ties_and_best(spark):
    rows = [("en", f"p{k} q{k}") for k in range(40) for _ in range(4)]
    got = result(collocations.collocations(frame(spark, rows), support=4, best=7))
    assert got == plain(rows, 4, best=7) and [r[2] for r in got] == sorted(f"p{k} q{k}" for k in range(40))[:7]


def test_flushed_counts_and_tight_tables(spark):
    """Counts given in many parts, and a table of few bits that lets nearly all phrases through, change nothing."""
    rows = corpus(2, 150)
    limits = collocations.Limits(chunk=20_000, keys=500, phrases=50, bits=1 << 10)
    assert result(collocations.collocations(frame(spark, rows), support=4, shards=2, limits=limits)) == plain(rows, 4)


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []


def test_whole_table_equals_plain_counts(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    assert result(collocations.collocations(table)) == plain([tuple(r) for r in table.select("lang", "text").collect()], 30)
