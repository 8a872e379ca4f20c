import hashlib
import random

import pytest
from brute import edit_distance, ngram_groups, normal_line, repeats_removed, union_find
from pyspark.sql import functions as F

from pegtrail.llm import components, line_dedup, ngram_join, substring_dedup

SCHEMA = "start int, doc_id long, text string, node long, component string, rk long, id long"


def frame(spark, docs):
    return spark.createDataFrame([(1, i, t, 2, "x", 3, 4) for i, t in docs], SCHEMA)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact copies, near copies of several strengths, shared passages, nulls and repeated rows."""
    rng = random.Random(3)
    docs, base = [], [words(rng, rng.randint(1, 300), 5000) for _ in range(30)]
    passage = words(rng, 70, 5000)
    for k, w in enumerate(base):
        docs.append((len(docs) + 10, " ".join(w)))
        for _ in range(k % 4):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 25))):
                v[rng.randrange(len(v))] = f"e{rng.random()}"
            docs.append((len(docs) + 10, "  ".join(v) if k % 2 else "\n".join(v).upper() if k % 5 == 0 else " ".join(v)))
        if k % 6 == 0:
            docs.append((len(docs) + 10, " ".join(words(rng, 20, 5000) + passage + words(rng, 15, 5000))))
    hot = words(rng, 120, 5000)
    for _ in range(40):
        v = list(hot)
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(len(v))] = f"h{rng.random()}"
        docs.append((len(docs) + 10, " ".join(v)))
    docs += [(3, docs[0][1]), (2, None), (1, ""), (5, "a b"), (6, "A  B"), (7, " \t "), (None, docs[5][1]), (None, None), docs[7], docs[7], (12, "other text here now"), (9, " ".join(["to"] * 200)), (8, " ".join(["to"] * 120))]
    return docs


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, corpus, n, percent):
    got = sorted(map(tuple, ngram_join.similar_groups(frame(spark, corpus), n, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted(ngram_groups(corpus, n, percent), key=str)


def test_substring_dedup(spark, corpus):
    out = substring_dedup.digest(substring_dedup.drop_repeats(frame(spark, corpus)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(repeats_removed(corpus), key=str)


def test_substring_dedup_judges_the_input(spark):
    """A chain of overlapping passages: the middle one goes though its own copy goes too."""
    rng = random.Random(8)
    w = words(rng, 200, 10_000)
    docs = [(1, " ".join(w[:100])), (2, " ".join(w[40:160])), (3, " ".join(w[90:200])), (4, " ".join(w[50:100])), (5, " ".join(w[51:100]))]
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.drop_repeats(frame(spark, docs))).collect())) == sorted(repeats_removed(docs))


def test_empty(spark):
    none = frame(spark, [])
    assert ngram_join.similar_groups(none).count() == 0
    assert substring_dedup.drop_repeats(none).count() == 0
    assert line_dedup.removed_lines(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, x) for x in range(501, 560)]
    group = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        if group[a] is not group[b]:
            whole = group[a] | group[b]
            for x in whole:
                group[x] = whole
    want = {x: min(g) for x, g in group.items() if len(g) > 1}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


LINE = "the quick brown fox jumps over the lazy dog while forty seven other animals watch from the shade of a very large tree near the old river bank in late summer every year again and again until dusk falls"


def test_lines(spark):
    near = LINE.replace("quick", "quicK,").replace("47", "48")
    fuzzy = LINE.replace("dusk", "dusks")
    docs = [
        (1, f"{LINE}\nonly here\n"), (2, f"first of two\n{near}\n--\n"), (3, f"{fuzzy}\nOnly  HERE!\nname 17 of 30 rows in all"), (4, None), (5, ""), (6, "--\n--\n\n"), (7, "name 18 of 45 rows in all"), (None, "only here"), (8, "first of two"), (8, "first of two"),
    ]
    got = {(r["doc_id"], r["n_lines"]): list(r["removed"]) for r in line_dedup.removed_lines(frame(spark, docs)).collect()}
    assert edit_distance(normal_line(LINE), normal_line(fuzzy)) == 1
    assert got[1, 3] == [] and got[2, 4] == [1] and got[3, 3][:1] in ([0], [1]) and 1 in got[3, 3]
    assert got[4, 0] == [] and got[5, 1] == [] and got[6, 4] == [] and got[7, 1] == [0] and got[None, 1] == [0] and got[8, 1] == [0]
    kept = line_dedup.without_repeats(frame(spark, docs))
    assert kept.columns == [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[1] == f"{LINE}\nonly here\n" and texts[2] == "first of two\n--\n" and 7 not in texts


def removed_by_brute_force(lines):
    """The lines that go where all similar ones, by edit distance alone, are one group."""
    parent, find = union_find(len(lines))
    normal = [normal_line(x) for x in lines]
    for i, a in enumerate(normal):
        for j, b in enumerate(normal[:i]):
            far = max(len(a), len(b)) // 10
            if abs(len(a) - len(b)) <= far and edit_distance(a, b) <= far:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in range(len(lines)) if find(i) != i}


def test_lines_against_brute_force(spark):
    """Every pair of lines that are similar enough is in one group, and no other is; keys are those of many lines, too."""
    rng = random.Random(11)
    base = [["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(40)] for _ in range(1)]  # letters: digits are all alike
    lines = []
    for w in base:
        for _ in range(45):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(40)] = v[rng.randrange(40)] + "x"
            lines.append(" ".join(v[rng.randint(0, 1) :]))
    got = {r["doc_id"] for r in line_dedup.removed_lines(frame(spark, list(enumerate(lines)))).collect() if r["n_removed"]}
    assert got == removed_by_brute_force(lines) and got


@pytest.mark.parametrize("n", [10, 20, 40, 60])
def test_lines_with_one_word_changed(spark, n):
    """Recall over 100 pairs of lines of one length, of which one word was changed, left out or put in."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 6)))
    docs = []
    for k in range(100):
        w = [word() for _ in range(n)]
        at = rng.randrange(n)
        v = [w[:at] + [word()] + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + [word()] + w[at:]][k % 3]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    like = [k for k in range(100) if edit_distance(docs[2 * k][1], docs[2 * k + 1][1]) <= max(len(docs[2 * k][1]), len(docs[2 * k + 1][1])) // 10]
    got = {r["doc_id"] for r in line_dedup.removed_lines(frame(spark, docs)).collect() if r["n_removed"]}
    assert got <= {2 * k + 1 for k in like} and len(got) >= 0.99 * len(like) > 40


def test_lines_of_a_common_key(spark):
    """Lines that share most of their words with very many others, which are not similar to them, still find their like."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    common, lines = [word() for _ in range(12)], []
    for _ in range(60):
        own = [word() for _ in range(8)]
        lines.append(" ".join(own[:4] + common + own[4:]))
    for k in range(0, 60, 3):
        lines.append(lines[k].replace(" ", " " + word()[:1], 1))
    got = {r["doc_id"] for r in line_dedup.removed_lines(frame(spark, list(enumerate(lines)))).collect() if r["n_removed"]}
    assert got == set(range(60, 80)) == removed_by_brute_force(lines)


def test_lines_of_one_template(spark):
    """Lines that share all words but one with very many, of which each has one near copy, find it, whatever the key's size."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    common, docs = [word(3) for _ in range(11)], []
    for k in range(100):
        own = word(rng.randint(22, 26))
        docs += [(2 * k, " ".join([*common[:6], own, *common[6:]])), (2 * k + 1, " ".join([*common[:6], own[:9] + "z" + own[10:], *common[6:]]))]
    got = {r["doc_id"] for r in line_dedup.removed_lines(frame(spark, docs)).collect() if r["n_removed"]}
    assert got == {2 * k + 1 for k in range(100)}


def line_keys(spark, lines):
    """The keys of each line, by its place."""
    return {r["id"]: set(r["keys"]) for r in line_dedup.marked_lines(frame(spark, list(enumerate(lines)))).select("id", "keys").collect()}


def test_lines_that_share_common_words_alone_share_no_key(spark):
    """Else each such line is marked, read again and paired with all others, on disk and in time."""
    rng = random.Random(17)
    lines = []
    for _ in range(100):
        w = ["the", "of", "and", "in", "to", "is", "was", "for"] + ["".join(rng.choices("abcdefghij", k=9)) for _ in range(6)]
        lines.append(" ".join(rng.sample(w, len(w))))
    keys = line_keys(spark, lines)
    assert len(set().union(*keys.values())) == sum(map(len, keys.values()))


def test_lines_with_a_tenth_of_words_changed_share_a_key(spark):
    """Words put in, left out and changed at random, up to a tenth of the longer line's; some lines have few different words."""
    rng = random.Random(18)
    word = lambda v: "".join(rng.choices("abcdefgh", k=rng.randint(1, 2 if v else 7)))
    lines = []
    for i in range(600):
        few = [word(True) for _ in range(rng.randint(1, 3))] if i % 4 == 0 else None
        own = lambda: rng.choice(few) if few else word(i % 3)
        w = [own() for _ in range(rng.randint(10, 39))]
        v = list(w)
        for _ in range(len(w) // 10):
            at = rng.randrange(len(v))
            v[at : at + rng.randint(0, 1)] = [word(False)] if rng.random() < 0.6 or len(v) <= 10 else []
        lines += [" ".join(w), " ".join(v)] if len(v) <= 39 else []
    keys = line_keys(spark, lines)
    assert len(lines) > 1000 and all(keys[i] & keys[i + 1] for i in range(0, len(lines), 2))


def test_long_lines_of_one_template(spark):
    """Long lines of which half is common to very many, and each has a near copy whose edits are all in its own half, find it by the common half."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    common, docs = [word(5) for _ in range(30)], []
    for k in range(40):
        own = [word(5) for _ in range(30)]
        docs.append((2 * k, " ".join([*common, *own])))
        docs.append((2 * k + 1, " ".join([*common, *(w[:2] + "z" + w[3:] if i % 3 == 1 else w for i, w in enumerate(own))])))
    got = {r["doc_id"] for r in line_dedup.removed_lines(frame(spark, docs)).collect() if r["n_removed"]}
    assert got == {2 * k + 1 for k in range(40)}


def test_digest_is_of_utf8(spark):
    out = substring_dedup.digest(substring_dedup.drop_repeats(frame(spark, [(1, "é  ü\nx")]))).first()
    assert out["kept_sha256"] == hashlib.sha256("é ü x".encode()).hexdigest()


def test_lines_with_changed_words(spark):
    """Lines of 4 to 60 words of which a tenth, or one, differs by little or much: brute force on edit similarity alone gives the same groups."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    lines = []
    for n in (4, 5, 9, 10, 11, 15, 19, 20, 29, 30, 40, 60):
        for _ in range(3):
            w = [word() for _ in range(n)]
            lines.append(" ".join(w))
            v = list(w)
            for i in rng.sample(range(n), max(1, n // 10)):
                v[i] = v[i] + "q" if n < 10 or rng.random() < 0.3 else "".join(rng.sample(v[i], len(v[i]) - 1)) + "z"
            lines.append(" ".join(v))
            at = rng.randrange(n)
            lines.append(" ".join(w[:at] + w[at + 1 :]))
    got = {r["doc_id"] for r in line_dedup.removed_lines(frame(spark, list(enumerate(lines)))).collect() if r["n_removed"]}
    parent, find = union_find(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            far = max(len(lines[i]), len(lines[j])) // 10
            if abs(len(lines[i]) - len(lines[j])) <= far and edit_distance(lines[i], lines[j]) <= far:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {i for i in range(len(lines)) if find(i) != i}
    assert got == want and len(want) > 45


def filler_lines(n):
    """Lines of 60 words that have four windows in common, each line at another place."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    phrase, lines = [word() for _ in range(16)], []
    for i in range(n):
        own = [word() for _ in range(44)]
        at = 22 * i % 44
        lines.append(" ".join([*own[:at], *phrase, *own[at:]]))
    return lines


def test_lines_with_a_phrase_at_other_places_are_not_paired(spark):
    """Nor are lines with it at the same place whose letters are too far apart; a line with the phrase twice is in reach at both places."""
    docs = frame(spark, list(enumerate(filler_lines(40))))
    marked = line_dedup.marked_lines(docs)
    each = marked.select("lid", "len", F.explode("keys").alias("key")).distinct()
    lids = each.select("lid").distinct()
    text = line_dedup.norms(lids, lids.count(), marked, docs)
    placed = line_dedup.with_places(each, text)
    shared = placed.join(placed.groupBy("key").count().where("count = 40").select("key"), "key")
    spots = shared.groupBy("key").agg(F.countDistinct("lo")).collect()
    assert spots and all(r[1] == 2 for r in spots) and shared.where("lo <> hi or lo < 0").isEmpty()
    left = line_dedup.still_apart(shared, spark.createDataFrame([], "node long, component long"))
    assert 0 < line_dedup.pairs_left(left, text).count() <= 2 * 20 * 19 // 2
    phrase = " ".join(filler_lines(1)[0].split(" ")[:16])
    twice = f"{phrase} {'x ' * 40}{phrase}"
    assert [r for r in line_dedup.with_places(*one_line(spark, twice)).where("hi > lo").collect()]


def one_line(spark, line):
    docs = frame(spark, [(1, line)])
    marked = line_dedup.marked_lines(docs)
    return marked.select("lid", "len", F.explode("keys").alias("key")).distinct(), line_dedup.norms(marked.select("lid"), 1, marked, docs)
