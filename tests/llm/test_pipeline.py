import random

import corpus_pipeline
from brute import ngram_groups

from pegtrail.llm import queries


def test_stages_follow_each_other(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert sizes[-1] >= 0.95 * before
        if name == "ngram_join":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert all(a == c for a, _, c in ngram_groups(rows, 5, 80))
    assert [x[0] for x in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "byte_bpe"]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sizes[-1] == sizes[-2] > 0


def test_near_duplicates_with_null_and_repeated_ids(spark, small):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (None, a), (None, a + " more"), (None, b), (None, b + " more"), (7, c), (7, a + " again"), (8, d), (8, d + " again"), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()]
    groups = [{rows[0], rows[1], rows[2], rows[6]}, {rows[3], rows[4]}, {rows[5]}, {rows[7], rows[8]}, {rows[9]}, {rows[10]}]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups) and (5, a) in kept


def test_registered():
    assert "pipeline" in queries.queries() and len([q for q in queries.queries() if q.startswith("op")]) == 10
