"""One query for each operator of the subpackage, over its whole table, and the pipeline."""

from __future__ import annotations

from pegtrail.llm import byte_bpe, collocations, conversation_repair, language, line_dedup, mixing, mpeg_audio, ngram_join, pii, quality_forest, substring_dedup, token_counts, warc
from pegtrail.llm.batches import documents


def op1_mpeg_audio(spark, sf_dir):
    packed = mpeg_audio.pack_mpeg(documents(spark, sf_dir))
    return mpeg_audio.scan_mpeg(packed, also=("n_bytes",), seek=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "n_frames", "crc_bad", "resyncs")


def op2_quality_forest(spark, sf_dir):
    judged = quality_forest.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_ngram_join(spark, sf_dir):
    return ngram_join.similar_groups(documents(spark, sf_dir), n=4, percent=85)


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(documents(spark, sf_dir), byte_bpe.tokenizer_json(ranks, public_tokenizers.PATTERN))


def op5_mixing(spark, sf_dir):
    sized = mixing.label_quality(mixing.sized(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


def op7_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~language.held_out(docs["doc_id"])))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.drop_repeats(documents(spark, sf_dir)))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.removed_lines(documents(spark, sf_dir))


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_warc(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.audits(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_mpeg_audio, op2_quality_forest, op3_ngram_join, op4_byte_bpe, op5_mixing, op6_pii, op7_language, op8_substring_dedup, op9_line_dedup, op10_token_counts, op11_warc, op12_collocations, op13_conversation_repair)}
ORACLE = {"op5_mixing": mixing.ORACLE, "op11_warc": warc.ORACLE, "op12_collocations": collocations.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return QUERIES | {"pipeline": pipeline}


def oracle_sql():
    return dict(ORACLE)
