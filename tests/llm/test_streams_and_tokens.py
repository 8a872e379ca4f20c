import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pegtrail.llm import byte_bpe, mpeg_audio, token_counts

ODD = [None, "", " ", "  a", "a  b \n c ", "\n", "x" * 50_000, "é" * 3000 + " ▁▁ a▁b", "a\x1c b", "<s> </s> <|endoftext|>", " \n\n x \t y  z  ", "日本語 テスト 1234 🎉🎉 ﬁ ①", "it's we'll 'S", "a" * 10 + " " * 300 + "b"]
CLASH = "n_tokens long, media string, doc_id long, text string, payload binary, _row long, ids string"


def rows(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def serialised():
    return byte_bpe.tokenizer_json(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_mpeg_round_trip(spark):
    got = mpeg_audio.scan_mpeg(mpeg_audio.pack_mpeg(rows(spark, ODD)), also=("n_bytes",)).orderBy("doc_id").collect()
    for r, text in zip(got, ODD):
        raw = (text or "").encode()
        assert bytes(r["payload"]) == raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert r["n_bytes"] == len(raw) and r["crc_bad"] == 0 and r["resyncs"] == 0 and r["rate"] == 32000
        assert r["samples"] == 1152 * r["n_frames"] and len(r["seek_offsets"]) == r["n_frames"]


def test_mpeg_resynchronises_and_checks():
    whole = mpeg_audio.pack(bytes(range(200)) * 64)
    good = mpeg_audio.scan(whole)
    offsets = [at for at, _ in good["frames"]]
    assert good["vbr"]["frames"] == len(offsets) and whole[offsets[0]] == 0xFF
    broken = bytearray(whole)
    broken[offsets[2] + 2 + 4] ^= 0xFF  # the CRC of the third frame
    assert mpeg_audio.scan(bytes(broken))["crc_bad"] == 1
    junk = whole[: offsets[3]] + b"\x00\xff\xfbjunk\xff\xe0" * 9 + whole[offsets[3] :]
    found = mpeg_audio.scan(junk)
    assert len(found["frames"]) == len(offsets) and found["resyncs"] == 1 and found["skipped"] == 81
    tagged = whole + b"TAG" + bytes(125)
    assert mpeg_audio.scan(tagged)["tags"] == {"id3v2": 1, "id3v1": 1} and len(mpeg_audio.scan(tagged)["frames"]) == len(offsets)
    assert len(mpeg_audio.scan(whole[: offsets[4] + 7])["frames"]) == 4
    assert mpeg_audio.scan(None)["samples"] == 0 and mpeg_audio.scan(b"no audio at all")["frames"] == []


def test_bpe_equals_the_library(spark, serialised, reference):
    got = byte_bpe.round_trip(rows(spark, ODD), serialised).orderBy("doc_id").collect()
    for r, text in zip(got, ODD):
        ids = reference.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t▁aé日1!\x1c 's<>,."), max_size=60))
def test_bpe_any_text(serialised, reference, text):
    encoder = byte_bpe.encoder_of(serialised)
    ids = encoder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_bpe_offsets_and_split_characters(spark, serialised):
    texts = ["héllo 🎉 wörld", "日本", None]
    out = byte_bpe.encode(rows(spark, texts), serialised).orderBy("doc_id").collect()
    for r, text in zip(out, texts):
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        if text:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text) and all(a <= b for a, b in zip(r["starts"], r["ends"]))
    back = byte_bpe.decode(byte_bpe.encode(rows(spark, texts), serialised), serialised).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == ["héllo 🎉 wörld", "日本", ""]
    encoder = byte_bpe.encoder_of(serialised)
    cut = encoder.encode(["🎉"])[0][:4]
    assert encoder.decode(cut) in "🎉".encode() and "�" in encoder.decode(cut).decode("utf-8", "replace")


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(rows(spark, ODD), P.path("piece_bpe_32k.model"), limit=10).orderBy("doc_id").collect()
    for r, text in zip(got, ODD):
        n = len(model.encode(text or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 10)


def test_token_counts_of_any_text():
    counter = token_counts.counter_of(P.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choices(" \n\t▁aé日1! the of", k=rng.randint(0, 50)))
        assert counter.count([text]) == [len(counter.model.encode(text))]


def test_empty_tables_and_clashing_columns(spark, serialised):
    none = spark.createDataFrame([], CLASH)
    one = spark.createDataFrame([(1, "m", 7, "a b", b"p", 2, "i"), (1, "m", 7, "a b", b"p", 2, "i"), (None, None, None, None, None, None, None)], CLASH)
    path = P.path("piece_bpe_32k.model")
    for run in (lambda d: byte_bpe.round_trip(d, serialised), lambda d: token_counts.count_tokens(d, path), lambda d: mpeg_audio.scan_mpeg(mpeg_audio.pack_mpeg(d), seek=False)):
        assert run(none).count() == 0
        got = [r.asDict() for r in run(one).collect()]
        assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "None"]
        same = [r for r in got if r["doc_id"] == 7]
        assert same[0] == same[1]


@pytest.mark.parametrize("text", [b"TAG " * 400, b"TAG" * 300, b"APETAGEX" * 100, b"x" * 15 + b"APETAGEX" * 60])
def test_mpeg_payload_like_a_tag(text):
    for cut in range(64):
        payload = text[cut:] + bytes(-len(text[cut:]) % 64)
        packed = mpeg_audio.pack(payload)
        for tail, tags in ((b"", {"id3v2": 1}), (b"TAG" + bytes(125), {"id3v2": 1, "id3v1": 1})):
            found = mpeg_audio.scan(packed + tail)
            assert mpeg_audio.payload_of(found) == payload and found["tags"] == tags and found["crc_bad"] == 0


@pytest.mark.parametrize(("word", "covered"), [(bytes([0xFF, 0xFE, 0x14, 0xC0]), 128), (bytes([0xFF, 0xFE, 0x44, 0x00]), 256), (bytes([0xFF, 0xFE, 0x44, 0x40]), 4 * (8 + 28)), (bytes([0xFF, 0xFC, 0xA4, 0xC0]), 88), (bytes([0xFF, 0xFC, 0xA4, 0x00]), 2 * 88)])
def test_mpeg_checks_layers_one_and_two(word, covered):
    """Silent frames: the CRC covers the allocations alone, all zero, so a changed one shows."""
    h, value = mpeg_audio.header(word), 0xFFFF
    for bit in f"{word[2]:08b}{word[3]:08b}" + "0" * covered:
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ int(bit) else 0)
    frame = word + value.to_bytes(2, "big") + bytes(h["size"] - 6)
    found = mpeg_audio.scan(frame * 4)
    assert found["crc_good"] == 4 and found["crc_bad"] == 0
    bad = frame[:6] + b"\x10" + frame[7:]
    found = mpeg_audio.scan(frame * 3 + bad)
    assert found["crc_good"] == 3 and found["crc_bad"] == 1
