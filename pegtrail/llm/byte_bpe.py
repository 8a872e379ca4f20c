"""Byte-level BPE with the tokenizers library over Arrow batches.

The tokenizer is built from a rank file: bytes are mapped to printable characters, the merges are derived from the
ranks once on the driver, and a pre-token that is itself in the vocabulary is one token, as rank-based encoders do.

A text is cut before each single space that stands between two other non-space characters. No match of the
pre-tokenizer's pattern crosses such a cut, so the pieces can be encoded one by one; each distinct piece of a slice is
encoded once, and a bounded table keeps the pieces met before. This changes no id.

Decoding maps the ids back through the byte table. A character whose bytes are split over tokens comes out whole where
all its bytes are there; what is left of a cut character becomes U+FFFD in text output and stays as it is in bytes.

Defined cases: a null or empty text has no tokens; ids outside the table raise an error; repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pegtrail.llm.batches import map_slices, strings

#: Pieces in each of the two tables, young and old, that a worker keeps between slices.
KEPT_PIECES = 300_000
#: Longer pieces aren't kept, so that the tables' bytes are bounded as well.
KEPT_LENGTH = 64

_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO = re.compile(r"\s\s")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next of those from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes `token`: what merging by lower ranks leaves of it, or None if not two."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts)


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A serialised tokenizer for these ranks; its size is the vocabulary's."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    spell = lambda token: "".join(table[b] for b in token)
    pairs = [merge_of(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(p[0]), spell(p[1])) for p in pairs if p], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


def byte_table(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id, by reversing the byte characters."""
    back = {c: b for b, c in enumerate(byte_characters())}
    table = [b""] * (max(vocab.values(), default=-1) + 1)
    for text, i in vocab.items():
        table[i] = bytes(back[c] for c in text)
    return table


class Pieces(dict):
    """Ids of pieces (without their space), encoded when first met; `old` holds those of the table before."""

    def __init__(self, encoder: Encoder, old: dict[str, bytes]):
        super().__init__()
        self.encoder, self.old = encoder, old

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        found = self.encoder.spaced(part) if found is None else found
        if len(part) <= KEPT_LENGTH:
            self[part] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, piece by piece."""

    def __init__(self, serialised: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(serialised).model
        first = json.loads(serialised)
        self.merge = model.tokenize
        self.pattern = regex.compile(first["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.table = byte_table(first["model"]["vocab"])
        self.spelled = dict(enumerate(byte_characters()))
        self.young = Pieces(self, {})
        self.marks = {mark: self.piece(mark) for mark in ".,;:!?"}

    def piece(self, text: str) -> bytes:
        """The ids of one piece, by the library's merges of each pre-token."""
        whole = text[1:] if text[:1] == " " else text
        ids: list[int] = []
        for token in [text] if whole.isalpha() else self.pattern.findall(text):
            ids += [t.id for t in self.merge(token.encode().decode("latin-1").translate(self.spelled))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def spaced(self, part: str) -> bytes:
        """The ids of a space and `part`. A mark after letters is a pre-token of its own, so the letters' ids are used again."""
        if part[-1:] in self.marks and part[:-1].isalpha():
            return self.young[part[:-1]] + self.marks[part[-1]]
        return self.piece(" " + part)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > KEPT_PIECES:  # a piece not met again since the last time goes with the old table
            self.young = Pieces(self, {**self.young})
        get = self.young.__getitem__
        out = []
        for text in texts:
            first, *rest = _CUT.split(text) if _TWO.search(text) or text[:1].isspace() or text[-1:].isspace() else text.split(" ")
            out.append(b"".join([self.piece(first), *map(get, rest)]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, raw: bytes) -> tuple[list[int], list[int]]:
        """Character start and end (exclusive) of each token; tokens that share a character share its place."""
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        lengths = np.array([len(self.table[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        first = lead[np.minimum(starts + 1, len(raw))] - 1  # of the character that the token's first byte is in
        return first.tolist(), lead[ends].tolist()


@lru_cache(maxsize=1)
def encoder_of(serialised: str) -> Encoder:
    """One encoder for each Python worker, which Spark uses again for later tasks."""
    return Encoder(serialised)


def encode(df: DataFrame, serialised: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, starts, ends): the ids of each whole text and their character offsets."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        encoder = encoder_of(serialised)

        def step(part: pa.RecordBatch) -> dict:
            texts = strings(part.column(1))
            ids = encoder.encode(texts)
            spans = [encoder.offsets(i, x.encode()) for i, x in zip(ids, texts)]
            return {key: part.column(0), "ids": [np.frombuffer(i, "<u4").tolist() for i in ids], "starts": [s for s, _ in spans], "ends": [e for _, e in spans]}

        return step

    return map_slices(df, [key, text], text, f"`{key}` {kind}, ids array<int>, starts array<bigint>, ends array<bigint>", make)


def decode(df: DataFrame, serialised: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, raw, text): the bytes of each list of ids, and their text with what is cut replaced."""
    kind = df.schema[key].dataType.simpleString()
    from pyspark.sql import functions as F

    def run(batches):
        encoder = encoder_of(serialised)
        for batch in batches:
            raw = [encoder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [key, "raw", "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, raw binary, text string")


def round_trip(df: DataFrame, serialised: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded again."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        encoder = encoder_of(serialised)

        def step(part: pa.RecordBatch) -> dict:
            ids = encoder.encode(strings(part.column(1)))
            return {
                key: part.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids],
            }

        return step

    return map_slices(df, [key, text], text, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
