"""Token counts by a sentencepiece BPE model, with a shortcut for whole tokens.

In this kind of model a space is the character U+2581, and no piece has one after another character (checked when the
model is loaded). So no merge crosses the place before a run of spaces, and the parts that start there are counted one
by one. Which vocabulary strings are alone encoded as one token is proved by encoding each of them once when a task
starts; a part that is such a string counts 1 without any merge. The library merges only the rest, each distinct part
of a slice once; a bounded table keeps the counts of parts met before.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pegtrail.llm.batches import map_slices, strings

SPACE = "▁"
#: Parts in each of the two tables, young and old, that a worker keeps between slices besides the proven ones.
KEPT_PARTS = 250_000
#: Longer parts aren't kept, so that the tables' bytes are bounded as well.
KEPT_LENGTH = 64

_PARTS = re.compile(r" +[^ ]*")


class Counter:
    """Counts of whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece has a space after another character: texts can't be cut before spaces")
        self.proven = self.prove(pieces)
        self.old: dict[str, int] = {}
        self.young = dict(self.proven)

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """Parts (with their spaces) that the model encodes as the one token that they spell."""
        spelled = [(i, p.replace(SPACE, " ")) for i, p in enumerate(pieces) if p.startswith(SPACE)]
        found = self.model.encode([text[1:] for _, text in spelled], num_threads=1)
        return {text: 1 for (i, text), ids in zip(spelled, found) if ids == [i]}

    def parts(self, text: str) -> list[str]:
        """The text after its added first space, cut before each run of spaces."""
        text = " " + text.replace(SPACE, " ")
        return _PARTS.findall(text)

    def merge(self, parts: list[str]) -> None:
        """Count each of these parts with the library, which adds the first space itself; a lone space is a piece of its own."""
        for part, ids in zip(parts, self.model.encode([p[1:] for p in parts], num_threads=1)):
            self.young[part] = len(ids)
        if " " in self.young:
            self.young[" "] = 1 if self.model.piece_to_id(SPACE) != self.model.unk_id() else len(SPACE.encode())

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.parts(x) if x else [] for x in texts]
        new = set().union(*cut).difference(self.young)
        if len(self.young) + len(new) > KEPT_PARTS + len(self.proven):  # a part not met again since the last time goes with the old table
            self.old, self.young = self.young, dict(self.proven)
            new = set().union(*cut).difference(self.young)
        self.young.update((x, self.old[x]) for x in new if x in self.old)
        self.merge([x for x in new if x not in self.young])
        get = self.young.__getitem__
        counts = [sum(map(get, x)) for x in cut]
        for x in new:
            if len(x) > KEPT_LENGTH:
                del self.young[x]
        return counts


@lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """One counter for each Python worker, which Spark uses again for later tasks."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each whole text by the model at `path`, a file that executors have too."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        counter = counter_of(path)

        def step(part: pa.RecordBatch) -> dict:
            texts = strings(part.column(1))
            found = counter.count(texts)
            return {key: part.column(0), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": found, "over_limit": [n > limit for n in found]}

        return step

    return map_slices(df, [key, text], text, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", make)
