"""Token counts: batch encoding in an Arrow function that returns lengths only.

Where a tokenizer drops white space and never encodes across it (tried out when it is
loaded), a text is split there, and its pieces are counted apart and added up; other
tokenizers get whole texts. Distinct pieces
that are not yet known go to the library's batch encoder, in batches of about the same
number of bytes; lengths are kept in a bounded two-generation table, since words repeat.

Defined cases: null and empty texts have 0 tokens; a text without white space is one
piece; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import take_over, uncollected, whole
from weirflow.plans.runtime import ship

#: Bytes of text sent to the encoder at once.
BATCH_BYTES = 1 << 20
#: Pieces whose length is remembered, by generation.
REMEMBERED = 300_000
#: Longer pieces are counted but not remembered.
LONGEST_KEPT = 64


_TO_SPACE = str.maketrans("\n\t\r", "   ")
_STOPS = frozenset(".,!?;:")


class PieceLengths:
    """Token counts of pieces, from ``encode`` (texts to counts)."""

    def __init__(self, encode, batch_bytes: int = BATCH_BYTES, remembered: int = REMEMBERED) -> None:
        self.encode, self.batch_bytes, self.remembered = encode, batch_bytes, remembered
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Counts of unknown pieces; those too long to keep are returned as well."""
        found: dict[str, int] = {}
        batch: list[str] = []
        held = 0
        for p in [*pieces, None]:
            if p is None or held + len(p) > self.batch_bytes:
                if batch:
                    found.update(zip(batch, self.encode(batch), strict=True))
                batch, held = [], 0
            if p is not None:
                batch.append(p)
                held += len(p)
        return found

    def count(self, texts: list[str]) -> list[int]:
        split = [t.translate(_TO_SPACE).split(" ") if "\t" in t or "\r" in t else t.replace("\n", " ").split(" ") for t in texts]
        parts: dict[str, tuple[str, ...]] = {}
        missing: set[str] = set()
        for p in set().union(*split) - self.new.keys():
            if (n := self.old.get(p)) is not None:
                self.new[p] = n
                continue
            # Only after ASCII letters is a stop sure to stand alone: others may turn into a letter and a mark, which joins it.
            parts[p] = at = (p[:-1], p[-1]) if p[-1:] in _STOPS and p[:-1].isascii() and p[:-1].isalpha() else (p,)
            missing.update(x for x in at if x not in self.new)
        found = self._learn(list(missing))
        self.new.update(found)
        self.new.update((p, sum(self.new[x] for x in at)) for p, at in parts.items() if len(at) > 1)
        get = self.new.__getitem__
        out = [sum(map(get, pieces)) for pieces in split]
        for p in {*found, *parts}:
            if len(p) > LONGEST_KEPT:
                del self.new[p]
        if len(self.new) > self.remembered:
            self.old, self.new = self.new, {}
        return out


class WholeLengths:
    """For tokenizers that encode white space: texts are counted whole."""

    def __init__(self, encode) -> None:
        self.count = encode


_KNOWN: dict[str, PieceLengths | WholeLengths] = {}


def lengths_for(path: str) -> PieceLengths | WholeLengths:
    """Of the tokenizer file at ``path``, once in each worker."""
    if path not in _KNOWN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _KNOWN[path] = WholeLengths(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)])
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            encode = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            drops_space = encode([" ", "\n \t", "a b", "a", "b"]) == [0, 0, 2, 1, 1] and encode(["ab.,", "ab.", "."])[1:] == [2, 1]
            _KNOWN[path] = PieceLengths(encode) if drops_space else WholeLengths(encode)
    return _KNOWN[path]


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, length) runs of about ``most`` bytes."""
    sizes = pc.binary_length(texts).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    ship(docs.sparkSession)
    doc_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("token_counts", _KNOWN.clear)
        lengths = lengths_for(tokenizer)
        for batch in batches:
            texts = batch.column(2)
            counts: list[int] = []
            with uncollected():
                for start, n in by_bytes(texts, batch_bytes):
                    counts += lengths.count(texts.slice(start, n).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = whole(F.col("text"))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {doc_type.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
