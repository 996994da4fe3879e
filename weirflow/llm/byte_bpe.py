"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A queue entry is a place in a linked list of byte runs where two neighbouring runs may
merge. Entries lie in buckets, one for each merge rank. A bitmap with a bit for each
rank, under two levels of summary bitmaps, gives the lowest waiting rank by three
find-first-set steps, whatever the number of ranks. Its bucket is worked off from the
leftmost place on; entries that an earlier merge has made stale are recognised by their
runs and skipped, and a merge that makes a lower rank possible gives way to it. One
queue serves all pieces of a batch, which lie end to end in one list and never merge with
each other, so the bitmap's upkeep is shared. A merge touches its two neighbours only,
so a piece of n bytes takes about n steps, which suits very long pieces.

Texts are cut into pieces by the vocabulary's pattern. No match of it crosses from
other characters into a following space or line feed, so a text whose only white space
is single spaces and line feeds between words is cut there first, and the ids of a word
are looked up in a bounded two-generation table before anything is encoded. The pattern
has to keep that rule. Decoding goes from ids back to bytes.

Defined cases: null and empty texts give no ids; texts may hold any characters and
pieces of any length; repeated rows are encoded alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import take_over, uncollected, whole
from weirflow.plans.runtime import ship

#: Words and matches whose ids are remembered, by generation, and the most characters of one.
REMEMBERED, LONGEST_KEPT = 420_000, 48
#: Bytes of text taken from Arrow at once.
BATCH_BYTES = 1 << 20

_BITS = 6
_MASK = (1 << _BITS) - 1


class RankBits:
    """The set of ranks whose buckets hold entries, as three levels of bitmaps."""

    def __init__(self, ranks: int) -> None:
        n = (ranks >> _BITS) + 1
        self.low = [0] * n
        self.mid = [0] * ((n >> _BITS) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        a = rank >> _BITS
        b = a >> _BITS
        self.low[a] |= 1 << (rank & _MASK)
        self.mid[b] |= 1 << (a & _MASK)
        self.top |= 1 << b

    def pop(self) -> int:
        """The lowest rank, taken out; -1 when there is none."""
        top = self.top
        if not top:
            return -1
        b = (top & -top).bit_length() - 1
        upper = self.mid[b]
        a = (b << _BITS) + (upper & -upper).bit_length() - 1
        word = self.low[a]
        rank = (a << _BITS) + (word & -word).bit_length() - 1
        word &= word - 1
        self.low[a] = word
        if not word:
            upper &= upper - 1
            self.mid[b] = upper
            if not upper:
                self.top = top & (top - 1)
        return rank


class ByteBpe:
    """The vocabulary of a rank file: encoding, decoding, and whole texts at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.ranks, self.pattern, self.remembered = ranks, regex.compile(pattern), remembered
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.digits = [str(i) for i in range(max(ranks.values()) + 1)]
        self.by_id = [self.bytes_of.get(i) for i in range(max(ranks.values()) + 1)]
        self.shift = max(ranks.values()).bit_length()
        self.merges = {(a << self.shift) | b: i for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.byte_pair = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.bits = RankBits(max(ranks.values()))
        self.matches: tuple[dict, dict] = ({}, {})
        self.words: tuple[dict, dict] = ({}, {})

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, a match of the pattern."""
        out: list = [(i,) if (i := self.ranks.get(p)) is not None else None for p in pieces]
        open_ = [k for k, ids in enumerate(out) if ids is None]
        todo = [pieces[k] for k in open_ if pieces[k]]
        if not todo:
            return [ids or () for ids in out]
        sizes = np.fromiter(map(len, todo), np.int64, len(todo))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(todo), np.uint8)
        n = len(data)
        first, last = ends - sizes, ends - 1
        links = np.arange(1, n + 1)
        links[last] = -1
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[first] = -1
        before = links.tolist()
        run = self.byte_id[data].tolist()
        rank_at = np.full(n, -1, np.int32)
        rank_at[:-1] = self.byte_pair[data[:-1].astype(np.int32) * 256 + data[1:]]
        rank_at[last] = -1
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        found, starts = np.unique(rank_at[places], return_index=True)
        ordered, edges = places.tolist(), [*starts.tolist(), len(places)]
        buckets = {r: ordered[edges[k] : edges[k + 1]] for k, r in enumerate(found.tolist())}
        bits, merge, shift = self.bits, self.merges.get, self.shift
        for r in buckets:
            bits.add(r)
        while (rank := bits.pop()) >= 0:
            bucket = buckets.pop(rank)
            bucket.sort()
            k, lower = 0, False
            while k < len(bucket):
                i = bucket[k]
                k += 1
                j = after[i]
                if j < 0 or run[i] < 0 or merge(run[i] << shift | run[j]) != rank:  # stale
                    continue
                run[i], run[j] = rank, -1
                after[i] = end = after[j]
                after[j] = -1
                if end >= 0:
                    before[end] = i
                    r = merge(rank << shift | run[end])
                    if r is not None:
                        lower |= self._wait(buckets, bucket, k, rank, r, i)
                start = before[i]
                if start >= 0:
                    r = merge(run[start] << shift | rank)
                    if r is not None:
                        lower |= self._wait(buckets, bucket, k, rank, r, start)
                if lower:
                    break
            if k < len(bucket):
                buckets[rank] = bucket[k:]
                bits.add(rank)
        ids = np.array(run)
        left = ids >= 0
        counts = np.add.reduceat(left, first)
        flat, at = ids[left].tolist(), 0
        results = []
        for c in counts.tolist():
            results.append(tuple(flat[at : at + c]))
            at += c
        filled = iter(results)
        for k in open_:
            out[k] = next(filled) if pieces[k] else ()
        return out

    def _wait(self, buckets: dict, bucket: list, k: int, rank: int, r: int, place: int) -> bool:
        """Puts a place into its bucket; whether its rank comes before the one at work."""
        if r == rank:
            insort(bucket, place, k)
            return False
        held = buckets.get(r)
        if held is None:
            buckets[r] = [place]
            self.bits.add(r)
        else:
            held.append(place)
        return r < rank

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text, match by match, without the tables."""
        return list(chain.from_iterable(self.encode_pieces([m.encode() for m in self.pattern.findall(text)])))

    def _learn(self, matches: set[str], words: set[str]) -> tuple[dict, dict]:
        """Ids of matches and of words with a space before them: those in the tables, and the rest encoded at once."""
        kept, old = self.matches
        kept_words, old_words = self.words
        split: dict[str, list[str]] = {}
        for w in words - kept_words.keys():
            if (ids := old_words.get(w)) is not None:
                kept_words[w] = ids
            elif w.isalpha():
                split[w] = [" " + w]
            elif w[-1] in ".,!?;:" and w[:-1].isalpha():
                split[w] = [" " + w[:-1], w[-1]]
            else:
                split[w] = self.pattern.findall(" " + w)
        wanted = matches.union(*split.values())
        missing = []
        for m in wanted - kept.keys():
            if (ids := old.get(m)) is not None:
                kept[m] = ids
            else:
                missing.append(m)
        kept.update(zip(missing, self.encode_pieces([m.encode() for m in missing]), strict=True))
        for w, parts in split.items():
            kept_words[w] = kept[parts[0]] if len(parts) == 1 else tuple(i for m in parts for i in kept[m])
        self.long = {"matches": [m for m in missing if len(m) > LONGEST_KEPT], "words": [w for w in split if len(w) > LONGEST_KEPT]}
        return kept, kept_words

    def _forget(self) -> None:
        """Drops what is too long to keep, and the older generation when the newer is full."""
        for name in ("matches", "words"):
            new, _ = getattr(self, name)
            for k in self.long[name]:
                del new[k]
            if len(new) > self.remembered:
                setattr(self, name, ({}, new))

    def encode_many(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of whole texts."""
        forms, matches, words = [], {"\n"}, set()
        for text in texts:
            lines = [line.split(" ") for line in text.split("\n")]
            if list(chain.from_iterable(lines)) == text.split():
                for line in lines:
                    head = line[0] = self.pattern.findall(line[0])
                    matches.update(head)
                    words.update(line[1:])
                forms.append(lines)
            else:
                found = self.pattern.findall(text)
                matches.update(found)
                forms.append(found)
        kept, kept_words = self._learn(matches, words)
        match, word, feed = kept.__getitem__, kept_words.__getitem__, kept["\n"]
        out = []
        for form in forms:
            if form and isinstance(form[0], list):
                parts: list[tuple[int, ...]] = []
                for line in form:
                    parts.append(feed)
                    parts += map(match, line[0])
                    parts += map(word, line[1:])
                out.append(list(chain.from_iterable(parts[1:])))
            else:
                out.append(list(chain.from_iterable(map(match, form))))
        self._forget()
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def vocabulary(path: str, pattern: str) -> ByteBpe:
    """Loaded once in each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    ship(docs.sparkSession)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weirflow.llm.token_counts import by_bytes

        take_over("byte_bpe", _LOADED.clear)
        bpe = vocabulary(ranks, pattern)
        digits, back = bpe.digits.__getitem__, bpe.by_id.__getitem__
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            with uncollected():
                for start, n in by_bytes(batch.column(1), BATCH_BYTES):
                    for ids in bpe.encode_many(batch.column(1).slice(start, n).to_pylist()):
                        counts.append(len(ids))
                        ids_hash.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                        text_hash.append(hashlib.sha256(b"".join(map(back, ids))).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids themselves."""
    ship(docs.sparkSession)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("byte_bpe", _LOADED.clear)
        bpe = vocabulary(ranks, pattern)
        for batch in batches:
            with uncollected():
                ids = bpe.encode_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", whole(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {doc_type}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids)."""
    ship(encoded.sparkSession)
    doc_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("byte_bpe", _LOADED.clear)
        bpe = vocabulary(ranks, pattern)
        for batch in batches:
            raw = [bpe.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {doc_type}, bytes binary")
