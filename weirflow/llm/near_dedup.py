"""MinHash near-duplicate detection by DartMinHash signatures and banded joining.

A document is the bag of its five-word shingles: a shingle weighs as often as it occurs
(once with ``weighted=False``), and two documents are as similar as their weighted
Jaccard similarity, the sum of the lesser weights over that of the greater. Each element's weight axis is cut
into unit strips. Darts fall on a strip at ranks that form a Poisson process drawn from hashes
of the element, the strip and the dart's number, each at a hashed height in the strip and
for a hashed coordinate. A document meets the darts below its weights, in rank order and only
up to the rank at which every coordinate should have been hit (``k ln k + 2k`` darts in all);
the earliest dart of each coordinate is the signature. Coordinates still open extend the
rank. Two documents agree in a coordinate with probability equal to their similarity.

Signatures are cut into bands. Equal texts are one node. Nodes that share a band's hash
form a bucket; buckets with the same members are one. Every pair of a bucket is settled on
the whole texts' exact shingle bags, without ever being written as a pair: a bucket's bags are
sent to one place, overlaps of all its members come from a matrix product, and only a
spanning forest of the similar ones goes on. A bucket larger than ``BLOCK_NODES`` or
``BLOCK_ELEMENTS`` is dealt into blocks by hash, and each block also gets the same few
``CENTRES`` of the bucket, so that groups of copies come together over all blocks in time that grows
with their size. In such buckets, members that are still outside the main class meet all blocks of the
bucket then, block by block, so no link between classes is lost. Classes are the
connected components. With 20 bands of 5, a pair at similarity 0.8 shares a band with
probability 0.9996.

Defined cases: null texts count as empty; all texts without words are one class; texts of
one to four words have one shingle, all their words; words are runs of non-space
characters, ASCII letters lower-cased; null ids take part under an id drawn from the text,
a negative number; repeated rows are in one class; different texts under one id are different
nodes: where several classes would be named by the same id, the first by text keeps the
name and the others get a negative number drawn from a text; texts of any length are read in parts of
``BATCH_BYTES``; an empty table gives an empty result; columns of the input may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import maybe_in, take_over, trim, whole
from weirflow.plans.runtime import Scratch, ship

#: Words in a shingle and the least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and coordinates in a band.
BANDS, ROWS = 20, 5
#: Nodes of a bucket compared at once, on average, and elements of their bags together.
BLOCK_NODES, BLOCK_ELEMENTS = 1024, 1 << 21
#: Nodes of a larger bucket that each of its blocks gets.
CENTRES = 8
#: Bytes of text hashed at once, and elements whose darts are thrown at once.
BATCH_BYTES, THROWN = 1 << 19, 1 << 19
#: Columns of a matrix product.
COLUMNS = 2048

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([_U(1)], np.full(n, _P))), dtype=_U)
        back = np.cumprod(np.concatenate(([_U(1)], np.full(n, _U(pow(int(_P), -1, 2**64))))), dtype=_U)
    return up, back


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def shingles(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, document) of texts lying end to end in a byte array; ``ends`` are the texts' ends.

    Texts of fewer than ``n`` words have a shingle only if ``short``.
    """
    size = len(data)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = _spaces(data)
    inside = ~space
    head = inside.copy()
    head[1:] &= space[:-1]
    starts_of_docs = np.concatenate(([0], ends[:-1]))
    at = starts_of_docs[starts_of_docs < size]
    head[at] |= inside[at]
    tail = inside.copy()
    tail[:-1] &= space[1:]
    last = ends[(ends > 0)] - 1
    tail[last] |= inside[last]
    start, stop = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    up, back = _powers(1 << max(20, (size + 1).bit_length()))
    total = np.concatenate(([_U(0)], np.cumsum((data.astype(_U) + _U(1)) * up[:size], dtype=_U)))
    word = mixed((total[stop] - total[start]) * back[start] + (stop - start).astype(_U))
    doc = np.searchsorted(ends, start, side="right")
    per_doc = np.bincount(doc, minlength=len(ends))
    # Rolling combination of n word hashes; a document with fewer words has one shingle.
    run = np.zeros(len(word), _U)
    padded = np.concatenate((word, np.zeros(n, _U)))
    place = np.arange(len(word)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    words_in = np.repeat(per_doc, per_doc)
    for k in range(n):
        run = run * _P + np.where(place + k < words_in, padded[k : k + len(word)], _U(0))
    begins = np.where(words_in >= n, place <= words_in - n, (place == 0) & short)
    return mixed(run)[begins], doc[begins]


def pieces(data: np.ndarray, n: int = SHINGLE, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Parts of a long text, cut at white space, each of which begins with the last ``n - 1`` words of the one before."""
    start, size = 0, len(data)
    while size - start > most:
        end, heads = start + most, np.zeros(0, np.int64)
        while end < size and len(heads) < n:
            gap = np.flatnonzero(_spaces(data[end : end + most]))
            if not len(gap):
                end += most
                continue
            inside = ~_spaces(data[start : end + gap[0]])
            heads = start + np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
            end += int(gap[0]) if len(heads) >= n else most
        if end >= size:
            break
        yield start, end
        start = int(heads[1 - n])
    yield start, size


def bags(texts: pa.Array, weighted: bool = True, most: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, weight) of texts, elements in order and once in each text."""
    data, ends = text_buffer(texts)
    if len(data) <= most:
        element, doc = shingles(data, ends)
        element, doc, weight = _distinct(element, doc)
    else:
        found = []
        for k, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
            own = data[a:b]
            parts = [shingles(own[i:j], np.array([j - i]), short=i == 0)[0] for i, j in pieces(own, most=most)]
            e, _, w = _distinct(np.concatenate(parts), np.zeros(sum(map(len, parts)), np.int64))
            found.append((e, np.full(len(e), k), w))
        element, doc, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    return element, doc, weight if weighted else np.ones(len(element))


def signatures(element: np.ndarray, doc: np.ndarray, docs: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: a (docs, k) array of the earliest dart of each coordinate; 0 in the rows of empty documents."""
    weight = np.ones(len(element)) if weight is None else weight
    mass = np.bincount(doc, weights=weight, minlength=docs)
    full = mass > 0
    theta = np.where(full, (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-12), 0.0)
    best = np.full(docs * k, np.inf)
    dart = np.zeros(docs * k, _U)
    strips = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = mixed(mixed(element)[of] + _P * strip.astype(_U))
    owner, room = doc[of], weight[of] - strip
    active = full.copy()
    done_to = np.zeros(docs)
    while active.any():
        wanted = np.flatnonzero(active[owner])
        for s in range(0, len(wanted), THROWN):
            live = wanted[s : s + THROWN]
            rank, throw = np.zeros(len(live)), 0
            while len(live):
                throw += 1
                h = mixed(seed[live] + _U(throw * 0xD1B54A32D192ED03 % 2**64))
                rank = rank - np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
                ok = rank < theta[owner[live]]
                live, rank, h = live[ok], rank[ok], h[ok]
                if not len(live):
                    break
                name = mixed(h ^ _U(0xA0761D6478BD642F))
                new = rank >= done_to[owner[live]]
                hit = new & ((name >> _U(40)).astype(np.float64) * 2.0**-24 < room[live])
                cell = owner[live[hit]] * k + (name[hit] % _U(k)).astype(np.int64)
                r, name = rank[hit], name[hit]
                first = np.lexsort((name, r, cell))
                cell, r, name = cell[first], r[first], name[first]
                lead = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
                cell, r, name = cell[lead], r[lead], name[lead]
                better = (r < best[cell]) | ((r == best[cell]) & (name < dart[cell]))
                best[cell[better]], dart[cell[better]] = r[better], name[better]
        done_to = np.where(active, theta, done_to)
        active = full & np.isinf(best.reshape(docs, k)).any(1)
        theta = np.where(active, theta * 2, theta)
    return dart.reshape(docs, k)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signature), bands), _U)
    for b in range(bands):
        h = np.full(len(signature), _U(b + 1))
        for r in range(rows):
            h = mixed(h * _P + signature[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def _distinct(element: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((element, doc))
    e, d = element[order], doc[order]
    first = np.concatenate(([True], (e[1:] != e[:-1]) | (d[1:] != d[:-1]))) if len(e) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return e[at], d[at], np.diff(np.append(at, len(e))).astype(float)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end, and where each text ends; nulls are empty."""
    wide = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def text_bands(texts: pa.Array, weighted: bool = True, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each text, those of texts without words all 0, and the weight of its bag."""
    element, doc, weight = bags(texts, weighted)
    mass = np.bincount(doc, weights=weight, minlength=len(texts)).astype(np.int64)
    out = band_hashes(signatures(element, doc, len(texts), bands * rows, weight), bands, rows)
    out[mass == 0] = 0
    return out, mass


def text_sets(texts: pa.Array, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bag as a sorted set, end to end, and the ends: the k-th occurrence of a shingle is an element of its own."""
    element, doc, weight = bags(texts, weighted)
    n = weight.astype(np.int64)
    if len(n) and n.max() > 1:
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        element, doc = mixed(np.repeat(element, n) + _P * place.astype(_U)), np.repeat(doc, n)
        order = np.lexsort((element, doc))
        element, doc = element[order], doc[order]
    return element, np.cumsum(np.bincount(doc, minlength=len(texts)))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets share."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), k := len(np.intersect1d(*sets, assume_unique=True))], [k, len(sets[1])]])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    fresh = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    common = (np.bincount(column) > 1)[column] if len(every) else fresh
    row, column = row[common], np.cumsum(fresh[common]) - 1  # elements of one set alone are left out
    shared = np.zeros((n, n), np.float32 if len(every) < 1 << 24 else np.float64)
    at = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        block = np.zeros((n, COLUMNS), shared.dtype)
        block[row[i:j], column[i:j] - k * COLUMNS] = 1
        shared += block @ block.T
    return shared


def forest(ids: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the ids of similar sets: no more than there are ids. Two empty sets are similar."""
    size = np.array([len(s) for s in sets])
    if len(sets) < 2 or (len(sets) == 2 and size.min() < (similar - 1e-9) * size.max()):
        return ids[:0], ids[:0]
    shared = overlaps(sets).astype(np.float64)
    every = size[:, None] + size[None, :] - shared
    near = np.where(every > 0, shared / np.maximum(every, 1), 1.0) >= similar
    np.fill_diagonal(near, False)
    loose, a, b = near.any(0), [], []
    while loose.any():
        root = int(np.argmax(loose))
        reached = np.zeros(len(ids), bool)
        reached[root], front = True, np.array([root])
        while len(front):
            new = near[front].any(0) & ~reached
            reached |= new
            front = np.flatnonzero(new)
        loose &= ~reached
        own = np.unique(ids[reached])
        a.append(own[1:])
        b.append(np.full(len(own) - 1, own[0]))
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def row_id(doc_id: Column, text: Column) -> Column:
    """The id, or a negative number from the text where it is null."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**62)) + F.shiftrightunsigned(F.xxhash64(text), 3))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in (a, b) pairs: the smallest node of its connected component.

    Labels pass along edges and then jump to their own label's label, until none changes.
    """
    both = scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), narrow=True)
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), narrow=True)
    while True:
        heard = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("heard"))
        stepped = scratch.keep(labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")), narrow=True)
        scratch.drop(labels)
        if not stepped.where("moved").limit(1).count():
            scratch.drop(both)
            return stepped.select("node", "label")
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        labels = scratch.keep(stepped.join(up, "label", "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label")), narrow=True)
        scratch.drop(stepped)


def join_cells(cells: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b) edges that join the ids of similar nodes of a cell, from (cell columns..., node, id) and (node, elements)."""
    keys = [c for c in cells.columns if c not in ("node", "id")]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the cell that the last batch ended in
        last = None

        def settled(found: list) -> tuple[np.ndarray, np.ndarray]:
            return forest(np.array([i for i, _ in found]), [s for _, s in found], similar)

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(len(keys))])
            ids, elements = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1)
            offsets, data = np.frombuffer(elements.buffers()[1], np.int32)[elements.offset :], elements.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            edges = []
            for i in range(batch.num_rows):
                here = tuple(key[:, i])
                if here != last and held:
                    edges.append(settled(held))
                    held = []
                last = here
                held.append((ids[i], np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), _U)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*edges, strict=True)], names=["a", "b"])
        if held:
            a, b = settled(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = cells.join(sets, "node").select(*keys, "id", "elements").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(link, "a long, b long")


def _blocks(nodes: Column, mass: Column) -> Column:
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(mass / BLOCK_ELEMENTS)).cast("int")


def _block_of(node: str, band: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(node, band), F.col(blocks)).cast("int")


def join_blocks(member: DataFrame, sets: DataFrame, labels: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """Labels after the members of buckets of several blocks that are outside the main class have met all blocks.

    ``member`` holds (band, node, mass, blocks) of these buckets.
    """
    classed = scratch.keep(member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    counts = classed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))
    main = counts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.max(F.struct("n", "label", "mass")).alias("top"))
    outside = _blocks(F.col("n") - F.col("top.n"), F.col("mass") - F.col("top.mass")).alias("rows")
    open_ = scratch.keep(main.where("labels > 1").select("band", "main", outside), narrow=True)
    row, column = _block_of("node", "band", "rows"), _block_of("node", "band", "blocks")
    along = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.when(F.col("label") != F.col("main"), F.transform(along("blocks"), lambda j: F.struct(row.alias("i"), j.alias("j"))))
    all_ = F.transform(along("rows"), lambda i: F.struct(i.alias("i"), column.alias("j")))
    cell = F.explode(F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<struct<i:int,j:int>>")), all_)))
    cells = classed.join(open_, "band").select("band", "node", "label", cell.alias("cell")).select("band", "cell.i", "cell.j", "node", F.col("label").alias("id"))
    found = scratch.keep(join_cells(cells, sets, similar).distinct(), narrow=True)
    scratch.drop(classed, open_)
    merged = components(found, scratch).toDF("label", "least")
    return scratch.keep(labels.join(merged, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("least", "label").alias("label")), narrow=True)


def classes(docs: DataFrame, similar: float = SIMILAR, weighted: bool = True) -> DataFrame:
    """(rid, text_key, class_id, kept) of every row; a class is named by its least row id, and that id's rows with its least text key are kept."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    text = whole(F.col("text"))
    keyed = docs.select(row_id(F.col("doc_id"), text).alias("rid"), F.md5(text).alias("text_key"), text.alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weirflow.llm.token_counts import by_bytes

        take_over("near_dedup", _powers.cache_clear)
        for batch in batches:
            for start, n in by_bytes(batch.column(2), BATCH_BYTES):
                part = batch.slice(start, n)
                found, mass = text_bands(part.column(2), weighted)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat, pa.array(mass)], names=["rid", "text_key", "bands", "mass"])
        trim()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weirflow.llm.token_counts import by_bytes

        for batch in batches:
            for start, n in by_bytes(batch.column(1), BATCH_BYTES):
                part = batch.slice(start, n)
                element, ends = text_sets(part.column(1), weighted)
                starts = np.concatenate(([0], ends))
                packed = pa.array([element[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["node", "elements"])
        trim()

    rows = scratch.keep(keyed.mapInArrow(read, "rid long, text_key string, bands array<long>, mass long"))
    once = rows.groupBy("text_key").agg(F.min("rid").alias("rid"), F.first("bands").alias("bands"), F.first("mass").alias("mass"))
    nodes = scratch.keep(once.withColumn("node", F.monotonically_increasing_id()))  # numbers hold once they are written
    member = nodes.select("node", "mass", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = (
        member.groupBy("band")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("sign"), F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), F.min("mass").alias("least"), F.max("mass").alias("most"))
        .where((F.col("n") > 2) | ((F.col("n") == 2) & (F.col("least") >= F.col("most") * (similar - 1e-9))))
    )
    buckets = sizes.groupBy("low", "high", "sign", "n", "mass").agg(F.min("band").alias("band")).select("band", _blocks(F.col("n"), F.col("mass")).alias("blocks"))
    member = scratch.keep(member.join(scratch.keep(buckets, narrow=True), "band").select("band", "node", "mass", F.greatest(F.col("blocks"), F.lit(1)).alias("blocks")))
    shared = scratch.keep(member.select("node").distinct().join(nodes.select("node", "rid", "text_key"), "node"), narrow=True)
    # One text of each node that shares a bucket; others, and equal rows but one, go before the shuffle.
    few = maybe_in(keyed, "text_key", shared, shared.count())
    texts = few.dropDuplicates(["rid", "text_key"]).join(shared, ["rid", "text_key"]).select("node", "text")
    sets = scratch.keep(texts.mapInArrow(gather, "node long, elements binary"))
    large = member.where("blocks > 1")
    centres = large.groupBy("band", "blocks", F.pmod(F.xxhash64("node"), F.lit(CENTRES))).agg(F.min("node").alias("node")).select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node")
    cells = member.select("band", _block_of("node", "band", "blocks").alias("block"), "node").unionByName(centres).withColumn("id", F.col("node"))
    found = scratch.keep(join_cells(cells, sets, similar).distinct(), narrow=True)
    labels = components(found, scratch)
    if large.limit(1).count():
        labels = join_blocks(large, sets, labels, similar, scratch)
    scratch.drop(found, sets, member, shared)
    named = nodes.select("text_key", "node", "rid").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.keep(named.select("text_key", "rid", "label"), narrow=True)
    scratch.drop(nodes)
    heads = named.groupBy("label").agg(F.min(F.struct("rid", "text_key")).alias("head")).select("label", "head.rid", "head.text_key")
    first = heads.groupBy("rid").agg(F.min("text_key").alias("first"))
    name = F.when(F.col("text_key") == F.col("first"), F.col("rid")).otherwise(row_id(F.lit(None), F.col("text_key")))
    heads = heads.join(first, "rid").select("label", F.col("rid").alias("head_rid"), F.col("text_key").alias("head_key"), name.alias("class_id"))
    named = scratch.keep(named.join(heads, "label").select("text_key", "head_rid", "head_key", "class_id"), narrow=True)
    kept = (F.col("rid") == F.col("head_rid")) & (F.col("text_key") == F.col("head_key"))
    return rows.select("rid", "text_key").join(named, "text_key").select("rid", "text_key", "class_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, weighted: bool = True) -> DataFrame:
    """(doc_id, class_id, kept) of every row; the row that names the class is kept."""
    return classes(docs, similar, weighted).select(F.when(F.col("rid") >= 0, F.col("rid")).alias("doc_id"), "class_id", "kept")


def deduplicated(docs: DataFrame, similar: float = SIMILAR, weighted: bool = True) -> DataFrame:
    """One row of every class, with the columns of ``docs``."""
    heads = classes(docs, similar, weighted).where("kept").select("rid", "text_key").distinct()
    text = whole(F.col("text"))
    tagged = docs.select(row_id(F.col("doc_id"), text).alias("rid"), F.md5(text).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = tagged.join(heads, ["rid", "text_key"], "left_semi")
    return kept.dropDuplicates(["rid", "text_key"]).select("row.*")
