"""Approximate nearest neighbours: balanced posting lists with replicated boundaries.

Equal vectors are searched once: a distinct vector stands for all its rows, of which the
smallest ``top + 1`` ids suffice for any answer. Inner products become distances by one
extra coordinate that lifts every vector to the greatest norm.

Centroids come from balanced k-means on a bounded sample (clusters too large for their
share are split). Every vector is put on the posting list of its nearest centroid and,
near a boundary, on those of further centroids whose distance is within ``REPLICATE`` of the
nearest, as long as they are not nearer to one already chosen. Queries walk a graph of
the centroids held in memory, from neighbour to neighbour, and search the lists whose
centroid's distance is within a ratio of the nearest found. The ratio is fitted on the
sample, so that the lists it selects hold the wanted share of true neighbours. Lists with
near centroids share a group of bounded size, and a query
meets its lists of a group at once, so that it gets one short answer from each group;
products are exact, in double precision.

The graph in memory has at most ``MOST_LISTS`` centroids, whatever the table's size. Beyond that lists grow, and one of
more than ``SPLIT`` vectors gets centroids of its own, fitted on a bounded share of it; its
vectors are put on inner lists, boundaries replicated as before, and queries that reach it choose
among the inner lists by the same ratio. So the vectors that a query meets follow the ratio and not the table's
size, and centroids of inner lists are never all in one place. A list that is still longer than a group is cut into chunks.

Fitting is bounded by ``SAMPLE`` rows, and by ``PER_INNER`` rows for each inner list; every row is indexed.

Defined cases: vectors that are null, empty, zero, of another than the commonest length, or hold null or non-finite components
take no part; null ids are no queries and no candidates; equal scores go to the smaller id;
with fewer candidates than asked for, all that are found are returned; repeated rows
(same id, same vector) count once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import side
from weirflow.plans.runtime import Scratch, ship

#: Rows in the fit, at most, and centroids, at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Distinct vectors for each centroid that the number of lists aims at, and listed rows in a group.
PER_LIST, GROUP = 256, 8192
#: Vectors beyond which a list gets inner lists, and rows for each of these in their fit.
SPLIT, PER_INNER = 32_768, 24
#: Distinct query vectors that may meet a group of lists at once.
QUERIES = 100_000
#: Lists a vector may stand on, and how much farther than the nearest they may be.
COPIES, REPLICATE = 4, 1.12
#: Share of true neighbours that the selected lists have to hold on the sample.
WANTED = 0.96


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, of all rows of one with all rows of the other."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, slack: float = 1.5) -> np.ndarray:
    """k-means whose clusters larger than ``slack`` times their share are split in two."""
    rng = np.random.default_rng(7)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for turn in range(rounds):
        near = np.concatenate([distances(x[s : s + 8192], c).argmin(1) for s in range(0, len(x), 8192)])
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        if turn < rounds - 2:
            small, large = np.argsort(size, kind="stable"), np.flatnonzero(size > slack * len(x) / k)
            for s, big in zip(small, large[np.argsort(-size[large], kind="stable")], strict=False):
                if size[s] * 2 >= size[big]:
                    break
                members = np.flatnonzero(near == big)
                c[s] = x[members[rng.integers(len(members))]]  # an emptier list takes over a part
    return c


@dataclass
class Graph:
    """Centroids and, for each, its nearest others and a few far ones."""

    centroids: np.ndarray
    links: list[np.ndarray]

    @classmethod
    def build(cls, centroids: np.ndarray, near: int = 16, far: int = 4) -> Graph:
        rng = np.random.default_rng(11)
        k = len(centroids)
        found: list[set[int]] = [set() for _ in range(k)]
        for s in range(0, k, 1024):
            d = distances(centroids[s : s + 1024], centroids)
            order = np.argpartition(d, min(near, k - 1), axis=1)[:, : near + 1]
            for i, row in enumerate(order.tolist(), s):
                for j in row:
                    if j != i:
                        found[i].add(j)
                        found[j].add(i)
        for i in range(k):
            found[i].update(int(j) for j in rng.integers(k, size=far) if j != i)
        return cls(centroids, [np.array(sorted(f), np.int64) for f in found])

    def search(self, q: np.ndarray, ratio: float, least: int = 4) -> list[int]:
        """Centroids whose squared distance is within ``ratio`` of the nearest found, reached over the graph."""
        c = self.centroids
        entry = np.unique(np.linspace(0, len(c) - 1, min(8, len(c))).astype(np.int64))
        seen = np.zeros(len(c), bool)
        seen[entry] = True
        d = ((c[entry] - q) ** 2).sum(1)
        frontier = list(zip(d.tolist(), entry.tolist(), strict=True))
        heapq.heapify(frontier)
        found = list(frontier)
        best = min(d)
        kept = heapq.nsmallest(least, [x for x, _ in found])
        while frontier:
            dist, i = heapq.heappop(frontier)
            # A step beyond the selected ratio leaves room for lists behind a worse neighbour.
            if dist > max(best * ratio * 1.1, kept[-1] if len(kept) >= least else np.inf):
                break
            new = self.links[i][~seen[self.links[i]]]
            if not len(new):
                continue
            seen[new] = True
            d = ((c[new] - q) ** 2).sum(1)
            best = min(best, float(d.min()))
            for x, j in zip(d.tolist(), new.tolist(), strict=True):
                heapq.heappush(frontier, (x, j))
                found.append((x, j))
            kept = heapq.nsmallest(least, [*kept, *d.tolist()])
        limit = max(best * ratio, kept[-1])
        return [j for x, j in found if x <= limit]


def assign(x: np.ndarray, c: np.ndarray, copies: int = COPIES, ratio: float = REPLICATE) -> list[list[int]]:
    """The lists of each vector: the nearest, and near boundaries further ones that are not shadowed by one chosen."""
    k = min(copies * 2, len(c))
    out: list[list[int]] = []
    between = distances(c, c) if len(c) <= 4096 else None
    for s in range(0, len(x), 4096):
        d = distances(x[s : s + 4096], c)
        order = np.argpartition(d, k - 1, axis=1)[:, :k]
        rows = np.arange(len(d))[:, None]
        order = order[rows, np.argsort(d[rows, order], axis=1, kind="stable")]
        near = d[rows, order]
        for row, dist in zip(order.tolist(), near.tolist(), strict=True):
            chosen = [row[0]]
            for j, dj in zip(row[1:], dist[1:], strict=True):
                if dj > dist[0] * ratio or len(chosen) == copies:
                    break
                if between is None or all(between[j, i] >= dj * 0.5 for i in chosen):
                    chosen.append(j)
            out.append(chosen)
    return out


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))])


@dataclass
class Index:
    """What a search needs on every executor; its size is bounded by ``MOST_LISTS``."""

    graph: Graph
    norm2: float
    ratio: float

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        return assign(lifted(x, self.norm2), self.graph.centroids)

    def probes(self, q: np.ndarray) -> list[list[int]]:
        unit = q * (np.sqrt(self.norm2) / np.sqrt((q * q).sum(1)))[:, None]
        return [self.graph.search(v, self.ratio) for v in np.column_stack([unit, np.zeros(len(q))])]


def fit(sample: np.ndarray, n_lists: int, norm2: float, top: int, wanted: float = WANTED) -> Index:
    """Centroids, their graph, and the smallest ratio whose lists hold ``wanted`` of the sample's true neighbours."""
    x = lifted(sample, norm2)
    graph = Graph.build(balanced_centroids(x, n_lists))
    index = Index(graph, norm2, 1.0)
    lists = index.lists_of(sample)
    rng = np.random.default_rng(3)
    asked = rng.choice(len(sample), min(300, len(sample)), replace=False)
    products = sample[asked] @ sample.T
    products[np.arange(len(asked)), asked] = -np.inf
    # The sample is thinner than the table: its nearest few stand for the table's nearest ``top``.
    wide = min(top, len(sample) - 1)
    if wide < 1:
        return index
    true = np.argpartition(-products, wide - 1, axis=1)[:, :wide]
    for ratio in (1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5, 1.7, 2.0, 3.0, 5.0, np.inf):
        index.ratio = float(min(ratio, 1e9))
        got = 0
        for probe, near in zip(index.probes(sample[asked]), true.tolist(), strict=True):
            probe_set = set(probe)
            got += sum(not probe_set.isdisjoint(lists[j]) for j in near)
        if got >= wanted * true.size:
            break
    return index


def search(vectors: DataFrame, is_query: Column, top: int = 20, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``is_query`` selects, against all rows but their own."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = vectors.where(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), is_query.alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    name = F.concat(F.hex(F.xxhash64("v")), F.hex(F.hash("v").cast("long")))  # 96 bits stand for a vector's value
    rows = rows.where(F.size("v") == (length["d"] if length else 0)).withColumn("key", name)
    # A distinct vector with the ids it answers with; the group limit runs before the shuffle.
    smallest = rows.select("key", "id", "v").dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= top + 1)
    distinct = scratch.keep(smallest.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = scratch.keep(rows.where("asks").groupBy("key").agg(F.first("v").alias("v")))
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    taken = distinct.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()["v"].combine_chunks()
    points = np.asarray(taken.flatten()).reshape(len(taken), -1)
    index = fit(points, int(np.clip(facts["n"] // PER_LIST, 1, MOST_LISTS)), facts["norm2"], top)
    n_lists = len(index.graph.centroids)
    groups = min(n_lists, max(1, -(-2 * facts["n"] // GROUP)))

    def on_lists(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.names.index("v")).flatten()).reshape(batch.num_rows, -1)
            lists = index.probes(x) if probing else index.lists_of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    stored = distinct.repartition(spread(spark)).mapInArrow(lambda it: on_lists(it, False), "key string, v array<double>, ids array<long>, lists array<int>")
    stored = scratch.keep(stored.select("key", "v", "ids", F.explode(F.col("lists").cast("array<long>")).alias("list")))
    probing = asked.repartition(spread(spark)).mapInArrow(lambda it: on_lists(it, True), "key string, v array<double>, lists array<int>")
    probing = probing.select("key", "v", F.explode(F.col("lists").cast("array<long>")).alias("list"))
    counts = stored.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MOST_LISTS rows
    long_ones = [(r["list"], -(-r["n"] // GROUP), r["n"]) for r in counts if r["n"] > SPLIT]
    if long_ones:
        stored, probing = inner_lists(stored, probing, long_ones, index, scratch)
    # Lists are dealt to groups of neighbouring centroids, inner lists are groups of their own, and a list too large for its share is cut into chunks.
    group_of = (np.argsort(np.argsort(index.graph.centroids[:, 0], kind="stable"), kind="stable") * groups // n_lists).tolist()
    outer = spark.createDataFrame([(c, int(g)) for c, g in enumerate(group_of)], "list long, grp long")
    sizes = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("chunks"))
    homes = scratch.keep(sizes.join(F.broadcast(outer), "list", "left").select("list", F.coalesce("grp", "list").alias("grp"), "chunks"))
    n_homes = homes.count()
    parts = max(1, -(-asked.count() // QUERIES))  # very many queries are dealt into parts, which each meet every group
    stored = (
        stored.join(side(homes.toDF("list", "grp", "chunks"), n_homes), "list")
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    meets = probing.join(side(homes, n_homes), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meets = meets.groupBy("key", "grp", "chunk").agg(F.first("v").alias("v"), F.collect_list("list").alias("lists")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    best = top + 1

    def compare(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"key": [], "near": [], "score": [], "ids": []})
        if not len(queries) or not len(found):
            return none
        q, x = np.stack(queries["v"].to_numpy()), np.stack(found["v"].to_numpy())
        low = np.array([i[0] for i in found["ids"]])
        asking: dict[int, list[int]] = {}
        for k, lists in enumerate(queries["lists"]):
            for c in lists:
                asking.setdefault(c, []).append(k)
        who, what, value = [], [], []
        for c, at in found.groupby("list").indices.items():
            ask = np.array(asking.get(c, []), np.int64)
            for s in range(0, len(ask), 1024):
                some = ask[s : s + 1024]
                row, col = picked(q[some] @ x[at].T, low[at], best)
                who.append(some[row])
                what.append(at[col])
        if not who:
            return none
        who, what = np.concatenate(who), np.concatenate(what)
        value = np.concatenate([in_order(q[who[s : s + 65536]], x[what[s : s + 65536]]) for s in range(0, len(who), 65536)])
        order = np.lexsort((low[what], -value, who))
        who, what, value = who[order], what[order], value[order]
        twice = np.zeros(len(who), bool)  # a vector on two lists
        twice[1:] = (who[1:] == who[:-1]) & (low[what[1:]] == low[what[:-1]])
        who, what, value = who[~twice], what[~twice], value[~twice]
        first = np.searchsorted(who, who)
        keep = np.arange(len(who)) - first < best
        who, what, value = who[keep], what[keep], value[keep]
        return pd.DataFrame({"key": queries["key"].to_numpy()[who], "near": low[what], "score": value, "ids": found["ids"].to_numpy()[what]})

    place = ["grp", "chunk", "part"]
    met = meets.select(*place, "key", "v", "lists").groupBy(*place).cogroup(stored.select(*place, "list", "v", "ids").groupBy(*place)).applyInPandas(compare, "key string, near long, score double, ids array<long>")
    along = Window.partitionBy("key").orderBy(F.desc("score"), "near")
    # Groups may repeat a vector that stands on lists of both; one of each is left, then the best.
    leading = met.dropDuplicates(["key", "near"]).withColumn("r", F.row_number().over(along)).where(F.col("r") <= best)
    answers = leading.groupBy("key").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("down"), i.alias("id")))))
    answers = scratch.keep(answers.select("key", F.slice(F.array_sort(flat), 1, best).alias("near")))
    asking_rows = rows.where("asks").select(F.col("id").alias("query_id"), "key").distinct()
    final = asking_rows.join(answers, "key").select("query_id", F.slice(F.filter("near", lambda f: f["id"] != F.col("query_id")), 1, top).alias("near"))
    out = final.select("query_id", F.posexplode("near").alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.down")).alias("score"))


#: Inner list ``i`` of list ``c`` is numbered ``(c + 1) * INNER + i``, beyond all outer lists.
INNER = 1 << 32


def inner_lists(stored: DataFrame, probing: DataFrame, long_ones: list[tuple[int, int, int]], index: Index, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Stored vectors and queries with inner lists in place of long ones, given as (list, inner lists, vectors)."""
    spark, norm2, ratio = stored.sparkSession, index.norm2, index.ratio
    sizes = F.broadcast(spark.createDataFrame(long_ones, "list long, inner long, n long"))  # at most MOST_LISTS rows
    one_in = F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("inner") * PER_INNER)))

    def fit_list(rows: pd.DataFrame) -> pd.DataFrame:
        c = balanced_centroids(lifted(np.stack(rows["v"].to_numpy()), norm2), int(rows["inner"].iloc[0]))
        return pd.DataFrame({"list": rows["list"].iloc[0], "c": list(c)})

    fitted = stored.join(sizes, "list").where(F.pmod(F.xxhash64("key", F.lit("fit")), one_in) == 0)
    centroids = scratch.keep(fitted.groupBy("list").applyInPandas(fit_list, "list long, c array<double>"))

    def dealt(df: DataFrame, share: Column) -> DataFrame:
        """Rows of long lists in parts of bounded size, each of which meets its list's centroids."""
        return df.join(sizes, "list").withColumn("of", share).withColumn("part", F.pmod(F.xxhash64("key"), F.col("of")))

    def met(df: DataFrame, share: Column, choose, schema: str) -> DataFrame:
        rows = dealt(df, share)
        known = centroids.join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), share - 1))).select("list", "part", "c")
        return rows.groupBy("list", "part").cogroup(known.groupBy("list", "part")).applyInPandas(choose, schema)

    def place(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        lists = assign(lifted(np.stack(rows["v"].to_numpy()), norm2), np.stack(known["c"].to_numpy())) if len(rows) else []
        at = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        inner = np.array([i for x in lists for i in x], np.int64)
        out = rows.iloc[at]
        return pd.DataFrame({"key": out["key"], "v": out["v"], "ids": out["ids"], "list": (out["list"].to_numpy() + 1) * INNER + inner})

    def probe(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"key": [], "v": [], "list": []})
        q, c = np.stack(rows["v"].to_numpy()), np.stack(known["c"].to_numpy())
        unit = q * (np.sqrt(norm2) / np.sqrt((q * q).sum(1)))[:, None]
        d = distances(np.column_stack([unit, np.zeros(len(q))]), c)
        few = min(4, len(c)) - 1
        at, inner = np.nonzero(d <= np.maximum(d.min(1) * ratio, np.partition(d, few, axis=1)[:, few])[:, None])
        out = rows.iloc[at]
        return pd.DataFrame({"key": out["key"], "v": out["v"], "list": (out["list"].to_numpy() + 1) * INNER + inner})

    names = F.broadcast(spark.createDataFrame([(c,) for c, *_ in long_ones], "list long"))
    asking = scratch.keep(probing)
    inner = met(stored, F.ceil(F.col("n") / GROUP), place, "key string, v array<double>, ids array<long>, list long")
    reached = met(asking, F.lit(max(1, -(-asking.count() // (GROUP * len(long_ones))))).cast("long"), probe, "key string, v array<double>, list long")
    stored = scratch.keep(stored.join(names, "list", "left_anti").select("key", "v", "ids", "list").unionByName(inner))
    return stored, asking.join(names, "list", "left_anti").select("key", "v", "list").unionByName(reached)


def spread(spark) -> int:
    """Partitions for work that is heavier than its rows are wide."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def picked(products: np.ndarray, low: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``best`` greatest; all columns that tie with the last of them, to rounding, stay in."""
    n = products.shape[1]
    if n <= best:
        return np.divmod(np.arange(products.size), n)
    bound = np.partition(products, n - best, axis=1)[:, n - best]
    return np.nonzero(products >= (bound - 1e-9 * np.maximum(1.0, np.abs(bound)))[:, None])


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, components added in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total
