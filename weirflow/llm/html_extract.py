"""HTML extraction with a host suffix array.

A page is read once into blocks: runs of text between block-level tags, with character
references decoded and white space folded. Markup decides what it can. Blocks inside
navigation, headers, footers, asides, forms, scripts, styles and elements whose class or
id names an advert, a menu, a notice or comments never are article text; blocks inside
``article`` or ``main`` are, headers too, unless they are one of the other tags, hidden, or
have one of the few whole class names of ``_NAMED_INSIDE``. What lies outside both is undecided, and there the
host's suffix arrays decide. On a host where any page marks no article, every page goes through them: token streams of the blocks outside
articles of all its pages are concatenated, and tokens that lie in a long substring found on
a share of the host's pages are boilerplate; a menu marked on some pages is known on those that
do not mark it. The runs that remain are kept. Passages that few pages share are no
boilerplate, and copies are one page: equal token streams, and those that such substrings
cover almost wholly, which is found first, all together. A page with an article needs none
of the undecided blocks, since the article is marked.

Repetition alone would be a wrong test inside an article: passages that many articles
share belong to each of them. That is why the suffix arrays rule only where markup is silent.

Pages are read twice: once for what lies outside articles, of which equal streams are one row with the number of
different articles that have it, and at the end for the articles, so those are not shuffled. Arrays are grouped
by host and a salt over token streams, so no group holds more than about ``PAGES_PER_ARRAY``
rows of a host of any size. An array only counts the pages of its salt that hold each run of
``REPEAT_TOKENS`` tokens; the counts are added up over the host by 64-bit hashes of the runs,
and every salt reads the host's table, so the result does not depend on the salts.

Defined cases: a null page is empty; a page without any text gives an empty text; pages
cut off in the middle end their open elements; a head without its end tag ends at the first
text or tag that cannot be in it, another skipped element with the element around it; a host of one page keeps its undecided
blocks; null urls share the empty host; rows with equal token streams are one page,
whatever their page ids; on a host where all pages are copies nothing is boilerplate; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.llm.common import side
from weirflow.llm.url_filter import host_of
from weirflow.plans.runtime import Scratch, ship

#: Tokens that a substring must have to count as boilerplate.
REPEAT_TOKENS = 6
#: It must be on this share of the host's distinct pages, and on so many or more than half of them.
SHARE, LEAST_PAGES = 0.1, 3
#: Distinct pages covered to this share by such substrings are copies of each other and count as one page.
COPY_SHARE = 0.95
#: Pages of a host in one suffix array, on average at most.
PAGES_PER_ARRAY = 2000

_SKIP = frozenset("script style noscript template svg math iframe object canvas select textarea title head button".split())
#: Of these, elements whose content is not markup; they end at their own end tag only.
_RAW = frozenset("script style textarea title".split())
#: Any other tag, and text, ends a head whose end tag is left out.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_BOILER = frozenset("nav header footer aside form menu dialog".split())
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements of these kinds end when one of the same kind, or a block for ``p``, begins.
_CLOSED_BY_SELF = frozenset("li dt dd tr td th option p".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|promo|sponsor(?:ed)?|sidebar|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|foot(?:er)?|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|share|social|related|recommend(?:ed|ations)?|comments?|replies|disqus|widget|pagination|pager|toolbar|copyright|legal|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Whole class names that mark a block inside ``article`` or ``main``, or an ``article`` itself, as no part of its text.
_NAMED_INSIDE = frozenset("ad ads advert advertisement sponsored share sharing social-share comments comment comment-body comment-list comment-content related-posts".split())
#: Quotes hold a value together only after an equals sign.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TELLING = frozenset("class id role hidden aria-hidden".split())

#: What markup says about a block.
NO, MAYBE, YES = 0, 1, 2


def _is_boiler(attributes: str, in_main: bool = False) -> bool:
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name not in _TELLING:
            continue
        value = value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if in_main:
            if name == "class" and not _NAMED_INSIDE.isdisjoint(value.lower().split()):
                return True
        elif name in ("class", "id") and _NAMED.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(verdict of the markup, text) of each block that has text, in page order, without those of skipped elements."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, verdict inside, whether this element set it
    state, pieces, at, n = MAYBE, [], 0, len(page)
    skipped = -1  # place of the outermost skipped element in the stack

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((state, text))
            pieces.clear()

    def resume() -> None:
        nonlocal state, skipped
        state = stack[skipped][1]
        del stack[skipped:]
        skipped = -1

    match = _TAG.search
    while at < n:
        m = match(page, at)
        if skipped >= 0 and stack[-1][0] == "head" and page[at : m.start() if m else n].strip():
            resume()
        if m is None:
            if skipped < 0:
                pieces.append(page[at:])
            break
        if skipped < 0 and m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK and skipped < 0:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if k <= skipped:  # its own end, or that of an element around it
                        resume()
                        if k == len(stack):
                            break
                        flush()
                    if any(s[1] != state for s in stack[k:]):
                        flush()
                    state = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name == "br":
            pieces.append(" ") if skipped < 0 else None
            continue
        if skipped >= 0 and stack[-1][0] == "head" and name not in _IN_HEAD:
            resume()
        if name in _BLOCK and skipped < 0:
            flush()
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if name in _SKIP or skipped >= 0:  # without its end tag it ends with the element around it
            if not m[3].endswith("/"):
                stack.append((name, state, True))
                skipped, state = len(stack) - 1 if skipped < 0 else skipped, NO
            continue
        if name in _BLOCK and stack and stack[-1][0] in _CLOSED_BY_SELF and (stack[-1][0] == name or stack[-1][0] == "p"):
            state = stack.pop()[1]
        attributes = m[3]
        inside = state
        if state != NO:
            in_main = state == YES
            if name in _MAIN:
                inside = YES
            elif name in _BOILER and not (name == "header" and in_main):
                inside = NO
            if attributes and name not in ("html", "body", "main") and _is_boiler(attributes, in_main or name == "article"):
                inside = NO
        if inside != state:
            flush()
        if not attributes.endswith("/"):
            stack.append((name, state, True))
            state = inside
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling and the common prefix length (up to 2^k tokens) with the suffix before."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        second = np.full(n, -1, np.int64)
        second[:-k] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = new
        if rank.max() == n - 1:
            break
        k *= 2
    # Common prefixes by Kasai's rule, on plain lists.
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    common, h = [0] * n, 0
    t, where, sa = tokens.tolist(), place.tolist(), order.tolist()
    for i in range(n):
        w = where[i]
        if w:
            j = sa[w - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            common[w] = h
            h -= h > 0
        else:
            h = 0
    return order, np.array(common, np.int64)


def _runs(streams: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The page of every place in the joined streams, suffixes in order, and where in it each run of suffixes with the same first ``least`` tokens starts."""
    parts, owner = [], []
    for p, s in enumerate(streams):  # a separator of its own ends each page
        parts += [np.asarray(s, np.int64), np.array([-1 - p])]
        owner.append(np.full(len(s) + 1, p))
    order, common = suffix_array(np.concatenate(parts))
    run = np.cumsum(common < least)
    return np.concatenate(owner), order, np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))


def _covered(hit: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of ``n`` places lie in a stretch of ``least`` tokens that starts at one of ``hit``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, np.minimum(hit + least, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_tokens(streams: list[list[int]], least: int = REPEAT_TOKENS) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a substring of at least ``least`` tokens found on another page too."""
    sizes = [len(s) for s in streams]
    if not sum(sizes):
        return [np.zeros(n, bool) for n in sizes]
    page, order, starts = _runs(streams, least)
    # In a run of suffixes that share ``least`` tokens, two pages make all of them repeated.
    of = page[order]
    many = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
    covered = _covered(order[np.repeat(many, np.diff(np.append(starts, len(order))))], len(order), least)
    out, at = [], 0
    for n in sizes:
        out.append(covered[at : at + n])
        at += n + 1
    return out


def _token_hashes(streams: list[list[str]]) -> list[np.ndarray]:
    known: dict[str, int] = {}
    for t in {t for s in streams for t in s}:
        known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return [np.array([known[t] for t in s], np.uint64) for s in streams]


def run_hashes(tokens: np.ndarray, least: int = REPEAT_TOKENS) -> np.ndarray:
    """A 64-bit hash of the ``least`` tokens from each place on, from the tokens' hashes."""
    n = len(tokens) - least + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(least if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
    return out.view(np.int64)


def run_counts(streams: list[list[str]], least: int = REPEAT_TOKENS, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``least`` tokens in some pages' streams, once each, and on how many of the pages, by their weights, each is found."""
    if not any(len(s) >= least for s in streams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _token_hashes(streams)
    known: dict[int, int] = {}
    page, order, starts = _runs([[known.setdefault(t, len(known)) for t in h.tolist()] for h in hashes], least)
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1
    whole = order + least <= ends[page[order]]  # not across the end of a page
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))[whole]
    pairs = np.unique(np.stack([run, page[order][whole]]), axis=1)
    _, first, pages = np.unique(pairs[0], return_index=True, return_counts=True)
    if weight is not None:
        pages = np.add.reduceat(np.asarray(weight, np.int64)[pairs[1]], first)
    at = np.full(len(starts), -1)
    at[run] = order[whole]
    joined = run_hashes(np.concatenate([np.append(h, np.uint64(0)) for h in hashes]), least)
    return joined[at[pairs[0][first]]], pages


def common_tokens(blocks: Iterable[list[str]], common: np.ndarray, least: int = REPEAT_TOKENS) -> Iterator[tuple[list[list[str]], np.ndarray]]:
    """Each page's blocks as tokens, and which of all of them lie in a run whose hash is in ``common``."""
    split = [[b.split(" ") for b in p] for p in blocks]
    for p, tokens in zip(split, _token_hashes([[t for b in p for t in b] for p in split]), strict=True):
        yield p, _covered(np.flatnonzero(np.isin(run_hashes(tokens, least), common)), len(tokens), least)


def keep_unique(pages: Iterable[list[str]], common: np.ndarray, least: int = REPEAT_TOKENS) -> list[list[str]]:
    """The undecided blocks of pages without the tokens that lie in a run whose hash is in ``common``.

    A block goes whole or loses stretches of at least ``least`` tokens: what a run reaches over from
    the block before or after is not boilerplate for that.
    """
    out = []
    for p, covered in common_tokens(pages, common, least):
        kept, at = [], 0
        for b in p:
            own = covered[at : at + len(b)]
            at += len(b)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            gone = [(i, j) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if j - i >= least or j - i == len(b)]
            for i, j in reversed(gone):
                del b[i:j]
            kept.append(" ".join(b))
        out.append(kept)
    return out


def extract(pages: DataFrame, least: int = REPEAT_TOKENS, pages_per_array: int = PAGES_PER_ARRAY) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies outside articles: of pages without one (``open``) the undecided blocks, of others all such."""
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [blocks(page) if page else [] for page in part.column(3).to_pylist()]
                article = ["\n".join(b for v, b in f if v == YES) for f in found]
                own = [[b for v, b in f if (v == MAYBE if not a else v != YES)] for f, a in zip(found, article, strict=True)]
                marked = [[b for v, b in f if v == NO] if not a else [] for f, a in zip(found, article, strict=True)]
                names = [hashlib.sha256((a or "\n".join(o)).encode("utf-8", "surrogatepass")).hexdigest() for a, o in zip(article, own, strict=True)]
                text = pa.list_(pa.string())
                columns = [part.column(0), part.column(1), part.column(2), pa.array([not a for a in article]), pa.array(own, text), pa.array(marked, text), pa.array(names)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "open", "blocks", "marked", "layout"])

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = pa.array(["\n".join(b for v, b in blocks(page) if v == YES) or None if page else None for page in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["page_id", "url", "text"]).filter(texts.is_valid())

    def count(group: pd.DataFrame) -> pd.DataFrame:
        streams = lambda rows, of: [[t for b in bs for t in b.split(" ")] for bs in rows[of]]
        pages, beside = group[group["open"]].drop_duplicates("stream"), group[~group["open"]]
        runs, found = run_counts(streams(pages[~pages["copied"]], "blocks"), least)
        copies, _ = run_counts(streams(pages[pages["copied"]], "blocks"), least)
        known, on = run_counts(streams(beside, "blocks"), least, beside["pages"].to_numpy())
        rows = {"run": np.concatenate([runs, copies, known]), "pages": np.concatenate([found, 0 * copies, on]), "copied": np.repeat([False, True, False], [len(runs), len(copies), len(known)])}
        return pd.DataFrame({"host": group["host"].iloc[0], "salt": group["salt"].iloc[0], "open": np.arange(len(rows["run"])) < len(runs) + len(copies), **rows})

    def find_copies(group: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        found = [c.mean() >= COPY_SHARE for _, c in common_tokens(group["blocks"], common["run"].to_numpy(np.int64), least)]
        return group.assign(copied=group["open"] & np.array(found, bool))

    def settle(group: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        group = group[group["open"]]
        kept = keep_unique(group["blocks"], common["run"].to_numpy(np.int64), least)
        return pd.DataFrame({"host": group["host"], "layout": group["layout"], "text": ["\n".join(b for b in bs if b) for bs in kept]})

    def with_common(distinct: DataFrame, then: Callable, schema: StructType | str) -> DataFrame:
        """``then`` on each salt's pages and those of its runs that are boilerplate on the host."""
        counts = scratch.keep(distinct.groupBy("host", "salt").applyInPandas(count, "host string, salt long, open boolean, run long, pages long, copied boolean"))
        sizes = scratch.keep(distinct.where("open").groupBy("host").agg((F.count_distinct(F.when(~F.col("copied"), F.col("stream"))) + F.max(F.col("copied").cast("int"))).alias("n")))
        found = counts.groupBy("host", "run").agg((F.sum("pages") + F.max(F.col("copied").cast("int"))).alias("pages"))
        need = F.greatest(F.lit(2), F.ceil(F.col("n") * SHARE), F.least(F.floor(F.col("n") / 2) + 1, F.lit(LEAST_PAGES)))
        common = found.join(side(sizes, sizes.count()), "host").where(F.col("pages") >= need).select("host", "run")
        held = counts.where("open").select("host", "salt", "run").join(common, ["host", "run"])
        return distinct.groupBy("host", "salt").cogroup(held.groupBy("host", "salt")).applyInPandas(then, schema)

    scratch = Scratch(spark)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    outside = scratch.keep(rows.mapInArrow(read, f"page_id {kind}, url string, host string, open boolean, blocks array<string>, marked array<string>, layout string"))
    # Copies of a page are one page here, and get its text at the end.
    stream = F.sha2(F.array_join("blocks", " "), 256)
    silent = outside.where("open").where(F.size("blocks") > 0).groupBy("host", "layout").agg(F.first("blocks").alias("blocks"))
    silent = silent.select("host", "layout", "blocks", stream.alias("stream"), F.lit(1).cast("long").alias("pages"), F.lit(True).alias("open"))
    beside = outside.select("host", "layout", F.when(F.col("open"), F.col("marked")).otherwise(F.col("blocks")).alias("blocks")).where(F.size("blocks") > 0)
    beside = beside.groupBy("host", stream.alias("stream")).agg(F.first("blocks").alias("blocks"), F.count_distinct("layout").alias("pages"))
    beside = beside.select("host", F.lit("").alias("layout"), "blocks", "stream", "pages", F.lit(False).alias("open"))
    # Only hosts with pages that mark no article have something to decide.
    hosts = silent.select("host").distinct()
    distinct = scratch.keep(silent.unionByName(beside.join(hosts, "host", "left_semi")).withColumn("copied", F.lit(False)))
    host_sizes = scratch.keep(distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    salted = distinct.join(side(host_sizes, host_sizes.count()), "host").withColumn("salt", F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / pages_per_array))).drop("n")
    salted = scratch.keep(with_common(salted, find_copies, salted.schema))
    texts = scratch.keep(with_common(salted, settle, "host string, layout string, text string"))
    settled = outside.where("open").join(texts, ["host", "layout"], "left").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    done = pages.select("page_id", "url", "html").mapInArrow(articles, f"page_id {kind}, url string, text string")
    return done.unionByName(settled).withColumn("n_chars", F.length("text").cast("long"))
