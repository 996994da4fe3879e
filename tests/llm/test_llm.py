"""Every operator against brute force or the public library, and its odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F

from weirflow.llm import ann, byte_bpe, fingerprint, html_extract, mixing, near_dedup, queries, sharding, token_counts, toxicity
from weirflow.llm.url_filter import UrlRule, judge_urls

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, __key string"
ODD = [
    (1, None, "en", "a", None, 1, "x"), (2, "", "en", None, 0, 1, "x"), (3, " \n ", None, "a", 3, 1, "x"), (None, "one two", "en", "a", 7, 1, "x"), (None, None, None, None, None, None, None),
    (4, "the cat sat on the mat today", "en", "b", 28, 1, "x"), (4, "the cat sat on the mat today", "en", "b", 28, 1, "x"), (5, "THE cat sat  on the mat today", "en", "b", 29, 1, "x"),
    (6, "word " * 30_000, "en", "b", 150_000, 1, "x"), (7, "x" * 60_000, "en", "c", 60_000, 1, "x"), (8, "é日本😀\x1f́ 1", "xx", "c", 9, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def test_sql_of_the_queries(spark):
    for name, sql in queries.oracle_sql().items():
        compare(spark, queries.queries()[name], sql, SF)


def test_url_rules(spark):
    urls = [None, "", "nohost", "http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.b.net/fr/9?x", "http://net/fr/", "http://x.org", "http://xnet/fr/", "http://example.com", "http://q.com/EN/#a"]
    df = spark.createDataFrame([(i, u, "taken") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = [None, None, None, "example.com/en/", "www.example.com/en/", "net/fr/", "net/fr/", None, None, None, "com/"]
    for inline in (256, 0):
        got = judge_urls(df, queries.URL_RULES, inline_rules=inline).orderBy("page_id").collect()
        assert [r["rule"] for r in got] == want
        assert [r["verdict"] for r in got][3:6] == ["block", "allow", "block"]
    # Repeated rows are judged alike, of equally long rules the greater text wins, and other columns stay as they are.
    odd = spark.createDataFrame([(1, "http://ab.cd/", "k"), (1, "http://ab.cd/", "k"), (2, None, "n"), (2, None, "n")], "page_id long, url string, __key string").withColumn("__best", F.lit(7))
    ties = [UrlRule("allow", "ab.cd"), UrlRule("block", "ab.cd", "/"), UrlRule("block", "cd")]
    for inline in (256, 0):
        got = judge_urls(odd, ties, inline_rules=inline)
        assert got.columns == ["page_id", "url", "__key", "__best", "host", "path", "rule", "verdict"]
        rows = sorted(map(tuple, got.collect()))
        assert rows == [(1, "http://ab.cd/", "k", 7, "ab.cd", "/", "ab.cd/", "block")] * 2 + [(2, None, "n", 7, "", "", None, "allow")] * 2
    assert judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        UrlRule("maybe", "com")


def test_mixing_meets_its_targets(spark, odd):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 60), s) for i, s in enumerate(["hot"] * 2000 + ["b"] * 900 + ["c"] * 700 + [None] * 300)], "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    again = mixing.mix(docs).toPandas()
    assert sorted(zip(out.doc_id, out.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    assert (out.taken <= 2 * out["size"]).all()
    total = 0
    for _, part in out.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 60
        assert part.target.iloc[0] <= 2 * part["size"].sum() + 1e-6
        total += part.target.iloc[0]
    assert abs(total - 1.5 * out["size"].sum()) < 1e-3
    assert mixing.mixed_rows(docs).count() == out.copies.sum()
    assert mixing.mix(odd).count() == len(ODD)
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and Counter(map(tuple, rows.collect())).keys() <= Counter(ODD).keys()
    assert mixing.mix(odd.limit(0)).count() == 0 == mixing.mixed_rows(odd.limit(0)).count()


def test_mixing_cuts_among_repeated_rows(spark):
    rows = [(1, "w " * 50, "a")] * 3000 + [(i, "w " * 10, "a") for i in range(2, 1002)] + [(i, "w " * 40, "b") for i in range(2000, 4000)] + [(9, "x " * 25, "c")] * 400
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == len(rows)
    for _, part in out.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 25


def test_mixing_prefers_by_size_and_by_column(spark):
    """Inclusion is unequal: with the same rest, longer documents, or those of a greater column, are taken more often."""
    docs = spark.createDataFrame([(i, "w " * (5 if i % 2 else 80), "a", 1.0 + 8 * (i % 3 == 0)) for i in range(8000)], "doc_id long, text string, source string, good double")
    out = mixing.mix(docs, share=0.4).toPandas()
    taken = out.groupby("size").copies.mean()
    odds = taken / (1 - taken)
    assert 3 < odds[80] / odds[5] < 5.2  # the square root of 16
    out = mixing.mix(docs, share=0.4, prefer="good").toPandas()
    taken = out.groupby("good").copies.mean()
    odds = taken / (1 - taken)
    assert 7 < odds[9.0] / odds[1.0] < 11.5


def test_html_blocks():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A&amp;B</h1><p>x <b>y</b>\n z<br>w<aside>no</aside></article><footer>f</footer>'
    assert [b for v, b in html_extract.blocks(page) if v == html_extract.YES] == ["A&B", "x y z w"]
    assert html_extract.blocks("") == [] and html_extract.blocks("<p") == []


def test_html_names_inside_an_article():
    kept = '<header class="entry-header"><h1>a</h1></header><section id="related-work"><h2 id="search-engines">b</h2></section><div id="legal-basis">c</div><p class="notice">d</p><p class="ad-hoc">e</p>'
    gone = '<div class="box Ad">x</div><div class="share">x</div><ul class="comments"><li>x</ul><div class="related-posts">x</div><div hidden>x</div><nav>x</nav>'
    for tag in ("article", "main"):
        found = html_extract.blocks(f'<p class="notice">x</p><{tag}>{kept}{gone}f</{tag}><p id="legal">x</p>')
        assert [b for b in found if b != (html_extract.NO, "x")] == [(html_extract.YES, c) for c in "abcdef"]


def test_html_attributes_and_comments():
    yes = lambda page: [b for v, b in html_extract.blocks(page) if v == html_extract.YES]
    assert yes('<article><p>a</p></article><article class="comment"><p>x</p></article><article id="c" class="comment-body x">x</article>') == ["a"]
    assert yes('<article><p>a</p><article class="comment">x</article><p>b</p></article>') == ["a", "b"]
    assert yes("<article><a href=/it's>a</a> b<p title=don't>c</p></article>") == ["a b", "c"]
    assert yes('<article><p title="a hidden > gem">a</p><p data-x = \'>\' hidden>x</p><p alt="class=ad">b</p></article>') == ["a", "b"]
    assert yes('<article><p class="related">a</p><p data-note=hidden>b</p><a =">c</a></article>')[:2] == ["a", "b"]


def test_html_skipped_elements_without_their_end_tags():
    yes = lambda page: [b for v, b in html_extract.blocks(page) if v == html_extract.YES]
    assert yes('<html><head><title>t</title><script>"<p>"</script><meta x><body><article>a</article>') == ["a"]
    assert yes("<head><title>t</title><main><p>a</p></main>") == ["a"]
    assert html_extract.blocks("<head><title>t</title>a<p>b") == [(html_extract.MAYBE, "a"), (html_extract.MAYBE, "b")]
    for name in ("button", "select", "object", "svg", "canvas", "noscript", "template", "math", "iframe"):
        assert yes(f"<article><p>a</p><div>b<{name}><i>x<p>x</div><p>c</p></article><{name}>x</{name}>") == ["a", "b", "c"]
        assert yes(f"<article>a <{name}><i>x<div>x</div></{name}> b</article>") == ["a b"]
    assert yes("<article>a<svg/>b<script>c</article>") == ["ab"]


def test_repeated_substrings_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        pages = [[rng.randrange(4) for _ in range(rng.randrange(0, 30))] for _ in range(4)]
        got = html_extract.repeated_tokens(pages, 4)
        for p, page in enumerate(pages):
            want = np.zeros(len(page), bool)
            for i in range(len(page) - 3):
                if any(page[i : i + 4] == other[j : j + 4] for q, other in enumerate(pages) if q != p for j in range(len(other) - 3)):
                    want[i : i + 4] = True
            assert (got[p] == want).all()


def test_html_extraction(spark):
    head = "home news sport weather cars travel music"
    rows = [(1, "http://h.com/1", f"<div>{head}</div><div>first story here</div>"), (2, "http://h.com/2", f"<div>{head}</div><div>second story there</div>"), (3, None, None), (4, "http://h.com/3", "<article></article>"), (5, "http://o.com/", f"<div>{head}</div>"), (None, "http://h.com/4", "<main>m</main>tail")]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert out == {1: "first story here", 2: "second story there", 3: "", 4: "", 5: head, None: "m"}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_menu_of_few_unmarked_pages_on_a_large_host(spark):
    """The menu goes from every page that does not mark it, whether other pages of the host show it or not."""
    menu = "home news sport weather cars travel music"
    for shown in ("", f"<nav><p>{menu}</p></nav>", f'<div class="menu">{menu}</div>'):
        rows = [(i, f"http://big.org/{i}", f"<html>{shown}<article><p>story {i} of many</p></article>") for i in range(2000)]
        rows += [(5000 + i, f"http://big.org/x{i}", f'<script>var a="<article";</script><div>{menu}</div><div>other words of page number {i}</div>') for i in range(6)]
        out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_per_array=400)
        got = {r["page_id"]: r["text"] for r in out.collect()}
        assert got == {**{i: f"story {i} of many" for i in range(2000)}, **{5000 + i: f"other words of page number {i}" for i in range(6)}}


def test_html_extraction_against_brute_force(spark):
    """Pages put together from marked and unmarked parts: the text is what was put in as text."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    shared = {h: [" ".join(word() for _ in range(9)) for _ in range(2)] for h in range(4)}
    passage = " ".join(word() for _ in range(60))
    rows, want = [], []
    for i in range(160):
        h = i % 4
        body = [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 5))] + [passage] * (i % 5 == 0 and i % 3 > 0)
        menu = "".join(f"<div>{m}</div>" for m in shared[h])
        tags = "".join(f"<p>{t.replace(' ', '&#32;', 1)}\n" for t in body)
        page = f"<body>{menu}<article><h1>t {i}</h1>{tags}</article><footer>{word()}</footer>" if i % 3 else f"{menu}<h2>t {i}</h2>{tags}"
        rows.append((i, f"http://h{h}.net/{i}", page))
        want.append("\n".join([f"t {i}", *body]))
    rows += [(900, "http://h0.net/l", "<main>" + "<p>long text here</p>" * 40_000 + "</main>"), (901, "http://h1.net/l", "<div>a lone very long word</div>" + "z" * 300_000), (3, "http://h3.net/3", rows[3][2])]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_per_array=15).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and [got[i] for i in range(160)] == want
    assert got[900] == "\n".join(["long text here"] * 40_000) and got[901] == "a lone very long word\n" + "z" * 300_000
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_html_repeats_are_found_across_arrays(spark):
    """One result for any number of arrays and of marked pages on the host, as a plain search of all pages finds it."""
    rng = random.Random(6)
    menus = [" ".join(f"m{k}w{i}" for i in range(8)) for k in range(4)]
    body = lambda i: " ".join(f"p{i}x{j}" for j in range(20))
    rows = [(i, f"http://h.com/{i}", f"<div>{menus[rng.randrange(4)]}</div><div>{body(i)}</div>") for i in range(24)]
    rows += [(100 + i, f"http://h.com/m{i}", f"<article>a{i}</article>") for i in range(40)]
    want = {i: body(i) for i in range(24)} | {100 + i: f"a{i}" for i in range(40)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (2000, 24, 1):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, pages_per_array=size).collect()} == want


def test_html_copies_and_shared_passages_stay(spark):
    say = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    menu, shared, body = say("menu", 8), say("both", 12), say("body", 60)
    text = {i: say(f"own{i}x", 15) for i in range(6)}
    text[0], text[1] = f"{text[0]} {shared} end", f"{shared} {text[1]}"  # a passage of two articles
    text |= {10 + i: f"{body} date{i}" for i in range(10)}  # near copies
    text |= {30 + i: "copied " + body[::-1] for i in range(10)}  # copies
    df = spark.createDataFrame([(i, f"http://h.com/{i}", f"<div>{menu}</div><div>{t}</div>") for i, t in text.items()], "page_id long, url string, html string")
    twins = spark.createDataFrame([(50 + i, "http://t.com/", f"<p>{body}</p>") for i in range(3)], df.schema)
    for size in (2000, 2):
        out = {r["page_id"]: r["text"] for r in html_extract.extract(df.unionByName(twins), pages_per_array=size).collect()}
        assert out == text | dict.fromkeys((50, 51, 52), body)


def test_html_run_counts_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pages = [[rng.choice("abc") for _ in range(rng.randrange(0, 30))] for _ in range(4)]
        want = Counter(g for p in pages for g in {tuple(p[i : i + 4]) for i in range(len(p) - 3)})
        hashed = {int(html_extract.run_hashes(html_extract._token_hashes([list(g)])[0], 4)[0]): n for g, n in want.items()}
        runs, found = html_extract.run_counts(pages, 4)
        assert len(hashed) == len(want) and dict(zip(runs.tolist(), found.tolist(), strict=True)) == hashed


def test_fingerprints(spark, odd):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t = texts[i]
        k = len(t) // 3
        assert out[i]["n_chars"] == len(t)
        assert out[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + texts[nxt][:k]).encode()).hexdigest()
    same = Counter((texts[i], out[i]["fingerprint"]) for i in ids)
    assert len({t for t, _ in same}) == len(same)
    long_ones = [i for i in ids if len(texts[i]) > 3000]
    assert np.mean([out[i]["near_edited"] for i in long_ones]) > 0.3 > 0.1 > np.mean([out[i]["near_next"] for i in long_ones])
    assert fingerprint.fingerprint_edits(odd).count() == len(ODD)
    assert fingerprint.fingerprint_edits(odd.limit(0)).count() == 0


def test_fingerprints_follow_each_other_over_many_ranges(spark):
    """The next document is the next over all ranges, with clustered, repeated, negative and null ids."""
    rng = random.Random(4)
    ids = [rng.choice([rng.randrange(50), 10**12 + rng.randrange(3000), -rng.randrange(10**6)]) for _ in range(1500)]
    ids += list(range(5000, 5800)) + [None] * 30
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (256, 3):
        out = fingerprint.with_next(docs, "doc_id", "text", ["doc_id", "text"], rows_per_range=size).collect()
        after = {r["text"]: (r["next_doc_id"], r["next_text"]) for r in out}
        assert len(out) == len(rows) and sorted(t for _, t in after.values()) == sorted(t for _, t in rows)
        keyed = sorted((i for i in ids if i is not None), reverse=True)
        of = {t: i for i, t in rows}
        assert all(n is None or of[t] is None or n <= of[t] or n == keyed[0] for t, (n, _) in after.items())
        walk, t = set(), rows[0][1]
        while t not in walk:
            walk.add(t)
            t = after[t][1]
        assert len(walk) == len(rows)  # one cycle goes through all rows


def test_fingerprints_merge_and_contain(spark):
    """Sketches of parts merge into that of both, at any fraction; containment is of the shingles'."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(rng.choices(words, k=n)), " ".join(rng.choices(words, k=m))) for n, m in ((0, 50), (3, 900), (200, 200), (40, 4000))]
    rows += [(" ".join(words[10:200]), " ".join(words)), (" ".join(words[:900]), " ".join(words[300:]))]
    for scale in (1, 4):
        df = spark.createDataFrame(rows, "a string, b string")
        for c in ("a", "b"):
            df = fingerprint.with_sketch(df, c, f"{c}_s", scale)
        out = df.select("a", "b", "a_s", "b_s", fingerprint.merge(F.col("a_s"), F.col("b_s")).alias("m"), fingerprint.containment(F.col("a_s"), F.col("b_s")).alias("c")).collect()
        for r in out:
            assert r["m"] == sorted(set(r["a_s"]) | set(r["b_s"]))
            assert all(h <= fingerprint.threshold(scale) for h in r["m"])
            a, b = _shingles(r["a"]), _shingles(r["b"])
            true = len(a & b) / len(a) if a else 1.0
            assert r["c"] == true if scale == 1 else not r["a_s"] or abs(r["c"] - true) < 0.2


def test_fingerprint_likeness_is_the_jaccard_of_shingles(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(docs).collect()}
    for i, t in enumerate(texts):
        nxt, k = texts[i - 1], len(t) // 3
        for name, other in (("near_edited", t[: len(t) - k] + nxt[:k]), ("near_next", nxt)):
            a, b = _shingles(t), _shingles(other)
            assert out[i][name] == (len(a & b) / len(a | b) if a | b else 1.0)
        assert (out[i]["fingerprint"] == "") == (not t.split())
    few = fingerprint.fingerprint_edits(docs, 2**20).where("near_next = 1.0").collect()
    assert all(not texts[r["doc_id"]] and not texts[r["doc_id"] - 1] for r in few)


def test_toxicity(spark, odd):
    out = queries.op5_toxicity(spark, SF).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    rng = random.Random(1)
    plain = [" ".join(rng.choice("anre thion eding ofthe sted reat".split()) for _ in range(40)) for _ in range(300)]
    texts = [t + " you stupid idiot" * (i % 2) for i, t in enumerate(plain)]
    model = toxicity.fit(texts, [i % 2 for i in range(300)])
    score = lambda *ts: model.scores(toxicity.Margins.of(model)(list(ts)))
    assert (score(plain[0] + " idiot stupid", plain[0] + " i d i o t, s.t.u.p.i.d") > 0.5).all() and (score(plain[0], "", "x" * 10_000) < 0.5).all()
    labels = spark.createDataFrame([(4, 1), (5, 0), (99, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).count() == len(ODD)
    assert toxicity.score_documents(odd, labels.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0


def test_string_kernel_against_definition():
    from itertools import combinations

    def slow(s, t):
        weigh = lambda w: [(tuple(w[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(w)), toxicity.LETTERS)]
        return sum(toxicity.DECAY ** (a + b) for x, a in weigh(s) for y, b in weigh(t) if x == y)

    for s, t in (("idiot", "i-d-i-o-t"), ("banana", "ananas"), ("abc", "abd")):
        assert toxicity.raw_kernel(toxicity.codes([s]), toxicity.codes([t]))[0] == pytest.approx(slow(s, t), rel=1e-4)


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _bag(text):
    w = (text or "").lower().split()
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return {(g, k) for g, n in found.items() for k in range(n)}


def _classes(rows):
    sets, parent = [_bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or both >= 0.8 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    want = {i: rows[c][0] for (i, _), c in zip(rows, _classes(rows), strict=True)}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == want
    assert near_dedup.deduplicated(docs).count() == len(set(want.values()))
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by_id = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] and by_id[4] == by_id[5] and by_id[6] == 6
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and {r["__key"] for r in kept.collect()} <= {"x", None} and kept.count() == len({(r["class_id"]) for r in out})
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0 == near_dedup.deduplicated(odd.limit(0)).count()


def test_key_filter_keeps_all_keys_and_drops_most_others(spark):
    from weirflow.llm.common import maybe_in

    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    wanted = df.where("id % 40 = 0")
    kept = {r["id"] for r in maybe_in(df, "k", wanted, wanted.count()).collect()}
    assert {i for i in range(20_000) if i % 40 == 0} <= kept and len(kept) < 0.15 * 20_000
    assert maybe_in(df, "k", df.limit(0), 0).count() == 0


def test_one_id_on_different_texts(spark):
    """Two texts under one id are two nodes, and each finds its own near copies."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and len({r["class_id"] for r in out}) == 2
    by = {i: {r["class_id"] for r in out if r["doc_id"] == i} for i in (1, 2, 3)}
    assert len(by[1]) == 2 and by[2] | by[3] == by[1] and by[2] != by[3]
    assert near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_long_texts_are_read_in_parts():
    rng = random.Random(6)
    texts = [" ".join("w" * rng.randrange(1, 40) for _ in range(rng.randrange(0, 300))) + " " * rng.randrange(3) for _ in range(40)] + ["x" * 500, "a b " + "y" * 300 + " c d e f"]
    for t in texts:
        whole, parts = (near_dedup.bags(pa.array([t]), most=m) for m in (1 << 20, 64))
        assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    """Buckets cut into blocks give the classes of brute force, whichever way their pairs meet."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 7)
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(_classes(rows)))


def test_near_duplicates_that_miss_their_buckets_centres(spark):
    """Twins in a large group whose other members are alike, but less than near duplicates."""
    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for k in range(60):
        words = list(template)
        for i in rng.choice(120, 4, replace=False):
            words[i] = f"own{k}x{i}"
        texts += [" ".join(words), " ".join([*words, f"more{k}"])] if k % 3 == 0 else [" ".join(words)]
    rows = [(int(i), texts[j]) for i, j in enumerate(rng.permutation(len(texts)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(_classes(rows)))


def test_dart_signatures_estimate_weighted_similarity():
    a, b = {1: 3.0, 2: 1.0, 3: 2.5}, {1: 2.0, 3: 2.5, 4: 1.0}
    want = (2 + 2.5) / (3 + 1 + 2.5 + 1)
    e = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = near_dedup.signatures(e, np.array([0, 0, 0, 1, 1, 1]), 2, 4000, np.array([*a.values(), *b.values()]))
    assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_sharding(spark, odd):
    out = queries.op7_sharding(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 8 == n for i, c, n in zip(out.doc_id, out.text_crc32, out["size"], strict=True))
    load = out.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= out["size"].max()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    got = sharding.shard(odd, 3).collect()
    assert sorted(r["size"] for r in got) == sorted(len((r[1] or "").encode()) + 8 for r in ODD)
    weight = {s: 100 + s for s in range(64)}
    first = sharding.SlotMap.balanced(weight, 4, 64)
    second = first.rebalanced(weight, 5)
    assert second.version == 2 and 0 < first.moved(second) <= 20
    assert sharding.shard(odd.limit(0), 3).count() == 0


def test_sharding_of_copies(spark):
    """Copies share a shard, but for a group too heavy for one; repeated rows do not unbalance shards."""
    rows = [(7, "same row " * 8)] * 3000 + [(i, f"text {i} " * 9) for i in range(100, 3100)] + [(i, f"copies {i % 40}" * 12) for i in range(4000, 4160)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.02 * load.mean()
    copies = out[out.doc_id >= 4000]
    assert copies.groupby("text_crc32")["shard"].nunique().max() == 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_slot_map_is_stored_and_edited(spark, tmp_path):
    store = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7)) for i in range(4000)], "doc_id long, text string")
    one = sharding.shard(docs, 4, store).toPandas()
    two = sharding.shard(docs, 5, store).toPandas()
    assert set(one.map_version) == {1} and set(two.map_version) == {2}
    first, last = sharding.SlotMap.load(spark, store, 1), sharding.SlotMap.load(spark, store)
    assert (first.version, first.shards, last.version, last.shards) == (1, 4, 2, 5)
    assert dict(zip(two.virtual_slot, two["shard"], strict=True)).items() <= dict(last.shard_of).items()
    moved = one.merge(two, on="doc_id").query("shard_x != shard_y")
    assert 0 < len(moved) <= 0.3 * len(one)
    load = two.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.03 * load.mean()
    with pytest.raises(Exception, match="exist"):
        last.save(spark, store)


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = odd.unionByName(spark.createDataFrame([(20, "a<|endoftext|>b Don't, x\ty\r\nz İΣ", "", "", 0, 0, "")], DOC))
    for r in token_counts.count_tokens(docs, path).join(docs.distinct(), "doc_id").collect():
        assert r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(docs, path).count() == len(ODD) + 1


def test_token_counts_of_random_texts_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    alphabet = ["\u0130", "\u0131", "e\u0301", "\u0301", "\u0307", "\u0958", "\u095c", "\ufb01", "\u03a3", "\u03c2", "\u1e9e", "日本", "\u0e01\u0e47", "\u1100\u1161", "😀", "'s", "'T", "<|endoftext|>", " ", "\n", "\t", "\r"]
    alphabet += ["\x0b", "\xa0", "\u2009", "\u200b", "\x1c", "\x85", ".", ",", "!", ";", ":", "?", "...", "the", "Don", "CAM", "9", "12", "_", "\u212b", "\U00010400", "\u01c5", "\u2167"]
    rng = random.Random(3)
    texts = ["theİ?", "İ.", "CAMİ, ev", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(8000))]
    for name, kind in (("word_bpe_49k.json", token_counts.PieceLengths), ("byte_bpe_50k.json", token_counts.WholeLengths)):
        tok, counted = Tokenizer.from_file(queries.tokenizer_file(name)), token_counts.lengths_for(queries.tokenizer_file(name))
        assert isinstance(counted, kind)
        assert counted.count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.lengths_for(path).count(texts[:2000]) == [len(model.encode(t)) for t in texts[:2000]]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 7, [1.0, None, *[0.0] * 6]]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(None, [1.0] * 8, 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = ann.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    hit = 0
    for q, part in out.groupby("query_id"):
        part = part.sort_values("rank")
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(score, 9)))[:20]
        assert list(part["rank"]) == list(range(1, 21))
        assert np.allclose(part.score, score[part.vec_id.to_numpy()], atol=1e-12)
        hit += len(set(want) & set(part.vec_id))
    assert hit >= 0.9 * 20 * 30
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).toPandas()
    assert set(few.vec_id) == {1, 2}


@pytest.mark.parametrize("split", [10**9, 300])
def test_nearest_neighbours_over_many_lists(spark, monkeypatch, split):
    """Dozens of lists with replicated boundaries, a graph and a ratio; and long lists with inner lists."""
    monkeypatch.setattr(ann, "PER_LIST", 64)
    monkeypatch.setattr(ann, "GROUP", 128)
    monkeypatch.setattr(ann, "SPLIT", split)
    if split == 300:
        monkeypatch.setattr(ann, "MOST_LISTS", 6)
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(60, 12)) * 3
    x = (heart[rng.integers(60, size=4000)] + rng.normal(size=(4000, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = ann.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    assert out.groupby("query_id").size().tolist() == [20] * 200
    y, hit = x.astype(float), 0
    for q, part in out.groupby("query_id"):
        score = y @ y[q]
        score[q] = -np.inf
        assert np.allclose(part.sort_values("rank").score, np.sort(score[part.vec_id.to_numpy()])[::-1], atol=1e-9)
        assert part.vec_id.is_unique
        hit += len(set(np.argsort(-score, kind="stable")[:20]) & set(part.vec_id))
    assert hit >= 0.9 * 4000


def test_byte_bpe_equals_the_library(spark, odd):
    import base64

    import tiktoken

    path = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=queries.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe.load(path, queries.split_pattern())
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "aa", "aaa", "the", "'s", "é", "9", "!", "...", " ", "日本", "😀", "́", "\x1c", "stem.", "word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000]
    got = bpe.encode_many(texts)
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert all(bpe.decode(i) == t.encode() for i, t in zip(got, texts, strict=True))
    for r in byte_bpe.encode_documents(odd, path, queries.split_pattern()).join(odd.distinct(), "doc_id").collect():
        ids = enc.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = byte_bpe.decode_ids(byte_bpe.encode_ids(odd, path, queries.split_pattern()), path, queries.split_pattern()).collect()
    assert Counter(bytes(r["bytes"]) for r in back) == Counter((r[1] or "").encode() for r in ODD)


def _plain_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    """doc_id -> copies, of (doc_id, text, source) without null or repeated ids."""
    size = {i: len([w for w in re.split(r"[ \t-\r]+", t or "") if w]) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(sources)}
    stopped: set = set()
    while True:
        left = share * sum(own.values()) - sum(cap * own[s] for s in stopped)
        level = left / sum(w[s] for s in sources if s not in stopped) if len(stopped) < len(sources) else float("inf")
        more = {s for s in sources if cap * own[s] / w[s] <= level} - stopped
        if not more:
            break
        stopped |= more
    copies = {}
    for s in sources:
        target = cap * own[s] if s in stopped else level * w[s]
        base = int(target // own[s]) if own[s] else 0
        rest = target - base * own[s]
        members = [i for i, _, x in rows if x == s]
        odds = rest / own[s] / (1 - rest / own[s]) if 0 < rest < own[s] else 0
        rank = {}
        for i in members:
            u = (int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            q = u / (1 - u) / (odds * (max(size[i], 1) / (own[s] / len(members))) ** 0.5) if odds else 0
            rank[i] = (q / (1 + q), i)
        taken = 0
        for i in sorted(members, key=rank.get):
            copies[i] = base + (rest > 0 and taken + size[i] / 2 <= rest)
            taken += size[i]
    return copies


def test_pipeline_against_plain_versions(spark):
    """Each stage's rows by plain Python on all rows, and the whole by them one after the other."""
    import base64

    import corpus_pipeline
    import tiktoken

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect())
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    model = toxicity.train(docs, labels)
    assert marks and len(marks) <= toxicity.SAMPLE
    margins = toxicity.Margins.of(model)
    clean = [r for r in rows if model.scores(margins([r[1]]))[0] < corpus_pipeline.TOXIC_SCORE]
    assert Counter(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == Counter(r[0] for r in clean)
    found = _classes([(i, t) for i, t, _ in clean])
    heads = [r for k, r in enumerate(clean) if found[k] == k]
    copies = _plain_mix(heads)
    with open(queries.tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=queries.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in heads:
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    out = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == +want


def test_pipeline_on_odd_rows_and_nothing(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names go through; only the last stage changes the columns."""
    import corpus_pipeline

    labels = spark.createDataFrame([(4, 1, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (5, None, 0), (7, 1, 0), (None, 1, 1), (6, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, sf)
            assert out.columns == odd.columns
            assert set(map(tuple, out.collect())) <= set(ODD)
            at = out
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 0) == (name == "odd")
    kept = near_dedup.deduplicated(odd).collect()
    assert len(kept) == 6  # wordless texts, the two ways to write one sentence, and four others


def test_toxicity_knows_a_stem_under_any_ending():
    endings = ("ka", "tes", "ning", "hafter", "i", "zzo", "perd", "une", "lich", "ost")
    bad = [f"das ist ein grumbol{e} sage ich" for e in endings]  # only the stem tells the classes apart
    good = [f"das ist ein {s}{e} sage ich" for e in endings for s in ("tisch", "wald", "fenst")]
    model = toxicity.fit(good + bad, [0] * len(good) + [1] * len(bad))
    margins = toxicity.Margins.of(model)
    assert model.scores(margins(["so ein grumbolvant", "so ein grum-bolvant"])).min() >= 0.5
    assert model.scores(margins(["das ist ein tischler", ""])).max() < 0.5


def test_toxicity_tolerates_letters_put_in(spark):
    """Trained on labelled texts: insults with one letter or marks put in are found, near clean words are not."""
    sf = SF.replace("0.001", "0.01")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    margins = toxicity.Margins.of(model)
    bad = ["you idiot", "you idxiot", "you stuxpid", "you moxron", "you wxorthless", "such a m-o-ron", "an i_di_ot he is", "what an i d i o t", "disgustxing", "so pathxetic you are"]
    good = ["good morning to you", "the idioms of a language", "a studio and moments of class", "worth the price", "the loose rosen", "stand up and paint", "the cloud and the lawn", "", "discussing a path"]
    assert model.scores(margins(bad)).min() >= 0.5 > model.scores(margins(good)).max()


def test_toxicity_in_four_scripts():
    rng = random.Random(9)
    insults = ["grumbolt", "дурачина", "καθίκι", "ბრიყვო"]
    letters = ["abcdefghilmnoprstu", "абвгдежзиклмнопрсту", "αβγδεζηθικλμνοπρστ", "აბგდევზთიკლმნოპრსტ"]
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randrange(3, 9)))
    texts, toxic = [], []
    for n in range(480):
        k = n % 4
        words = [word(k) for _ in range(12)]
        if n % 3 == 0:
            words[rng.randrange(12)] = insults[k]
        texts.append(" ".join(words))
        toxic.append(int(n % 3 == 0))
    model = toxicity.fit(texts, toxic)
    margins = toxicity.Margins.of(model)
    assert len({c for w in model.landmarks for c in w}) > 62
    for k, w in enumerate(insults):
        spoiled = w[:3] + letters[k][0] + w[3:]
        assert model.scores(margins([f"{word(k)} {w} {word(k)}", f"{word(k)} {spoiled} {word(k)}"])).min() >= 0.5
    assert np.mean(model.scores(margins([" ".join(word(n % 4) for _ in range(12)) for n in range(200)])) < 0.5) > 0.97


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    out = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert rows[rows.toxic == 1].predicted.mean() >= 0.6 and rows[rows.toxic == 0].predicted.mean() <= 0.03


def test_kernel_of_all_words_and_landmarks():
    """The triples' table gives the kernel of the definition, also for words with few or repeated letters."""
    words = ["nanana", "nananabc", "bababa", "connard", "conn", "idiot", "idxiot", "banana", "trash", "abcdefghijklmnop"]
    marks = toxicity.Landmarks(words[:7])
    got = marks.near([(w, False) for w in words])
    for i, w in enumerate(words):
        for j, z in enumerate(marks.words):
            assert got[i, j] == pytest.approx(float(toxicity.kernel(toxicity.codes([w]), toxicity.codes([z]))[0]) ** toxicity.POWER, rel=1e-3, abs=1e-6)
    assert marks.near([("idio", True)])[0, 5] == 0 and marks.near([("idiot", True)])[0, 5] == pytest.approx(1, rel=1e-3)
