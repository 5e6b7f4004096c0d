"""Operators against brute force, known cases and held-out rows."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import decontaminate, htmltext, langid, licenses, mixing, mtree, secrets, simhash, toxicity, urlfilter
from keyloom.llm.common import held_out, read
from keyloom.llm.queries import oracle_sql, queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(queries()[name](spark, SF), oracle_sql()[name], SF) is None


# -- 2 licenses -----------------------------------------------------------------------------------


def test_every_block_that_contains_enough(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 64, 65, 96, 97, 200]))) for _ in range(60)]
    for i in range(0, 60, 3):  # clauses with a word missing, among others
        words = rng.choice(licenses.TEMPLATES)[1].split()
        del words[rng.randrange(len(words))]
        texts[i] += " " + " ".join(words)
    got = {r["doc_id"]: (sorted(r["matched"]), round(r["score"], 9)) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ws, labels, best = t.split(), set(), 0.0
        for b in range(max(1, -(-(len(ws) - 32) // 32))):
            block = set(ws[b * 32 : b * 32 + 64])
            for label, clause in licenses.TEMPLATES:
                terms = set(clause.split())
                share = len(block & terms) / len(terms)
                if len(block & terms) >= 0.8 * len(terms) - 1e-9:
                    labels.add(label)
                    best = max(best, share)
        assert got[i] == (sorted(labels), round(best, 9))


# -- 3 urls ---------------------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".example")).alias("key"))
    listed = universe.where(F.xxhash64("key") % 5 == 0).union(spark.createDataFrame([("not-in-corpus.example",)], "key string"))
    levels = urlfilter.build_cascade(universe, listed)
    assert len(levels) >= 2
    got = {r["key"] for r in universe.where(urlfilter.in_cascade(F.col("key"), levels)).collect()}
    assert got == {r["key"] for r in universe.join(listed, "key", "left_semi").collect()}
    hosts = universe.select(F.concat(F.lit("www."), "key").alias("host"))
    assert {r["host"][4:] for r in urlfilter.listed_by_join(hosts, listed).collect()} == got


def test_long_lists_are_joined(spark, monkeypatch):
    urls = ["http://a.spam-farm.example.org/x", "http://spam-farm.example.org", "http://b.example.net/fr/", None, "ftp://ok.example/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(k,) for k in urlfilter.LISTED], "key string")
    want = sorted(urlfilter.judge(pages, listed).collect())
    monkeypatch.setattr(urlfilter, "MAX_BITS", 64)
    assert sorted(urlfilter.judge(pages, listed).collect()) == want and sum(r["listed"] for r in want) == 2


def test_empty_list(spark):
    pages = spark.createDataFrame([(1, "http://Spam-Farm.example.org:80/x?y")], "page_id long, url string")
    row = urlfilter.judge(pages, spark.createDataFrame([], "key string")).first()
    assert (row["host"], row["path"], row["verdict"]) == ("spam-farm.example.org:80", "/x", "allow")


# -- 4 search -------------------------------------------------------------------------------------


def best_by_hand(x, ids, queries, k=5):
    """For each query row its best k other rows."""
    out = []
    for a in queries:
        scores = [(-sum(int(c) * int(d) for c, d in zip(x[a], x[j], strict=True)), ids[j]) for j in range(len(x)) if j != a]
        out += [(ids[a], r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(spark, x, ids, k=5):
    df = spark.createDataFrame([(int(i), [int(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<long>")
    return sorted(map(tuple, mtree.top_k(df, df.where("vec_id % 50 = 0"), k).collect()))


def test_search_is_exact_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-5, 6, (900, 8)), np.repeat(rng.integers(-5, 6, (1, 8)), 700, 0)])
    ids = list(range(len(x)))
    want = best_by_hand(x, ids, range(0, len(x), 50))
    assert searched(spark, x, ids) == want
    # Many pages, several blocks of queries, pages split by hash.
    for name, value in (("PAGE", 64), ("BLOCK", 10), ("MOST", 48), ("LEAF", 8), ("FIRST", 4)):
        monkeypatch.setattr(mtree, name, value)
    assert searched(spark, x, ids) == want


def test_search_of_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(14)
    x = rng.integers(-3, 4, (60, 4))
    x[20:28], ids = x[50], [i % 55 for i in range(60)]
    ids[20:24], ids[50:53] = [50] * 4, [50] * 3
    assert searched(spark, x, ids) == best_by_hand(x, ids, [j for j in range(60) if ids[j] % 50 == 0])


def test_search_of_large_numbers(spark):
    v = 94906267
    x = np.array([[v, v - 1], [v, v + 1], [v + 1, v], [v - 1, v + 2], [-v, v], [v, v]])
    assert searched(spark, x, range(6)) == best_by_hand(x, range(6), [0])
    with pytest.raises(Exception, match="64 bits"):
        searched(spark, x * 2**20, range(6))


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (400, 6)) for c in (0, 30, -30)]).round()
    order, nodes, away = mtree.build(x)
    assert sorted(order) == list(range(len(x)))
    for n in nodes:
        rows, centre = x[order[int(n[mtree._LO]) : int(n[mtree._HI])]], n[mtree._CENTRE :]
        assert (np.linalg.norm(rows - centre, axis=1) <= n[mtree._RADIUS] + 1e-4).all() and (np.linalg.norm(rows, axis=1) <= n[mtree._NORM] + 1e-6).all()
        if n[mtree._LEAF]:
            assert np.allclose(np.linalg.norm(rows - centre, axis=1), away[int(n[mtree._LO]) : int(n[mtree._HI])], atol=1e-4)
        elif n[mtree._PARENT] >= 0:
            assert n[mtree._TO_PARENT] == pytest.approx(np.linalg.norm(centre - nodes[int(n[mtree._PARENT]), mtree._CENTRE :]))
    block = mtree.Block(np.arange(20), x[400:420], np.full(20, -(1 << 63)), 5)
    assert block.meet(nodes, x[order], away, np.arange(len(x))[order], np.ones(len(x), np.int64)) < 0.5 * 20 * len(x)
    assert all(-b[-1][0] == sorted(((x @ q).astype(int)[np.arange(len(x)) != i]).tolist())[-5] for i, (b, q) in enumerate(zip(block.best, x[400:420], strict=True)))


# -- 5 near copies --------------------------------------------------------------------------------


def test_components_within_two_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    chain = [np.uint64(7)]
    for i in range(40):
        chain.append(chain[-1] ^ np.uint64(3 << i))
    fps = np.unique(np.concatenate([base, near, np.array(chain, np.uint64)]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2)).collect()}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 2) + i + 1:
            parent[find(j)] = find(i)
    groups = defaultdict(set)
    for i, f in enumerate(fps.view(np.int64).tolist()):
        groups[find(i)].add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_neighbour_patterns_find_what_the_tree_does():
    rng = np.random.default_rng(7)
    fps = np.unique(rng.integers(0, 2**12, 300, dtype=np.uint64))
    forest = simhash._Forest(len(fps))
    simhash._neighbours(fps, np.arange(len(fps)), np.arange(len(fps)), 2, forest)
    assert (forest.root == simhash.link_leaf(fps, np.ones(len(fps), bool), 2)).all()


def test_similar_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([3, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    got = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(simhash.shingle_hashes(t, 5)[1].tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert got == {find(i) for i in range(len(texts))}


def test_sieve_holds_back_none_of_its_own(spark):
    values = np.random.default_rng(9).integers(-(2**63), 2**63, 3000)
    table = simhash.sieve(spark.createDataFrame([(int(v),) for v in values[:1000]], "h long"), 1000)
    assert simhash.sifted(table, values[:1000]).all() and simhash.sifted(table, values[1000:]).mean() < 0.2


def test_tables_reach_the_driver_packed(spark, monkeypatch):
    n, kind, seen = 100_000, type(spark.range(0)), []
    take = kind.collect

    def collect(df):
        rows = take(df)
        seen.append((len(rows), "TakeOrdered" in df._jdf.queryExecution().executedPlan().toString()))
        return rows

    texts = spark.createDataFrame([(f"a{i % 997} b{i % 991} c{i % 5}",) for i in range(5000)], "text string")
    monkeypatch.setattr(kind, "collect", collect)
    monkeypatch.setattr(kind, "toPandas", lambda df: pytest.fail("an object a row"))
    monkeypatch.setattr(simhash, "MAX_COMMON", 3000)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    hashes = spark.range(n).select(F.xxhash64("id").alias("h"))
    table = simhash.sieve(hashes, n)
    tokens, counts = simhash.common_shingles(texts, 1)
    assert len(tokens) == len(counts) == 997 + 991 + 5 and (np.diff(tokens) > 0).all() and counts.sum() == 15_000
    assert seen and all(rows < 1000 and not sorted_ for rows, sorted_ in seen)
    assert simhash.sifted(table, np.array([r["h"] for r in take(hashes)], np.int64)).all()


@pytest.mark.parametrize("most", [1, 2, 3, 500, 1000, 4002, 4003, 9000])
def test_most_frequent_without_sorting(spark, most):
    df = spark.range(4003).select(F.xxhash64("id").alias("token"), F.when(F.col("id") < 3, 10 - F.col("id")).otherwise(2 + F.col("id") % 3).alias("n"))
    want = sorted(map(tuple, df.orderBy(F.desc("n"), "token").limit(most).collect()))
    assert sorted(map(tuple, simhash.most_frequent(df, most).collect())) == want and len(want) == min(most, 4003)


def test_similar_texts_of_common_boilerplate(spark):
    rng = random.Random(81)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    common, texts = [word() for _ in range(160)], []
    for i in range(160):
        share = rng.choice([0.6, 0.7, 0.8, 0.85, 0.9])
        own = [word() for _ in range(round(160 / share) - 160)]
        texts.append(" ".join(common + own))
        if i % 4 == 0:  # a pair near the threshold, whose edits both touch the boilerplate
            for _ in range(2):
                edited = common + own
                for at in rng.sample(range(len(edited)), 2):
                    edited[at] = word()
                texts.append(" ".join(edited))
    groups = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string"))
    got = {r["key"]: r["root"] for r in groups.collect()}
    sets = [set(simhash.shingle_hashes(t, 5)[1].tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert 1 < len(set(map(find, range(len(texts))))) < len(texts)
    assert len({(got[i], find(i)) for i in got}) == len(set(got.values())) == len({find(i) for i in got})


# -- 6 pages --------------------------------------------------------------------------------------


def test_main_text(spark):
    furniture = '<nav><a href="/">Home</a></nav><div class="share-box">Share</div><div id="x1"><span>Our site, our slogan</span></div>'
    page = lambda i: f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body>{furniture}<article><header><h1>Title {i}</h1></header><p>First&nbsp;&amp; <b>bold</b>text<br>line {i}<p>Shared sentence.<aside>ad</aside><section class='promo'>buy</section><div>Follow our channel</div></article><div class='comments'><p>reader says</p></div><footer>(c)</footer></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/a", page(i)) for i in range(5)] + [(9, "http://other.example/", furniture + "<p>Only text</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(df).collect()}
    assert got[2] == "Title 2 First & boldtext line 2 Shared sentence." and got[9] == "Our site, our slogan Only text"


@pytest.mark.parametrize("html", ["<", "<p", "</p>", "<!--", "<![CDATA[x", "<script>", "<div " * 500, "<b>" * 3000 + "x", "&#xD800;&#0;&bogus;", "<p title='>'>q</p>"])
def test_broken_markup(html):
    assert isinstance(htmltext.extract(html), str)


def shop_page(i):
    """A page without article or main, whose furniture has no telling names: only recurrence gives it away."""
    links = "".join(f"<li><a href='/{i}/{k}'>Item {i * 7 + k}</a></li>" for k in range(4 + i % 3))
    body = "".join(f"<p>Paragraph {k} of page {i} has words of its own and some more to read.</p>" for k in range(6))
    return f"<html><body><div class='x1'><span>Our shop since 1999</span></div><div class='x2'><ul>{links}</ul></div><div class='x3'>{body}<p>As always.</p></div><div class='x4'>Call us any day &amp; night</div></body></html>"


def own_text(i):
    return " ".join(f"Paragraph {k} of page {i} has words of its own and some more to read." for k in range(6)) + " As always."


def test_recurrence_decides(spark, monkeypatch):
    pages = [(i, "http://shop.example/p", shop_page(i)) for i in range(8)] + [(100, "http://alone.example/p", shop_page(0))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = lambda **o: {r["page_id"]: r["text"] for r in htmltext.main_text(df, **o).collect()}
    got, off = texts(), texts(min_pages=10**9)
    assert all(got[i] == own_text(i).replace(" As always.", "") for i in range(8))  # a sentence outside an article that all pages share goes too
    assert all(x in off[3] for x in ("Our shop since 1999", "Item 21", "Call us any day & night", own_text(3))) and got[100] == off[100]
    # The same by hand: on how many different pages of the host each hash occurs.
    seen = Counter(h for _, url, html in pages if "shop" in url for h in htmltext.subtree_hashes(html)[1])
    want = {h for h, n in seen.items() if n >= 3}
    assert {r["digest"] for r in htmltext.site_templates(htmltext.page_hashes(df)).collect()} == want
    monkeypatch.setattr(htmltext, "BROADCAST_ROWS", 0)
    assert texts() == got


def test_copies_of_a_page_are_one_page(spark):
    article = "<html><body><div class='b'><div class='c'><p>" + "</p><p>".join(f"Sentence {i} of the text." for i in range(9)) + "</p></div></div></body></html>"
    others = [f"<html><body><div><p>Other page {i}</p></div></body></html>" for i in range(4)]
    # Copies, and near copies that differ in their titles, must not lose their text.
    rows = [(i, "http://h.example/", article) for i in range(6)] + [(10 + i, "http://h.example/", x) for i, x in enumerate(others)]
    rows += [(20 + i, "http://near.example/", article.replace("<body>", f"<body><h1>Copy {i}</h1>")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Sentence 8 of the text." in got[i] for i in range(6)) and all(got[20 + i].endswith("Sentence 8 of the text.") for i in range(6)) and got[11] == "Other page 1"


def test_void_and_inline_tags_break_no_word():
    assert htmltext.extract("<p>un<img src=x>broken<wbr>word</p><p>two<br>lines</p>") == "unbrokenword two lines"
    assert htmltext.extract("<p>x < y and a <3 b</p><p title=it's>q</p><svg><p>rest</p>") == "x < y and a <3 b q rest"


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<i><div><b></i>", "<dt></dt><div>", '<a b="', "<svg>", "<td><table>", "</b>", "<p><b>", "<!--"])
def test_broken_pages_take_linear_time(unit):
    def seconds(n):
        start = time.process_time()
        htmltext.extract(unit * n, frozenset([1]))
        return time.process_time() - start

    seconds(1000)
    assert seconds(60_000) < 40 * max(0.05, seconds(5_000))  # 12 times if linear, 144 if quadratic


def test_a_megabyte_of_open_tags():
    start = time.process_time()
    htmltext.subtree_hashes("<a " * 350_000)
    assert time.process_time() - start < 2


# -- 7 toxicity -----------------------------------------------------------------------------------


DISGUISED = {
    "looks": ["1d10t", "m0r0n", "$tupid", "st*pid", "cl0wn", "1d10" + "t" * 60],
    "spacing": ["i d i o t", "i.d.i.o.t", "c-l-o-w-n", "m_o_r_o_n", "s t u p i d  c l o w n", "y.o.u.a.r.e.a.m.o.r.o.n", "a i d i o t"],
    "repetition": ["iiidiot", "id" + "i" * 70 + "ot", "mmmoronnn", "stuuupiiid", "clllooown"],
}


@pytest.fixture(scope="module")
def insulted(spark):
    """A model of labelled texts with plain insults, over a corpus of the given documents."""
    rng = random.Random(17)
    docs = [r["text"] for r in read(spark, SF, "documents").where("lang = 'en' and text is not null").select("text").collect()]
    words = [w for t in docs for w in t.lower().split() if w.isalpha() and w not in ("idiot", "moron", "stupid", "clown")]
    rows = []
    for i in range(500):
        text = rng.choices(words, k=30)
        if i % 2:
            text[rng.randrange(30)] = rng.choice(["idiot", "moron", "stupid", "clown"])
        rows.append((i, " ".join(text), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic")), words


def test_disguises(insulted):
    model, _ = insulted
    lm = model["lm"].tolist()
    for disguised in [x for form in DISGUISED.values() for x in form] + ["idiooot", "idi" + "o" * 70 + "t"]:
        assert {"idiot", "moron", "stupid", "clown"} & toxicity.restored_words(f"such {disguised} here", lm, {}), disguised
    assert toxicity.restored_words("plain words stay 2024 10%", lm, {}) >= {"plain", "words", "stay"}


def every_path(choices):
    paths = [("", 0.0)]
    for options in choices:
        paths = [(done + text, cost + more) for done, cost in paths for text, more in options]
    return paths


def test_decoder_finds_the_best_of_all_paths(insulted):
    model, _ = insulted
    lm = model["lm"].tolist()

    def value(text, cost):
        total, x, y = -cost, 0, 0
        for c in text:
            z = toxicity.symbol(c)
            total += lm[x][y][z]
            x, y = (y, z) if z else (0, 0)
        return total + (lm[x][y][0] if (x, y) != (0, 0) else 0.0)

    for token in ("1d10t", "a.b.c", "m0r0n", "$t*p1d", "aab 1", "i d  o t", "x@y"):
        best = max(value(t, c) for t, c in every_path(toxicity.lattice(token)))
        got = toxicity.decode(token, lm)
        assert any(t.strip() == got and value(t, c) == pytest.approx(best) for t, c in every_path(toxicity.lattice(token))), token


@pytest.mark.parametrize("form", sorted(DISGUISED))
def test_disguised_insults_need_the_decoder(insulted, monkeypatch, form):
    (model, words), rng = insulted, random.Random(3)
    texts = [" ".join([*rng.choices(words, k=20), x, *rng.choices(words, k=20)]) for x in DISGUISED[form]]
    clean = [" ".join(rng.choices(words, k=41)) for _ in range(100)]
    lm = model["lm"].tolist()
    assert (toxicity.text_scores(texts, model, lm, {}) >= 0.5).mean() > 0.8 and (toxicity.text_scores(clean, model, lm, {}) >= 0.5).mean() < 0.03
    monkeypatch.setattr(toxicity, "decode", lambda token, lm: token)
    assert (toxicity.text_scores(texts, model, lm, {}) >= 0.5).mean() < 0.2


def test_trigrams_are_counted_over_all_rows(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,)], "text string")
    assert toxicity.trigram_counts(df)[0, 1, 2] == 2


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op7_toxicity"](spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert len(rows) > 50 and wrong / len(rows) < 0.12 and sum(r["predicted"] > r["toxic"] for r in rows) <= 2


# -- 8 leaks --------------------------------------------------------------------------------------


def test_parameters_may_change_but_consistently(spark):
    item = "A train leaves Paris at 3 pm with 40 people and reaches London after 3 hours with 40 bags on board today."
    docs = [item, item.replace("3", "5").replace("40", "70").replace("Paris", "Rome"), item.replace("after 3", "after 4"), "Well. " + item + " More.", "words of another kind that have nothing to do with trains at all, really nothing", " ".join(item.split()[:9])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    # The third has another number where the item repeats one, but fourteen words before it to the letter.
    assert got == {0: [7], 1: [7], 2: [7], 3: [7], 4: [], 5: []}


def windows_by_hand(doc, item):
    """Per diagonal the windows (item place, item slots, document slots) that agree, found by comparing word by word."""
    out = defaultdict(set)
    for dw, ds in decontaminate.readings(*decontaminate.canonical(doc)):
        for iw, islots in decontaminate.readings(*decontaminate.canonical(item)):
            width = min(decontaminate.WINDOW, len(iw))
            if not width or width < decontaminate.MIN_WORDS and width != len(dw):
                continue
            for p in range(len(iw) - width + 1):
                if 2 * sum(not x for x in islots[p : p + width]) < width:
                    continue
                for q in range(len(dw) - width + 1):
                    if dw[q : q + width] == iw[p : p + width]:
                        out[q - p].add((p, tuple(islots[p : p + width]), tuple(ds[q : q + width])))
    return out


def test_leaks_as_by_hand(spark):
    """Both ways: what is found, and nothing else, for given documents and passages of items with other numbers, names and edits."""
    rng = random.Random(11)
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").orderBy("item_id").limit(14).collect()]
    items += [(900, "A shop sold 12 red lamps to Anna and 15 lamps to Boris, so how many of 40 lamps are left there?"), (901, "yes"), (902, "not at all"), (903, None)]
    filler = [r["text"] for r in read(spark, SF, "documents").where("length(text) < 900").orderBy("doc_id").limit(25).collect()]
    docs = [*filler, "yes", "Yes it is", "not at all", "the answer is yes, not at all"]
    for _, text in items:
        words = (text or "").split()
        for _ in range(4):
            lo = rng.randrange(max(1, len(words) // 2))
            some = words[lo : lo + rng.randint(5, 40)]
            for at in rng.sample(range(len(some)), min(len(some), rng.choice([0, 0, 1, 2]))):
                some[at] = rng.choice(["77", "Zoe", "other"])
            docs.append(" ".join(["Start here:", *some, "the end"]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, doc in enumerate(docs):
        want[i] = []
        for j, item in items:
            n = len(decontaminate.canonical(item)[0])
            if any(decontaminate.covered_words(list(ws), decontaminate.RUN, n) for ws in windows_by_hand(doc, item).values()):
                want[i].append(j)
    assert got == want and sum(map(bool, want.values())) > 20 and got[25] == [901] and got[26] == []


def test_an_item_with_one_number_changed(spark):
    words = [f"w{chr(97 + i)}" for i in range(26)]
    item = " ".join([*words[:20], "12", *words[20:25], "12"])
    rows = [(0, item.replace("12", "13", 1)), (1, " ".join(words[:12])), (2, " ".join(words[:13]))]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == {0: [5], 1: [], 2: [5]}


def test_without_the_first_filter(spark, monkeypatch):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    some = docs.where("doc_id % 4 = 0")
    want = sorted(map(tuple, decontaminate.matches(some, items).collect()))
    monkeypatch.setattr(decontaminate, "MAX_HASHES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert want and sorted(map(tuple, decontaminate.matches(some, items).collect())) == want


def test_texts_of_one_id_are_judged_apart(spark):
    item = "A train leaves Paris at 3 pm with 40 people and reaches London after 3 hours with 40 bags on board today."
    other = item.replace("3", "5").replace("40", "70")
    rows = [(None, item), (None, other), (None, "nothing of it"), (None, None), (1, item), (1, "clean words"), (2, "clean words")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(decontaminate.clean(docs, items).collect(), key=str) == sorted((r for r in docs.collect() if r["text"] not in (item, other)), key=str)
    assert sum(r["contaminated"] for r in decontaminate.contaminated(docs, items).collect()) == 3


def test_leaks_beside_other_numbers_and_of_numbers(spark):
    literal = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    long = f"From 3 to 40 it is said that {literal} and then 3 more"
    numbers = " ".join(str(i * i + 7) for i in range(20))
    docs = [long.replace("3 more", "5 more"), f"so {numbers} it goes", " ".join(str(i * i + 8) for i in range(20)), " ".join(literal.split()[::2])]
    items = [(1, long), (2, numbers), (3, "2 m and 3 m and 4 m and 5 m and 6 m and 7 m")]
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == {0: [1], 1: [2], 2: [], 3: []}


# -- 9 mixing -------------------------------------------------------------------------------------


def filled(budget, rooms, weights):
    """Shares of a budget, by pouring it out until nothing is left: what a full child can't take is poured again."""
    out, left = dict.fromkeys(rooms, 0.0), min(budget, sum(rooms.values()))
    for tier in (lambda k: weights.get(k, 1.0) > 0, lambda k: weights.get(k, 1.0) <= 0):
        weight = {k: weights.get(k, 1.0) or 1.0 for k in rooms if tier(k)}
        full = set()
        while weight.keys() - full:
            rest = left - sum(rooms[k] for k in full)
            level = rest / sum(weight[k] for k in weight.keys() - full)
            more = {k for k in weight.keys() - full if rooms[k] <= level * weight[k] + 1e-9}
            if not more:
                out.update((k, level * weight[k]) for k in weight.keys() - full)
                break
            full |= more
        out.update((k, rooms[k]) for k in full)
        left = max(0.0, left - sum(out[k] for k in weight))
    return out


def leaf_budgets(tokens, plan):
    def share(budget, keys, depth):
        groups = defaultdict(list)
        for k in keys:
            groups[k[depth]].append(k)
        parts = filled(budget, {g: float(plan.max_epochs * sum(tokens[k] for k in ks)) for g, ks in groups.items()}, (plan.domains, plan.languages, plan.sources)[depth])
        return {groups[g][0]: part for g, part in parts.items()} if depth == 2 else {k: b for g, part in parts.items() for k, b in share(part, groups[g], depth + 1).items()}

    return {k: int(b + 1e-6) for k, b in share(plan.share * sum(tokens.values()), sorted(tokens), 0).items()}


def spark_budgets(spark, tokens, plan):
    df = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "domain string, lang string, source string, n long")
    return {(r["domain"], r["lang"], r["source"]): r["leaf_budget"] for r in mixing.leaf_budgets(df, plan).collect()}


def test_shortage_goes_to_siblings_first(spark):
    tokens = {("a", "x", "s1"): 10, ("a", "x", "s2"): 1000, ("a", "y", "s3"): 1000, ("b", "x", "s4"): 1000}
    plan = mixing.Plan(domains={"a": 0.5, "b": 0.5}, languages={"x": 0.5, "y": 0.5}, domain_of={}, share=0.2, max_epochs=1)
    got = spark_budgets(spark, tokens, plan)
    assert got[("a", "x", "s1")] == 10 and abs(got[("a", "x", "s2")] - 140) <= 1 and abs(got[("a", "y", "s3")] - 150) <= 1 and abs(got[("b", "x", "s4")] - 301) <= 1
    assert filled(100, {"a": 10, "b": 50, "c": 1000}, {"a": 1, "b": 1, "c": 2}) == pytest.approx({"a": 10, "b": 30, "c": 60})


@pytest.mark.parametrize("seed", range(4))
def test_budgets_as_poured_by_hand(spark, seed):
    rng = random.Random(seed)
    tokens = {(d, lang, f"s{i}"): rng.choice([0, 1, 50, 3000]) for d in "abc" for lang in "xyz" for i in range(rng.randint(1, 9))}
    weights = lambda names: {n: rng.choice([0, 0.5, 1, 7]) for n in names if rng.random() < 0.8}
    plan = mixing.Plan(domains=weights("abc"), languages=weights("xyz"), sources=weights([f"s{i}" for i in range(9)]), domain_of={}, share=rng.choice([0.05, 0.6, 2.5, 9]), max_epochs=rng.choice([1, 3]))
    got, want = spark_budgets(spark, tokens, plan), leaf_budgets(tokens, plan)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes_as_by_hand(spark):
    docs = read(spark, SF, "documents")
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(docs).collect())
    plan, want, leaves = mixing.Plan(), Counter(), defaultdict(list)
    for r in docs.withColumn("h", F.md5("text")).collect():
        leaves[plan.domain_of.get(r["source"], "other"), r["lang"], r["source"]].append((r["doc_id"], r["h"], len((r["text"] or "").split())))
    sizes = {k: sum(x[2] for x in v) for k, v in leaves.items()}
    for k, budget in leaf_budgets(sizes, plan).items():
        whole, rest = divmod(budget, sizes[k])
        for e in range(whole):
            want.update((i, e) for i, _, _ in leaves[k])
        used = 0
        for _, i, n in sorted((int(hashlib.md5(f"{plan.seed}:{whole}:{i}:{h}".encode()).hexdigest()[:15], 16), i, n) for i, h, n in leaves[k]):
            used += n
            if used > rest:
                break
            want[i, whole] += 1
    assert got == want


def test_no_text_is_shuffled_for_its_range(spark):
    docs = read(spark, SF, "documents")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in mixing.mix(docs, carry=("text",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- 10 language ----------------------------------------------------------------------------------


def test_language_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op10_language"](spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_document_frequencies(spark):
    df = spark.createDataFrame([("aa",), ("ab",), (None,), ("12",)], "text string")
    n, seen = langid.document_frequencies(df)
    assert n == 2 and seen[langid.gram_counts("a")[0]].max() == 2


def test_letters_of_every_plane(spark):
    assert len(langid.gram_counts("\U00030001")[0]) and not len(langid.gram_counts("12 \U0001f600 !")[0])


def test_grams_as_by_hand():
    """Weights of a text, recomputed from its letters with plain dictionaries."""
    text = "Ab ab, é1b"
    flat = " ab ab é b"  # every stretch without letters is one space; none at the end
    want = Counter(flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1))
    at, counts = langid.gram_counts(text)
    assert counts.sum() == sum(want.values()) and sorted(counts.tolist()) == sorted(want.values())
    idf = np.linspace(1, 2, langid.BUCKETS)
    x = langid.weigh(at, counts, idf)
    dense = np.zeros(langid.BUCKETS)
    for b, c in zip(at, counts, strict=True):
        dense[b] = (1 + np.log(c)) * idf[b]
    assert np.allclose(x, (dense / np.linalg.norm(dense))[at]) and langid.temperature(np.array([[3.0, 0.0], [0.0, 3.0]] * 20), np.array([0, 1] * 19 + [1, 0])) > 0.5


def test_sparse_weights():
    model = langid.Ftrl(2, 10)
    for _ in range(50):
        model.learn(np.array([0]), np.array([1.0]), 0)
        model.learn(np.array([1]), np.array([1.0]), 1)
    w = model.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[2:10].any()


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    by_hand, lm = set(), model["lm"].tolist()
    for r in docs.collect():
        words = toxicity.features(toxicity.restored_words(r["text"], lm, {}))
        if model["bias"] + sum(model["weights"].get(w, 0.0) for w in words) < 0:
            by_hand.add(r["doc_id"])
    assert kept == by_hand
    clean = corpus_pipeline.drop_leaks(spark, docs, SF)
    leaks = decontaminate.contaminated(docs, read(spark, SF, "benchmark")).where("contaminated").count()
    assert clean.count() == docs.count() - leaks and clean.columns == docs.columns
    masked = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert masked.count() == docs.count() and masked.dtypes == docs.dtypes
    assert all(not secrets.base_spans(r["text"]) for r in masked.collect())
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_names_without_capitals_and_words_with_them(spark):
    item = "Yesterday the mayor of Paris asked Maria to count every red bicycle that stood near the old town hall."
    docs = [item.lower(), item.title(), item.upper(), item.replace("Paris", "Rome").replace("Maria", "Anna"), "Yesterday the mayor spoke."]
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["contaminated"] for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False}
