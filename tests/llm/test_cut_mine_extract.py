"""Fill-in-middle, hard negatives and main texts of pages, against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdetect.llm import extraction, middle, negatives

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("offsets", [[0], range(200_000), range(0, 300_000, 2), sorted(random.Random(1).sample(range(400_000), 9000)), [*range(70_000), 90_000, 500_001], sorted(random.Random(2).sample(range(65_536), 40_000))])
def test_boundary_sets(offsets):
    offsets = np.array(list(offsets))
    own = middle.Boundaries(offsets)
    assert len(own) == len(offsets)
    for k in {0, len(offsets) - 1, len(offsets) // 2, *random.Random(3).sample(range(len(offsets)), min(200, len(offsets)))}:
        assert own.select(k) == offsets[k]


def test_containers_take_the_smallest_form():
    kinds = lambda x: [p[0] for p in middle.Boundaries(np.array(sorted(x))).parts]
    assert kinds(range(150_000)) == ["runs"] * 3 and kinds(range(0, 65_536, 40)) == ["array"] and kinds(range(0, 65_536, 2)) == ["bitmap"]


def plain_middle(doc_id, text):
    """The contract in plain Python."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, sha = len(units), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in middle.SENTINELS):
        return doc_id, n, "plain", None, None, sha(text or ""), sha(text or "")
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)


def test_middle_of_awkward_rows(spark, odd, empty):
    more = spark.createDataFrame([(10, "\n\n\n"), (11, "a <P> b"), (12, "no end\nof line"), (13, "<\nS>\n<M\n>"), (14, "é😀\r\n x\n" * 9), (15, "\n" * 200_000)], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).withColumn("output", F.lit("clash"))
    got = middle.with_digests(middle.fill_in_middle(docs))
    assert got.columns.count("output") == 1 and "clash" not in {r.output for r in got.select("output").collect()}
    rows = [tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
    assert sorted(rows, key=str) == sorted((plain_middle(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert middle.with_digests(middle.fill_in_middle(empty)).count() == 0


def test_middle_is_restored_whatever_the_parts():
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("<>PSM\na") for _ in range(r.randrange(12)))
        for spm in (0, 100):
            _, form, _, _, output = middle.transformed(text, tuple(r.randrange(1 << 32) for _ in range(4)), 100, spm)
            assert middle.restored(output, form) == text
    assert middle.transformed("a\nb\n", (0, 1, 60, 0), 60, 50)[1] == "plain"


def vectors(n, dims=64, seed=5):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims))
    x = centres[g.integers(0, 6, n)] * 0.7 + g.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_intervals_hold_every_score():
    ints = np.floor(256 * vectors(900)).astype(np.int64)
    block = negatives.Block(np.arange(900), np.zeros(900, np.int64), ints, *negatives.encoded(ints.astype(float)))
    estimate, half = block.intervals(ints[:50].astype(float), slice(0, 900))
    off = np.abs(estimate - ints[:50] @ ints.T)
    assert (off <= half).all() and half.mean() < 0.25 * np.linalg.norm(ints, axis=1).mean() ** 2
    assert ((estimate + half) < 0.3 * np.linalg.norm(ints, axis=1).mean() ** 2).mean() > 0.4  # intervals do exclude


def plain_negatives(rows, positives=5, negatives_=3):
    whole = [(i, la, [math.floor(256 * x) for x in v]) for i, la, v in rows if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    anchors = {(i, la, tuple(v)) for i, la, v in whole if i is not None and i % 50 == 0}
    for i, la, v in anchors:
        near = sorted(((dot(v, w), j) for j, lb, w in whole if lb == la and j != i), key=order)[:positives]
        far = sorted(((dot(v, w), j) for j, lb, w in whole if lb != la), key=order)
        for score, p in near:
            fit = [(s, j) for s, j in far if 50 * score <= 100 * s <= 95 * score][:negatives_]
            out += [(i, p, k, j, score, s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out, key=str)


def test_negatives_of_awkward_rows(spark):
    x = vectors(400, 20).tolist()
    rows = [(i, i % 3, v) for i, v in enumerate(x)]
    rows += [(1000, None, x[0]), (1050, 1, None), (1100, 1, [0.1, None]), (1150, 2, [float("nan")] * 20), (1200, 2, [float("inf")] * 20), (1250, 0, []), (1300, 1, [0.5, -0.25, 1.0])]
    rows += [(None, 0, x[3]), (None, 1, x[4]), (100, 1, x[100]), (100, 1, x[100]), (150, 0, x[7]), (7, 1, x[7]), (8, 2, x[7]), (9, 2, x[7]), (1350, 0, [0.0] * 20), (1400, 9, x[5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"score": F.lit("clash"), "rank": F.lit(1), "node": F.lit(2)})
    got = sorted((tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()), key=str)
    assert got == plain_negatives(rows) and len(got) > 50
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 3"), F.col("vec_id") % 50 == 0).count() == 0


def test_negatives_in_many_blocks(spark, monkeypatch):
    """A label with nine tenths of all rows, and more cells than one."""
    rows = [(i, 0 if i % 10 else 1, v) for i, v in enumerate(vectors(700, 70, 6).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 100)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows)


def test_large_whole_numbers_stay_exact(spark):
    rows = [(0, 1, [200_000.123, -3.0]), (1, 1, [190_000.5, 1.0]), (2, 2, [150_000.25, 9.0]), (3, 2, [120_000.75, -5.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()] == plain_negatives(rows)


BODY = "<p>The quick brown fox number {0} jumps over {0} lazy dogs.</p><p>Then it went home &amp; slept for {0} hours.</p>"
TEXT = "The quick brown fox number {0} jumps over {0} lazy dogs. Then it went home & slept for {0} hours."


@pytest.mark.parametrize("page", [
    "<body><nav><ul><li>Home<li>About</ul></nav><article>{}</article><footer>end</footer>", "<div class='site-header'>Name</div><main>{}<aside>more</aside></main>", "<div id=sidebar-left>links</div><div class='entry-content'>{}</div><div class=cookie-notice>ok?</div>",
    "<header>Top</header><article>{}<section id='comments'><article class='comment'><p>First!</p></article></section></article>", "<form id='aspnetForm'><input><article>{}</article><select><option>x<option>y</select></form>",
    "<article>{}<div class='share-buttons'><a>Tweet</a></div><div role=alert>Updated</div><script>document.write('<p>no</p>')</script></article>", "<div class='ad banner-ad'>Buy</div><article>{}</article><!-- <article>old</article> -->",
    "<table><tr><td class=menu>Home</td><td><article>{}</article></td></tr></table>", "<style>p{{}}</style><article>{}</article><noscript>enable</noscript><p hidden>secret</p>", "<article><template>t</template>{}<iframe>f</iframe><button>Like</button></article>",
    "<article>{}<p style='display: none'>no</p><svg><text>s</text></svg></article><article class='related-story comments'>z</article>", "<section class=related><article>teaser</article></section><article>{}</article>",
])
def test_declared_furniture(page):
    assert extraction.main_text(page.format(BODY.format(7))) == TEXT.format(7)


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("<article></article><p>x", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<article><h1>A<p>b<b>c<br><p>d</article>", "A bc d"), ("<article>a&nbsp;b&amp c &am d &#233;&#x1F600;\n\n e</article>", "a b& c &am d é😀 e"),
    ("<article>1 < 2 </3><a href='x>y'>l</a> <i>m</i>n</article>", "1 < 2 l mn"), ("<article>a<!-- never closed <p>b</p>", "a"), ("<article>a <a href='never closed>b</p>", "a b"), ("<ARTICLE><P>Up<BR/>per</P></ARTICLE>", "Up per"),
    ("<article><table><tr><td>1<td>2<tr><th>3</table>4</article>", "1 2 3 4"), ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article>", "a b c"), ("<article><script>never closed <p>x", ""), ("<head><title>t</title><p>x", "x"),
])
def test_markup(source, text):
    assert extraction.main_text(source) == text


def site(spark, pages, host="http://Site.example/"):
    return spark.createDataFrame([(i, f"{host}{i}?x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_site_style_tree(spark):
    """Nothing declares a part; what all pages of the site share goes, what differs stays, whatever it looks like."""
    page = "<body><div><a>Home</a><a>Shop</a></div><div><span>Opening hours: 9 to 5</span></div><div>" + BODY + "</div><div><p>All rights reserved by the owner of this very site, who has much to say about it in this long line.</p></div></body>"
    rows = site(spark, [page.format(i) for i in range(8)])
    other = site(spark, [page.format(99)], "http://lone.example/")
    got = {(r.url, r.page_id): r.text for r in extraction.extracted(rows.union(other)).collect()}
    assert all(got[(f"http://Site.example/{i}?x", i)] == TEXT.format(i) for i in range(8))
    assert "Opening hours" in got[("http://lone.example/0?x", 0)]  # of one page there is nothing to compare
    tree = {x.importance for r in extraction.style_trees(rows.select(F.lit("h").alias("host"), "html")).collect() for x in r.tree}
    assert min(tree) == 0 and max(tree) <= 1


def test_copies_of_an_article_stay(spark):
    """Copies of one page, and one article on most pages of a site: the node with the most text is no furniture."""
    page = "<body><div>Menu {0}</div><div>" + BODY.format(5) * 3 + "</div></body>"
    got = [r.text for r in extraction.extracted(site(spark, [page.format("same")] * 9 + [page.format(i) for i in range(9)])).collect()]
    assert len(got) == 18 and all(TEXT.format(5) in t for t in got)


def plain_style_tree(pages):
    """(pages, composite importance, largest in it) of each element that two pages have, by the definitions, one element at a time."""
    rows, log = [], math.log

    def element(nodes):
        m = len(nodes)
        if m == 1:
            return 1.0, 1.0
        styles = {}
        for page, i in nodes:
            styles.setdefault(tuple(page.name[k] for k in page.parts[i] if isinstance(k, int)), []).append((page, [k for k in page.parts[i] if isinstance(k, int)], i))
        means, most = [], 0.0
        for style, of in styles.items():
            if style:
                inside = [element([(page, kids[j]) for page, kids, _ in of]) for j in range(len(style))]
                mean, top = sum(c for c, _ in inside) / len(inside), max(t for _, t in inside)
            else:
                bags = [Counter([*"".join(page.parts[i]).split(), *(ref for _, ref in page.refs.get(i, ()))]) for page, _, i in of]
                entropies = []
                for w in set().union(*bags):
                    share = [b[w] / sum(x[w] for x in bags) for b in bags if b[w]]
                    entropies.append(-sum(x * log(x) for x in share) / log(len(of)) if len(of) > 1 else 0.0)
                mean = top = 1.0 if len(of) == 1 else 1 - sum(entropies) / len(entropies) if entropies else 0.0
            means.append((len(of) / m, mean))
            most = max(most, top)
        own, g = -sum(x * log(x) for x, _ in means) / log(m), 0.9 ** len(styles)
        composite = means[0][1] if list(styles) == [()] else (1 - g) * own + g * sum(x * y for x, y in means)
        rows.append((m, composite, max(composite, most)))
        return composite, max(composite, most)

    element([(page, 0) for page in pages])
    return sorted(rows)


def test_importances_by_the_definitions(spark, monkeypatch):
    """All elements of random sites, with copies, against the definitions; tallied in small parts that go to many places."""
    monkeypatch.setattr(extraction, "TALLY", 300)
    monkeypatch.setattr(extraction, "PLACE_BYTES", 2000)
    r = random.Random(8)
    some = lambda: " ".join(r.choices("one two three four five six seven".split(), k=r.randrange(6)))

    def block(depth):
        if not depth or r.random() < 0.3:
            return f"<p>{some()} <a href='/{r.randrange(3)}'>{some()}</a>{some()}</p>" + "<img src=a.png>" * r.randrange(2)
        return f"<div class='x{r.randrange(2)}' align={r.choice(['left', 'right'])}>" + "".join(f"{r.choice(['', some()])}{block(depth - 1)}" for _ in range(r.randrange(1, 3))) + "</div>"

    sites = {h: [f"<body><div>Menu {i % 3}</div>{block(3)}<div></div></body>" for i in range(n)] for h, n in (("a", 200), ("b", 7), ("c", 1))}
    rows = [(h, page) for h, pages in sites.items() for page in [*pages, *pages[:5], *pages[:2]]]
    got = extraction.importances(spark.createDataFrame(rows, "host string, html string").repartition(3))[0].collect()
    want = sorted(x for pages in sites.values() for x in plain_style_tree([extraction.Page(p) for p in dict.fromkeys(pages)]))
    assert len(want) > 60 and np.allclose(sorted((x.m, x.importance, x.most) for x in got), want, atol=2e-6)


def test_words_of_a_leaf_count_alone(spark):
    """A footer that differs in one word is noise; the words that all pages share say so."""
    page = "<body><div>" + BODY + "</div><div>Page {0} of this site, which is run by its owner, who reserves all rights in it and asks that nobody copies any part without leave first.</div></body>"
    assert sorted(r.text for r in extraction.extracted(site(spark, [page.format(i) for i in range(8)])).collect()) == [TEXT.format(i) for i in range(8)]


def test_noise_has_nothing_important_in_it(spark):
    """A part most of whose elements all pages share is no noise for that, if one differs; the others in it are."""
    page = "<body><div>" + BODY * 4 + "</div><div>" + "<div>Shared by all</div>" * 12 + "<div>w{0} x{0} y{0}</div></div></body>"
    got = {r.page_id: r.text for r in extraction.extracted(site(spark, [page.format(i) for i in range(8)])).collect()}
    assert got == {i: " ".join([TEXT.format(i)] * 4 + [f"w{i} x{i} y{i}"]) for i in range(8)}


def test_every_template_of_a_site_is_judged(spark):
    """Noise of pages of a style that is not that of half of the site."""
    page = "<body>{1}<div>All rights reserved</div><div>" + BODY + "</div></body>"
    rows = site(spark, [page.format(i, "<ul><li>Shop</ul>" * (i % 3)) for i in range(18)])
    assert sorted(r.text for r in extraction.extracted(rows).collect()) == sorted(TEXT.format(i) for i in range(18))


def test_deep_pages_take_few_rounds(spark):
    """Elements 500 deep, on all pages of a site."""
    rows = site(spark, [f"{'<div>' * 500}<p>same line</p><p>{BODY.format(i)}</p>" for i in range(6)]).select(F.lit("h").alias("host"), "html")
    began = time.perf_counter()
    got = sorted((x.m, x.importance, x.most) for x in extraction.importances(rows)[0].collect())
    assert time.perf_counter() - began < 60
    want = plain_style_tree([extraction.Page(r.html) for r in rows.collect()])
    assert len(want) > 500 and np.allclose(got, want, atol=2e-6)


def test_column_named_tree(spark):
    df = site(spark, ["<article>one</article>"]).withColumns({"tree": F.lit("t"), "root": F.lit(1), "weight": F.lit(2)})
    assert [(r.tree, r.root, r.weight, r.text) for r in extraction.extracted(df).collect()] == [("t", 1, 2, "one")]


def test_pages_awkward_rows(spark):
    rows = [(1, "http://a/x", "<article>one</article>"), (1, "http://a/x", "<article>one</article>"), (2, None, "<p>two"), (None, "no scheme", None), (3, "http://a/y", ""), (4, "http://a/z", "<article>" + "long text " * 200_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "host", "tree", "node", "n_chars")})
    got = extraction.extracted(df)
    assert got.columns.count("text") == 1
    assert sorted((r.page_id or 0, r.text[:9], len(r.text)) for r in got.collect()) == [(0, "", 0), (1, "one", 3), (1, "one", 3), (2, "two", 3), (3, "", 0), (4, "long text", 1_999_999)]
    assert extraction.extracted(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [extraction.BROADCAST_NODES, 0])
def test_hot_host_is_dealt(spark, monkeypatch, most):
    monkeypatch.setattr(extraction, "BROADCAST_NODES", most)
    rows = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("id"))), F.lit(".example/")).alias("url"), F.concat(F.lit("<div>Menu</div><div><p>text "), "id", F.lit("</div>")).alias("html"))
    got = {r.page_id: r.text for r in extraction.extracted(rows).collect()}
    assert len(got) == 600 and got[3] == "text 3" and got[4] == "Menu text 4"


def test_pages_cost_little_over_a_plain_parser():
    """A page is read twice and tallied in less than four times what the library's parser takes to read it once."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist() * 2

    def ours():
        tally = extraction._Tally(1)
        for page in pages:
            tally.add(1, page, 1.0)
            extraction.main_text(page)
        tally.taken()

    def theirs():
        for page in pages:
            parser = HTMLParser()
            parser.feed(page)
            parser.close()

    def cost(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    assert min(cost(ours) for _ in range(5)) < 3.8 * min(cost(theirs) for _ in range(5))


def test_tags_met_before_end_where_they_end():
    """What a tag's text says of itself is kept, but not where it ends by what follows."""
    for _ in range(2):
        assert extraction.main_text('<p><b title="x>one</b> two') == "one two"
        assert extraction.main_text('<p><b title="x>one</b> two">three') == "three"
        assert extraction.main_text('<p><b title="x">one</b> two">three') == 'one two">three'
        assert extraction.main_text("<body><div class=site-header>b</div><p>c</body>") == "c"
        assert extraction.main_text("<article>a<div class=site-header>b</div>c</article>") == "a b c"


def test_end_tag_of_other_letters_is_a_comment():
    assert extraction.main_text("<article>one</é> two</article>") == "one two"


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<!--", "</td>", "<li><ul>", "<b>", "<span class=ad>", "<td>", "&", "<p", '<a b="', "<header>", "<div><b></div></b>", "<table><tr>", "</i><i>"])
def test_extraction_takes_linear_time(piece):
    began = time.perf_counter()
    extraction.main_text(piece * 100_000)
    assert time.perf_counter() - began < 12


def test_given_pages(spark):
    """The article as it stands between its tags, in all given pages."""
    import html

    for r in extraction.op13_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert r.text == want and r.n_chars == len(want)
