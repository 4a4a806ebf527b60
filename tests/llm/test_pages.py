"""URL filter and main text of pages."""

import html
import random
import re

import pytest

from assaykit.llm import url_filter
from assaykit.llm.html_extract import Page, Reference, extract_text
from assaykit.llm.queries import QUERIES
from assaykit.llm.url_filter import judge_urls, seed_labels, train


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_rules_and_trees(spark, small):
    urls = [r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://A.Example.NET/en/1?x://y", "https://example.net/en", "ftp://net", "http://net/", "http://xnet/", "a://b://c.org/fr/#q",
             "http://x.org/fr/\n2", "http://ÄB.net/de/", "HTTP://example.com?/de/", "http://example.com/de/", "://example.com/de/x", "http://u@h.example.com:80/de/"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "y"), (3, urls[3], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, HOST string")
    got = judge_urls(pages, train(seed_labels(pages))).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u, _ in rows:
        r = by_id[i]
        assert (r.host, r.path) == split_url(u)
        found = rule_of(r.host, r.path)
        assert r.rule == (found[1] if found else None)
        assert r.verdict == found[0] if found else r.verdict in ("allow", "block")
    empty = pages.limit(0)
    assert judge_urls(empty, train(seed_labels(empty))).count() == 0


def test_trees_on_unseen_hosts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randrange(5, 9)))
    good = [f"https://www.{word()}.example.org/en/{rng.randrange(999)}" for _ in range(400)]
    bad = [f"http://{word()}-{word()}-{rng.randrange(99)}.example.biz/x/{rng.randrange(10**9)}?a=1&b=2&c=3" for _ in range(400)]
    data = spark.createDataFrame([(u, 0) for u in good[:300]] + [(u, 1) for u in bad[:300]], "url string, label int")
    unseen = spark.createDataFrame(list(enumerate(good[300:] + bad[300:])), "page_id bigint, url string")
    got = judge_urls(unseen, train(data), rules=(("allow", "nowhere/"),)).collect()
    assert sum((r.verdict == "block") == (r.page_id >= 100) for r in got) >= 195


def test_trees_keep_the_shares_of_the_labels(spark):
    # three in ten urls below /x are bad and none elsewhere: no leaf is bad for the most part, however few are fitted on
    urls = [(f"http://h.example.org/x/{i}", int(i % 10 < 3)) for i in range(1000, 3000)] + [(f"http://h.example.org/{i}", 0) for i in range(1000, 5000)]
    urls += [("http://h.example.org/x/1000", 1)] * 3000
    model = train(spark.createDataFrame(urls, "url string, label int"), most=100)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    assert judge_urls(pages, model, rules=(("allow", "nowhere/"),)).where("verdict = 'block'").count() == 0


def test_suffixes_are_counted_over_all_labelled_rows(spark, monkeypatch):
    urls = [(f"http://h.site{i % 300}.org/{i}", int(i % 300 < 100)) for i in range(3000)] + [("http://h.site0.org/0", 1)] * 5
    data = spark.createDataFrame(urls, "url string, label int")
    model = train(data, most=20)
    got = {r.suffix: r.s_count for r in model.suffixes.collect()}
    assert got == {f"site{i}.org": 15 if i == 0 else 10 for i in range(300)}
    assert model.prior == 1005 / 3005
    # the same verdicts when the statistics are not broadcast
    pages = data.selectExpr("cast(hash(url) as bigint) as page_id", "url").union(spark.sql("select 1L, 'http://new.net/x'"))
    verdicts = lambda: sorted(map(tuple, judge_urls(pages, model).collect()), key=str)
    small = verdicts()
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", 10)
    assert verdicts() == small and len(small) == 3006


def test_plan_is_native(spark, small):
    plan = QUERIES["op1_url_filter"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def article(page):
    """The article of a generated page, by its known make-up."""
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_generated_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op3_html_extraction"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, 0) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, Text int")
    return [r.text for r in sorted(extract_text(df).collect(), key=lambda r: r.page_id)]


def test_parts_that_are_no_content(spark):
    page = """<html><head><title>T</title><style>x</style></head><body><header><h2>Site</h2></header><nav>Menu</nav>
<div id=cookie-notice>We use cookies</div><main><article class="post has-sidebar"><h1>Big &amp; <b>bo</b>ld</h1>
<p>One<br>two&nbsp;  three<p>a<i>b</i>c &lt;tag&gt; &#233; &amp copy<script>if (a < b) "</p>"</script>
<ul><li>x<li>y</ul><div class="advert">Buy</div><form>Mail <input></form><aside>Side</aside>
<table><tr><td>c1<td>c2</table><!-- no --><div class='share-tools'>Share</div><section class="comments"><article>Nice post</article></section>
</article></main><div class="sidebar">Links</div><footer>&copy; me</footer></body></html>"""
    assert run(spark, [("http://h/1", page)]) == ["Big & bold One two three abc <tag> é & copy x y c1 c2"]


def test_odd_pages(spark):
    rows = [(None, None), ("x", ""), ("http://h/", "plain text &amp; <b>bold"), ("http://h/", "<p>open <a href='>'>quote</a> <p"), ("http://h/", "<" * 2000),
            ("http://h/", "<div>" * 3000 + "deep" + "</div>" * 2000), ("http://h/", "<article></article>"), ("http://h/", "<p>" + "word " * 100_000)]
    got = run(spark, rows)
    assert got[:2] == ["", ""] and got[2] == "plain text & bold" and got[5] == "deep" and got[6] == "" and len(got[7]) == 499_999
    assert run(spark, []) == []


def test_all_articles_and_main_parts_are_joined():
    page = """<nav>Menu</nav><main><p>Before</p><article><h1>One</h1><p>first</p></article>between<article class="teaser">Read on</article>
<article>Two<article class=comment>So true</article> and more</article></main><div>Bar</div><article>Three</article><article class="ad">Buy</article>"""
    assert Page(page).blocks() == ["Before", "One", "first", "between", "Two", "and more", "Three"]


def test_deep_elements_keep_their_parents():
    deep = "<div>" * 5000
    assert Page(deep + "<article><p>one</p><nav><div>Menu</div></nav><p>two</p></article>rest").blocks() == ["one", "two"]
    assert Page(deep + "<main><p>text</p></main><p>after</p>").blocks() == ["text"]
    assert Page(deep + "<p>text</p><aside><div><p>Side</p></div></aside>").blocks() == ["text"]
    assert len(Reference(Page(deep + "<p>x").skeleton()).align(Page(deep + "<ul><li>x</ul><p>y"))) == 5002


def test_template_of_a_host(spark):
    def page(i):
        return f"<body><div>Welcome to our shop</div><div><p>Item {i} is new</p><p>Best price {i * 7}</p><p>All rights kept</p></div></body>"

    rows = [("http://shop/" + str(i), page(i)) for i in range(8)] + [("http://shop/0", page(0))] * 3 + [("http://other/", page(1))]
    got = run(spark, rows)
    assert got[:8] == [f"Item {i} is new Best price {i * 7}" for i in range(8)]
    assert got[8:11] == got[:1] * 3
    assert got[11] == "Welcome to our shop Item 1 is new Best price 7 All rights kept"
    # copies of one page are no evidence of a template
    assert run(spark, [("http://same/", page(2))] * 9)[0].startswith("Welcome")


def test_template_when_the_first_page_is_odd(spark):
    def page(i):
        return f"<body><div>Welcome to our shop</div><div><p>Item {i} is new</p><p>All rights kept</p></div></body>"

    def other(i):
        return f"<body><section class=big><p>Story {i}</p></section><section><p>Told by us</p></section></body>"

    rows = [("http://shop/", None), ("http://shop/e", "<h1>Error</h1>")] + [("http://shop/", page(i)) for i in range(8)] + [("http://shop/", other(i)) for i in range(6)]
    got = run(spark, rows)
    assert got[0] == "" and got[2:10] == [f"Item {i} is new" for i in range(8)] and got[10:] == [f"Story {i}" for i in range(6)]


def brute_matching(a, b):
    """Size of the largest simple tree matching, from its definition."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute_matching(x, y))
    return 1 + table[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_a_largest_matching(seed):
    rng = random.Random(seed)

    def tree(depth):
        return (rng.choice(["div", "section"]), [tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)])

    def text(t):
        return f"<{t[0]}>" + "".join(map(text, t[1])) + f"</{t[0]}>"

    a, b = ("div", [tree(3), tree(2)]), ("div", [tree(3), tree(2), tree(1)])
    found = Reference(Page(text(b)).skeleton()).align(Page(text(a)))
    assert len(set(found.values())) == len(found) == 1 + brute_matching(a, b)


def test_long_lists_are_aligned_like_short_ones():
    # one late <section> must not keep the many siblings after it from their partners
    a = "<section>s</section>" + "".join(f"<div><p>{i}</p></div><h2>{i}</h2>" for i in range(700))
    b = "".join(f"<h2>{i}</h2><div><p>{i}</p><b>x</b></div>" for i in range(700)) + "<section>s</section><div></div>"
    page, ref = Page(a), Reference(Page(b).skeleton())
    found = ref.align(page)
    # 700 <div> with their <p>, the 699 <h2> between them and the root
    assert len(found) == len(set(found.values())) == 700 * 2 + 699 + 1
