"""Expected texts, written out or rebuilt from how the pages are made; wrappers fold and align as they should."""

import html
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract as H


@pytest.mark.parametrize("page,want", [
    ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("<p>a</p><p>b", "a\n\nb"), ("<p>a<br>b &lt;p&gt; <i>c</i>d</p>", "a b <p> cd"),
    ("<nav>menu</nav><article><h1>T</h1><p>x\n\n y</p><aside>s</aside><footer>f</footer></article><footer>g</footer>", "T\n\nx y"),
    ("<article><header><h1>T</h1></header><p>x</p><div class='comments'><p>me too</p></div></article>", "T\n\nx"),
    ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- no --><form>q</form>", "x"),
    ("<p>unclosed <b>bold<p>next <ul><li>one<li>two</ul>", "unclosed bold\n\nnext\n\none\n\ntwo"),
    ("<main><div class='cookie-banner'>ok?</div><p>&eacute;&#233;&#x1F600;</p></main>", "éé\U0001f600"), ("<p>" * 3000 + "deep", "deep"), ("a < b and c > d", "a < b and c > d"),
])
def test_texts(page, want):
    assert H.main_text(page or "") == want


def test_given_pages(spark, sf):
    """The given pages' articles: cut at block tags by a plain pattern."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in H.extracted(pages).collect()}
    checked = 0
    for r in pages.collect():
        m = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        if m and not re.search(r"<(?!/?(?:p|b|h1|br)\b)[a-z/]", m[1]):
            blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", m[1]))
            assert got[r["page_id"]]["text"] == "\n\n".join(filter(None, blocks)), r["page_id"]
            checked += 1
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]
    assert checked > 20 and len(got) == pages.count()


def test_wrapper_finds_template_text(spark):
    """Without an article, what all pages of a host say in the same place is template; hosts of few pages show nothing."""
    page = lambda k: f"<div><p class=top>Welcome to us</p><div id=b>{''.join(f'<p>Text {k} {i}</p>' for i in range(k % 4 + 1))}</div><p class=end>All the best</p></div>"
    rows = [(k, "https://One.example/" + str(k), page(k)) for k in range(12)] + [(100 + k, f"http://few.example/{k}", page(k)) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}
    for k in range(12):
        assert got[k] == "\n\n".join(f"Text {k} {i}" for i in range(k % 4 + 1))
    assert got[101].startswith("Welcome to us\n\n")


def test_folding_and_alignment():
    items = lambda s: [[c, 0, 0, None] for c in s]
    assert H.fold(items("aaab")) == [["a", 0, 1, None], ["b", 0, 0, None]]
    assert [[x[0], x[2]] for x in H.fold(items("ababab"))] == [["()", 1]]
    out = H.align(items("abd"), items("acd"))
    assert [(x[0], x[1]) for x in out] == [("a", 0), ("b", 1), ("c", 1), ("d", 0)]


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<p>x"), (1, None, "<p>x"), (2, "http://a.example", ""), (3, "x", "<div>" * 500 + "y" * 200_000), (4, "http://a.example", "<!--"), (5, "http://a.example", "<p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "id", "salt", "text", "template", "outside", "wrapper", "part")})
    got = H.extracted(pages).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 1), ("1", 1), ("2", 0), ("3", 200_000), ("4", 0), ("5", 2), ("None", 0)]
    assert H.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<div class=content><p>The text</p></div><article class=comment><p>me too</p></article>", "The text"),
    ("<div class=content><p>The text</p></div><aside><article><p>teaser</p></article></aside>", "The text"),
    ("<div class=content><p>The text</p></div><div class=comments><article>a long reply, longer</article><article>b</article></div>", "The text"),
    ("<body class='has-sidebar cookie-ok'><article class='post category-search'><p>x</p></article></body>", "x"), ("<html class=widget><main class='with-sidebar'><p>x</p></main></html>", "x"),
    ("<div class='page with-sidebar'><main><p>x</p><div class=share>s</div></main></div>", "x"), ("<div class='with-sidebar'><nav>n</nav><article><p>long text</p><div class=comments>c</div></article></div><p>end</p>", "long text"),
    ("<aside><main><p>no</p></main></aside><p>x</p>", "x"),
])
def test_marks_and_articles(page, want):
    assert H.main_text(page) == want


def test_copies_are_no_template(spark):
    """Copies count once: a host of copies only, and a layout that only a copied page uses, keep their text."""
    page = lambda k: f"<p class=top>Welcome</p><div id=b><p>Text {k}</p></div>"
    rows = [(k, f"http://copies.example/{k}", page(0)) for k in range(12)] + [(100 + k, f"http://mixed.example/{k}", page(k)) for k in range(8)]
    rows += [(200 + k, f"http://mixed.example/own/{k}", "<p class=top>Welcome</p><div id=own><p>Only here</p></div>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}
    assert all(got[k] == "Welcome\n\nText 0" for k in range(12)) and all(got[100 + k] == f"Text {k}" for k in range(8))
    assert all(got[200 + k] == "Only here" for k in range(12))


@pytest.mark.parametrize("page,want", [
    ("<article><section class='related work'><p>a</p></section><div class='search-results'>b</div><div class=banner>c</div></article>", "a\n\nb\n\nc"),
    ("<article><p>&<b>lt</b>; &amp;<i>lt;</i></p></article>", "&lt; &lt;"), ("<p>a<img src=x>b <wbr>c", "ab c"), ("<title>T</title><p title='x class=ad'>y", "y"),
    ("<article><p>x</p><div class='comment-list'>c</div><div class='ad-slot'>d</div><div id=cookie-notice>e</div></article>", "x"),
    ("<a title='1 > 0' class='>'>x</a> y", "x y"), ("<p>a</p></div></b></p><p>b", "a\n\nb"), ("<![CDATA[1 < 2]]> &lt;", "1 < 2 <"), ("<a \"", '<a "'), ("<p a=\">x", 'x'),
])
def test_nothing_else_goes(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("page,n", [
    ("<div>" * 40_000 + "x", 1), ("<div>" * 50_000 + "</p></b>" * 50_000 + "x", 1), ('<a "' * 40_000, 160_000), ("<p>y<ul>" * 60_000, 0), ("".join(f"<{t}>y" for k in range(20_000) for t in ("p", "div", "h2")[: k % 3 + 1]), 0),
    ("".join(f"<p class=k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}>x" for k in range(80_000)), 0), ("<script>" * 40_000, 0), ("<!--" * 40_000, 0), ('<p a="' * 40_000 + ">", 0), ("<a b='>'" * 50_000, 0),
])
def test_deep_and_wide_pages(page, n):
    """In time and room that grow with the page."""
    import time

    began = time.process_time()
    a, b = H.Wrapper(), H.Wrapper()
    a.add_page(page)
    b.add_page(page[: len(page) // 2])
    a.add(H.Wrapper.load(b.dump()))
    a.decided()
    got = H.main_text(page)
    assert not n or len(got) == n
    assert time.process_time() - began < 20 and max(map(len, a.rules.values()), default=0) <= H.WIDEST


def test_wrappers_equal_brute_force(spark):
    """Small hosts: slots by place alone, compared over all pages of the host by a plain parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.at, self.last, self.runs = [], [None], []
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            self.last[-1] = (tag, tuple(attrs))
            self.at.append(self.last[-1])
            self.last.append(None)

        def handle_endtag(self, tag):
            self.at.pop()
            self.last.pop()

        def handle_data(self, data):
            self.runs.append(((*self.at, "#", self.last[-1]), data))

    rng = __import__("random").Random(5)
    rows = []
    for host in range(8):
        for k in range(rng.choice((2, 4, 6, 15))):
            body = "".join(f"<p>par {host} {k if host % 2 else rng.randint(0, 2)} {i}</p>" for i in range(rng.randint(1, 4)))
            note = "<div id=note>read on</div>" if rng.random() < 0.8 else ""
            rows.append((len(rows), f"http://h{host}.example/{k}", f"<body><h1>Site {host}</h1><div class=x>{body}{note}</div><h2>the end{k % 2 if host > 5 else ''}</h2></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}
    by_host = {}
    for i, url, page in rows:
        by_host.setdefault(url.split("/")[2], []).append((i, Plain(page).runs))
    dropped = 0
    for held in by_host.values():
        texts, where = {}, {}
        for _, runs in held:
            for slot in {s for s, _ in runs}:
                texts.setdefault(slot, set()).add(tuple(sorted({t for s, t in runs if s == slot})))
                where.setdefault(slot, set()).add("\n".join(t for _, t in runs))
        template = {s for s in texts if len(texts[s]) == 1 and len(where[s]) >= H.LEAST_PAGES}
        dropped += len(template)
        for i, runs in held:
            assert got[i] == "\n\n".join(t for s, t in runs if s not in template), i
    assert dropped > 5


def test_the_wrapper_chooses_between_articles_and_the_rest(spark):
    """Teasers in unmarked articles beside a text that is in none: the host's pages show which is which."""
    page = lambda k: f"<div class=text><p>{'Long story ' * 20}{k}</p></div><div><article>teaser {k}</article><article>teaser {k + 1}</article></div>"
    rows = [(k, f"http://one.example/{k}", page(k)) for k in range(9)] + [(100, "http://two.example/", page(100))]
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == " ".join(f"{'Long story ' * 20}{k}".split()) for k in range(9)) and got[100].startswith("teaser")


@pytest.mark.parametrize("page,want", [
    ("<p>See <svg/> here</p>", "See here"), ("<p>See <svg><g><text>no</text></g></svg> here</p>", "See here"), ("<p>a<script>x</script>b</p>", "ab"), ("<p>a <button>press <b>me</b></button> b <select><option>1<option>2</select>c</p>", "a b c"),
    ("<p>a<style>p{}</style> b<noscript><div>on</div></noscript> c<template><p>t</p></template></p><p>d", "a b c\n\nd"), ("<div>a<iframe src=x></iframe>b<input>c<textarea>t</textarea>d</div>", "abcd"), ("<p>x <button>unclosed</p><p>y</p>", "x\n\ny"),
    ("<article><p>one</p><blockquote class='skip'>two</blockquote><p class='notice'>three</p><h2 class=menu>four</h2><ul class=menu><li>m</ul></article>", "one\n\ntwo\n\nthree\n\nfour"),
    ("<div id='main-menu-content'><p>Long enough prose</p><a href=x>link</a></div>", "Long enough prose\n\nlink"), ("<div class=menu><a href=x>only</a> <a href=y>links</a></div>", ""), ("<div class=menu><p>gone</p></div><p>stays</p>", "stays"),
    ("<p>a <span class=share>tell</span> b</p>", "a b"), ("<article>a<footer>f</footer>b</article>", "a\n\nb"),
])
def test_blocks_are_not_cut_and_names_alone_take_nothing(page, want):
    assert H.main_text(page) == want


def test_unmarked_chrome_inside_articles_is_template(spark):
    """No telling class: what all pages say inside the article goes, but for a heading between texts that differ; near copies of one page keep all."""
    rng = __import__("random").Random(2)
    prose = lambda k, n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + f" {k}"

    def page(k):
        a, b, c = prose(k, 30), prose(k, 20), prose(k, 10)
        html_ = f"<article><div class=k1>Tell your friends</div><h1>{c}</h1><p>{a}</p><h2>Summary</h2><p>{b}</p><p>Thank you for reading</p><div class=k2><a href=x>More like this</a></div></article><div class=z>All rights</div>"
        return html_, "\n\n".join((c, a, "Summary", b))

    made = [page(k) for k in range(40)]
    rows = [(k, f"http://one.example/{k}", h) for k, (h, _) in enumerate(made)]
    base = page(99)[0]
    copies = [(100 + k, f"http://two.example/{k}", base.replace(" 99</p><h2>", f" {k}</p><h2>")) for k in range(12)]
    few = [(200 + k, f"http://three.example/{k}", made[k][0]) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(rows + copies + few, "page_id long, url string, html string").repartition(7)).collect()}
    for k, (_, text) in enumerate(made):
        assert got[k] == text, k
    for i, _, h in copies + few:
        assert got[i] == H.main_text(h) and got[i].startswith("Tell your friends") and got[i].endswith("More like this")


def test_a_constant_heading_in_the_varying_region_stays(spark):
    page = lambda k: f"<div class=top>Our site</div><div class=post><h1>T {k}</h1><p>first {k}</p><h2>Summary</h2><p>second {k}</p></div><div class=low><p>Contact us</p></div>"
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame([(k, f"http://one.example/{k}", page(k)) for k in range(8)], "page_id long, url string, html string")).collect()}
    assert got == {k: f"T {k}\n\nfirst {k}\n\nSummary\n\nsecond {k}" for k in range(8)}


def _letters(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(3))


@pytest.mark.parametrize("shape", ["deep", "wide", "many"])
def test_no_bound_loses_template(spark, shape, monkeypatch):
    """Template below 100 levels, between 700 differently named elements, and in 9,000 paths; once with texts that go with the pages, once by the join."""

    def page(k):
        own = f"<div><p>first {k} {'word ' * k}</p><p>second {k}</p></div>"
        if shape == "deep":  # two places that differ in name only above the text, one of them on some pages
            return "<div>" * 100 + ("<section class=a><p>Welcome</p></section>" if k % 2 else "") + f"<section class=b>{own}</section>"
        if shape == "wide":
            return "".join(f"<p class=k{_letters(j)}>" for j in range(k % 2, 700)) + f"<hr class=last>Welcome<div class=end>{own}</div>"
        return own + "".join(f"<div class=k{_letters(j)}><b>Welcome</b></div>" for j in range(9000))

    want = {k: "\n\n".join(" ".join(t.split()) for t in (f"first {k} {'word ' * k}", f"second {k}")) for k in range(12)}
    rows = spark.createDataFrame([(k, f"http://one.example/{k}", page(k)) for k in range(12)], "page_id long, url string, html string").repartition(3)
    for whole in (4096, 0):
        monkeypatch.setattr(H, "WHOLE_TEMPLATE", whole, raising=False)
        assert {r["page_id"]: r["text"] for r in H.extracted(rows).collect()} == want


def test_articles_of_loose_rules(spark):
    """Among more names than a rule holds, one article a page is no repeated item, several teasers are."""
    names = lambda k: "".join(f"<p class=k{_letters(j)}></p>" for j in range(k % 2, 700))
    one = lambda k: f"{names(k)}<article><p>Story {k}</p></article><div class=low><p>{'Other words ' * 9}{k}</p></div>"
    two = lambda k: f"{names(k)}<article>teaser {k}</article><article>teaser {k + 1}</article><div class=low><p>{'Other words ' * 9}{k}</p></div>"
    rows = [(k, f"http://one.example/{k}", one(k)) for k in range(9)] + [(100 + k, f"http://two.example/{k}", two(k)) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert all(got[k] == f"Story {k}" and got[100 + k] == f"{'Other words ' * 9}{k}" for k in range(9))
