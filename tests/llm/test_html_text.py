import random
import re
import time
from html import unescape
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import html_text

PAGES = "page_id long, url string, html string"


NONE = np.empty(0, np.uint64)


def text(html):
    return html_text.main_text(html, NONE)[0]


def test_article_alone():
    page = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a>menu</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <article><h1>Title &amp; more</h1><p>One <b>bo</b>ld<br>two&nbsp;three<p>Four &lt;five&gt; &#233;&#x4e2d;
    <ul><li>a<li>b</ul><form><input value=x>sign</form><aside>side</aside><div class="share">share</div><pre>x
      y</pre><table><tr><td>1<td>2</table><section id="comments"><p>first!</p></section></article>
    <div class="sidebar">s</div><footer>&copy; us</footer></body></html>"""
    assert text(page) == "Title & more One bold two three Four <five> é中 a b x y 1 2"


def test_without_article_and_broken():
    assert text("<body><div id=cookie-notice>ok?</div><div><p>Hello <i>you</i></p></div><div role=search>q</div>") == "Hello you"
    assert text("") == ""
    assert text("just text & more") == "just text & more"
    assert text("<p>a < b and <b>c</b> <p") == "a < b and c"
    assert text("<article><p>open <b>bold") == "open bold"
    assert text("<article><p>x</article></div></p>tail") == "x"
    assert text("<main><article><p>a</p></article><article class=comment>no</article></main>") == "a"
    assert text('<article><header class="entry-header"><h1>T</h1><span>by me</span></header><p>x</p></article>') == "T x"


def site(n, host="h.example.com", body=lambda i: f"<div><p>story number {i} is long</p></div>"):
    return [(i, f"https://{host}/{i}", f"<body><div class=x1><span>Our site</span></div>{body(i)}<div class=x2>Call us</div></body>") for i in range(n)]


def test_recurring_subtrees_go(spark):
    df = spark.createDataFrame(site(12) + [(100, "https://other.example.com/1", site(1)[0][2])], PAGES)
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    assert all(got[i] == f"story number {i} is long" for i in range(12))
    assert got[100] == "Our site story number 0 is long Call us"


def test_copies_of_one_page_are_no_template(spark):
    df = spark.createDataFrame([(i, f"http://h.example.com/{i}", site(1)[0][2]) for i in range(30)], PAGES)
    assert {r.text for r in html_text.extract_main_text(df).collect()} == {"Our site story number 0 is long Call us"}


def test_prose_in_articles_goes_only_where_half_of_the_host_has_it(spark):
    def page(i, host, quoted):
        quote = "<p>The same opening line.</p><ul><li>1 tsp salt</li></ul>" if quoted else ""
        return (i, f"http://{host}/{i}", f"<body><div>Our site</div><article>{quote}<p>Subscribe to our letters</p><div><p>Body {i} of {host}</p></div><div>Tags here</div></article></body>")

    rows = [page(i, "h.example.com", i % 3 == 0) for i in range(80)] + [page(100 + i, "small.example.com", False) for i in range(9)]
    got = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: got[i].text for i in range(80)} == {i: ("The same opening line. 1 tsp salt " if i % 3 == 0 else "") + f"Body {i} of h.example.com" for i in range(80)}
    assert got[100].text == "Subscribe to our letters Body 100 of small.example.com Tags here"
    assert all(got[i].template_chars == len("Our site" + "Subscribe to our letters" + "Tags here") for i in range(80))
    assert got[100].template_chars == 0


def test_near_copies_make_no_template(spark):
    copies = [(i, f"http://h.example.com/{i}", f"<article><h1>Same</h1><p>{'A long paragraph. ' * 9}</p><p>Second of them, rather long too</p><p>edit {i}</p></article>") for i in range(40)]
    assert {r.text for r in html_text.extract_main_text(spark.createDataFrame(copies, PAGES)).select("text").distinct().collect()} == {f"Same {'A long paragraph. ' * 9}Second of them, rather long too edit {i}" for i in range(40)}


def test_names_are_whole_and_headings_keep_their_anchors():
    assert text('<div class="elementor-widget-theme-post-content"><h2 id="related-work">Related</h2><p id="share">x</p></div>') == "Related x"
    assert text('<article><p class="notice">Kept</p><div class="related-posts">gone</div><div class="ad-slot">gone</div></article>') == "Kept"
    assert text('<p class="notice">gone</p><p>kept</p><div class="site-header">gone</div>') == "kept"
    # Cards beside a body without an article tag don't take its place.
    body = " ".join(["The body of this page"] * 12)
    assert text(f"<div>{body}</div><article>card</article>") == f"{body} card"
    assert text("<div>Left over</div><article>card</article>") == "card"


def test_entities_are_decoded_by_text_node():
    assert text("<p>&<b>amp;</b> &amp;lt; &eacute;&#x41;") == "&amp; &lt; éA"


@pytest.mark.parametrize("unit", ["<div>|</span>", "<b>|<div></div>", "<i>|</b>", "<p><b>|<p>"])
def test_stray_tags_take_linear_time(unit):
    opening, closing = unit.split("|")
    times = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        html_text.main_text(opening * n + closing * n + "end", NONE)
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * 4 * max(times[0], 0.02)


def known_sites():
    """Pages of two hosts and the main text of each, known since it was put there."""
    r = random.Random(7)
    say = lambda n: " ".join(r.choice("sun moon river stone light wind tree house road cloud".split()) + str(r.randrange(1000)) for _ in range(n))
    rows = []
    for host, n in (("one.example.com", 60), ("two.example.com", 25)):
        menus = [f"<div class=m{k}><a href=/{k}>{say(1)}</a> <a href=/x>{say(1)}</a></div>" for k in range(4)]
        tail = f"<div class=z><p>{say(12)}</p><p>{say(8)}</p></div>"
        notice = f"<div class=q><p>{say(10)}</p></div>"
        for i in range(n):
            title, body, items = say(3), [say(20) for _ in range(3)], [say(2) for _ in range(2)]
            related = "".join(f"<li><a href=/r{k}>{say(2)}</a></li>" for k in range(3))
            inner = f"<h1>{title}</h1>{notice if i % 5 else ''}" + "".join(f"<p>{b}</p>" for b in body) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
            whole = f"<article>{inner}</article>" if i % 2 else f"<div class=text>{inner}</div>"
            page = f"<html><head><title>{title}</title></head><body>{menus[i % 4]}{'</span>' * (i % 3)}{whole}<nav><ul>{related}</ul></nav>{tail}<div class=ad>{say(4)}</div></body>"
            rows.append((len(rows), f"https://{host}/p{i}", page, " ".join([title, *body, *items])))
    return rows


def test_known_main_texts(spark):
    rows = known_sites()
    df = spark.createDataFrame([x[:3] for x in rows], PAGES).repartition(5)
    want = {x[0]: x[3] for x in rows}
    for most in (html_text.BROADCAST_TEMPLATES, 0):
        found = html_text.extract_main_text(df, broadcast_templates=most).collect()
        assert {r.page_id: r.text for r in found} == want
        # Each page loses its tail and its menu to templates.
        assert all(r.template_chars > 100 for r in found)


def test_templates_match_brute_force(spark):
    rows = [x[:3] for x in known_sites()] + site(3, "b.example.com") + site(30, "c.example.com", lambda i: f"<div>same</div><p>{'long text ' * 4}{i}</p>")
    seen, sizes = {}, {}
    hosts = {h: i for i, h in enumerate(sorted({u.split("/")[2] for _, u, _ in rows}))}
    pages = []
    for _, url, html in rows:
        page, host = html_text.Page(html), hosts[url.split("/")[2]]
        _, keys, side = html_text.page_places(page, host)
        sizes.setdefault(host, set()).add(page.look())
        for k, s in zip(keys.tolist(), side.tolist(), strict=True):
            seen.setdefault(k, (host, s, set()))[2].add(page.look())
        pages.append((host, page.look() - (1 << 64) if page.look() >> 63 else page.look(), *(keys[c].view(np.int64).tolist() for c in (side, ~side))))
    least = {True: (html_text.SIDE_PAGES, html_text.SIDE_SHARE), False: (html_text.BODY_PAGES, html_text.BODY_SHARE)}
    want = {k for k, (host, s, looks) in seen.items() if len(looks) >= max(least[s][0], least[s][1] * len(sizes[host]))}
    df = spark.createDataFrame(pages, "host long, look long, side array<long>, body array<long>")
    assert len(want) > 8
    assert {r.place & (1 << 64) - 1 for r in html_text.site_templates(df).collect()} == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/pages.parquet").exists(), reason="needs the driver's tables")
def test_pages_of_the_tables(spark):
    """Whole pages, against the article as a plain reading of its markup gives it."""
    got = html_text.extract_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    html = {r.page_id: r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}

    def article(page):
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
        inside = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: " " if m[2].lower() in ("p", "h1", "h2", "br", "li", "ul", "div") else "", inside)
        return " ".join(unescape(inside).split())

    rows = got.collect()
    assert {r.page_id: r.text for r in rows} == {k: article(v) for k, v in html.items()}


def test_awkward(spark):
    rows = [(1, None, None), (None, "x", "<p>a</p>"), (2, "", ""), (2, "", ""), (3, "http://h/", "<p>" + "long &amp; " * 20_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("row", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted(((r.page_id or -1, r.url, r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()), key=str)
    assert len(got) == 5
    assert all(n == len(t) for _, _, t, n in got)
    assert [t for i, _, t, _ in got if i == 3] == [("long & " * 20_000).strip()]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_host(spark):
    urls = ["http://www.A.example.com:80/x", "//u@b.example.com/y?z", "c.example.com/x", None, "https://d.example.com"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(html_text.host_of("u")).collect()] == ["a.example.com", "b.example.com", "", "", "d.example.com"]
