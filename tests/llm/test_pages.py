import html
import random
import re

import pytest

from vulntide.llm import pages

PAGES = "page_id long, url string, html string, TEXT string"


def extracted(spark, rows):
    frame = spark.createDataFrame([(k, u, h, "clash") for k, (u, h) in enumerate(rows)], PAGES)
    return [r.text for r in pages.extract_main_text(frame).orderBy("page_id").collect()]


def test_articles_of_the_given_pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in pages.extract_main_text(given).collect()}
    rows = given.collect()
    assert len(out) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", row.html, re.DOTALL).group(1)
        blocks = [re.sub(r"</?b>", "", b) for b in re.split(r"</?(?:p|h1|br)>", article)]
        lines = [" ".join(html.unescape(b).split()) for b in blocks]
        want = "\n".join(line for line in lines if line)
        assert out[row.page_id].text == want and out[row.page_id].n_chars == len(want)


def site(k, body, n=6):
    draw = random.Random(k)
    prose = lambda: " ".join("".join(draw.choices("abcdefg", k=5)) for _ in range(40)) + "."
    return [(f"http://h{k}.example.org/{i}", body.format(a=prose(), b=prose(), i=i)) for i in range(n)]


def test_surroundings_go(spark):
    body = (
        "<html><head><title>t {i}</title><style>x</style></head><body class='no-sidebar'><header>Top</header>"
        "<nav><a href=/>menu</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article class='post'><header class='entry-header'><h1>Head &amp; line {i}</h1></header>"
        "<p>{a}&nbsp; <em>x</em>y<script>bad()</script></p><div class='ad-box'>Buy</div><ul><li>one<li>two</ul>"
        "<form><input>Send</form><p>{b}</p><div class='comments'><p>First!</p></div></article>"
        "<aside>side</aside><footer>&copy; foot</footer></body></html>"
    )
    for (_, page), text in zip(site(1, body), extracted(spark, site(1, body))):
        a, b = re.search(r"<p>(\w.*?)&nbsp;", page).group(1), re.search(r"<p>(\w[^<]*)</p><div class='com", page).group(1)
        head = re.search(r"line \d", page).group()
        assert text == f"Head & {head}\n{a} xy\none\ntwo\n{b}"


def test_template_marks_the_article_where_no_element_does(spark):
    body = (
        "<html><body><div id=x1><a href=/>Home</a> <a href=/n>News</a></div><div id=x2><div>Welcome to our site</div>"
        "<div id=c><h2>Title {i}</h2><p>{a}</p><p>{b}</p></div></div><div id=x3>Imprint</div></body></html>"
    )
    for (_, page), text in zip(site(2, body), extracted(spark, site(2, body))):
        a, b = re.findall(r"<p>(.*?)</p>", page)
        assert text == f"{re.search('Title [0-9]', page).group()}\n{a}\n{b}"


def test_a_box_that_the_template_fills_leaves_the_article(spark):
    body = (
        "<html><body><article class='post'><p>{a}</p><div class='x7'><p>Buy our hats.</p><p>Now <b>cheap</b>.</p></div>"
        "<div class='k2'><p>{b}</p><p>Same on every page.</p></div></article></body></html>"
    )
    for (_, page), text in zip(site(4, body), extracted(spark, site(4, body))):
        a, b = re.findall(r"<p>([a-g ]*\.)</p>", page)
        assert text == f"{a}\n{b}\nSame on every page."


def test_no_good_slot_is_dropped(spark):
    body = "<html><body><section id=a><p>{a}</p></section><section id=b><p>{b}</p><p>Part {i}</p></section></body></html>"
    rows = site(5, body)
    rows.append(("http://alone.example.org/", "<div id=c><p>intro</p><blockquote><p>long quote</p></blockquote></div>"))
    for (_, page), text in zip(rows, extracted(spark, rows)):
        assert text == "\n".join(re.findall(r"<p>(.*?)</p>", page))


def test_constant_texts_go_whatever_their_length_and_the_number_of_pages(spark):
    consent = "We and our partners keep things on your device. " * 40
    body = "<html><body><div id=x4><p>" + consent + "</p></div><div id=c><p>{a}</p></div><div id=x5>Imprint</div></body></html>"
    rows = site(6, body) + site(7, body, 2)
    for (_, page), text in zip(rows, extracted(spark, rows)):
        assert text == re.search(r"<div id=c><p>(.*?)</p>", page).group(1)


def test_equal_vectors_form_a_class(spark):
    frame = spark.createDataFrame([(k, "h", h) for k, (_, h) in enumerate(site(3, "<html><body><p>{a}</p><div><i>{b}</i></div></body></html>"))], "page_id long, host string, html string")
    (row,) = pages.templates(frame).collect()
    classes = {t.token: t["class"] for t in row.tokens}
    assert row.host_pages == 6 and len({classes[t] for t in (">html", ">html>body", ">html>body>p", ">html>body>div")}) == 1


def test_odd_pages(spark):
    rows = [
        (None, None), ("http://a.example/", ""), ("no url", "plain text only"), ("http://a.example/", "<p>cut <b>off <a hre"),
        ("http://a.example/", "<script>never closed"), ("http://a.example/", "<article>&lt;b&gt; &#65; &amp &unknown;</article>"),
        ("http://a.example/", "<article>" + "long " * 50_000 + "</article>"), ("http://a.example/", "<article><p>1 < 2 and 3 > 2</p></article>"),
    ]
    text = extracted(spark, rows + rows)
    assert text[:8] == text[8:]
    assert text[0] == text[1] == text[4] == "" and text[2] == "plain text only" and text[3].startswith("cut off")
    assert text[5] == "<b> A & &unknown;" and len(text[6]) == 249_999 and text[7] == "1 < 2 and 3 > 2"
    assert extracted(spark, []) == []


@pytest.mark.parametrize(
    "body",
    [
        '<div class="overflow-hidden"><article><p>{}</p></article></div>',
        '<article><p>before</p><p aria-hidden="false">{}</p></article>',
        '<article><p><a href="/the/hidden/valley">{}</a> and more words than the link has, by far, in this line</p></article>',
        '<div class="content has-sidebar"><p>{}</p></div>',
        '<article><h2 id="related-work">{}</h2><p>x y z</p></article>',
        '<article><section id="social-history"><p>{}</p></section></article>',
        '<article><h2 id="search">{}</h2></article>',
        '<article><p style="color: none; border: hidden">{}</p></article>',
    ],
)
def test_attributes_that_hide_nothing(spark, body):
    text = "A sentence of the article itself, long enough to count."
    (got,) = extracted(spark, [("http://one.example.org/", body.format(text))])
    assert text in got


@pytest.mark.parametrize(
    "box",
    ['<div hidden>{}</div>', '<p HIDDEN="">{}</p>', '<p style="color:red; DISPLAY : none">{}</p>', '<div id="comments"><p>{}</p></div>',
     '<div class="related-posts"><p>{}</p></div>', "<div style='display:none'>{}</div>"],
)
def test_boxes_that_are_hidden_or_beside_the_article_go(spark, box):
    page = "<article><p>Words of the article.</p>" + box.format("Not of it.") + "</article>"
    assert extracted(spark, [("http://one.example.org/", page)]) == ["Words of the article."]
