import pytest
from pyspark.sql import functions as F

from tapeline.llm import wrappers as W

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>a</a></li><li>b</li></ul></nav><!-- ad -->"
    "<div class='ad-box'>buy</div><div class=\"cookie-notice\">we use</div>{}"
    "<aside>more</aside><div id=comments><p>nice post</p></div><form><input>mail</form><footer>&copy; x</footer></body></html>"
)
ARTICLE = "<article><h1>T&eacute;st &amp; more</h1><p>one\n  two <b>three</b><br>four<p>five&nbsp;six</article>"
WANT = "Tést & more\none two three four\nfive six"


def test_article_alone_is_left():
    assert W.extract(PAGE.format(ARTICLE), None) == WANT
    assert W.extract(PAGE.format(f"<main><div class=x>{ARTICLE}</div></main>"), None) == WANT
    assert W.extract(PAGE.format("<div class=post><h2>h</h2><p>a a</p><p>b b</p><p>c c c</p></div>"), None) == "h\na a\nb b\nc c c"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("a < b", "a < b"),
    ("<p>x<p>y</b></div>z", "x\ny\nz"), ("<article><p>cut &am", "cut &am"), ("<article><p>cut <foot", "cut"),
])
def test_odd_pages(page, want):
    assert W.extract(page, None) == want


def test_wrappers_are_union_free_expressions():
    one = W.wrapper(W.parse("<body><h1>a</h1><p>x</p><p>y</p></body>"))
    two = W.wrapper(W.parse("<body><h1>a</h1><h2>s</h2><p>x</p></body>"))
    three = W.wrapper(W.parse("<body><dl><dt>k</dt><dd>v</dd><dt>k</dt><dd>v</dd></dl></body>"))
    assert W.expression(one) == "<>(<body>(<h1>(#) <p>(#)+))"
    assert W.expression(W.unify(one, two)) == "<>(<body>(<h1>(#) <h2>(#)? <p>(#)+))"
    assert W.expression(three) == "<>(<body>(<dl>((<dt>(#) <dd>(#))+)))"
    assert W.unify(one, two)[3] == one[3] + two[3]


def test_pages_of_a_host_share_a_wrapper(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)  # many rounds of alignment
    # The host's pages tell where the article is; this one alone would pick its long list.
    odd = "<html><body><div class=post><p>short</p></div><section><p>" + "link " * 50 + "</p></section></body></html>"
    usual = "<html><body><div class=post><h1>t</h1><p>" + "word " * 200 + "</p></div><section><p>{}</p></section></body></html>"
    rows = [(i, f"http://A.example.org/{i}", usual.format(i) if i else odd) for i in range(30)]
    rows += [(100, None, "<p>no host</p>"), (101, "x", None), (102, None, "<p>no host</p>")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, host string").repartition(7)
    got = {r["page_id"]: r for r in W.with_text(pages).collect()}
    assert got[0]["text"] == "short" and got[5]["text"] == "t\n" + ("word " * 200).strip()
    assert got[100]["text"] == got[102]["text"] == "no host" and got[101]["text"] == "" and got[101]["n_chars"] == 0
    assert len(got) == 33 and got[0]["host"] == "mine" and got[0]["n_chars"] == 5
    assert W.with_text(pages.limit(0)).count() == 0


def test_no_unmarked_text_is_lost(spark):
    body = "word " * 200
    rows = [  # title and lead beside a large body; a list with most of the text; a second template of the host
        *[(i, f"http://a.org/{i}", f"<article><h1>T{'x' * i}</h1><p>lead</p><div class=body>{body}</div></article>") for i in range(40)],
        *[(100 + i, f"http://b.org/{i}", f"<div class=post><p>in {'x' * i}</p><ul><li>{body}</ul><p>out</p></div>") for i in range(2)],
        (200, "http://a.org/z", f"<article><p>own</p></article><section><h2>more</h2><p>{body}</p></section>"),
        *[(300 + i, "http://c.org/", f"<p>intro</p><div><p>{body}</p></div>") for i in range(20)],  # copies tell no template
    ]
    got = {r["page_id"]: r["text"] for r in W.with_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == f"Txxx\nlead\n{body.strip()}" and got[101] == f"in x\n{body.strip()}\nout"
    assert got[200] == f"own\nmore\n{body.strip()}" and got[319] == f"intro\n{body.strip()}"


def test_shared_slots_beside_the_article_go(spark):
    page = "<div><p>" + "text {} " * 40 + "</p></div><section><p>join us</p></section><h5>{}</h5>"
    rows = [(i, f"http://a.org/{i}", page.replace("{}", "x" * i) if i else page.replace("join us", "join</p><p>me")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in W.with_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "join" not in got[7] and got[7].endswith("\nxxxxxxx") and "\njoin\nme\n" in got[0]


def test_given_pages_hold_no_markup(spark, sf_dir):
    for r in W.query(spark, sf_dir).collect():
        assert r["text"] and r["n_chars"] == len(r["text"]) and "<" not in r["text"] and "©" not in r["text"]


@pytest.mark.parametrize("mark", [
    '<body class="has-sidebar">{}</body>', '<div class="right-sidebar-layout">{}</div>', '<div class="content-with-sidebar">{}</div>',
    '<div class="no-banner">{}</div>', '<div class="post search-result">{}</div>', '<body class="sidebar menu">{}</body>',
    '<main class="search">{}</main>', '<div class="sidebar">{}</div>',
])
def test_class_names_do_not_cost_a_page(spark, mark):
    rows = [(i, f"http://a.org/{i}", mark.replace("{}", f"<p>text {'x' * i} of this page</p>")) for i in range(1, 7)]
    got = W.with_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"text {'x' * r['page_id']} of this page" for r in got)


def test_marks_inside_an_article():
    inner = ('<p class="alert">a</p><div class="related-work">b</div><div class="notice">c</div><h2 class="menu">d</h2>'
             '<div class="comments">gone</div><div class="post ad">gone</div><header>e</header>')
    assert W.extract(f"<article>{inner}</article>", None) == "a\nb\nc\nd\ne"
    outside = ('<div class="site-footer">x</div><div class="cookie-banner bottom">x</div><div id="comments-area">x</div>'
               '<div class="left sidebar">x</div><div role="complementary">x</div><div class="ad_slot_3">x</div>')
    assert W.extract(f"{outside}<article><p>t</p></article>", None) == "t"


def test_an_open_quote_ends_with_its_tag():
    assert W.extract('<p title="open>text</p><p>more', None) == "text\nmore"


@pytest.mark.parametrize("deep", [99, 100, 101, 1_500, 5_000])
def test_deep_pages(deep):
    page = "<div>" * deep + "<p>in</p><div class=ad>x</div><p>side" + "</div>" * deep + "<p>out</p>"
    assert W.extract(page, None) == "in\nside\nout"
    W.expression(W.unify(W.wrapper(W.parse(page)), W.wrapper(W.parse("<p>x</p>" + page))))


def test_very_many_children(spark):
    import random

    rng = random.Random(1)
    tags = ["section", "figure", "ul", "div", "p", "h3"]
    rows = [
        (i, "http://a.org/", "<body>" + "".join(f"<{t}>{i}.{k}</{t}>" for k, t in enumerate(rng.choices(tags, k=20_000))) + "</body>")
        for i in range(3)
    ]
    got = W.with_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_path", F.lit("mine"))).collect()
    assert all(r["text"].split("\n") == [f"{r['page_id']}.{k}" for k in range(20_000)] for r in got)


def test_matches_are_a_longest_common_run():
    import random

    rng = random.Random(2)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        return best[-1][-1]

    for _ in range(300):
        a, b = (rng.choices("abc", k=rng.randint(0, 12)) for _ in "ab")
        got = W.matches(a, b)
        assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def plain_text(page):
    """Text of all elements that no tag name or whole class name of the fixture marks."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.run, self.skip = [], "", []

        def cut(self):
            if self.run.strip():
                self.out.append(" ".join(self.run.split()))
            self.run = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "a"):
                return
            self.cut()
            if self.skip or tag in ("nav", "footer") or dict(attrs).get("class") == "ad":
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if tag in ("b", "a"):
                return
            self.cut()
            if self.skip:
                self.skip.pop()

        def handle_data(self, data):
            if not self.skip:
                self.run += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.cut()
    return "\n".join(reader.out)


def test_random_pages_equal_a_plain_reader(spark):
    import random

    rng = random.Random(7)

    def element(depth):
        tag = rng.choice(["div", "section", "p", "h2", "nav", "div class=ad", "footer", "ul"])
        name = tag.split()[0]
        if name in ("p", "h2") or depth == 0:
            inner = f"w{rng.random():.6f} <b>b</b> &amp; x" if name != "ul" else f"<li>i{rng.random():.6f}</li>"
        else:
            inner = "".join(element(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{tag}>{inner}</{name}>"

    rows = [(i, f"http://h{i % 3}.org/{i}", "<body><article>" + element(3) + "<p>end</p></article></body>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in W.with_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        assert got[i] == plain_text(page), page
