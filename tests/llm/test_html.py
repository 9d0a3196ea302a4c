"""Trees from bad markup, rules, and templates counted per site."""

import pytest

from sparsight.llm import html_text as X

PAGES = {
    "<article><h1>A &amp; B</h1><p><b>one<br>two<p>three <i>x</i>y</p><ul><li>l1<li>l2</ul></article>": "A & B\none two\nthree xy\nl1\nl2",
    "<nav>menu</nav><main><p>a &lt;b&gt; &#233;&copy</p></main><footer>f": "a <b> é©",
    "<body><header>Site</header><div id=menu>m</div><p>Hello<p>World<div class='user-comments'><p>c</p></div><form>x</form>": "Hello\nWorld",
    "<article><header><h1>T</h1></header><p>x</p><div class='share-box'>s</div><aside>a</aside></article>": "T\nx",
    "<article class=comment>long comment text here, longer than it all</article><article><p>short</article>": "short",
    "<div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div><p>t": "t",
    "<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>text <a>link</a> more</p>": "text link more",
    "<script>var a = '<p>no</p>';</script><style>p{}</style><noscript>n</noscript><p>yes": "yes",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "a <!-- <p>no</p> --> b <![CDATA[x]]> c": "a b c",
    "<p>cut off in a ta<b": "cut off in a ta",
    "<p>  white \n\t space  </p><pre>kept\nin one</pre>": "white space\nkept in one",
    "": "", "no markup": "no markup", "<": "<", "<!": "", "<!DOCTYPE": "", "&amp": "&",
    "<div>" * 3000 + "deep": "deep",
    "</p></div></article>x": "x",
}


@pytest.mark.parametrize("html", PAGES, ids=range(len(PAGES)))
def test_text_of_a_page(html):
    assert X.main_text(html) == PAGES[html]


def test_names_alone_are_no_noise_in_an_article():
    parts = [
        "<section id='discussion'><h2 id='search'>We discuss</h2><p>What was found.</p></section>",
        "<section id='related-work'><p>Others found less.</p></section><div class='notice'>Mind the wet paint.</div>",
        "<div class='alert'><p>It burns.</p></div><p class='side'>On the side.</p><div class='overlay'>Laid over it.</div>",
    ]
    chrome = (
        "<div class='share-box'>Share</div><div class='related'><a>One text</a> <a>Another text</a></div>"
        "<div class='newsletter'>Get our letter <input name=mail></div>"
    )
    kept = "We discuss\nWhat was found.\nOthers found less.\nMind the wet paint.\nIt burns.\nOn the side.\nLaid over it."
    assert X.main_text(f"<article>{''.join(parts)}{chrome}</article>") == kept
    assert X.main_text(f"<body><p>{'Outside of an article. ' * 9}</p>{parts[2]}") == ("Outside of an article. " * 9).strip()


ARTICLES = {
    "<div><article><p>Part one</p></article><nav>n</nav><article><p>Part two, longer</p></article></div>": "Part one\nPart two, longer",
    "<nav>n</nav><main><h1>Title</h1><p>Lead</p><article><p>Body one</p></article><article><p>2</p></article><aside>a</aside></main><p>x":
        "Title\nLead\nBody one\n2",
    "<main><p>m</p></main><article><p>The body</p></article>": "The body",
    "<article><p>Body of the page</p></article><section class=related><article><p>A card</p></article></section>": "Body of the page",
    "<main><section class=related><article>c</article></section><article>Body of it<article class=b>nested</article></article></main>":
        "Body of it\nnested",
}


@pytest.mark.parametrize("html", ARTICLES, ids=range(len(ARTICLES)))
def test_all_articles_and_what_the_main_has_around_them(html):
    assert X.main_text(html) == ARTICLES[html]


def site(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, template string")


def test_templates_go_and_copies_stay(spark):
    box = "<div class=c{}><span>Try our daily letter</span></div>"
    story = "<div><p>One story, told the same on every copy of it, at quite some length.</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{box.format(i)}<div><p>Page {i} says something of its own, {i}.</p></div>{box.format(0)}") for i in range(8)]
    rows += [(100 + i, f"https://USER@b.org:80/{i}", f"<body>{story}") for i in range(9)]
    rows += [(200, "http://c.org", f"<body>{box.format(1)}<p>Another site.</p>"), (300, None, None), (301, "http://a.org/9", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in X.extract_text(site(spark, rows)).collect()}
    joined = X.extract_text(site(spark, rows), most_sent=0)
    assert {r.page_id: (r.text, r.n_chars) for r in joined.collect()} == got
    for i in range(8):
        assert got[i][0] == f"Page {i} says something of its own, {i}."
    for i in range(9):
        assert got[100 + i][0] == "One story, told the same on every copy of it, at quite some length."
    assert got[200] == ("Try our daily letter\nAnother site.", 34)
    assert got[300] == ("", 0) and got[301] == ("", 0)


def test_an_articles_paragraphs_are_no_template(spark):
    rows = [(i, "http://a.org/", f"<article><p>Told often.</p><p>Own {i}</p><div>Follow us</div></article>") for i in range(9)]
    got = [r.text for r in X.extract_text(site(spark, [*rows, *rows[:2]])).collect()]
    assert sorted(got) == sorted(f"Told often.\nOwn {i}" for i in [*range(9), 0, 1])


def test_copies_versions_and_small_shares_are_no_template(spark):
    shared = [f"Paragraph {k} of a story that stands on several pages, told at length." for k in range(4)]
    lists = "<ul><li>Step one</li><li>Step two</li></ul><div><b>A boxed remark</b></div>"

    def page(i, own):
        body = "".join(f"<p>{x}</p>" for x in own)
        return f"<body><div><span>Menu of the site</span></div><div>{body}</div><p>Printed on day {i}</p></body>"

    rows = [(i, "http://v.org/", page(i, [*shared, f"Edit {i}."])) for i in range(6)]
    rows += [(100 + i, "http://v.org/", page(i, [f"Page {i} is about number {i} and about nothing else on earth."])) for i in range(20)]
    rows += [(200 + i, "http://w.org/", page(i, [*shared, f"Edit {i}."])) for i in range(6)]
    rows += [(300 + i, "http://l.org/", page(i, [f"Text {i} that is like no other text of its host.", "Read more below." if i < 5 else f"{i}"])) for i in range(300)]
    rows += [(900 + i, "http://t.org/", f"<article><p>Own {i}.</p>{lists if i < 6 else ''}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in X.extract_text(site(spark, rows)).collect()}
    joined = {r.page_id: r.text for r in X.extract_text(site(spark, rows), most_sent=0).collect()}
    assert joined == got
    for i in range(6):
        assert got[i] == "\n".join([*shared, f"Edit {i}.", f"Printed on day {i}"])
        assert got[200 + i].split("\n")[1:] == [*shared, f"Edit {i}.", f"Printed on day {i}"]  # the menu can't be told from it
        assert got[900 + i] == f"Own {i}.\nStep one\nStep two\nA boxed remark"
    for i in range(20):
        assert got[100 + i] == f"Page {i} is about number {i} and about nothing else on earth.\nPrinted on day {i}"
    for i in range(5):
        assert "Read more below." in got[300 + i]


def test_hosts_and_no_pages(spark):
    urls = {"http://A.org/x": "a.org", "//b.org?x": "b.org", "https://u:p@c.org:8080/": "c.org", "mail": "", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.h for r in rows.select("url", X.host_of(rows.url).alias("h")).collect()} == urls
    assert X.extract_text(site(spark, [])).count() == 0
