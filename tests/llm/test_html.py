"""Main text of pages against the text the pages were made from."""

import pytest

from quarry.llm import html
from quarry.llm.html import Page, extract, host_of, main_text

SCHEMA = "page_id long, url string, html string"
NONE = (frozenset(), frozenset(), False)


def page(k, paragraphs, article=True):
    body = "".join(f"<p class='x{k}'>{p}</p>" for p in paragraphs)
    main = f"<article><h1>Title {k}</h1>{body}<div class=share-buttons>Share this</div><section id='comments'><p>Nice {k}</p></section></article>" if article else f"<div id=content{k}><h1>Title {k}</h1>{body}</div>"
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body><header><p>Site</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>"
        f"<div class='cookie-notice'>We use cookies {k}</div><!-- <p>no</p> -->{main}<aside><p>Aside {k}</p></aside><form><p>Name<input></p></form><div class=tagline>Always the same words</div><footer><p>&copy; us {k}</p></footer></body></html>"
    )


def text(k, paragraphs):
    return "\n\n".join([f"Title {k}", *paragraphs])


def rows(article, n=12, host="a.example.com"):
    return [(k, f"https://{host}/p/{k}?q=1", page(k, [f"First {k} words.", f"Second {k}."][: 1 + k % 2], article)) for k in range(n)]


@pytest.mark.parametrize("article", [True, False])
def test_templates(spark, article):
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows(article), SCHEMA)).collect()}
    for k in range(12):
        assert got[k].text == text(k, [f"First {k} words.", f"Second {k}."][: 1 + k % 2])
        assert got[k].n_chars == len(got[k].text) and got[k].url.endswith(f"{k}?q=1")


def test_hosts_of_one_page_share_a_template(spark):
    pages = [(h, f"https://h{h}.example.org/", page(h, [f"First {h} words."])) for h in range(12)] + [(90, None, page(1, ["x"])), (91, "nonsense", page(1, ["y"]))]
    assert all(r.text.startswith("Title") and "Share" not in r.text and "Nice" not in r.text and "cookies" not in r.text for r in main_text(spark.createDataFrame(pages, SCHEMA)).collect())


def test_shuffled_templates_agree(spark, monkeypatch):
    df = spark.createDataFrame(rows(True) + rows(False, 9, "b.example.com"), SCHEMA)
    one = sorted(map(tuple, main_text(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, main_text(df).collect())) == one


def test_awkward(spark):
    pages = [(1, "http://x.y/", None), (2, "http://x.y/", ""), (3, None, "plain  text\n\tonly &lt;b&gt;"), (4, "http://x.y/", "<p>one<br>two<p>three"), (None, "http://x.y/", "<article>&amp;amp; caf&eacute;&#33;</article>"), (4, "http://x.y/", "<p>one<br>two<p>three"), (5, "http://x.y/", "<div><p " + "x" * 50_000), (6, "http://x.y/", "<article>" + "<p>word word</p>" * 20_000)]
    got = [(r.page_id, r.text) for r in main_text(spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 as text", "2 as path", "3 as group")).collect()]
    told = dict(got)
    assert len(got) == 8 and told[1] == told[2] == "" and told[3] == "plain text only <b>" and told[4] == "one two\n\nthree" and told[None] == "&amp; café!"
    assert told[6] == "\n\n".join(["word word"] * 20_000)
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><p>a <b>b<i>c</b> d</p>e</article>f", "a bc d\n\ne"), ("<article><ul><li>a<li>b</ul></article>", "a\n\nb"), ("<main>x<article>y</article></main>z", "x\n\ny"), ("<article>a<nav>n</nav><aside>s</aside>b</article>", "a\n\nb"),
        ("<article><div hidden>h</div><p style='display: none'>i</p>v</article>", "v"), ("<article><p title='a>b'>t</p></article>", "t"), ("<article>a<script>if (1 < 2) '</article>'</script>b</article>", "a\n\nb"), ("<article><p>1 < 2 & 3</article>", "1 < 2 & 3"),
        ("<ARTICLE><P>a</P></ARTICLE>", "a"), ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"), ("<div role='main'>m</div><p>o</p>", "m"), ("<article><header><h1>t</h1></header>b</article><header>h</header>", "t\n\nb"),
        ("<article><p><b>one<br><p>two</p></article>", "one\n\ntwo"), ("<article></p></div>a</span></article>", "a"), ("<article><![CDATA[x]]>a<!-- b --", "a"), ("<article>a<!--", "a"),
    ],
)
def test_extract(source, want):
    assert extract(source, *NONE) == want


def test_host():
    assert [host_of(u) for u in ("HTTP://u@A.b:8/x", "//a/b", None, "https://a.b?x=http://c")] == ["a.b:8", "", "", "a.b"]


def test_page_paths():
    assert Page("<html><body><div class='a b1' id=c2><p>x").opened == ["/html", "/html/body", "/html/body/div.a b0.c0", "/html/body/div.a b0.c0/p"]


@pytest.mark.parametrize("own", ["https://a.example.com/{}", "https://h{}.example.com/"])
def test_template_inside_the_article(spark, own):
    """Boilerplate without a telling name, on one host and on hosts of one page; a second layout on a fifth of the pages."""

    def source(k):
        links = "".join(f"<li><a href=/{k}{i}>Other story {k} {i}</a>" for i in range(3))
        if k % 5 == 0:
            return f"<main><div class=u><h1><a href=/{k}>Title {k}</a></h1><p>Body {k}.</p><div class=z>Ask us by letter</div></div></main>"
        return f"<article><h1>Title {k}</h1><div class=q7>All words here are <b>ours</b></div><p>Body {k}, <a href=/x>with a link</a>.</p><ul class=q8>{links}</ul><ul><li>point {k}</ul></article>"

    got = {r.page_id: r.text for r in main_text(spark.createDataFrame([(k, own.format(k), source(k)) for k in range(50)], SCHEMA)).collect()}
    for k in range(50):
        assert got[k] == (f"Title {k}\n\nBody {k}." if k % 5 == 0 else f"Title {k}\n\nBody {k}, with a link.\n\npoint {k}")


def test_repeated_pages_keep_their_text(spark):
    got = main_text(spark.createDataFrame([(k, f"https://a.example.com/{k}", "<article><h1>Same</h1><p>text</p></article>") for k in range(20)], SCHEMA)).collect()
    assert [r.text for r in got] == ["Same\n\ntext"] * 20


@pytest.mark.parametrize(
    "source, want",
    [
        ("<body><nav class='main-navigation'><a>n</a></nav><div class=text><p>whole text</p></div>", "whole text"), ("<div class='main-menu'><a>n</a></div><div class=text>t</div>", "t"), ("<div class='main-menu'><a>n</a></div><article>t</article>", "t"),
        ("<div id=main>m</div><p>o</p>", "m"), ("<div itemprop='articleBody'>m</div><p>o</p>", "m"), ("<div class='main menu'>n</div><p>o</p>", "o"), ("<div id=main class='has-sidebar'>m</div>", "m"), ("<main class='with-sidebar'>m</main><p>o</p>", "m"),
        ("<article class='post comments-open'>m</article><p>o</p>", "m"), ("<article><nav>n</nav></article><p>o</p>", "o"), ("<nav><div role=main>n</div></nav><p>o</p>", "o"),
    ],
)
def test_main_is_named_as_a_whole(source, want):
    assert extract(source, *NONE) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<h2 id='related-work'>Related work</h2><p>a</p>", "Related work\n\na"), ("<section id='legal-framework'><p>law</p></section>", "law"), ("<div class='search-results'>found</div>", "found"), ("<h2 id=comments>c</h2>", "c"), ("<div class='alert'>take care</div>", "take care"),
        ("<pre><span class='token comment'># c</span> x</pre>", "# c x"), ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then</p>", "if x=1 then"), ("<p>a</p><svg><title>i</title><defs><g/></defs><path d='M0'/><text>axis</text></svg><p>b</p>", "a\n\naxis\n\nb"),
        ("a<div class='related posts'>r</div><section id=comments>c</section>b", "a\n\nb"), ("a<div role=navigation>n</div>b", "a\n\nb"),
    ],
)
def test_names_inside_an_article(source, want):
    assert extract(f"<article>{source}</article>", *NONE) == want


def deduced(spark, pages):
    found = html.templates(spark.createDataFrame(pages, SCHEMA)).collect()
    return {r.group: (frozenset(r.template), frozenset(r.kept), frozenset(r.links)) for r in found}


def test_the_template_makes_the_result(spark):
    """Without article or main, paragraphs with telling names are text, and constant ones without are not: by the host's template alone."""

    def source(k):
        return f"<body><div class=w><div class=t9>Printed in our own works</div><h1>Title {k}</h1><p class='body-law'>Clause {k}.</p><p class=x>More {k}.</p><div class=e3>The end of the page</div></div></body>"

    for n in (2, 7, 8, 20):
        pages = [(k, f"https://a.example.com/{k}", source(k)) for k in range(n)]
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
        assert got == {k: f"Title {k}\n\nClause {k}.\n\nMore {k}." for k in range(n)}
        told = deduced(spark, pages)["a.example.com"]
        assert extract(source(0), *told) == got[0] != extract(source(0), *NONE)


@pytest.mark.parametrize("n", [2, 3, 7, 8, 30])
def test_every_number_of_pages_is_treated_alike(spark, n):
    """Inside an article too: from two different pages on, what never changes is the template's; named paragraphs stay."""
    pages = [(k, f"https://a.example.com/{k}", f"<article><h1>Title {k}</h1><p class='legal'>Law {k}.</p><div class=k1>Same words</div></article>") for k in range(n)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {k: f"Title {k}\n\nLaw {k}." for k in range(n)}


def test_two_copies_are_no_template(spark):
    same = "<article><h1>Same</h1><p>text</p></article>"
    pages = [(1, "https://a.example.com/1", same), (2, "https://a.example.com/2", same), (3, "https://b.example.com/", "<article><h1>Other</h1><p>words</p></article>")]
    assert sorted((r.page_id, r.text) for r in main_text(spark.createDataFrame(pages, SCHEMA)).collect()) == [(1, "Same\n\ntext"), (2, "Same\n\ntext"), (3, "Other\n\nwords")]


def test_classes_equal_brute_force(spark):
    """Tokens with equal occurrence vectors are one class; classes of several tokens, or on all pages, nest into the template."""

    def source(k):
        extra = "".join(f"<section class=s><h2>Part {k} {i}</h2><p>Text {k} {i}</p></section>" for i in range(k % 3))
        return f"<body><div class=top><h1>T {k}</h1>{extra}</div>{'<table><tr><td>cell ' + str(k) + '</table>' if k % 2 else ''}<em>x{k}</em><div class=end{chr(97 + k)}>rare {k}</div></body>"

    pages = [(k, f"https://a.example.com/{k}", source(k)) for k in range(9)]
    vectors = {}
    for k, _, h in pages:
        for path in ["", *Page(h).opened]:
            vectors.setdefault(path, [0] * 9)[k] += 1
    vectors[""] = [1] * 9
    n_pages = {p: sum(x > 0 for x in v) for p, v in vectors.items()}
    frequent = {p for p, n in n_pages.items() if n >= 2}
    classes = {}
    for p in frequent:
        classes.setdefault(tuple(vectors[p]), set()).add(p)
    large = {p for c in classes.values() for p in c if len(c) > 1 or n_pages[p] == 9}
    nested = {p for p in large if all(p[:i] in large for i, c in enumerate(p) if c == "/" and i)} | {""}
    template, kept, links = deduced(spark, pages)["a.example.com"]
    assert template == nested and kept == nested and not links
    assert any("section" in p for p in nested) and any("td" in p for p in nested) and not any("div.end" in p for p in nested)
