import pytest

from paperloom.llm import html_text as H

TREE = H.train()
LONG = "A paragraph with quite a few words, of the kind that articles have, and no links at all in it."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>&lt;b&gt; &amp; &eacute;&#x41;</p>", "<b> & éA"),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}<p><b>Un\n closed<br>twice</article><footer>&copy; x</footer>", f"Title\n{LONG}\nUn closed twice"),
        (f"<html class='has-sidebar'><body class=home><main><div class='article-header'><h1>T</h1></div><p>{LONG}</p><aside>More</aside><div id=comments><p>I think {LONG}</p></div></main></body></html>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><script>if (a<b) x='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><form><p>Your name</p></form><p>end</p></article>", f"{LONG}\nend"),
        (f"<header><p>Site name and slogan</p></header><div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p><div class=adBanner>Buy</div></article>", LONG),
        ("<article><p>a<p hidden>b<p style='display:none'>c<p>d</article>", "a\nd"),
        ("<article>1 &lt; 2 < 3 <p title='a>b'>x</p></article>", "1 < 2 < 3\nx"),
        ("<article><p>open <em>tag", "open tag"),
    ],
)
def test_main_text(html, text):
    assert H.main_text(html, TREE) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article style='overflow:hidden'><p>{LONG}</p></article>", LONG),
        (f"<article><div class='overflow-hidden'><p>{LONG}</p></div><p class=hidden-print>end</p></article>", f"{LONG}\nend"),
        ("<article><p title='the hidden part'>a<p title='display:none'>b<p data-hidden>c<p aria-hidden=false>d<p style='visibility:hidden;--display:none'>e</article>", "a\nb\nc\nd\ne"),
        ("<article><p title='aria-hidden=true'>a<p data-x='y'hidden>b<p HIDDEN=''>c<p aria-hidden='true'>d<p style='color:red; DISPLAY : none !important'>e<p class=x hidden>f<p>g</article>", "a\ng"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><object data=a.pdf><p>Read the file</p></object><p>end</article>", "let x=1 be\nRead the file\nend"),
    ],
)
def test_only_hidden_elements_are_hidden(html, text):
    assert H.main_text(html, TREE) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article><p class='promoted'>{LONG}<div class='ad-hoc-queries'>{LONG}</div><div class='share-price'>Up</div><section class='notification-systems'>Short</section></article>", f"{LONG}\n{LONG}\nUp\nShort"),
        (f"<div class=top><a href=/>Home</a></div><div><a href=/n>News</a></div><div>All the news</div><div><a href=/s>Sport</a></div><h1>A title of words</h1><div>{LONG}</div><div>{LONG} {LONG}</div><div>Short one</div><div>{LONG}</div>", f"A title of words\n{LONG}\n{LONG} {LONG}\nShort one\n{LONG}"),
        (f"<div>cheap deals</div><main><h1>T</h1><p>{LONG}</p><section class='user-feedback'><p>{LONG}</p></section></main><div>more deals</div>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>And two</a><li><a href=3>Three</a></ul></article>", LONG),
        (f"<article><p>{LONG}</p><p><a href=1>A link</a></p><p>{LONG}</p></article>", f"{LONG}\nA link\n{LONG}"),
        ("<article><p title=don't>a<p title = \"b>c\" class='x'>d</></ x><p>e</article>", "a\nd\ne"),
        ("<article><p>a &#65; &#x41; &#99999999999; &#" + "9" * 5000 + "; &#" + "0" * 5000 + "65;</article>", "a A A \ufffd \ufffd A"),
        ("<article><p>a<p title='never closed>b<p>c</article>", "a"),
        ("<article><p>a<!-- b <p>c", "a"),
    ],
)
def test_counts_and_densities_decide_and_damaged_tags_are_read(html, text):
    assert H.main_text(html, TREE) == text


def splits(tree):
    return set() if isinstance(tree, int) else {H.FEATURES[tree[0]]} | splits(tree[2]) | splits(tree[3])


def test_the_tree_looks_at_neighbours():
    assert {"words", "link density"} <= splits(TREE)
    assert splits(TREE) & {"words before", "words after"} and splits(TREE) & {"link density before", "link density after"}


@pytest.mark.parametrize("piece", ["<a ", "<", "</", "<aaa", "<p x='", '<p x="', "<b>", "<b></i>", "<!--", "<script>", "&#1", "&amp", "<p =", "<div class=a ", " = ", "<p a  ", "</a <"])
def test_time_follows_length(piece):
    import time

    began = time.process_time()
    H.main_text("<article>text " + piece * (1_000_000 // len(piece)), TREE)
    assert time.process_time() - began < 6


def test_query_on_pages(spark, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in H.op5(pages).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_defined_results(spark):
    frame = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", f"<article><p>{'word ' * 50_000}</p></article>", "x")], "page_id long, url string, html string, text string")
    got = H.op5(frame).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, 0, 249_999]
    assert H.op5(frame.where("false")).count() == 0
