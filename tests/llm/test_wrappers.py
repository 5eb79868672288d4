"""Wrappers: hand-made sites, alignment rules, and the sample pages."""

import html
import random
import re

from cairn.llm import wrappers as w
from tests.llm.data import prose

SCHEMA = "page_id long, url string, html string"


def site(k, body, host="a.example", before="", after=""):
    return (k, f"https://{host}/{k}", f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p><article>x';</script></head><body>{before}{body}{after}</body></html>")


BEFORE = '<header>Site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies</div>'
AFTER = '<aside>side</aside><div id="comments"><p>nice post by reader</p></div><form><label>mail</label></form><footer>&copy; x</footer>'


def test_articles(spark):
    rows, want = [], {}
    for k in range(12):
        parts = [prose(100 * k + j, 20) for j in range(1 + k % 4)]
        rows.append(site(k, f"<article><h1>Head &amp; {k}</h1>{''.join(f'<p>{p}</p>' for p in parts)}<div class='ad'>buy</div></article>", before=BEFORE, after=AFTER))
        want[k] = f"Head & {k} " + " ".join(parts)
    got = {r["page_id"]: r for r in w.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_many_hosts_are_joined(spark, monkeypatch):
    rows = [site(k, f"<article>text {k}</article>", host=f"h{k % 5}.example") for k in range(40)]
    monkeypatch.setattr(w, "HOSTS_TO_SEND", 3)
    assert {r["page_id"]: r["text"] for r in w.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: f"text {k}" for k in range(40)}


def test_main_element_without_a_name(spark):
    """No article tag: the paragraphs that differ between pages win over a longer text that all pages share."""
    rows, want = [], {}
    shared = "<div class='x1'><p>" + prose(1, 150) + "</p></div>"
    for k in range(8):
        parts = [prose(100 * k + j, 25) for j in range(2 + k % 3)]
        rows.append(site(k, f"{shared}<div class='x2'>{''.join(f'<p>{p}' for p in parts)}</div>", host="b.example", before=BEFORE, after=AFTER))
        want[k] = " ".join(parts)
    got = {r["page_id"]: r["text"] for r in w.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_the_wrapper_decides_on_parts_of_classes(spark):
    rows, want, alone = [], {}, {}
    for k in range(6):
        body = f"<article id='post-{100 + k}' class='post-{100 + k} hentry'><div class='entry-header'><h1>Head {k}</h1></div><p>{prose(k, 20)}</p>"
        body += f"<div class='social-history'><p>{prose(50 + k, 20)}</p></div><div class='related-work'><p>{prose(90 + k, 9)}</p></div>"
        body += "<div class='share-bar'>Tell your friends about this page</div><ul class='related-posts'><li><a href='/x'>Other</a></ul>"
        body += f"<div class='comment-list'><p>reader {k}</p></div></article>"
        rows.append(site(k, body, host="c.example", before=BEFORE, after=AFTER))
        want[k] = f"Head {k} {prose(k, 20)} {prose(50 + k, 20)} {prose(90 + k, 9)}"
        tree = w.page_tree(rows[-1][2])
        alone[k] = w.extract(rows[-1][2], w.main_path(tree), frozenset(w.dropped_keys(tree)))
    got = {r["page_id"]: r["text"] for r in w.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want
    # Without the pages of its host a page cannot tell the bar that they share from its own text.
    assert all("Tell your friends" in text for text in alone.values())
    # Pages that are all the same keep their text.
    same = [(k, "https://d.example/x", rows[0][2]) for k in range(5)]
    kept = {r["text"] for r in w.main_texts(spark.createDataFrame(same, SCHEMA)).collect()}
    assert kept == {alone[0]}


def test_wrappers_are_as_large_as_their_template():
    sizes = []
    for n in (50, 400):
        root = None
        for k in range(n):
            tree = w.page_tree(site(k, f"<article id='post-{100 + k}' class='post-{100 + k}'><p>{prose(k, 5)}</p></article>")[2])
            root = tree if root is None else (w.fold(root, tree), root)[1]
        sizes.append(sum(1 for _ in _nodes(root)))
        assert w.main_path(root)[-1] == "article|class=post-#|id=post-#"
    assert sizes[0] == sizes[1]


def _nodes(node):
    yield node
    for kid in node.kids:
        yield from _nodes(kid)


def test_an_empty_main_element_falls_back():
    page = "<body><article></article><div><p>text that stands elsewhere</p></div></body>"
    assert w.extract(page, ["body", "article"]) == "text that stands elsewhere"


def test_markup_rules():
    text = lambda body: w.main_text(f"<body><article>{body}</article></body>", ["body", "article"])
    assert text("a<b>b</b>c<br>d&nbsp; e\n\tf") == "abc d e f"
    assert text("<p>one<p>two<div>three</div><!-- <p>no --><style>p{}</style>&lt;p&gt; &#233;&eacute;") == "one two three <p> éé"
    assert text("<p><b>open<br><p>next</p><ul><li>x<li>y</ul><script>if (a<b) '</article>'</script>z") == "open next x y z"
    assert text("a<nav>n<p>m</p></nav>b<section class='comments'><article>c</article></section>d<img alt='q'>e") == "a b d e"
    assert text("2 < 3 & 4 <5") == "2 < 3 & 4 <5"


def test_alignment():
    one = w.page_tree("<body><h1>x</h1><p>a</p><p>b</p><p>c</p></body>")
    two = w.page_tree("<body><h1>y</h1><div class='ad'>z</div><p>a</p></body>")
    w.fold(one, two)
    body = one.kids[0]
    assert [(k.key, k.seen, k.repeated) for k in body.kids] == [("h1", 2, False), ("div|class=ad", 1, False), ("p", 2, True)]
    assert body.kids[0].kids[0].text is None and body.seen == 2
    pairs = w.page_tree("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>")
    assert [(k.key, k.repeated) for k in pairs.kids[0].kids] == [("dt", True), ("dd", True)]
    assert w.Node.unpacked(one.packed()) == one


def test_awkward_rows(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, None, "just text"), (None, "https://a.example/", "<article>x</article>"), (4, "https://a.example/1", "<article>y"),
        (4, "https://a.example/1", "<article>y"), (5, "::bad", "<p"), (6, "https://c.example", "<!-- open"), (7, "https://c.example", "<div>" * 2000 + "deep"),
        (8, "https://d.example", "<article>" + "<p>word word</p>" * 20_000 + "</article>"), (9, "https://e.example", "</div></p><td>\ud7ff\x00"),
    ]
    got = {}
    for r in w.main_texts(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == got[2] == [""] and got[None] == ["x"] and got[4] == ["y", "y"]
    assert got[3] == ["just text"] and got[8] == [" ".join(["word word"] * 20_000)]
    assert w.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sample_pages(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in entry.queries()["op9_html_wrappers"](spark, folder).collect():
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inside))
        assert r["text"] == " ".join(b for b in blocks if b)


def test_random_markup_does_not_crash():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "text ", "<b>", "</b>", "<li>", "<!--", "-->", "<script>", "</script>", "&amp;", "<", ">", '"', "<a href='x'>", "</a>"]
    for _ in range(500):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        path = w.main_path(w.page_tree(page))
        assert isinstance(w.extract(page, path), str)
