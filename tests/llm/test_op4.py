import math
from xml.etree import ElementTree

from siltstone.llm import op4_main_text as op4
from siltstone.llm.op4_main_text import extract_main_text, main_text, op4_main_text, parse

ARTICLE = "<h1>A title of some length</h1>" + "".join(f"<p>Paragraph {k} of the article goes on for a while, with <a href='#'>a link</a> and <b>bold</b> words&nbsp;&amp; more.</p>" for k in range(6))
WANT = "A title of some length " + " ".join(f"Paragraph {k} of the article goes on for a while, with a link and bold words & more." for k in range(6))
AROUND = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(8)) + "</ul></nav>"


def page(body):
    return f"<!doctype html><html><head><title>T</title><style>p {{ color: red }}</style><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


def test_article_in_various_frames():
    for frame in ("{}", "<div class='content'>{}</div>", "<main>{}</main>", "<article>{}</article>", "<div><div id='x'>{}</div></div>"):
        html = page(
            "<header><a href='/'>Site</a> Slogan of the site</header>" + AROUND + frame.format(ARTICLE)
            + "<aside><p>Related: something else entirely that is not part of it.</p></aside><div class='cookie-notice'>We use cookies on this site, accept?</div>"
            + "<form><label>Name</label><input></form><section id='comments'><p>First reader: I think that this is a fine article indeed.</p></section><footer>Copyright 2024, all rights.</footer>"
        )
        assert main_text(html) == WANT, frame


def test_broken_markup():
    assert main_text("<p>One paragraph of text<p>Another one, unclosed<br>with a break") == "One paragraph of text Another one, unclosed with a break"
    assert main_text("plain text, 3 < 4 &lt; 5 &#233;") == "plain text, 3 < 4 < 5 é"
    assert main_text("<div><p>Cut off in the mid") == "Cut off in the mid"
    assert main_text("<!-- <p>no</p> --><p>yes it is</p><script>alert(1)") == "yes it is"


def test_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<html></html>"), (4, None, page(ARTICLE)), (4, None, page(ARTICLE)), (5, "u", "<div>" * 3000 + "deep text" + "</div>" * 3000), (6, "u", page(AROUND))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as other")
    got = extract_main_text(df).collect()
    by = sorted(((r.page_id, r.text, r.n_chars, r.other) for r in got), key=repr)
    assert by[:3] == [(1, "", 0, 2), (2, "", 0, 2), (3, "", 0, 2)]
    assert by[3] == by[4] == (4, WANT, len(WANT), 2)
    assert by[5][1] == "deep text"
    assert extract_main_text(df.limit(0)).count() == 0


def test_all_pages(spark, sf):
    got = op4_main_text(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in got:
        assert r.n_chars == len(r.text) and "  " not in r.text and r.text == r.text.strip() and "<p>" not in r.text


def test_density_chooses_over_tags():
    post = "<div class='post'>" + "".join(f"<p>Paragraph {k} of the post is long, much longer than what any teaser beside it has to say to its readers.</p>" for k in range(6)) + "</div>"
    text = " ".join(f"Paragraph {k} of the post is long, much longer than what any teaser beside it has to say to its readers." for k in range(6))
    card = "<article class='card'><p>A teaser.</p></article>"
    assert main_text(page(post + card)).startswith(text)
    assert main_text(page(card + post)).endswith(text)
    # inside an article, too, what is thinner than the path to the body stays out
    thin = "<div>" + "".join(f"<span>t{k}</span>" for k in range(9)) + "</div>"
    assert main_text(page(f"<article>{post}{thin}</article>")) == text


def test_names_alone_cut_nothing_of_the_content():
    for kind in ("class='content has-sidebar'", "id='page-with-comments'"):
        assert main_text(page(f"<div {kind}>{ARTICLE}</div>")) == WANT, kind
        assert main_text(page(f"<div {kind}>{ARTICLE}</div><article class='card'><p>A teaser.</p></article>")).startswith(WANT), kind
    assert main_text(page("<div class='content has-sidebar'>All text of this page<br>without paragraphs</div>")) == "All text of this page without paragraphs"
    said = "What the part says is a whole sentence of the article, longer than its name."
    for tag, kind in (("section", "id='discussion'"), ("h2", "id='navigation'"), ("p", "class='notice-period'"), ("div", "class='related-work'")):
        part = f"<{tag} {kind}>{said}</{tag}>"
        for frame in ("article", "main", "div"):
            assert main_text(page(f"{AROUND}<{frame}>{ARTICLE}{part}</{frame}><footer>Foot of it.</footer>")) == f"{WANT} {said}", (tag, frame)
    assert main_text(page(f"{ARTICLE}<p class='notice-period'>{said}</p>")) == f"{WANT} {said}"


def test_form_around_the_page():
    inner = f"<header>Site</header>{AROUND}%s<input><footer>Copyright</footer>"
    for frame in ("<article>{}</article>", "<div>{}</div>", "{}"):
        assert main_text(page(f"<form action='/'>{inner % frame.format(ARTICLE)}</form>")) == WANT, frame


def test_links_and_thin_parts_still_go():
    share = "<div class='share'><a href='#'>Send it to a friend</a> <a href='#'>Print it out on paper</a></div><div class='ad'>Buy</div>"
    talk = "<section id='comments'>" + "".join(f"<p>Reader {k}: I read all of it and have something rather long to say about it, as always, and more than the article.</p>" for k in range(12)) + "</section>"
    assert main_text(page(f"<article>{ARTICLE}{share}</article>{talk}")) == WANT


def test_no_paragraph_is_lost_for_a_class_name():
    one, two = "This paragraph says a whole sentence, or even two of them.", "And so does the other paragraph of the page, with a few words more."
    for name in ("post-header", "discussion", "related-work", "social-science", "story-teaser", "article-share-body"):
        assert main_text(page(f"<article><p>{one}</p><p class='{name}'>{two}</p></article>")) == f"{one} {two}", name
        assert main_text(page(f"<article>{ARTICLE}<div class='{name}'><p>{one}</p><p>{two}</p></div></article>")) == f"{WANT} {one} {two}", name


def composite(element, page_links, page_chars):
    """The density by its formula, from counts of the standard library's tree."""
    text = lambda e: len("".join("".join(e.itertext()).split()))
    inner = [e for e in element.iter() if e is not element]
    c, t = text(element), max(1, len(inner))
    links = [e for e in inner if e.tag == "a"]
    linked = c if element.tag == "a" else sum(map(text, links))
    if not c:
        return 0.0
    base = max(1.1, math.log(c / max(1, c - linked) * linked + page_links / max(1, page_chars) * c + math.e))
    return c / t * max(0.0, math.log(c / max(1, linked) * t / max(1, len(links)))) / math.log(base)


def test_densities_by_counting():
    html = "<html><body><div id='a'><a href='#'>one</a><a href='#'>two</a> x</div><div id='b'><h2>Title</h2><p>Some text with <b>bold</b> and <a href='#'>a link</a>.</p><p>More of it, and no link.</p></div><p>Last</p></body></html>"
    root = parse(html)
    op4._measure(root)
    tree = ElementTree.fromstring(html)
    text = lambda e: len("".join("".join(e.itertext()).split()))
    page_links, page_chars = sum(text(a) for a in tree.iter("a")), text(tree)
    mine = [n for n in in_order(root)]
    theirs = list(tree.iter())
    assert [n.tag for n in mine] == [e.tag for e in theirs]
    for n, e in zip(mine, theirs):
        assert abs(n.density - composite(e, page_links, page_chars)) < 1e-9, e.tag


def in_order(node):
    yield node
    for k in node.kids:
        if not isinstance(k, str):
            yield from in_order(k)


def test_without_densities_the_content_is_lost(monkeypatch):
    """What chooses among parts that no tag or name tells apart is the density."""
    post = "<div>" + "".join(f"<p>Paragraph {k} of the post is long, and longer than what stands in the lists beside it on this page.</p>" for k in range(6)) + "</div>"
    lists = "<div>" + "".join(f"<span>t{k}</span> " for k in range(30)) + "</div>"
    want = main_text(page(post))
    assert main_text(page(lists + post + lists)) == want
    measured = op4._measure

    def flat(root):
        measured(root)
        for n in in_order(root):
            n.density = 0.0

    monkeypatch.setattr(op4, "_measure", flat)
    assert main_text(page(lists + post + lists)) != want
