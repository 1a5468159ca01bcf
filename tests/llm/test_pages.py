"""Main text of pages."""

from quotalens.llm import pages

PAGE = "page_id long, url string, html string, node string, salt string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def page(k, article, side="", tail="</body></html>"):
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/{k}'>menu {k}</a>"
        f"</li></ul></nav><!-- ad <p>hidden</p> --><div class=\"ad\">buy {k}</div>{side}<article>{article}</article><footer>&copy; me</footer>{tail}")


def texts(spark, rows):
    return {r.page_id: r.text for r in pages.extract(frame(spark, rows)).collect()}


def test_article_only(spark):
    rows = [(k, f"https://a.example/{k}", page(k, f"<h1>Head {k}</h1><p><b>One&amp;two  {k}<br><p>three\n four</p>")) for k in range(6)]
    rows += [(10, "http://b.example", page(10, "<p>alone", tail="")), (11, None, page(11, "<p>A &lt;b&gt; &eacute;&nbsp;x</p><p> </p>"))]
    got = texts(spark, rows)
    assert got[3] == "Head 3\nOne&two 3\nthree four"
    assert got[10] == "alone" and got[11] == "A <b> é x"


def test_slots_inside_the_article_are_left_out(spark):
    article = (
        "<header><h1>Title</h1></header><div class='post-header'>By me</div><p>Text<script>bad()</script> <i>it</i>alic</p><aside>side</aside><form><p>Mail?</p></form>"
        "<div class='cookie-notice'>ok?</div><ul><li>a<li>b</ul><section id=comments><p>first!</p></section><blockquote>said</blockquote>")
    assert texts(spark, [(1, "http://c.example", page(1, article))])[1] == "Title\nBy me\nText italic\na\nb\nsaid"


def test_without_article_repeated_blocks_go(spark):
    body = "<html><body><div class=top><p>Welcome to the site</p></div><div><p>Story number {0}</p></div></body></html>"
    got = texts(spark, [(k, "http://d.example/x", body.format(k)) for k in range(8)])
    assert got[5] == "Story number 5"


def test_copies_on_a_host_keep_their_text(spark):
    rows = [(k, "http://e.example/x", page(1, "<h1>Same</h1><p>same text</p>")) for k in range(9)]
    assert set(texts(spark, rows).values()) == {"Same\nsame text"}


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "http://f.example", "just text"), (4, "x", "<<<>< a <b"), (5, "x", "<p title='" + "<" * 50_000), (6, "x", "<div>" * 3000 + "deep")]
    rows += [(7, "x", page(7, "<p>" + "long " * 100_000 + "</p>"))] * 2
    got = pages.extract(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == "" and by_id[None] == "just text" and by_id[6] == "deep" and len(by_id[7]) == 499_999
    assert pages.extract(frame(spark, [])).count() == 0


def test_host_does_not_change_the_text(spark):
    """One host with most pages and many hosts with one page give the same texts."""
    articles = {k: f"<h1>H {k}</h1><p>w{k} text</p>" for k in range(30)}
    one = texts(spark, [(k, "http://same.example", page(k, a)) for k, a in articles.items()])
    many = texts(spark, [(k, f"http://h{k}.example", page(k, a)) for k, a in articles.items()])
    assert one == many == {k: f"H {k}\nw{k} text" for k in articles}


def test_unclosed_tags_end_soon():
    import time

    start = time.perf_counter()
    assert pages.parse("<p>x</p>" + "<a " * 400_000)[1][0][1] == "x"
    assert time.perf_counter() - start < 2
    assert pages.parse("a<p>b<!-- c")[1] == [("", "a"), (">p", "b")]


def test_words_inside_an_article_label_only_whole_attributes(spark):
    article = (
        "<h1>Stocks {0}</h1><div class='share-price-table'><p>ACME {0}</p></div><div class='main banner'><p>Lead {0}</p></div>"
        "<div class='post-share-buttons'><p>Share it</p></div><div class='entry' id='user-comments'><p>Nice {0}</p></div><p>End {0}</p>")
    got = texts(spark, [(k, "http://g.example/x", page(k, article.format(k))) for k in range(9)])
    assert got == {k: f"Stocks {k}\nACME {k}\nLead {k}\nEnd {k}" for k in range(9)}


def test_a_word_on_the_body_loses_nothing(spark):
    html = "<html><body class='has-sidebar menu-open'><article><p>Text {0}</p></article><div id=sidebar><p>side</p></div></body></html>"
    assert texts(spark, [(k, "http://h.example", html.format(k)) for k in range(5)])[3] == "Text 3"


def test_template_labels_slots_without_an_article(spark):
    """A part with other words too is left out if it belongs to the template, and kept if it stands in one page."""
    html = "<html><body><div class='promo-strip'><p>Offer {0}</p></div><div><p>Story {0}</p>{1}</div></body></html>"
    rows = [(k, "http://i.example", html.format(k, "<div class='notice-board'><p>Pinned</p></div>" if k == 4 else "")) for k in range(12)]
    assert texts(spark, rows) == {k: f"Story {k}" + ("\nPinned" if k == 4 else "") for k in range(12)}


def test_two_layouts_of_a_host(spark):
    """Each layout has a class of its own, with its fixed texts, though neither stands in most pages."""
    one = "<html><body><div class=a><h2>Daily news</h2><p>News {0}</p></div></body></html>"
    two = "<html><body><table><tr><td>Price list</td><td><ul><li>Item {0}</li></ul></td></tr></table></body></html>"
    rows = [(k, "http://j.example", (one, two)[k % 2].format(k)) for k in range(20)]
    assert texts(spark, rows) == {k: (f"News {k}", f"Item {k}")[k % 2] for k in range(20)}


def brute_classes(rows):
    """Classes of one host by whole occurrence vectors, nested by trying every outer element."""
    pages_of = []
    for html in rows:
        elements, blocks, begun = pages.parse(html)
        at = [(p, 2 * k) for k, p in enumerate(elements)]
        at += [(pages.token_of(*b), 2 * k - 1) for b, k in zip(blocks, begun) if not pages.article_of(b[0])]
        pages_of.append(at)
    tokens = {t for at in pages_of for t, _ in at}
    vector = {t: tuple(sum(x == t for x, _ in at) for at in pages_of) for t in tokens}
    place = {t: sum(min(k for x, k in at if x == t) for at in pages_of if any(x == t for x, _ in at)) for t in tokens}
    seen = {t: sum(n > 0 for n in v) for t, v in vector.items()}
    usual = {t for t in tokens if seen[t] >= max(2, pages.SUPPORT * len(rows)) and ("\n" not in t or seen[t] > 2)}
    accepted, out = set(), []
    for v in sorted({vector[t] for t in usual}, key=lambda v: (-sum(n > 0 for n in v), sum(v))):
        members = {t for t in usual if vector[t] == v}
        homes = {t: max((e for e in accepted if t.split("\n")[0].startswith(e + ">") or "\n" in t and t.split("\n")[0] == e), key=len, default="") for t in members}
        for home in set(homes.values()):
            part = [t for t in members if homes[t] == home]
            if any("\n" not in t for t in part) and (len(part) >= pages.CLASS_SIZE or all(v)):
                out.append((set(v) <= {0, 1}, sorted(part, key=lambda t: (place[t], t))))
                accepted |= {t for t in part if "\n" not in t}
    return out


def test_classes_equal_whole_vectors(spark):
    """Hash sums, one aggregation and nesting by prefixes give the classes that whole vectors and a search give."""
    import json
    import random

    rng = random.Random(5)
    for round_ in range(3):
        rows = []
        for k in range(14):
            items = "".join(f"<li>i{rng.random()}" for _ in range(rng.randint(1, 4)))
            notes = "<div class=n><h3>Fixed note</h3><p>n</p></div>" * rng.randint(0, 2)
            extra = f"<section><h2>More</h2><ul>{items}</ul></section>" if rng.random() < 0.6 else ""
            rows.append(f"<html><body><div class=t><p>Site</p></div><div><p>w{k}</p>{extra}{notes}</div><table><tr><td>{k}</table></body></html>")
        found = pages.templates(frame(spark, [(k, "http://k.example", r) for k, r in enumerate(rows)])).collect()
        expect = sorted((once, sorted(part)) for once, part in brute_classes(rows))
        for row in found:
            got = json.loads(row.template)
            assert sorted((once, sorted(part)) for once, part in got) == expect, (round_, row.key)
            for _, part in got:  # a template's order is the order on every page that holds it all
                for html in rows:
                    elements = pages.parse(html)[0]
                    places = [elements.index(p) for p in part if p in elements]
                    assert places == sorted(places)
        assert {r.key for r in found} == {"k.example", pages.POOLED}


def test_deep_trees_stay_small():
    elements, blocks, _ = pages.parse("<article>" + "<div>" * 50_000 + "deep<aside><div>side</div></aside>")
    assert sum(map(len, elements)) < 50_000_000 and pages.article_of(blocks[0][0])
    assert "!" not in blocks[0][0] and "!" in blocks[1][0]
