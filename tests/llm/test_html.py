import itertools
import time

import numpy as np

from parley.llm import htmltext

MODEL = htmltext.train()
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">a</a></li></ul></nav><div id="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
<div class="content"><h1>Big &eacute; title</h1><p>Some <b>bo</b>ld text &amp; more
 of   it.<p>Open paragraph.<form>Find <input></form><script>var a="</p>";</script><p>Last &lt;one&gt;.</div>
<div class="sidebar"><p>A long side text that could well be an article, it has a full stop.</p></div>
<section class="comments"><p>I like this article a lot. Really good text.</p></section><footer>&copy; me</footer></body></html>"""


def test_the_article_stays_and_the_rest_goes():
    assert htmltext.main_text(PAGE, MODEL) == "Big é title Some bold text & more of it. Open paragraph. Last <one>."


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        gain = rng.integers(-5, 6, n).astype(float)
        edges = [(int(a), int(b), float(rng.integers(0, 4))) for a, b in rng.integers(0, n, (n, 2)) if a != b]

        def cost(keep):
            return sum(max(0, g) for g, k in zip(gain, keep) if not k) + sum(max(0, -g) for g, k in zip(gain, keep) if k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        least = min(cost(keep) for keep in itertools.product((False, True), repeat=n))
        assert np.isclose(cost(htmltext.minimum_cut(gain, edges).tolist()), least)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, PAGE), (3, None, PAGE), (4, "u", "<article><p>Cut off he"), (5, "u", "<article><p>Whole one.</p><p cla"), (6, "u", "<article>" + "<p>word and more.</p>" * 5000), (7, "u", "<nav>only</nav>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = htmltext.extract(pages).collect()
    assert [r.text for r in got][:6] == ["", "", htmltext.main_text(PAGE, MODEL), htmltext.main_text(PAGE, MODEL), "Cut off he", "Whole one."]
    assert got[6].text == " ".join(["word and more."] * 5000) and got[7].text == ""
    assert all(r.n_chars == len(r.text) for r in got) and got[2].url is None
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_a_wrapper_of_the_page_is_no_evidence_against_its_article():
    article = "<h1>Title of it</h1>" + "<p>A long sentence of the article, which has words and a full stop.</p>" * 4
    text = "Title of it" + " A long sentence of the article, which has words and a full stop." * 4
    side = '<div class="sidebar"><p>A side text that could be an article, with a full stop.</p></div>'
    for page in (
        f'<div class="site has-sidebar"><main><article>{article}</article></main>{side}</div>',
        f'<div id="page" class="with-comments"><div>{article}</div>{side}</div>',
        f'<section class="content no-banner">{article}</section>{side}',
        f'<div class="sidebar-left"><article>{article}</article>{side}</div>',
        f'<div class="search-page"><div class="banner-top"><div class="post">{article}</div>{side}</div></div>',
        f'<div class="menu-open"><p>Other.</p><main>{article}</main></div>',
    ):
        assert htmltext.main_text(page, MODEL).removeprefix("Other. ") == text, page
    comments = f'<article>{article}</article><section class="comments">' + '<article class="comment-body"><p>I like this article a lot. Really good text.</p></article>' * 20 + "</section>"
    assert not htmltext.main_text(comments.replace("<article class", "<div class").replace("</p></article>", "</p></div>"), MODEL).endswith("good text.")
    assert htmltext.main_text(f"<nav><main>{article}</main></nav>", MODEL) == ""


def test_formulas_stay():
    page = "<article><p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></semantics></math> holds.</p></article>"
    assert htmltext.main_text(page, MODEL) == "So x=2 holds."


def test_classes_that_only_contain_a_word_against_content_lose_nothing():
    para = "<p>A long sentence of the article, which has words and a full stop.</p>"
    for name in ("related-work", "share-price", "tags-of-war", "cookie-recipe", "menu-of-the-week"):
        page = f'<nav><a href="/">Home</a></nav><article><h1>Title of it</h1>{para}<div class="{name}"><h2>Short head</h2>{para}</div>{para}</article><div class="share-buttons"><a href=x>Mail</a></div>'
        text = "A long sentence of the article, which has words and a full stop."
        assert htmltext.main_text(page, MODEL) == f"Title of it {text} Short head {text} {text}", name


def scored(marked):
    """Of held-out generated pages: blocks, labels that the cut turned, errors of the cut and of the classifier alone."""
    total = turned = wrong = alone = 0
    for source, content in htmltext.labelled_pages(150, 99, marked):
        page = htmltext.parse(source)
        right = np.array([t in content for t in page.texts])
        kept, first = htmltext.label(page, MODEL), MODEL.gain(page) > 0
        total, turned = total + len(right), turned + int((kept != first).sum())
        wrong, alone = wrong + int((kept != right).sum()), alone + int((first != right).sum())
    return total, turned, wrong, alone


def test_the_cut_decides_and_is_better_than_the_classifier_alone():
    for marked in (True, False):  # without marks no word list has a say
        total, turned, wrong, alone = scored(marked)
        assert turned > 20 and wrong < 0.7 * alone and wrong < 0.03 * total, (marked, total, turned, wrong, alone)


def test_cut_of_a_page_against_a_walk_over_its_tree():
    """The graph of a page is a tree with a chain over its leaves: the least cost follows from the labels at the ends of each subtree."""

    def least(page, gain, count, edges):
        n, weight = len(page.texts), {}
        below = {}
        for a, b, w in edges:
            weight[a, b] = weight.get((a, b), 0.0) + w
            if b >= n:
                below.setdefault(b, []).append(a)
        place = {i: i for i in range(n)}
        for v in range(count - 1, n - 1, -1):
            place[v] = min(place[c] for c in below[v])

        def cost(v):  # {(label, first leaf's, last leaf's): cost}
            own = (max(0.0, gain[v]), max(0.0, -gain[v]))
            if v < n:
                return {(x, x, x): own[x] for x in (0, 1)}, v
            kids = sorted(below[v], key=place.get)
            best, last = None, None
            for c in kids:
                part, end = cost(c)
                now = {}
                for x in (0, 1):
                    for (y, f, z), k in part.items():
                        k += weight[c, v] * (x != y)
                        if best is None:
                            now[x, f, z] = min(now.get((x, f, z), np.inf), k + own[x])
                            continue
                        for (x2, f2, z2), k2 in best.items():
                            if x2 == x:
                                total = k + k2 + weight.get((last, place[c]), 0.0) * (z2 != f)
                                now[x, f2, z] = min(now.get((x, f2, z), np.inf), total)
                best, last = now, end
            return best, last

        roots = [v for v in range(n, count) if not any(a == v for a, b, _ in edges if b >= n)]
        assert len(roots) == 1
        return min(cost(roots[0])[0].values())

    rng = np.random.default_rng(5)
    for source, _ in htmltext.labelled_pages(25, 7):
        page = htmltext.parse(source)
        count, edges = htmltext.edges_of(page)
        if len(page.texts) < 2:
            continue  # one block has no tree
        gain = np.concatenate((rng.normal(0, 1, len(page.texts)), np.zeros(count - len(page.texts))))
        kept = htmltext.minimum_cut(gain, edges)
        cost = np.maximum(0, gain)[~kept].sum() + np.maximum(0, -gain)[kept].sum() + sum(w for a, b, w in edges if kept[a] != kept[b])
        assert np.isclose(cost, least(page, gain, count, edges))


def test_large_and_deep_pages_take_no_long():
    rows = "".join(f"<div><p>Some words of part {i}, and a full stop.</p><p>x{i}</p></div>" for i in range(5000))
    began = time.perf_counter()
    text = htmltext.main_text(f"<nav>{'<a href=x>menu</a>' * 50}</nav><article>{rows}</article>", MODEL)
    assert text.count("full stop.") == 5000 and "x4999" in text and "menu" not in text
    assert time.perf_counter() - began < 5
    began = time.perf_counter()
    htmltext.main_text("<div>" * 20000 + "text here." + "</div>" * 20000, MODEL)
    assert time.perf_counter() - began < 5


def test_query_against_brute_force(spark):
    """The query on the smallest table against blocks cut out by plain slicing of its articles."""
    import html
    import re

    from parley.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op10_html_text(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inside = " ".join(re.findall(r"<article>(.*?)</article>", r.html or "", re.S))
        plain = re.sub(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", "", inside, flags=re.S)
        words = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())
        assert got[r.page_id].split() == words.split() or re.search(r"<(?:aside|form|nav|footer|div|section)", inside)


ARTICLE = "<h1>Title of it</h1>" + "<p>A long sentence of the article, which has words and a full stop.</p>" * 4
TEXT = "Title of it" + " A long sentence of the article, which has words and a full stop." * 4
NAV = '<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>'


def test_attribute_values_hide_nothing():
    for tag in ('title="the hidden gem"', 'class="a hidden md:block"', 'data-x="css display: none trick"', "data-hidden=no", 'class="x" title="aria-hidden=true"', 'style="color: red" alt="display:none"'):
        assert htmltext.main_text(f"{NAV}<article {tag}>{ARTICLE}</article>", MODEL) == TEXT, tag
    assert htmltext.attributes("""a=1 B='x y' c="d>e" hidden A=2 d = "&amp;" /""") == {"a": "1", "b": "x y", "c": "d>e", "hidden": "", "d": "&"}


def test_what_is_hidden_is_parsed_and_the_cut_decides():
    unseen = "<h2>Sign up</h2><p>Get our letter every week, it costs nothing.</p>"
    for tag in ("<div hidden>%s</div>", "<div style='display:none'>%s</div>", "<div aria-hidden=true>%s</div>", "<template>%s</template>"):
        page = f"{NAV}<article>{ARTICLE}</article>{tag % unseen}"
        assert "Sign up" in htmltext.parse(page).texts
        assert htmltext.main_text(page, MODEL) == TEXT, tag


def test_foreign_elements_that_end_in_their_own_tag():
    for mark in ("<svg/>", '<svg viewBox="0 0 1 1" />', "<svg><path d='M0'/><text>no</text></svg>", "<p><svg class=x/></p>", "<svg>", "<iframe src=x></iframe>", "<title>no</title>", "<annotation/>"):
        assert htmltext.main_text(f"{NAV}{mark}<article>{ARTICLE}</article>", MODEL) == TEXT, mark
    assert htmltext.main_text(f"<article>{ARTICLE}</article><script>var a = '<p>no</p>", MODEL) == TEXT


def test_content_that_browsers_may_fall_back_to_is_text():
    for name in ("noscript", "object", "canvas", "audio", "video"):
        assert htmltext.main_text(f"{NAV}<{name}><article>{ARTICLE}</article></{name}>", MODEL) == TEXT, name
        assert htmltext.main_text(f"{NAV}<article><{name}>{ARTICLE}</{name}></article>", MODEL) == TEXT, name


def test_a_page_that_is_one_text_and_a_head_that_is_left_open():
    text = "This page has no markup at all, but it has a sentence, and that sentence is its article."
    for page in (text, f"<p>{text}", f"<html><body>{text}</body></html>", f"<html><head><title>t</title><body><p>{text}</p>", f"<head><meta x><p>{text}</p>", f"<head><title>t</title>{text}"):
        assert htmltext.main_text(page, MODEL) == text, page


def test_many_elements_without_an_end_take_linear_time():
    begun = time.perf_counter()
    htmltext.parse("<title>a<svg>b<annotation>" * 40_000)
    assert time.perf_counter() - begun < 10
