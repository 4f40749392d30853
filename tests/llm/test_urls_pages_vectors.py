"""URL rules and aliases, main text and templates, neighbours against brute force."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from tablemend.llm import ann, graph, pages, queries, urls
from tablemend.llm.common import stored

# --- components and urls ---------------------------------------------------------------------------


def brute_components(edges):
    least = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            least.setdefault(a, a)
            least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 3000 + i) for i in range(50)]
    edges += [(None, 5), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, graph.connected_components(df, "a", "b").collect())) == brute_components(edges)
    assert graph.connected_components(df.where("false"), "a", "b").count() == 0


RULES = (*queries.URL_RULES, urls.UrlRule("block", "bad.test", "/"))


def test_blocks_reach_aliases_and_allows_win(spark):
    def page(*tags):
        return "<html><head>" + "".join(tags) + "</head><body>x</body></html>"

    def canonical(href):
        return f'<link rel="canonical" href="{href}">'

    rows = [
        (1, "http://a.net/x", page(canonical("https://Bad.test/home"))),
        (2, "http://b.net/y?q=1#z", page('<meta http-equiv="refresh" content="0; url=http://a.net/x">')),
        (3, "http://c.org/z", page(canonical("http://a.net/x"))),  # allowed by rule
        (4, "http://d.net/free", page(canonical("/other"))),
        (5, "http://d.net/other", None),
        (6, None, page(canonical("http://a.net/x"))),
        (7, "mailto:me", ""),
        (8, "http://e.net/dir/p", page(canonical("../p?x=1&amp;y"))),
        (9, "http://f.net/old", page()),
        (9, "http://f.net/old", page()),
        (10, "HTTP://Sub.EXAMPLE.org/en/15#q", page()),
        (11, "http://example.org/en/2", page()),
        (12, "http://example.org", page()),
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, host string")
    moved = spark.createDataFrame([("http://f.net/old", "http://b.net/y?q=1"), (None, "http://x.net/")], "source string, target string")
    out = urls.judge(df, RULES, redirects=moved).collect()
    verdicts = {r.page_id: (r.rule, r.verdict) for r in out}
    assert len(out) == 13
    assert verdicts[1] == (None, "block") and verdicts[2] == (None, "block") and verdicts[9] == (None, "block")
    assert verdicts[3] == ("org/", "allow") and verdicts[4] == (None, "allow") and verdicts[5] == (None, "allow")
    assert verdicts[6] == (None, "allow") and verdicts[7] == (None, "allow") and verdicts[8] == (None, "allow")
    assert verdicts[10] == ("example.org/en/1", "block") and verdicts[11] == ("org/", "allow") and verdicts[12] == (None, "allow")
    row = next(r for r in out if r.page_id == 10)
    assert (row.host, row.path) == ("sub.example.org", "/en/15")
    assert all((r.host, r.path) == ("", "") for r in out if r.page_id in (6, 7))
    assert urls.judge(df.where("false"), RULES).count() == 0
    assert {r.page_id: r.verdict for r in urls.judge(df, RULES, html=None).collect()}[1] == "allow"


def test_url_query_runs_without_python(spark, sf):
    plan = queries.op8(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pages -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class=site><h1>Site</h1></header>
<div id="sidebar"><p>side</p></div><main><article class="post"><header><h2>Title &amp; more</h2><p class="byline">by X</p></header>
<p>One <a href=x>two</a>
 three&nbsp;four.<p>Second<br>line<ul><li>a<li>b</ul><div class="share-buttons">Share</div><form><p>name</p></form>
<section id="comments"><article class="comment"><p>bad</p></article></section><div class="adBox">buy</div><blockquote>quote</blockquote> tail &lt;b&gt;
<!-- <p>not</p> --><table><tr><td>x<td>y</table></article></main><footer>f</footer><script>if (a<b) "</p>"</script></body></html>"""


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        (PAGE, ["Title & more", "One two three four.", "Second line", "a", "b", "quote", "tail <b>", "x", "y"]),
        ("", []), ("<p", []), ("<p>x &am", ["x &am"]), ("a < b", ["a < b"]), ("<p>a<!-- c --> b<!-- open", ["a b"]),
        ("text only\n\n two", ["text only two"]), ("<div><p>1</div>2<p>3", ["1", "2", "3"]), ("<body><nav><p>no</nav><p>yes", ["yes"]),
        ("<p hidden>no<p>yes<p style='display: none'>no", ["yes"]), ("<article><p>&copy; a&#x41;</article><p>after", ["© aA"]),
    ],
)
def test_main_text(markup, expected):
    assert pages.remaining(markup, set()) == expected


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ('<body><div class="layout has-sidebar"><div class="sidebar">side</div><article><p>story told</p></article></div>', ["story told"]),
        ('<body><p>top</p><article class="post share-enabled"><p>a story told at length</p></article>', ["a story told at length"]),
        ("<body><form action=/><div id=nav>menu</div><p>a story</p><p>told</p><input></form>", ["a story", "told"]),
        ("<body><form><main><p>x</p></main></form><p>much more than this outside of the form</p>", ["x"]),
        ('<body><h1>Head</h1><div class="ad-hoc-analysis"><p>the analysis itself</p></div>', ["Head", "the analysis itself"]),
        ('<body><p>a long enough story</p><div class="hero-banner">Buy!</div><form>Name</form>', ["a long enough story"]),
        ('<article><p>short</p><div class="comment-list"><p>a comment much longer than the article</p></div></article>', ["short"]),
        ('<p>short</p><div class="comments"><article>a comment much longer than the article</article></div>', ["short"]),
        ("<p title=O'Brien>one</p><p>two</p><p title=O'Neill>three</p>", ["one", "two", "three"]),
        ("<p title = 'a>b' class=x/>one</p><p data-x=\"it's\"lang=en>two</p><p title=\"open>three", ["one", "two", "three"]),
        ('<div class="share-outer"><div class="share-box">no</div><p>what is told here</p></div>', ["what is told here"]),
        ("<article><header><h1>Title <b>bold</b></h1><p>by X</p></header><p>text</p></article>", ["Title bold", "text"]),
    ],
)
def test_articles_under_telling_names_stay(markup, expected):
    assert pages.remaining(markup, set()) == expected


@pytest.mark.parametrize("tag", ["div", "b", "ul><li", "form", "div class=has-ads", "dl><dd"])
def test_deeply_nested_pages_take_linear_time(tag):
    started = time.perf_counter()
    page = f"<{tag}>x" * 50_000
    kept = "".join(pages.remaining(page, {1})).count("x")  # of elements in doubt, those that hold half of the text
    assert kept == (25_001 if tag in ("form", "div class=has-ads") else 50_000)
    assert len(pages.holders(pages.parse(page)[0])) <= 100_000
    assert time.perf_counter() - started < 20


def test_templates_go_and_copied_articles_stay(spark):
    rows = [(i, f"http://s.net/{i}", f"<body><div class=x9><p>Welcome to our site</p></div><div><p>story {i}</p><p>more {i}</p></div></body>") for i in range(8)]
    rows += [(100 + i, f"http://t.net/{i}", "<article><p>same story</p><p>for all</p></article>") for i in range(30)]
    rows += [(200 + i, f"http://u.net/{i}", f"<article><p>own {i} words of this page alone</p><p>read on</p></article>") for i in range(20)]
    rows += [(300, None, None), (301, "http://s.net/", ""), (302, "", "<p>no host"), (0, "http://s.net/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")
    out = {(r.page_id): r for r in pages.main_texts(df).collect()}
    assert out[3].text == "story 3\n\nmore 3" and out[3].n_chars == len(out[3].text)
    assert out[110].text == "same story\n\nfor all"
    assert out[205].text == "own 5 words of this page alone"  # a block on all pages of the host
    assert (out[300].text, out[300].n_chars, out[301].text, out[302].text) == ("", 0, "", "no host")
    assert pages.main_texts(df).count() == len(rows) and pages.main_texts(df.where("false")).count() == 0


def test_main_text_query_whole(spark, sf):
    out = queries.op2(spark, sf)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert out.where("n_chars <> length(text) OR text RLIKE '^\\\\s|\\\\s$'").count() == 0
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


# --- neighbours ------------------------------------------------------------------------------------


def brute(rows, k, modulus):
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good.items():
        if q % modulus == 0:
            scored = []
            for c, b in good.items():
                if c != q and len(a) == len(b):
                    dot = aa = bb = 0.0
                    for x, y in zip(a, b):
                        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
                    scored.append((-dot / (math.sqrt(aa) * math.sqrt(bb)), c))
            for rank, (s, c) in enumerate(sorted(scored)[:k], 1):
                out[q, rank] = (c, -s)
    return out


@pytest.mark.parametrize("block_rows", [16_384, 7])
def test_neighbours_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(24).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [math.nan] * 24), (504, [None] * 24), (510, [math.inf] * 24), (None, rows[0][1])]
    rows += [(600 + i, [float(x) for x in rng.standard_normal(3)]) for i in range(4)]  # another length, fewer than k
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    coded = stored(ann.index(df, "vec_id", "embedding"), "codes")
    found = ann.search(coded, "vec_id % 10 = 0", k=5, block_rows=block_rows).collect()
    exact = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 10)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found}
    assert set(got) == set(exact)
    assert sum(got[k] == exact[k] for k in exact) >= 0.99 * len(exact)
    assert ann.search(coded.where("false"), "vec_id % 10 = 0").count() == 0


def test_error_bounds_save_exact_work(spark, sf):
    """Most vectors are ruled out by their codes."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((4000, 64))
    vectors[100:300] = np.repeat(vectors[:20], 10, axis=0) + 0.4 * rng.standard_normal((200, 64))  # ten near ones each
    block = ann._Block(np.arange(20), vectors[:20], 256, 5, 4.0)
    asked = []
    plain = ann.exact_cosines
    try:
        ann.exact_cosines = lambda a, b: (asked.append(len(a)), plain(a, b))[1]
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        x = unit @ ann.rotation(64, 256)
        block.offer(np.arange(4000), np.packbits(x >= 0, axis=1), np.abs(x).sum(axis=1) / 16, vectors)
    finally:
        ann.exact_cosines = plain
    assert sum(asked) < 0.05 * 20 * 4000


def test_repeated_ids_count_once(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    coded = stored(ann.index(df, "vec_id", "embedding"), "codes")
    assert [(r.rank, r.vec_id) for r in ann.search(coded, "vec_id = 0").orderBy("rank").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("noise", [0.0, 0.01])
def test_many_rows_of_one_near_id_leave_room_for_others(noise):
    """Eight rows of the nearest id, equal or not, and six ids further off, in one chunk."""
    rng = np.random.default_rng(12)
    query = rng.standard_normal((1, 64))
    near = np.repeat(query, 8, axis=0) + noise * rng.standard_normal((8, 64))
    far = query + np.arange(2, 8)[:, None] * 0.5 * rng.standard_normal((6, 64))
    vectors, ids = np.concatenate([near, far]), np.array([1] * 8 + list(range(2, 8)))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    x = unit @ ann.rotation(64, 256)
    block = ann._Block(np.array([0]), query, 256, 5, 4.0)
    block.offer(ids, np.packbits(x >= 0, axis=1), np.abs(x).sum(axis=1) / 16, vectors)
    cosine = unit @ query[0] / np.linalg.norm(query)
    best = {i: cosine[ids == i].max() for i in set(ids.tolist())}
    assert block.found[0].tolist() == sorted(best, key=lambda i: -best[i])[:5]


def test_which_markup_links(spark):
    marks = [
        ('<link rel="alternate canonical" href="/a">', "/a"), ("<link href='/b' rel='x canonical'>", "/b"), ("<LINK rel=canonical href=/c>", "/c"),
        ('<!-- <link rel="canonical" href="/d"> -->', None), ('<script>"<link rel=canonical href=/e>"</script>', None),
        ('<link rel="non-canonical" href="/f">', None), ('<link data-rel="canonical" href="/g">', None),
        ('<meta http-equiv="refresh" content="0; url=/h">', "/h"), ("<style>/* canonical */</style>" * 5000 + '<link rel="canonical" href="/i">', "/i"),
        ("<!-- " + "canonical " * 200_000 + '--><link rel="canonical" href="/j">', "/j"), (None, None), ("", None),
    ]
    df = spark.createDataFrame([(f"http://h.net/{i}", m) for i, (m, _) in enumerate(marks)], "url string, html string")
    found = {r.source: r.target for r in urls.page_links(df, "url", "html").collect()}
    assert found == {f"x://h.net/{i}": t for i, (_, t) in enumerate(marks) if t}
