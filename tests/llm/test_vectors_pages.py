"""Operators on vectors and pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice_spectra.llm import exact_topk, page_samples, pages, permutation_index, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int")


def made(n, seed, d=16, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies] = x[0]
    return [(i, [float(np.float32(v)) for v in row], 1.0, 1) for i, row in enumerate(x)]


ODD = [(2000, None, 1.0, 1), (2001, [1.0, None], 1.0, 1), (2002, [float("nan")] * 16, 1.0, 1), (2020, [float("inf")] * 16, 1.0, 1), (None, [1.0] * 16, 1.0, 1), (2040, [0.0] * 16, 1.0, 1), (2060, [1.0, 2.0], 1.0, 1), (2080, [], 1.0, 1)]


def usable(rows, zero=True):
    out = [(i, [float(np.float32(v)) for v in x]) for i, x, *_ in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = [(i, [*x, *[0.0] * (16 - len(x))]) for i, x in out]
    return [(i, x) for i, x in out if zero or any(x)]


@pytest.mark.parametrize("rows_a_task", [8192, 64])
def test_exact_top_k_equals_brute_force(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(vectors, "ROWS", rows_a_task)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    rows = made(400, 1, copies=60) + ODD
    got = exact_topk.exact_top_k(table(spark, rows), F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    own = usable(rows)
    codes = {i: np.floor(64 * np.array(x)).astype(int) for i, x in own}
    want = []
    for q in sorted(i for i in codes if i % 20 == 0):
        best = sorted((-int(codes[q] @ codes[i]), i) for i in codes if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert [tuple(r) for r in got] == want


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (20, 32))
    codes = (centres[rng.integers(0, 20, 4000)] + rng.integers(-2, 3, (4000, 32))).astype(np.int64)
    blocks = exact_topk.Blocks(codes, np.arange(4000))
    q, i, s = blocks.top_k(codes[:5], np.arange(5), 10)
    for k in range(5):
        score = codes @ codes[k]
        score[k] = -(10**9)
        best = np.lexsort((np.arange(4000), -score))[:10]
        assert i[10 * k : 10 * k + 10] == best.tolist() and s[10 * k : 10 * k + 10] == score[best].tolist()


def test_sums_of_any_size_are_exact(spark):
    rng = np.random.default_rng(4)
    for size in (2.0**18, 2.0**21, 2.0**45):  # codes in float64, in long, and past a long's sums
        x = np.round(rng.normal(size=(120, 4)), 3) * size
        x[:, 3] = 1 if size > 2**30 else x[:, 3]
        x[::2, 0] = 0 if size > 2**30 else x[::2, 0]
        rows = table(spark, [(i, [float(np.float32(v)) for v in row], 1.0, 1) for i, row in enumerate(x)])
        query = exact_topk.exact_top_k(rows, F.col("id") % 20 == 0, 5)
        if size > 2**30:
            with pytest.raises(Exception, match="OverflowError"):
                query.collect()
            continue
        codes = [[int(np.floor(64 * float(np.float32(v)))) for v in row] for row in x]
        want = []
        for q in range(0, 120, 20):
            best = sorted((-sum(a * b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in range(120) if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        assert sorted(map(tuple, query.collect())) == want


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_of_the_index(spark, monkeypatch, n):
    """With the query's own settings, over several blocks."""
    monkeypatch.setattr(vectors, "ROWS", 1024)
    rows = made(n, 9, d=64)
    got = permutation_index.nearest(table(spark, rows), F.col("id") % 20 == 0).toPandas()
    x = np.array([v for _, v, *_ in rows])
    recall = []
    for q, found in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(set(np.argsort(-score)[:20]) & set(found.vec_id)) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


def test_few_candidates_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1.0, 1), (0, [0.5, 0.0], 1.0, 1), (1, [1.0, 1.0], 1.0, 1), (20, [0.0, 1.0], 1.0, 1)]
    got = exact_topk.exact_top_k(table(spark, rows), F.col("id") % 20 == 0, 20).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(0, 1), (0, 20), (20, 0), (20, 1)} and len(got) == 5
    assert exact_topk.exact_top_k(table(spark, rows).where("false"), F.col("id") % 20 == 0).count() == 0
    assert permutation_index.nearest(table(spark, rows).where("false"), F.col("id") % 20 == 0).count() == 0


def test_nearest(spark):
    rows = made(600, 3, copies=90) + ODD
    got = permutation_index.nearest(table(spark, rows), F.col("id") % 20 == 0, 20, pivots=64, prefix=24, part=0.2, least=64).toPandas()
    own = usable(rows, zero=False)
    x = np.array([v for _, v in own])
    ids = np.array([i for i, _ in own])
    hits = total = 0
    for q, found in got.groupby("query_id"):
        score = np.zeros(len(ids))
        for j in range(16):
            score += x[:, j] * x[ids == q][0, j]
        other = ids != q
        best = ids[other][np.lexsort((ids[other], -score[other]))[:20]]
        hits += len(set(best) & set(found.vec_id))
        total += 20
        assert sorted(found["rank"]) == list(range(1, 21))
        want = dict(zip(ids, score, strict=True))
        assert np.allclose([want[i] for i in found.vec_id], found.score, atol=1e-12)
        ordered = found.sort_values("rank")
        assert list(zip(-ordered.score, ordered.vec_id, strict=True)) == sorted(zip(-ordered.score, ordered.vec_id, strict=True))
    assert hits / total >= 0.9 and set(got.query_id) == {i for i, _ in own if i % 20 == 0}


def test_closeness_is_the_footrule_gain():
    rng = np.random.default_rng(0)
    orders = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = permutation_index.PivotFiles(orders, 12)

    def footrule(a, b):
        place = lambda o, p: list(o).index(p) if p in o else 5
        return sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})

    near = files.closeness(orders[3])
    assert all(5 * 6 - 2 * near[i] == footrule(orders[3], orders[i]) for i in range(40))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</head><p>no</p>";</script></head><body>
<header class="site"><p>Site name</p></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy now.</div>
<article><header><h1>A &amp; B</h1></header><p>First&nbsp;  paragraph,<br>with <b>bold</b> and <a href="#">a link</a>.<p>Short.
<script>if (a < b) {}</script><aside>See also</aside><ul><li>one<li>two</ul><form><input><p>Mail?</p></form><!-- <p>gone</p> --></article>
<section class="comments"><p>I think this is wrong, and here is why, at length, with commas.</p></section><footer>&copy; all</footer></body></html>"""


def test_main_text():
    assert pages.main_text(PAGE).split("\n\n") == ["A & B", "First paragraph, with bold and a link.", "Short.", "one", "two"]


SENTENCES = "This is a sentence of some length, with a comma in it. And here is another one, as pages have them."


@pytest.mark.parametrize("name", ["social-policy", "search-results", "discussion", "text-share", "tags-section", "hidden-gems", "related-work", "comment-law", "menu-of-the-day", "has-sidebar"])
def test_a_topics_name_does_not_bar_a_paragraph(name):
    around = f"<nav><a href=x>x</a></nav><article><h1>Title</h1><p>{SENTENCES}</p>%s</article><footer>x</footer>"
    kept = f"Title\n\n{SENTENCES}\n\nKept. {SENTENCES}"
    assert pages.main_text(around % f'<div class="{name}"><p>Kept. {SENTENCES}</p></div>') == kept
    assert pages.main_text(around % f'<p class="{name}">Kept. {SENTENCES}</p>') == kept


@pytest.mark.parametrize("marks", ['class="ad"', 'class="box ad-slot"', 'id="comments"', 'class="commentList"', 'class="cookie-notice"', 'class="share-buttons"', 'role="complementary"', 'class="related-posts"', "hidden", 'style="display: none"', 'class="sidebar-widget"', 'class="newsletter_signup"'])
def test_furniture_goes_inside_an_article_too(marks):
    html = f"<article><h1>Title</h1><p>{SENTENCES}</p><div {marks}><p>{SENTENCES} Gone. {SENTENCES}</p></div><p>{SENTENCES}</p></article>"
    assert pages.main_text(html) == f"Title\n\n{SENTENCES}\n\n{SENTENCES}"


def test_pages_without_an_article():
    linked = "A linked paragraph of some ninety characters, which is all but one word of this small page."
    assert pages.main_text(f"<html><body><p><a href=x>{linked}</a></p><p>Word</p></body></html>") == linked + "\n\nWord"
    body = f"<div id=content><h1>Title</h1><p>{SENTENCES}</p></div>"
    menu = "<ul>" + "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(6)) + "</ul>"
    assert pages.main_text(f"<body>{menu}{body}<div class=footer>© 2020, all of it.</div></body>") == f"Title\n\n{SENTENCES}"
    assert pages.main_text(f"<body>{menu}</body>") == ""


def test_heads_without_an_end():
    rest = f"<p>{SENTENCES}</p><p>{SENTENCES}</p>"
    want = f"{SENTENCES}\n\n{SENTENCES}"
    for head in ("<head><title>x</title><meta charset=u>", "<head><script>'<p>no</p></head>'</script><link rel=x><style>p{}</style>", "<html><head>", "<head><title>x</title></head>"):
        assert pages.main_text(head + rest) == want
    assert pages.main_text(f"<head><title>x</title>{SENTENCES}") == SENTENCES and pages.main_text("<head><title>x</title>") == ""


def test_marks_are_counted_over_the_whole_block():
    words = "word " * 100
    rows = pages.features(pages.blocks(f"<p>{words}{'one. two. three. four.' * 2}</p><p>{words}</p>"))
    stops = pages.FEATURES.index("stops")
    assert rows[0][stops] == 1 and rows[1][stops] == 0


#: Names that the generated pages for training don't have.
UNSEEN = {
    "menu": ["globalNav", "nav-primary", "menu-bar"], "header": ["masthead", "page_topbar"], "footer": ["pageFooter", "footer-inner"], "sidebar": ["right-sidebar", "sidebar_box"], "notice": ["gdpr-consent", "cookies", "alert-box"],
    "advert": ["advertising", "sponsored-links", "ads_top"], "comments": ["reader-comments", "disqus-thread", "replies"], "related": ["recommended-links", "related_box"], "share": ["sharing-buttons", "social-links"], "form": ["subscribe", "signup-form"],
}


def test_labelled_pages(spark):
    """Characters of made pages with other seeds, names and topics than those for training."""
    from random import Random

    rng = Random(2024)
    made_pages = [page_samples.page(rng, UNSEEN, "opera tax river chess planet novel sugar".split(), ["article__content", "singlePost", "story-text"]) for _ in range(400)]
    rows = spark.createDataFrame([(i, "u", html) for i, (html, _) in enumerate(made_pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n\n") for r in pages.extract(rows).collect()}
    right = kept = wanted = 0
    for i, (_, truth) in enumerate(made_pages):
        good = [t for t, g in truth if g]
        wanted += sum(map(len, good))
        kept += sum(map(len, got[i]))
        right += sum(len(t) for t in got[i] if t in good)
    assert right / kept >= 0.97 and right / wanted >= 0.98


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<p>&am", "</div></p>", "<script>x", "<div " * 50, "<!-- x", "a" * 100_000, "<p>" * 3000 + "x"])
def test_any_form_is_read(html):
    pages.main_text(html)


def test_flow_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = 6
        graph, cost = pages.Flow(n + 2), {}
        for i in range(n):
            a, b = int(rng.integers(0, 20)), int(rng.integers(0, 20))
            graph.tie(0, i + 2, a)
            graph.tie(i + 2, 1, b)
            cost[i] = (a, b)
        ties = [(i, j, int(rng.integers(0, 10))) for i in range(n) for j in range(i) if rng.random() < 0.5]
        for i, j, c in ties:
            graph.tie(i + 2, j + 2, c, c)
        level = graph.run()

        def value(side):
            return sum(cost[i][1] if side[i] else cost[i][0] for i in range(n)) + sum(c for i, j, c in ties if side[i] != side[j])

        best = min(value([(m >> i) & 1 for i in range(n)]) for m in range(2**n))
        assert value([level[i + 2] >= 0 for i in range(n)]) == best


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "<p>" + "A long enough sentence, with some words in it. " * 4, 3)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in pages.extract(rows).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[None]["text"].startswith("A long") and got[1]["n_chars"] == len(got[1]["text"])
    assert pages.extract(rows.where("false")).count() == 0
