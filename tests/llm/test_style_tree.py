"""Style trees against a sequential model, and main texts of planted templates."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from flowmill.llm.style_tree import PageTree, extract_pages, main_text, node_importance, page_blocks

SCHEMA = "page_id bigint, url string, html string"


def _texts(spark, rows, **extra):
    pages = spark.createDataFrame(rows, SCHEMA)
    for name in ("text", "node", "m", "_x", "role", "host"):
        pages = pages.withColumn(name, F.lit("clash"))
    return [tuple(r) for r in extract_pages(pages, **extra).orderBy("page_id", "text").select("page_id", "text").collect()]


def _one(html):
    return "\n".join(t for _, role, t in PageTree(html).blocks if role != 1)


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a\nb"), ("<p>a&nbsp; \n b</p>c", "a b\nc"),
    ("<article><h1>T</h1><p><b>a<br><p>b <i>c</i>d</p></article><footer>f</footer>", "T\na\nb cd"),
    ("<style>p{}</style><script>var t='</p><b>';</script><p>x", "x"), ("<title>t</title><body>x", "x"),
    ("<head><title>t</title><body><p>x", "x"), ("<!-- c --><p>&#65;&#x42;&copy;&unknown;", "AB©&unknown;"),
    ("<nav><p>n</p></nav><main>m<aside>s</aside>n</main>", "m\nn"),
    ("<div class='page has-sidebar'><main><p>x</p></main></div>", "x"),
    ("<div class='comments'><article>reader</article></div><p>x", "x"),
    ("<article><header><h1>H</h1></header>x<div class=share-bar>s</div></article><header>top</header>", "H\nx"),
    ("<body class='no-sidebar'><form>f<p>g</form><p>x", "x"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a</b></i></div>b", "a\nb"),
    ("<div><span class='ad'>buy</span>x</div>", "x"), ("a < b & c", "a < b & c"), ("<", "<"), ("<article>x", "x"),
    ("<noscript>n</noscript><iframe>q</iframe><p>x<textarea>t</textarea>", "x"),
])
def test_page(html, text):
    assert _one(html) == text


def _template_pages(n_hosts=3, n_pages=60, seed=2):
    """Pages whose menus, notices and adverts have names that say nothing, different by host."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, truth = [], []
    for i in range(n_hosts * n_pages):
        h = i % n_hosts
        body = [" ".join(word() for _ in range(12)) for _ in range(int(rng.integers(2, 9)))]
        menu = "".join(f"<li>{x}</li>" for x in ("home", "news", f"about h{h}"))
        ads = ["buy one", "buy two", "buy three"][int(rng.integers(3))]
        page = (f"<body><div class=z{h}><ul>{menu}</ul></div><div class=q{h}1>We use {i} small files.</div>"
                f"<div class=b{h}>{''.join(f'<p>{p}</p>' for p in body)}<div class=k{h}>{ads}</div></div>")
        rows.append((i, f"http://H{h}.org/{i}", page))
        truth.append((i, "\n".join(body)))
    return rows, truth


def test_unnamed_templates_are_found_by_their_entropy(spark):
    rows, truth = _template_pages()
    assert _texts(spark, rows) == truth


def test_copies_of_a_page_do_not_make_it_boilerplate(spark):
    rows, truth = _template_pages(1, 40)
    copied = rows + [(1000 + i, "http://h0.org/copy", rows[3][2]) for i in range(200)]
    assert _texts(spark, copied) == truth + [(1000 + i, truth[3][1]) for i in range(200)]


def _model(pages):
    """Importance of every (host, node), computed page by page."""
    trees, seen = defaultdict(lambda: (Counter(), defaultdict(Counter), [0])), set()
    import re

    for host, html in pages:
        blocks = PageTree(html).blocks
        if (host, tuple(blocks)) in seen:
            continue
        seen.add((host, tuple(blocks)))
        for node, times in Counter(b[0] for b in blocks).items():
            for key in ((host, node), (None, node)):
                trees[key][0][times] += 1
                trees[key][2][0] += 1
                for text in {re.sub("[0-9]+", "#", t.lower()) for n, _, t in blocks if n == node}:
                    trees[key][1]["k"][text] += 1
    out = {}
    for key, (times, held, (m,)) in trees.items():
        if m == 1:
            out[key] = 1.0
            continue
        ks = held["k"].values()
        dull = min(1.0, sum(math.log(k) for k in ks) / len(ks) / math.log(m))
        varied = -sum(c / m * math.log(c / m) for c in times.values()) / math.log(m)
        out[key] = 1 - dull * (1 - varied)
    return {k: min(v, out[None, k[1]]) for k, v in out.items() if k[0] is not None}


def test_importance_equals_the_sequential_model(spark):
    rows, _ = _template_pages(4, 15, seed=9)
    rows += [(900 + i, "http://h0.org/", rows[0][2]) for i in range(5)]
    rows += [(950, None, "<p>x</p><p>y</p>"), (951, "no scheme", "<p>x</p>"), (952, "x://", "<p>x<p>z")]
    hosts = lambda url: url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
    expected = _model([(hosts(u), h) for _, u, h in rows])
    blocks = page_blocks(spark.createDataFrame(rows, SCHEMA))
    got = {(r["_host"], r.node): r.importance for r in node_importance(blocks).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_trees_alone_and_threshold(spark):
    rows, truth = _template_pages(2, 30)
    blocks = page_blocks(spark.createDataFrame(rows, SCHEMA))
    importance = node_importance(blocks)
    alone = main_text(blocks, importance, named=False).orderBy("page_id").select("page_id", "text").collect()
    assert [tuple(r) for r in alone] == truth
    all_kept = main_text(blocks, importance, least=0.0).orderBy("page_id").first().text
    assert "home" in all_kept and "buy" in all_kept


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>"
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(1, None, None), (2, "http://a/", ""), (None, "http://a/", "<p>x"), (None, "http://a/", "<p>x"), (3, None, long),
            (4, "http://b", deep)]
    got = _texts(spark, rows)
    assert got == [(None, "x"), (None, "x"), (1, ""), (2, ""), (3, "\n".join(["word & more"] * 50_000)), (4, "deep")]
    assert _texts(spark, []) == []
