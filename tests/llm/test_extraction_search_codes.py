"""Operators 11 to 13 against brute force and round trips, with nulls, empty and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaweave.llm import html_text, search, vector_codes

# ---- 11 ----


def text_of(html: str, known=frozenset()) -> str:  # noqa: ANN001
    return html_text.Page(html, "h").text(known.__contains__)[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain  text\n only", "plain text only"),
        ("<p>a</p><p>b", "a b"),
        ("<p>a<b>b</b>c<br>d<i>e", "abc de"),
        ("<article><h1>T</h1><p><b>one<br><p>two</article><footer>no</footer>", "T one two"),
        ("<nav><ul><li>menu</ul></nav><main><p>x &amp; y &lt;z&gt; &#233;&nbsp;&quot;q&quot;</p></main>", 'x & y <z> é "q"'),
        ("<article><p>1 < 2 and a<b</p></article>", "1 < 2 and a"),
        ("<article><p title='a>b' data-x=\"</p>\">in</p></article>", "in"),
        ("<body><script>var t='</p><article>no</article>';</script><style>p{}</style><p>yes</p>", "yes"),
        ("<p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
        ("<article><p>keep</p><div class='share-buttons'>no</div><section id=comments><article><p>a reader</p></article></section></article>", "keep"),
        ("<article><header><h1>Title</h1></header><p>x</p><footer>by</footer></article>", "Title x"),
        ("<div class='page has-sidebar'><header>site</header><article>text</article><aside>side</aside></div>", "text"),
        ("<div role=banner>no</div><div id=content><p>x</p><form><input>no</form></div><div class=cookie-notice>no</div>", "x"),
        ("<p class=ad>buy</p><p>x</p><table><tr><td>1<td>2<tr><td>3</table>", "x 1 2 3"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article>a</article><article>b</article>", "a b"),
        ("<svg><title>no</title></svg><title>no</title><p>x", "x"),
        ("<article><p>one</div>two</article>", "onetwo"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"),
        ("<ARTICLE><P CLASS=Advert>no</P><P>é</P></ARTICLE>", "é"),
    ],
)
def test_pages(html, want):
    assert text_of(html) == want


def site_page(k: int, body: str, marked: bool) -> str:
    """A page whose frame has nothing that names its parts."""
    frame = "<div><p>Home</p><p>About the site</p></div>"
    end = "<div><p>All rights reserved.</p></div>"
    body = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
    return f"<html><body>{frame}{body}<div><p>page {k}</p></div>{end}</body></html>" if not marked else f"<html><body>{frame}{body}{end}</body></html>"


def test_site_templates(spark):
    shared = "<p>A passage that many articles quote.</p>"
    rows = [(k, f"http://Site.example:80/{k}", site_page(k, f"<h1>Title {k}</h1><p>Body of page {k}.</p>", False)) for k in range(8)]
    rows += [(100 + k, f"https://u@site.example/{k}", site_page(k, f"<h1>Marked {k}</h1>{shared}<p>Text {k}.</p><div><p>Subscribe here</p></div>", True)) for k in range(6)]
    rows += [(200 + k, f"http://copies.example/{k}", site_page(k, "<h1>Same</h1><p>The same article, copied.</p>", False)) for k in range(9)]
    rows += [(300, "http://few.example/", site_page(0, "<h1>Few</h1><p>x</p>", False)), (301, None, None), (302, "no url", ""), (None, None, "<p>only</p>"), (300, "http://few.example/", site_page(0, "<h1>Few</h1><p>x</p>", False))]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, text string, digest int").repartition(3)
    want = {k: f"Title {k} Body of page {k}. page {k}" for k in range(8)}
    want |= {100 + k: f"Marked {k} A passage that many articles quote. Text {k}." for k in range(6)}
    want |= {300: "Home About the site Few x page 0 All rights reserved.", 301: "", 302: "", None: "only"}
    for sent in (1000, 0):  # templates sent to the tasks, and joined
        got = html_text.extract_text(pages, sent_templates=sent)
        assert got.columns == ["page_id", "url", "text", "n_chars", "n_templates"]
        found = got.collect()
        assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
        texts = {r.page_id: r.text for r in found}
        assert {i: texts[i] for i in want} == want
        assert all("The same article, copied." in texts[200 + k] for k in range(9))  # copies are one page to the count
        assert {r.page_id: r.n_templates for r in found}[3] >= 2
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_very_long_page(spark):
    html = "<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>" + "<div>" * 3000
    r = html_text.extract_text(spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")).first()
    assert r.text == " ".join(["word & word"] * 100_000)


# ---- 12 ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, top=10):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return out


def test_search(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "été", "x9", "가나", *(f"w{rng.randrange(200)}" for _ in range(5))])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " ,.;"), (503, rows[3][1]), (504, rows[3][1]), (504, rows[3][1]), (None, rows[3][1]), (505, "alpha " * 50_000), (506, "CafÉ bar-Beta_x9")]
    items = [(k, " ".join(word() for _ in range(rng.randrange(12)))) for k in range(12)] + [(20, None), (21, "été"), (22, "nowhere to be found"), (23, rows[3][1]), (23, "alpha Alpha ALPHA")]
    docs = spark.createDataFrame([(i, t, 7, "y") for i, t in rows], "doc_id long, text string, score int, terms string").repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for shard_bytes, block in ((1 << 24, 1 << 22), (700, 60)):  # one shard a task and one block, and many
        got = search.search_documents(docs, queries, shard_bytes=shard_bytes, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_search(rows, items)))
    assert search.search_documents(docs.where("false"), queries).count() == 0
    assert search.search_documents(docs, queries.where("false")).count() == 0
    three = search.search_documents(docs, queries, top=3).collect()
    assert sorted(map(str, map(tuple, three))) == sorted(map(str, brute_search(rows, items, 3)))


def test_best_of_equals():
    scores = np.array([5, 0, 7, 5, 5, 0, 9, 5])
    assert sorted(search.best(scores, 4).tolist()) == [0, 2, 3, 6]  # of four with 5 the first two
    assert search.best(scores, 8).tolist() == [0, 2, 3, 4, 6, 7] and search.best(np.zeros(20, np.int64), 3).tolist() == []


# ---- 13 ----


def brute_codes(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    step = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(v, p), books[p])[1] for _, v, _ in kept]
            for e in set(own):
                some = [cut(v, p) for (_, v, _), o in zip(kept, own, strict=True) if o == e]
                books[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in kept]
    total = Counter()
    for _, n, lab in found:
        total[lab] += sum(d for d, _ in n)
    return [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), total[lab], digest) for i, n, lab in found]


def test_vector_codes(spark):
    rng = random.Random(11)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 0.1)]) for _ in range(8)], rng.choice([None, 0, 1])) for k in range(90)]
    rows += [(200, None, 1), (201, [None, *[0.1] * 7], 1), (202, [float("nan"), *[0.1] * 7], 1), (203, [float("inf"), *[0.1] * 7], 1), (4, rows[4][1], 5), (4, rows[5][1], 5), (None, rows[6][1], None)]
    want = {n: sorted(map(str, brute_codes(rows, entries=n))) for n in (1, 16, 256)}
    rows += [(300, [0.1] * 7, 1), (301, [0.1] * 12, 1), (302, [], 1), (303, [1e30] * 8, 1)]  # dropped as they cannot be cut, or held, like the others
    df = spark.createDataFrame([(i, v, lab, "c") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string").repartition(4)
    for n, expected in want.items():
        got = vector_codes.compress_vectors(df, entries=n)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == expected
    assert vector_codes.compress_vectors(df.where("false")).count() == 0
    assert vector_codes.compress_vectors(df.where("vec_id = 302")).count() == 0


@pytest.mark.parametrize("spread", [1, 3, 5000])
def test_filter_keeps_the_nearest(spread):
    """Bounds enclose every distance, and the filter finds what an exhaustive search does, ties included."""
    rng = np.random.default_rng(spread)
    entries, queries = rng.integers(-spread, spread + 1, (200, 6)), rng.integers(-2 * spread, 2 * spread + 1, (3000, 6))
    found = vector_codes.VaFile(entries)
    distance = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    lower, best, upper = found.bounds(queries)
    assert (lower.T <= distance).all() and (distance[np.arange(3000), best] <= upper).all()
    codes, least = found.nearest(queries)
    assert (codes == distance.argmin(1)).all() and (least == distance.min(1)).all()
    if spread == 5000:  # and leaves most entries out
        assert (lower <= upper).mean() < 0.3


def test_sums_survive_many_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*[((F.col("id") % 7) / 8 + k).cast("float") for k in range(4)]).alias("embedding"), (F.col("id") % 2 == 0).alias("label"))
    out = vector_codes.compress_vectors(df, entries=7).agg(F.sum("error"), F.count_distinct("code"), F.count_distinct("label_error")).first()
    assert tuple(out) == (0, 7, 1)
