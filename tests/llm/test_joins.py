"""The Jaccard join, top-k search and HTML extraction against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listenlab.llm import html, jaccard, topk


def _brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
                if a != b:
                    links[i].add(b), links[j].add(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), len(links[i])) for i, (d, _) in enumerate(rows)), key=str)


def _near(seed, n_bases, copies):
    rng, rows = np.random.default_rng(seed), []
    for b in range(n_bases):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(1, 120))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 50)}"
            rows.append((b * copies + c + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_join(spark, docs, n, percent):
    rule = jaccard.Rule(n, percent)
    for rows in (_near(n, 30, 5), [(r.doc_id, r.text) for r in docs.collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.joined(df, rule).collect()]
        assert sorted(got, key=str) == _brute(rows, n, percent)


def test_large_group(spark, monkeypatch):
    """A group beyond the hot bound and the slice size, cut into slices."""
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "SLICE", 10)
    rows = _near(5, 2, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.joined(df).collect()]
    assert sorted(got, key=str) == _brute(rows, 3, 90)


def test_join_nothing(none):
    assert jaccard.joined(none).count() == 0


def test_representatives(spark, docs):
    kept = jaccard.representatives(docs, jaccard.Rule(5, 80))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 11, 4, 5, 6, 7, 8, 9, None]


def test_plan_covers_every_band():
    for percent in (50, 80, 90, 95):
        for b in range(25):
            m, u = jaccard.plan(percent, b)
            top = int(jaccard.bands(percent)[b + 1]) - 1
            h = top * (100 - percent) // percent
            assert (m, u) == (0, 0) if h == 0 else m + u > h and 0 <= u <= m


def _brute_top(rows, k):
    ok = [(n, i, np.floor(256 * np.array(v, float)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for m, j, v in ok if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def _found(df, **more):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, **more).collect())


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 20)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PACK", 3)
    monkeypatch.setattr(topk, "ROUNDS", (2, 5))
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 8))]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, []), (2200, [float("inf")] * 8), (2250, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, pivot string, score long")
    assert _found(df) == _brute_top(rows, 5)
    few = df.where("vec_id IN (0, 1, 2)")
    assert _found(few) == _brute_top(rows[:3], 5)
    assert topk.search(df.where("false")).count() == topk.search(df.where("vec_id = 1")).count() == 0


def test_top_k_of_repeated_rows(spark):
    rows = [(50 * (i % 3), [float(i % 2), 1.0]) for i in range(12)] + [(7, [1.0, 1.0])] * 2
    assert _found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == _brute_top(rows, 5)


def test_top_k_leaves_annuli_out(spark):
    """On clustered vectors most annuli are never visited."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (40, 16))
    rows = [(i, [float(x) for x in np.float32(centers[i % 40] + rng.normal(0, 0.05, 16))]) for i in range(6000)]
    report = {}
    assert _found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), report=report) == _brute_top(rows, 5)
    assert report["annuli"] >= 15 and report["visited"] < 0.5


def test_top_k_gathers_looks(spark, monkeypatch):
    """Where bounds part little, queries of all pivots meet annuli of all pivots in a few products, not in one for each two pivots."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 32))]) for i in range(3000)]
    trips, written = [], topk.written

    def spied(df, what):
        out = written(df, what)
        if what == "trips":
            trips.append(out.count())
        return out

    monkeypatch.setattr(topk, "written", spied)
    report = {}
    assert _found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), report=report) == _brute_top(rows, 5)
    assert report["visited"] > 0.5 and sum(trips) <= 4


def test_top_k_of_opposite_copies(spark):
    """Bounds of large negative scores are not rounded below the scores: the smallest ids stand in annuli of all rounds."""
    rows = [(0, [-4096.0, 0.0])] + [(i, [4096.0, float(i % 8)]) for i in range(1, 400)]
    assert _found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == _brute_top(rows, 5)


PAGE = """<html><head><title>t {n}</title><style>x</style></head><body><header>Site</header><div class="menu"><a>Home</a></div>
<div id="wrap"><div class="cookie-notice">We use cookies</div><main><h1>Title {n}</h1><p>First &amp; {n}
  words.</p><p>Shared line</p><ul><li>one {n}<li>two</ul><div class="share">Share this</div></main><aside>Other {n}</aside></div>
<section class="comments"><p>Nice {n}!</p></section><script>var x = "</p>{n}";</script><footer>&copy; {n}</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://Shop.example.com/{i}", PAGE.replace("{n}", f"number{i} " * (i + 1))) for i in range(8)]
    rows += [(20, "http://other.example", "<p>alone <b>bold<p>second&nbsp;x"), (21, None, "<div>no host</div>"), (22, "x", None), (23, "http://e.example/", ""), (20, "http://other.example", "<p>alone <b>bold<p>second&nbsp;x")]
    got = [(r.page_id, r.text, r.n_chars) for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    for i in range(8):
        n = " ".join([f"number{i}"] * (i + 1))
        # the line that all pages share is template text
        assert by[i] == f"Title {n}\nFirst & {n} words.\none {n}\n{'two'}".replace("\ntwo", "")
    assert by[20] == "alone bold\nsecond x" and by[21] == "no host" and by[22] == by[23] == ""
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_one_article_stay(spark):
    body = "<body><nav>Menu</nav><article>" + "".join(f"<p>The same paragraph number {i}.</p>" for i in range(6)) + "</article>"
    rows = [(i, "http://a.example/x", body + f"<footer>{i}</footer></body>") for i in range(8)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"\n".join(f"The same paragraph number {i}." for i in range(6))}


def _texts(spark, rows):
    return {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_of_every_host_and_layout(spark):
    # four pages that agree; a notice on nearly all pages; a rare layout on a host with many pages of another
    few = [(i, "http://few.example/", f"<body><div><a>Start</a></div><p>Read more at home</p><p>own text of page {'x' * i} is long enough</p></body>") for i in (1, 2, 3, 4)]
    most = [(i, "http://most.example/", f"<body><p>{'Shop closes early' if i < 21 else 'open'}</p><div id='post-{i}'><p>text {'y' * i} of a page</p></div></body>") for i in range(10, 22)]
    rare = [(i, "http://most.example/", f"<body><section><h2>Archive of old</h2><pre>old number {'z' * i} and so on</pre></section></body>") for i in range(31, 36)]
    got = _texts(spark, few + most + rare)
    assert got == {i: f"own text of page {'x' * i} is long enough" for i in (1, 2, 3, 4)} | {i: f"{'' if i < 21 else 'open' + chr(10)}text {'y' * i} of a page" for i in range(10, 22)} | {i: f"old number {'z' * i} and so on" for i in range(31, 36)}


def test_what_few_pages_say_is_content(spark):
    """Two of three pages of a host share a headline and a first paragraph, and class names say nothing."""
    page = "<body><div><div><h1>{h}</h1><p>{h} begins here and goes on for a while</p><p>The rest of page {i} is its own</p></div></div></body>"
    heads = ["Rain over the hills", "Rain over the hills", "Sun again"]
    rows = [(i, "http://small.example/", page.format(h=h, i=i)) for i, h in enumerate(heads)]
    want = {i: f"{h}\n{h} begins here and goes on for a while\nThe rest of page {i} is its own" for i, h in enumerate(heads)}
    assert _texts(spark, rows) == want
    # on a large host too, a headline of less than nearly all pages stays
    many = [(i, "http://large.example/", page.format(h=heads[i % 3], i=i)) for i in range(30)]
    assert _texts(spark, many)[1] == want[1] and len(_texts(spark, many)[3].split("\n")) == 3


def test_least_share(spark):
    cases = [(1, 1), (2, 2), (2, 3), (3, 3), (4, 4), (5, 6), (9, 10), (60, 100), (1, 100)]
    df = spark.createDataFrame(cases, "n long, total long")
    got = [r[0] for r in df.select(html.least_share(F.col("n"), F.col("total"))).collect()]
    assert [g > 0.5 for g in got] == [False, False, False, False, True, False, True, True, False]
    assert got == pytest.approx([_wilson(n, t) for n, t in cases])


def _wilson(n, total, z=1.96):
    """The smaller p at which n of total is z deviates away: a root of (n / total - p)^2 = z^2 p (1 - p) / total."""
    a, b, c = 1 + z * z / total, -(2 * n / total + z * z / total), (n / total) ** 2
    return (-b - (b * b - 4 * a * c) ** 0.5) / (2 * a)


def test_short_parts_and_slots_stay(spark):
    page = "<body><main><h1>Title {n}</h1><div><div>" + "long body {n} " * 60 + "</div><div>Short {n}</div></div></main></body>"
    body = " ".join(["long body 1"] * 60)
    assert html.extract(page.replace("{n}", "1")) == f"Title 1\n{body}\nShort 1"
    by = [(i, "http://by.example/", f"<body><article><p>By <b>writer {'w' * i}</b></p><p>{'text ' * i} of it, and more of the same</p></article></body>") for i in range(1, 7)]
    assert _texts(spark, by)[3] == "writer www\ntext text text of it, and more of the same"


SAME = """<body><div class="{cls}"><p>Welcome to the shop of all shops</p><p>Please log in to read</p></div><div id="x{n}"><p>Article {n} starts</p>{more}
<p>Article {n} ends</p></div><div><span>Imprint</span> <span>Terms of use</span></div></body>"""


def test_alignment_decides_without_lists(spark, monkeypatch):
    """Same-host pages with text at several places that is constant; no list of names or elements helps."""
    for name in ("FURNITURE", "NAMES", "AROUND", "ARTICLE"):
        monkeypatch.setattr(html, name, set())
    rows = [(i, "http://same.example/", SAME.format(cls="top", n=f"n{i}", more="".join(f"<p>part {k} of n{i} is long enough to be read</p>" for k in range(i)))) for i in range(2, 9)]
    for i, _, page in rows:
        got = html.extract(page, rows[0][2], _keys(rows))
        assert got == "\n".join([f"Article n{i} starts", *(f"part {k} of n{i} is long enough to be read" for k in range(i)), f"Article n{i} ends"])
    full = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.template_chars > 50 for r in full)


def _keys(rows):
    """Template keys by brute force: what pages that have a slot say there, so many that hardly less than half of all would."""
    slots, said = {}, {}
    for _, _, page in rows:
        runs, _ = html.read(page, rows[0][2])
        for slot, key in {(r[1], r[2]) for r in runs if r[2]}:
            slots.setdefault(slot, set()).add(page)
            said.setdefault((slot, key), set()).add(page)
    return frozenset(k for (s, k), p in said.items() if _wilson(len(p), len(slots[s])) > 0.5)


def test_template_against_brute_force(spark):
    rows = [(i, "http://same.example/", SAME.format(cls="side", n=f"n{i}", more="<p>all pages say this</p>" * (i % 10 > 0) + f"<p>but this is of n{i}</p>")) for i in range(20)]
    want = {i: html.extract(page, rows[0][2], _keys(rows)) for i, _, page in rows}
    model = min(rows, key=lambda r: r[0])
    assert "all pages say this" not in want[4] and model[0] == 0
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, layout long, wrapper string")
    assert {r.page_id: r.text for r in html.extracted(df).collect()} == want


def test_names_around_a_page_lose_nothing():
    body = "<article><h1>Head</h1><p class='alert'>Take care here</p><p>Some more text of it</p><div class='share'>Share it</div></article>"
    want = "Head\nTake care here\nSome more text of it"
    for names in ("layout has-sidebar", "sidebar-layout", "comment-free", "page"):
        assert html.extract(f"<body><nav>Menu</nav><div class='{names}'>{body}<div class='sidebar'>Other things</div></div><footer>End</footer>") == want
    assert html.extract(f"<body><form>{body}</form><form><p>Search</p></form>") == want


def test_deep_and_wide_pages(spark):
    deep = "<body>" + "<div>" * 5000 + "deep {n}" + "</div>" * 5000
    wide = "<body>" + "".join(f"<p>line {i} of {{n}}</p>" for i in range(10_000))
    rows = [(10 * k + i, f"http://h{k}.example/", t.replace("{n}", f"page {i}")) for k, t in enumerate((deep, wide)) for i in range(3)]
    got = _texts(spark, rows)
    assert got[1] == "deep page 1" and got[11] == "\n".join(f"line {i} of page 1" for i in range(10_000))


def _naive(a, b, p, q):
    if a.tags[p] != b.tags[q]:
        return 0
    x, y = a.kids[p], b.kids[q]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + _naive(a, b, u, v))
    return 1 + (a.own[p] == b.own[q] != "") + m[-1][-1]


def _tree(rng, depth):
    tag = rng.choice(["div", "span", "b"])
    inner = "".join(rng.choice(["x", "y", ""]) + _tree(rng, depth - 1) for _ in range(rng.integers(0, 4))) if depth else rng.choice(["x", "y", "z", ""])
    return f"<{tag}>{inner}</{tag}>"


def test_tree_matching_is_the_best():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = (html.outline(f"<main>{_tree(rng, 3)}{_tree(rng, 2)}</main>") for _ in range(2))
        known = html.match(a, b)
        assert known[0, 0][0] == _naive(a, b, 0, 0)
        assert len(set(html.aligned(a, b).values())) == len(html.aligned(a, b))


def test_tree_matching():
    a, b = html.outline("<div><p>x</p><ul><li>1<li>2</ul></div>"), html.outline("<div><h1>t</h1><p>y</p><ul><li>1<li>2<li>3</ul></div>")
    assert len(html.aligned(a, b)) == 6
