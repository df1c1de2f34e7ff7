"""Vector search, URL rules and main text against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from compare import DATA, canonical, tables

from pyspark.sql import functions as F

from chatguard.llm import maintext, queries as Q, urlrules, vafile


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), tables(DATA).execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert canonical(got) == canonical(want)


def _brute(rows, asked, k):
    out = set()
    for q, v in asked.items():
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block,cells", [(3, 2), (50, 16), (10_000, 256)])
def test_exact_search(spark, block, cells, monkeypatch):
    monkeypatch.setattr(vafile, "_SLICE", 1500 if block == 3 else 1 << 25)
    rng = random.Random(block)
    rows = {i: [rng.randint(-9, 9) for _ in range(6)] for i in range(120)} | {i: [1, 2, 3, 4, 5, 6] for i in range(120, 140)} | {200: [5], 201: [7], 202: [0]}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, vec array<long>")
    frame = frame.union(frame.filter("vec_id % 10 = 0"))
    asked = frame.filter("vec_id % 7 = 0 or vec_id > 118")
    got = vafile.exact_top_k(frame, asked, k=5, block_rows=block, cells=cells).collect()
    assert {tuple(r) for r in got} == _brute(rows, {i: v for i, v in rows.items() if i % 7 == 0 or i > 118}, 5)


def test_bounds_hold_every_product():
    rng = np.random.default_rng(8)
    for high in (3, 300, 1 << 20, 1 << 28):
        rows, asked = rng.integers(-high, high, (200, 24)), rng.integers(-high, high, (30, 24))
        (block,) = vafile._blocks(iter([pd.DataFrame({"ids": [[k] for k in range(200)], "vec": list(rows)})]), 500, 256)
        cells = vafile.Cells(24, *(block[c][0] for c in ("codes", "low", "width")))
        base, under, over = cells.bounds(asked.astype(float))
        products = asked @ rows.T
        assert (base + under[:, None] <= products).all() and (products <= base + over[:, None]).all()
        assert high < 100 or (over - under).mean() < 0.1 * np.ptp(products)


def test_search_reads_few_exact_vectors():
    rng = np.random.default_rng(9)
    rows, asked = rng.integers(-256, 256, (4000, 16)), rng.integers(-256, 256, (20, 16))
    frames = list(vafile._blocks(iter([pd.DataFrame({"ids": [[k] for k in range(4000)], "vec": list(rows)})]), 1000, 256))
    some = vafile.Asked(list(range(10_000, 10_020)), list(asked))
    bounds = pd.concat(list(vafile._scan_bounds(iter(frames), some, 6)))
    some.raise_floors(bounds.groupby("query_id")["bound"].nsmallest(1).reset_index().rename(columns={"bound": "floor"}))
    read = []
    add = vafile.Best.add
    try:
        vafile.Best.add = lambda self, q, s, i: read.append(len(q)) or add(self, q, s, i)
        got = pd.concat(list(vafile._scan_exact(iter(frames), some, 5)))
    finally:
        vafile.Best.add = add
    assert sum(read) < 20 * 4000 * 0.05 and len(got) == 100


def test_search_skips_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [-0.001, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", vafile.scaled("embedding").alias("vec"))
    assert {(r[0], r[2], r[3]) for r in vafile.exact_top_k(frame, frame).collect()} == {(1, 7, 128 * -1 + 64 * 256), (7, 1, 128 * -1 + 64 * 256)}
    assert vafile.exact_top_k(frame.filter("1 = 0"), frame).count() == 0
    assert vafile.exact_top_k(frame.filter("vec_id = 1"), frame.filter("vec_id = 1")).count() == 0


def test_url_rules(spark):
    urls = [
        (1, "https://EXAMPLE.org/es/1"), (2, "http://a.example.org/en/12?x=1"), (3, "http://x.org/"), (4, "http://x.org"), (5, "ftp://b.com/fr/x#y"), (6, "http://b.com/de/"), (7, None), (8, "no scheme org/es/"),
        (9, "http://notexample.org/es/"), (10, "http://cheap-pills.net/"), (11, "http://a.net/Login?x"), (12, "http://com/de/x"), (13, "http://evil.net/?u=http://b.com/de/"), (14, "http://b.com:80/de/"), (14, "http://b.com:80/de/"), (15, ""), (16, "://"),
    ]
    frame = spark.createDataFrame([(i, u, "old") for i, u in urls], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge_urls(frame).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: ("com/fr/", "allow"), 6: ("com/de/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/", "allow"), 10: (None, "block"), 11: (None, "block"), 12: ("com/de/", "block"), 13: (None, "allow"), 14: (None, "allow"), 15: (None, "allow"), 16: (None, "allow")}
    assert urlrules.judge_urls(frame).count() == len(urls)
    assert urlrules.judge_urls(frame.filter("1 = 0")).count() == 0
    named = urlrules.judge_urls(frame.withColumn("__said", F.lit("mine"))).collect()
    assert {r["__said"] for r in named} == {"mine"} and {r["page_id"]: (r["rule"], r["verdict"]) for r in named} == got


def test_host_and_path_are_apart(spark):
    urls = [(1, "http://foo.net/x.org\n/"), (2, "http://a\n.org/es/"), (3, "http://foo.net\n.com/de/x"), (4, "http://x.example.org/\nes/")]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urlrules.judge_urls(frame).collect()} == {1: None, 2: "org/", 3: "com/de/", 4: "org/"}


def test_many_rules_equal_plain_loop(spark):
    rng = random.Random(5)
    hosts = [f"{rng.choice(['shop', 'news', 'img', 'my-site'])}{k % 700}.{rng.choice(['com', 'net', 'org', 'co.uk'])}" for k in range(50_000)]
    rules = list({(h, p): urlrules.PathRule(rng.choice(["allow", "block"]), h, p) for h in hosts for p in [rng.choice(["/", "/a/", "/a/b", "/a/b/c", f"/{rng.randrange(30)}/", "/%C3/"])]}.values())
    rules += [urlrules.PathRule("block", f"h{k}.example", f"/p{k}/") for k in range(50_000 - len(rules))]
    free = [urlrules.PatternRule("block", "w", r"[/.-]win-now[/.-]", "win-now"), urlrules.PatternRule("allow", "i", r"//img\d", "img"), urlrules.PatternRule("block", "z", r"\?.*zz", "zz")]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice([rng.choice(hosts), f'h{rng.randrange(60_000)}.example', 'else.where'])}{rng.choice(['', '/', '/a/b/c/d', '/a/x', f'/{rng.randrange(30)}/y', f'/p{rng.randrange(60_000)}/', '/x-win-now/', '?zz', '/%C3/x'])}" for _ in range(3000)]
    urls.append("http://h1.example/p1/" + "x/" * 200_000)
    by_host = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)

    def plain(url):
        rest = url.split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0]
        path = rest[len(host):].split("?")[0]
        labels = host.split(".")
        fit = [r for k in range(len(labels)) for r in by_host.get(".".join(labels[k:]), []) if path.startswith(r.path)]
        if fit:
            best = min(fit, key=lambda r: (-len(r.host) - len(r.path), r))
            return best.host + best.path, best.verdict
        return None, "block" if any(x + "win-now" + y in url for x in "/.-" for y in "/.-") else "block" if "zz" in url.partition("?")[2] else "allow"

    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge_urls(frame, base_rules=rules, pattern_rules=[free[0], free[2]]).collect()}
    assert got == {k: plain(u) for k, u in enumerate(urls)}
    assert len({v for v, _ in got.values()}) > 100


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header><p>Site head, with, many, commas, in it and a rather long line of words</p></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class="cookie-notice"><p>We use cookies, really, many, of, them, and tell you so at length</p></div><div id=wrap>{body}</div>
<aside><p>Side, side, side, side, side, side, side text that is long enough to score well</p></aside><div class="comments"><p>First, comment, here, with, commas, and some more words to be long</p></div>
<form><label>Name</label><input></form><footer>&copy; All</footer></body></html>"""


@pytest.mark.parametrize("body,text", [
    ("<article><h1>Head &amp; more</h1><p>One, two <b>th</b>ree<br>four.<p>Next&nbsp;one,\n  here</p></article>", "Head & more One, two three four. Next one, here"),
    ("<div><p>One, two, three and some text, to score.</p><p>Second, paragraph.</p><div class='ad'>Buy</div></div>", "One, two, three and some text, to score. Second, paragraph."),
    ("<main><section><p>Alpha, beta, gamma, delta.</p></section><section><p>Short</p></section></main>", "Alpha, beta, gamma, delta. Short"),
    ("<article><p>Text, with &lt;tags&gt; &#233;<!-- <p>not</p> --></p><ul><li>item one<li>item two</ul><blockquote>Quote</blockquote></article>", "Text, with <tags> é item one item two Quote"),
])
def test_main_text(body, text):
    assert maintext.main_text(PAGE.format(body=body)) == text


def test_layout_wrappers_and_siblings():
    said = "<p>One, two, three and some text, to score, at length.</p><p>Second, paragraph, of it.</p>"
    plain = "One, two, three and some text, to score, at length. Second, paragraph, of it."
    for name in ("site has-sidebar", "content no-sidebar", "page with-header", "post-share"):
        assert maintext.main_text(PAGE.format(body=f"<div class='{name}'><article>{said}</article></div>")) == plain, name
        assert maintext.main_text(f"<body><div class='{name}'>{said}</div><div class='ad'><p>Buy</p></div></body>") == plain, name
    assert maintext.main_text(PAGE.format(body=f"<article>{said}</article><div class='share'><p>Share, this, now</p></div>")) == plain
    long = "<div>" + "<p>Some, text, with, commas, that, is, long, enough, to, score, well.</p>" * 3 + "</div>"
    got = maintext.main_text(f"<body>{long}<h2>Head</h2><p>Short one.</p><div><p>Tiny.</p></div><p><a href=x>link</a></p>{long}</body>")
    assert "well. Head Short one. Tiny. Some" in got and "link" not in got


def test_main_text_survives():
    assert maintext.main_text(None) == maintext.main_text("") == ""
    assert maintext.main_text("just words, no markup") == "just words, no markup"
    assert maintext.main_text("<p>open <b>never <i>closed") == "open never closed"
    deep = "<div>" * 5000 + "<p>Deep, down, here</p>"
    assert maintext.main_text(deep) == "Deep, down, here"
    rng = random.Random(1)
    for _ in range(200):
        maintext.main_text("".join(rng.choice(["<p>", "</p>", "<div>", "</", "<", ">", "<!--", "-->", "<script>", "a,b ", "<a href='x>", "&amp", "<li>"]) for _ in range(30)))


def test_main_text_column(spark):
    frame = spark.createDataFrame([(1, None, "old"), (2, "<p>a, b</p>", "old"), (2, "<p>a, b</p>", "old")], "page_id long, html string, main_text string")
    assert sorted((r["page_id"], r["main_text"]) for r in maintext.extract_main_text(frame).collect()) == [(1, ""), (2, "a, b"), (2, "a, b")]
    assert maintext.extract_main_text(frame.filter("1 = 0")).count() == 0


def test_pages_of_the_table(spark):
    rows = Q.op9_main_text(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id")
    rows = rows.filter(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1) != "").select("text", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("head"), "html").collect()
    assert rows and all(r["text"].startswith(r["head"].strip().split("&")[0][:20]) for r in rows)


_A, _B = "First part, with some, commas and words.", "Second part, with more, commas and words."

# What stands between the two parts of the article, and what of it belongs to the text.
GOLDEN = [
    *[(f"<{t}>Menu, one, two, three</{t}>", "") for t in ("nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset")],
    *[(f"<div class='{c}'>Page, furniture, of a kind.</div>", "") for c in ("ad", "ads", "ad-slot", "google-ads", "adsBox", "sidebar", "left-sidebar", "cookie-notice", "notice", "comments", "comment-list", "user-comments", "nav-menu", "breadcrumbs", "newsletter", "siteFooter", "promo", "share")],
    *[(f"<div class='{c}'>Part, of the article.</div>", "Part, of the article.") for c in ("legal-analysis", "has-sidebar", "no-comments", "text", "lead-in", "header-image-caption-text-x", "download", "adventure", "shadow")],
    *[(f"<section id='{c}'><p>{'Prose of the article, ' * 4}ends here.</p></section>", f"{'Prose of the article, ' * 4}ends here.") for c in ("social-policy", "related", "search", "share-of-income", "discussion", "legal")],
    ("<div class=related><a href=1>One more story</a> <a href=2>And another story to read</a></div>", ""),
    ("<div role=navigation>a, b</div>", ""), ("<div hidden>a, b</div>", ""), ("<div role=note>a, b</div>", "a, b"),
    ("<script>var a='<p>no</p>'</script>", ""), ("<style>p{}</style>", ""), ("<noscript><p>Turn it on</p></noscript>", ""), ("<svg><title>icon</title><text>x</text></svg>", ""), ("<template><p>t</p></template>", ""),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<object>Fallback, text</object>", "Fallback, text"), ("<canvas>no</canvas>", ""),
    ("<table><tr><th>Head<td>1, 2<tr><td>3</table>", "Head 1, 2 3"), ("<dl><dt>Term<dd>Meaning</dl>", "Term Meaning"), ("<ol><li>one<li>two<ol><li>deep</ol></ol>", "one two deep"), ("<pre>a  b\n  c</pre>", "a b c"),
    ("<h2>Sub &amp; title</h2>", "Sub & title"), ("<figure><img src=x><figcaption>Caption</figcaption></figure>", "Caption"), ("<p>a<br>b</p>", "a b"), ("<p>x<sub>2</sub>y</p>", "x2y"), ("<p>&eacute;&#x41;&#66;&nbsp;c</p>", "éAB c"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<!-- <p>no</p> -->", ""), ("<?php x ?>", ""), ("<![CDATA[x]]>", ""), ("<p title='a > b'>quoted</p>", "quoted"), ("<p it's>odd sign</p>", "odd sign"), ('<p class="never closed>lost</p><p>also "here">kept</p>', "kept"),
    ("<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>", ""), ("<ul><li>with, words <a href=1>a</a><li>more<li>most</ul>", "with, words a more most"),
    ("<textarea>typed</textarea>", ""), ("<iframe>old</iframe>", ""), ("<p>open <b>bold <i>both</p>", "open bold both"), ("</span></em>", ""), ("<p>a</p></p><p>b</p>", "a b"),
]


@pytest.mark.parametrize("inner,text", GOLDEN)
def test_golden_pages(inner, text):
    want = " ".join(x for x in (_A, text.strip(), _B) if x)
    assert maintext.main_text(PAGE.format(body=f"<article><p>{_A}</p>{inner}<p>{_B}</p></article>")) == want


@pytest.mark.parametrize("tag", ["svg", "math", "object", "noscript", "canvas", "audio", "video", "script", "style", "iframe", "textarea"])
def test_unclosed_elements_lose_no_paragraph(tag):
    assert maintext.main_text(f"<body><article><p>{_A}</p><{tag}><p>{_B}</p></article></body>") == f"{_A} {_B}"


def test_pages_take_linear_time():
    import time

    for page in (lambda n: "<blockquote>" * n + "<p>Deep, text</p>", lambda n: "<a x='y\">" * n + "text", lambda n: "<div>" * n + "</x>" * n, lambda n: "<svg>" * n, lambda n: '<a x=">' * n + "<" * n, lambda n: "<script>" * n, lambda n: "word, " * (20 * n)):
        began = time.perf_counter()
        maintext.main_text(page(8000))
        assert time.perf_counter() - began < 1.5


def _plain_points(root):
    """Scores by the definition: every paragraph's whole text is read again and given to its ancestors."""
    points = {}
    for node in maintext._walk(root):
        texts = []
        left = [node]
        while left:
            one = left.pop()
            if isinstance(one, str):
                texts.append(one)
            elif not one.cut:
                left += one.parts
        own = [p for p in node.parts if isinstance(p, str) and p.strip()] if node.tag in ("div", "section", "article", "main", "body", "html") else []
        said = own or texts
        size = sum(len(t.strip()) for t in said)
        if size and (own or node.tag in maintext._PARAGRAPH):
            score = 1 + sum(t.count(",") for t in said) + min(size / 100, 3)
            line = [node if own else node.parent, node.parent if own else node.parent and node.parent.parent]
            for share, up in zip((1.0, 0.5), line, strict=True):
                if up is not None:
                    points[up] = points.get(up, maintext._BETTER.get(up.tag, 0.0)) + share * score
    return points


def test_tree_scores_equal_plain_definition():
    rng = random.Random(3)
    for _ in range(100):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<blockquote>", "</blockquote>", "<section>", "</section>", "word, word ", "a sentence of text. ", "<b>bold</b>"]) for _ in range(60))
        root = maintext.parse(page)
        want, seen = _plain_points(root), {}
        nodes = maintext._walk(root)
        maintext._measure(nodes)
        keep = maintext._kept
        try:
            maintext._kept = lambda best, fair, seen=seen: seen.update(score=fair(best)) or [best]
            maintext.main_text(page)
        finally:
            maintext._kept = keep
        fair = [want[n] * (1 - n.linked / n.size if n.size else 0) for n in nodes if n in want and n.tag not in ("a", "p")]
        assert seen.get("score") == (pytest.approx(max(fair)) if fair else None)


LONG = "The council met on Tuesday, heard three reports, and agreed on a plan for the old bridge, which had been closed since spring. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div id=a><p>{LONG}</p><p>{LONG}</p></div><p>Short final words.</p><div class=footer>gone</div></body>", f"{LONG}{LONG}Short final words."),
        (f"<body><div id=a><p>{LONG}</p></div><p>One.</p><div class='ad-slot'>buy</div><p>Two.</p></body>", f"{LONG}One. Two."),
        (f"<body><div id=a><p>{LONG}</p></div><p><a href=x>More stories from here</a></p><p>After a link list.</p></body>", LONG),
        (f"<body><h1>Bridge plan agreed</h1><p>By Robin Doe</p><div id=a><p>{LONG}</p></div></body>", f"Bridge plan agreed By Robin Doe {LONG}"),
        (f"<body><h1>Bridge plan agreed</h1><nav>Home</nav><div>3 May</div><h2>Again</h2><div id=a><p>{LONG}</p></div></body>", f"Bridge plan agreed 3 May Again {LONG}"),
        (f"<body><p>By Robin Doe</p><div id=a><p>{LONG}</p></div></body>", LONG),
        (f"<article><p>{LONG}</p><h2>Sources</h2><ul><li><a href=1>First report</a><li><a href=2>Second report</a><li><a href=3>Third report</a></ul></article>", f"{LONG}Sources First report Second report Third report"),
        (f"<article><p>{LONG}</p><ul class=related><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></article>", LONG),
        (f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><div><p>{LONG}</p></div></body>", LONG),
    ],
)
def test_no_part_of_the_article_is_lost(page, text):
    assert maintext.main_text(page) == " ".join(text.split())
