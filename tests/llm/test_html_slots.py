"""Template classes of pages: nothing of an article is lost, all slots stay, and the classes decide rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from gatewarden.llm import html

OWN = [" ".join(f"w{k * 70 + j}" for j in range(50)) for k in range(6)]


def texts_of(spark, rows):
    got = html.with_main_text(spark.createDataFrame(rows, "url string, html string")).collect()
    return {r.url: r.main_text for r in got}


def test_no_article_text_is_lost(spark):
    rows, want = [], {}

    def add(url, page, text):
        rows.append((url, page))
        want[url] = text

    body = OWN[5] + " Second sentence of it."
    for k in range(4):
        heads = f"<h2>Introduction</h2><p>{OWN[k]}</p><h2>References</h2><p>ref {k} of them</p>"
        add(f"http://a.example/{k}", f"<body><div>Site name</div><article>{heads}</article></body>", f"Introduction\n\n{OWN[k]}\n\nReferences\n\nref {k} of them")
        add(f"http://b.example/{k}", f"<body><div>Site name</div><article><p>{body}</p><p>{OWN[4]}</p><p>Printed 12:0{k}</p></article></body>", f"{body}\n\n{OWN[4]}\n\nPrinted 12:0{k}")
        add(f"http://c.example/{k}", f"<body><div>Site name of all</div><section id=one><p>{OWN[k]}</p></section><section id=two><p>{OWN[k][:90].strip()} short</p></section></body>", f"{OWN[k]}\n\n{OWN[k][:90].strip()} short")
    assert texts_of(spark, rows) == want


def test_classes_decide_rows(spark):
    """A block named as content holds the site's own words; the text stands in a block without a name."""
    rows = [(f"http://d.example/{k}", f"<body><div class=content><p>We are a site about many things, since long ago, for all of you</p></div><div id=x{'y'}><p>{OWN[k]}</p></div></body>") for k in range(4)]
    got = texts_of(spark, rows)
    assert got == {u: OWN[k] for k, (u, _) in enumerate(rows)}
    for url, page in rows:  # without the classes, the names choose the site's own words
        assert html.extract(page) == "We are a site about many things, since long ago, for all of you" != got[url]


def test_classes_equal_brute_force(spark):
    """Shared texts, those that come with a layout, and slots of a small host, from occurrence vectors written out."""
    pages = {k: f"<body><div id=h>Head</div><div id=n><p>note {k % 2}</p></div><article><p>{OWN[k]}</p>{'<p>copied</p>' if k > 2 else ''}</article><div id=f>Foot</div></body>" for k in range(6)}
    vectors, sizes, layouts = defaultdict(lambda: defaultdict(int)), defaultdict(int), {}
    for k, page in pages.items():
        blocks, paths, above = html.read(page)
        layouts[k] = html._code("\n".join(sorted({html._container(p, above) for p in paths})))
        vectors[layouts[k], False][k] = 1
        for path, n in paths.items():
            vectors[html._code(path), False][k] = n
        for b in blocks:
            vectors[html._code(b.path + "\0" + b.text), True][k] = 1
    classes = defaultdict(set)
    for token, seen in vectors.items():
        if len(seen) >= html.PAGES:
            classes[tuple(sorted(seen.items()))].add(token)
    shared = {code for tokens in classes.values() for code, is_text in tokens if is_text}
    fixed = {code for tokens in classes.values() if any(not t for _, t in tokens) for code, is_text in tokens if is_text}
    for k, page in pages.items():
        blocks, _, above = html.read(page)
        for b in blocks:
            if not b.bad and html._code(b.path + "\0" + b.text) not in shared:
                sizes[html._code(b.main or html._container(b.path, above))] += len(b.text)
    slots = {c for c, n in sizes.items() if n >= max(sizes.values()) * html.SHARE}
    df = spark.createDataFrame([("h", k, p) for k, p in pages.items()], "host string, page long, html string")
    for r in html.templates(df).collect():
        blocks, _, _ = html.read(pages[r.page])
        own = {html._code(b.path + "\0" + b.text) for b in blocks}
        assert set(r.texts) == own & shared and set(r.fixed) == own & fixed and set(r.slots) == slots
    assert shared - fixed and fixed  # the note is shared by half of the pages only, head and foot by all


def test_given_pages_by_names_only(spark):
    """On the given pages the article elements lead to the same rows; the classes add the hosts' templates."""
    sf = "/root/testdata/sf0.001"
    got = html.with_main_text(spark.read.parquet(f"{sf}/pages.parquet")).select("html", F.col("main_text").alias("t")).collect()
    assert got and all(html.extract(r.html) == r.t for r in got)
