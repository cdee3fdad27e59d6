"""Chat, classifier, pieces, pages, vectors and archives."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.conftest import prose
from tessera.llm import chat, classifier, html, knn, spm, warc
from tessera.llm.queries import ORACLE, QUERIES, TOKENIZER


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|>"), (1, 3, "ann", None), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "system", "alone"), (None, 0, "ann", "y"), (4, None, "ann", "z"), (4, 1, None, "w")]
    turns = spark.createDataFrame([(*r, "q") for r in rows], "conv_id bigint, turn bigint, role string, text string, speaker string")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "user", 0), (4, "ann", 0)}
    ann = got[1, "ann", 0]
    assert ann["text"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nHello < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["Hi<|im_end|>\n", "<|im_end|>\n"]
    assert got[2, "user", 0]["n_turns"] == 2 and got[2, "user", 0]["n_assistant"] == 2
    parts = chat.perspectives(turns, part=1).where("conv_id = 1 and perspective = 'ann'").orderBy("part").collect()
    assert "".join(p["text"] for p in parts) == ann["text"] and [p["part"] for p in parts] == [0, 1, 2, 3]
    assert chat.perspectives(turns.limit(0)).collect() == []


def test_classifier_on_held_out_rows(spark):
    rows, grades = [], []
    for i in range(600):
        grade = i % 3
        text = prose(i, 60) + (" vile insult" if grade == 0 else " SPAM!! BUY!! NOW!!" if grade == 1 else "")
        rows.append((i, text, "c"))
        if i < 400:
            grades.append((i, grade))
    docs = spark.createDataFrame([*rows, (None, "x", "c"), (700, None, "c"), (701, "", "c"), (1, rows[1][1], "c")], "doc_id bigint, text string, tail string")
    labels = spark.createDataFrame([*grades, (None, 1), (5, None), (9999, 2), (0, 2)], "doc_id bigint, grade int")
    model = classifier.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = classifier.score(docs, model).collect()
    assert len(out) == docs.count()
    held = [(r["doc_id"] % 3 == 2) == (r["tail"] >= 0.5) for r in out if r["doc_id"] is not None and 400 <= r["doc_id"] < 600]
    assert np.mean(held) > 0.95
    kept = classifier.select(docs, model)
    assert kept.columns == docs.columns and 150 < kept.count() < 260
    none = classifier.train(docs, labels.limit(0))
    assert classifier.select(docs, none).count() == docs.count()
    assert classifier.score(docs.limit(0), model).collect() == []


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = ["Hello  world", "  a", "a\nb", " ", "", "x\ty \n", "é中🙂 Ａ", "▁a", "it's 2024", "\xa0a", "a" * 900, "ab" * 500 + " the " * 50, None, "\0x\0", prose(1, 2000), "hello " * 300]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0), (3, " ", 0)], "doc_id bigint, text string, n_tokens int")
    model = spm.model_bytes(spark, f"file://{TOKENIZER}")
    encoded = spm.encode(docs, model)
    got = {r["doc_id"]: r for r in encoded.where("doc_id is not null").collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["token_ids"]) == ([] if t is None else sp.encode(t)), t
        assert got[i]["n_tokens"] == len(got[i]["token_ids"])
        assert got[i]["round_trip"] == (None if t is None else "▁" not in t)
    back = {r[0]: r[1] for r in spm.decode(encoded.where("doc_id is not null"), model).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if t and "▁" not in t)
    assert encoded.count() == docs.count() and spm.encode(docs.limit(0), model).collect() == []


def test_cuts_of_long_parts_change_nothing():
    import random

    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    encoder = spm.Encoder(spm.Vocabulary(open(TOKENIZER, "rb").read()))
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefgheinst漢字仮名éüß🙂0123456789+/=") for _ in range(r.choice([401, 900, 3000]))) for _ in range(12)] + ["漢" * 2000, "the" * 700]
    ids, sizes, same = encoder.encode(texts)
    assert [ids[j - n : j].tolist() for n, j in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)] == [sp.encode(t) for t in texts] and all(same)
    assert max(map(len, encoder.v.cut("漢字仮名" * 100))) < 5


def test_long_parts_merge_alike():
    v = spm.Vocabulary(open(TOKENIZER, "rb").read())
    text = "▁" + "thequickbrownfox" * 60
    long = v.encode_parts([text])[0].tolist()
    spm.LONG, was = 10**6, spm.LONG
    try:
        assert v.encode_parts([text])[0].tolist() == long
    finally:
        spm.LONG = was


PAGES = [
    ("<html><body class='has-sidebar'><nav><a href=/>Home</a></nav><div id=post-12><h1>T&eacute;st  page</h1><p>First <b>bold</b>er<br>text<p>Second &amp; last with many words to win</div><div class='comments'><p>nice</p></div><footer>f</footer>", "Tést page\nFirst bolder text\nSecond & last with many words to win"),
    ("<body><header>Top</header><article><h2>A</h2><p>x y</p><script>var a='<p>no</p>'; if (a <b) {}</script><aside>no</aside><form>no</form><ul><li>one<li>two</ul><style>p{}</style></article><div class=ad>buy</div>", "A\nx y\none\ntwo"),
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p>unclosed <a href='x>broken</p><p>more", None),
    ("<!-- c --><body><main><p>m</p><section class='related posts'><p>r</p></section></main>", "m"),
]


def test_pages(spark):
    rows = [(i, f"http://h{i}.example/x", h, 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[1][0], 1), (1, "::bad::", PAGES[1][0], 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    got = html.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    for i, (_, want) in enumerate(PAGES):
        text = by[i, f"http://h{i}.example/x"]
        assert text is not None if want is None else text == want, (i, text)
    assert by[None, None] == PAGES[1][1] and by[1, "::bad::"] == PAGES[1][1]
    assert html.main_text(pages.limit(0)).collect() == []


def test_hosts_agree(spark):
    """A page on which a long sidebar without a telling name outweighs the text follows the host's other pages."""
    page = lambda a, b: f"<body><div class=words><p>{prose(a, 40 if a else 4)}</p></div><div class=extra><p>{prose(99, b)}</p></div>"
    rows = [(i, f"http://host.example/{i}", page(i, 2)) for i in range(1, 9)] + [(9, "http://host.example/9", page(0, 60))]
    got = {r[0]: r[2] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == prose(0, 4)


def plain_nearest(rows, k):
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for q, a in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        found = sorted((-float(np.cumsum([x * y for x, y in zip(a, b, strict=True)])[-1]), i) for i, b in ok if i != q and len(b) == len(a))
        out.update((q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1))
    return out


def test_nearest(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(90)]
    same = rows[0][1]
    rows += [(100 + i, same) for i in range(30)] + [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] + [1.0] * 7), (205, [float("inf")] * 8), (None, same), (206, [1.0, 2.0]), (220, [1e-30] * 8), (240, [1e6] * 8)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, id int").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block in (7, 1024):
        got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in knn.nearest(vectors, F.col("vec_id") % 20 == 0, k=5, block=block).collect())
        assert got == plain_nearest(exact, 5)
    wide = spark.createDataFrame([(i, None if v is None else [None if x is None else x / 3 for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    thirds = [(i, None if v is None else [None if x is None else x / 3 for x in v]) for i, v in rows]
    assert Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in knn.nearest(wide, F.col("vec_id") % 20 == 0, k=5).collect()) == plain_nearest(thirds, 5)
    assert knn.nearest(vectors.limit(0), F.lit(True)).collect() == []
    assert len(knn.nearest(vectors.where("vec_id < 3"), F.col("vec_id") == 0, k=20).collect()) == 2


def test_bounds_hold():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(50, 2000)), r.normal(size=(60, 2000))
    cx, sx, nx, ex = knn.quantise(x)
    cy, sy, ny, ey = knn.quantise(y)
    near = knn._code_products(cx, cy) * sx[:, None] * sy[None, :]
    off = ex[:, None] * (ny + ey)[None, :] + nx[:, None] * ey[None, :]
    assert (np.abs(near - x @ y.T) <= off).all()


def test_archive(spark):
    rows = [(1, "http://www.a.example/x?b=2&a=1", "<p>one</p>"), (2, "https://a.example/y", "<p>one</p>"), (3, "http://b.example/", None), (4, None, ""), (5, "http://a.example/x", "é" * 5000), (None, "http://a.example/z", "<p>one</p>"), (6, "bad url \n x", "six"), (6, "bad url \n x", "six")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, key string").repartition(2)
    archive, captures = warc.write_archive(pages)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive.read(captures).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(i, len(data), digest, "response", None) if i == last else (i, len(data), digest, "revisit", last)] += 1
    assert got == want
    found = archive.index().captures("https://a.example/y")
    assert [(f["warc-type"], f["payload"]) for f in found] == [("response", b"<p>one</p>")]
    assert archive.index().captures("http://nowhere.example/") == []
    empty, none = warc.write_archive(pages.limit(0))
    assert empty.read(none).collect() == [] and empty.index().captures("http://a.example/") == []


def test_archive_files_are_plain_gzip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a.example/", "x" * 100), (2, "http://b.example/", "y")], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archive(pages, folder=f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w" / "archive").iterdir()
    data = gzip.decompress(file.read_bytes())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLE[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><article><h1>T</h1><p>some words of text</p><p><a href=/x>a sentence that is a link</a></p><ul><li><a href='/s'>source</a></ul></article>", "T\nsome words of text\na sentence that is a link\nsource"),
        ("<body><div id=a><a name=top><p>one two three</p><a id=x/><p>four five</p><a href='/y'/><p>six</p></div>", "one two three\nfour five\nsix"),
        ("<body><div id=a><p><a href=/x>never closed</p><p>one two three four five</p><p>six seven</p></div>", "never closed\none two three four five\nsix seven"),
        ("<body><article><p><a href=/x>nothing but links</a></p></article>", "nothing but links"),
        ("<p><a href=/x>no container</a></p><p>text</p>", "no container\ntext"),
    ],
)
def test_links_of_the_article_stay(page, want):
    p = html.Page(page)
    assert p.text([p.key(x) for x in [p.vote()[0]] if x >= 0]) == want


def test_links_count_in_votes():
    linked = [n for _, n, _ in html.Page("<div><p><a href=/x>link</a></p><p><a name=y>open</p><p>text<p><a href=/z>open</p><p>text</div>").blocks]
    assert linked == [4, 0, 0, 4, 0]


def test_all_of_the_article_is_covered(spark):
    """Lists of most of the text, leads beside bodies, and text in wrappers, on hosts of one page and of many."""
    many = lambda i: "".join(f"<li>{prose(500 + 10 * i + k, 12)}" for k in range(6))
    recipe = lambda i: (f"<body><div class=menu><a href=/>Home</a></div><div class=content><h1>T{i}</h1><p>intro {i}</p><ul>{many(i)}</ul><p>end {i}</p></div>", [f"T{i}", f"intro {i}", *(prose(500 + 10 * i + k, 12) for k in range(6)), f"end {i}"])
    lead = lambda i: (f"<body><div class=lead>lead {i}</div><div class=wrap><div class=body><p>{prose(700 + i, 40)}</p></div></div>", [f"lead {i}", prose(700 + i, 40)])
    cell = lambda i: (f"<body><div><p>before {i}</p><table><tr><th>head {i}</th><td>{prose(800 + i, 40)}</td></tr></table></div>", [f"before {i}", f"head {i}", prose(800 + i, 40)])
    loose = lambda i: (f"<p>loose {i}</p><div class=x><p>{prose(900 + i, 40)}</p></div>", [f"loose {i}", prose(900 + i, 40)])
    rows, want = [], {}
    for n, kind in enumerate((recipe, lead, cell, loose)):
        for i in range(7):
            page, lines = kind(i)
            for j, host in enumerate((f"many{n}", f"one{n}x{i}")):
                rows.append((key := 100 * n + 10 * i + j, f"http://{host}.example/{i}", page))
                want[key] = "\n".join(lines)
    got = {r[0]: r[2] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got == want


def test_repeated_blocks_do_not_raise_the_path(spark):
    rows = [(i, f"http://host.example/{i}", f"<body><div class=words><p>{prose(i, 40)}</p></div><div class=extra><p>the same words</p></div>") for i in range(6)]
    got = {r[0]: r[2] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: prose(i, 40) for i in range(6)}


def test_parts_of_the_article_stay():
    page = (
        "<body><div class=site-header>Name</div><article class='post has-comments'><header class=entry-header><h1>T</h1></header><p>Long paragraph</p><figure><img src=x><figcaption>A caption</figcaption></figure>"
        "<p><a href=/x>Whole paragraph linked</a></p><div class='entry-header'><p>kept</p></div><p class='notice-of-motion'>Legal text</p><p class=discussion-paper>A paper</p><ul><li><a href=/r>Reference one</a></li></ul>"
        "<noscript>plain</noscript> <math><mi>x</mi><mo>=</mo></math><p>custom <x-y class=z>tag</x-y></p><div class='related-posts'>no</div><p class=notice>no</p><div id=td-comments-wrapper>no</div><ol class='reader-comments'><li>no</ol><div class=article__comment-list>no</div><div class='cookieBanner'>no</div>"
        "<div class=ad>no</div><svg><title>no</title></svg><footer>no</footer><form>no</form></article><div id=comments><article class=comment>no</article></div>"
    )
    lines = ["T", "Long paragraph", "A caption", "Whole paragraph linked", "kept", "Legal text", "A paper", "Reference one", "plain x=", "custom tag"]
    assert html.Page(page).text([]) == "\n".join(lines)
    assert html.Page(f"<body><form id=all>{page[6:]}</form>").text([]) == "\n".join(lines)
    assert html.Page("<div class=content-sidebar-wrap><div class=content><p>text</p></div><div class=sidebar>no</div></div>").text([]) == "text"


def test_paths_take_all_classes():
    """Containers that differ in a fourth class only are different paths."""
    one, two = (html.Page(f"<div class='a b c {x}'><p>text</p></div>") for x in ("d1", "e"))
    assert one.key(one.vote()[0]) != two.key(two.vote()[0])
    assert one.key(one.vote()[0]) == (p := html.Page("<div class='d2 b a c'><p>text</p></div>")).key(p.vote()[0])


def plain_main_text(node) -> list[str]:
    """The lines of a page given as a tree: (tag, attributes, children or text, whether it is of the article)."""
    lines, now = [], ""

    def walk(node):
        nonlocal now
        if isinstance(node, str):
            now += node
            return
        tag, _, children, wanted = node
        if not wanted:
            if tag in html.BLOCK:
                end()
            return
        if tag in html.BLOCK:
            end()
        for child in children:
            walk(child)
        if tag in html.BLOCK:
            end()

    def end():
        nonlocal now
        if now.split():
            lines.append(" ".join(now.split()))
        now = ""

    walk(node)
    end()
    return lines


def written(node, escape) -> str:
    if isinstance(node, str):
        return escape(node)
    tag, attrs, children, _ = node
    return f"<{tag}{attrs}>" + "".join(written(x, escape) for x in children) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(6))
def test_pages_made_of_trees(spark, seed):
    """Pages built from trees that say what is of the article, against those trees."""
    import random
    from html import escape

    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["alpha", "béta", "a < b", "R&D", "x\n\ty", '"q"', "5 > 4", "\xa0"]) + str(r.randrange(99)) for _ in range(n))

    def inline():
        kind = r.randrange(6)
        return words(r.randrange(1, 9)) if kind < 4 else (r.choice(["b", "em", "span", "code", "a href='/x>y'"]).split(" ")[0], r.choice(["", " class=x", " href='/a?b=1>2'"]), [words(2)], True)

    def block(depth=0):
        kind = r.randrange(9)
        if kind < 4 or depth > 3:
            return ("p", r.choice(["", " class=lead", " id=p7"]), [inline() for _ in range(r.randrange(1, 4))], True)
        if kind == 4:
            return (r.choice(["ul", "ol"]), "", [("li", "", [inline()], True) for _ in range(r.randrange(1, 4))], True)
        if kind == 5:
            return ("figure", "", [("figcaption", "", [words(4)], True)], True)
        if kind == 6:
            bad = r.choice([("aside", ""), ("div", " class=ad"), ("section", " id=comments"), ("nav", ""), ("form", ""), ("div", " class='newsletter-signup box'"), ("div", " style='display: none'"), ("script", "")])
            return (*bad, ["var x = 1;" if bad[0] == "script" else ("p", "", [words(5)], False)], False)
        return (r.choice(["div", "section", "blockquote"]), r.choice(["", " class='a b c d'", " class=notice-of-motion"]), [block(depth + 1) for _ in range(r.randrange(1, 4))], True)

    rows, want = [], {}
    for i in range(40):
        article = (["article", "main"][i % 2], "", [("h1", "", [words(3)], True), *(block() for _ in range(6))], True)
        page = ("body", "", [("nav", "", [("a", " href=/", ["Home"], True)], False), ("header", "", [words(2)], False), article, ("footer", "", [words(3)], False)], True)
        rows.append((i, f"http://h{i % 3}.example/{i}", "<!doctype html><!-- > -->" + written(page, escape if i % 3 else lambda t: t.replace("&", "&amp;").replace("<", "&lt;"))))
        want[i] = "\n".join(plain_main_text(article))
    got = {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got == want


@pytest.mark.parametrize(
    "page",
    ["<a" * 500_000, "<div>" * 100_000 + "x", "<div class=q>" * 100_000 + "x" + "</p>" * 100_000, "<a x=\"'>" * 100_000, "<script></script" * 60_000, "</" * 400_000, "<" * 1_000_000, "<p><table>" + "<button>" * 100_000 + "<h1></h1>" * 100_000, "<a '\">" * 100_000],
    ids=["open tags", "deep", "deep, other ends", "quotes", "scripts", "ends", "signs", "scopes", "odd quotes"],
)
def test_broken_pages_take_linear_time(page):
    import time
    import tracemalloc

    began = time.process_time()
    html.Page(page).text([])
    assert time.process_time() - began < 5
    if page.startswith("<div"):
        tracemalloc.start()
        html.Page(page).text([])
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()


def plain_chances(score, thresholds):
    """The probability of each grade."""
    above = [1.0, *(1 / (1 + math.exp(t - score)) for t in thresholds), 0.0]
    return [a - b for a, b in zip(above, above[1:], strict=False)]


@pytest.mark.parametrize("levels", [2, 3, 5])
def test_likelihood_and_its_gradient(levels):
    r = np.random.default_rng(levels)
    docs, size = 40, 12
    features = [np.unique(r.integers(0, size, r.integers(0, 6))) for _ in range(docs)]
    grades = r.integers(0, levels, docs)
    flat, row = np.concatenate(features).astype(int), np.repeat(np.arange(docs), [len(f) for f in features])

    def plain(params):
        thresholds = [params[size]]
        for gap in params[size + 1 :]:
            thresholds.append(thresholds[-1] + math.exp(gap))
        logs = [math.log(plain_chances(sum(params[j] for j in f), thresholds)[g]) for f, g in zip(features, grades, strict=True)]
        return -sum(logs) / docs + classifier.PENALTY / 2 * sum(x * x for x in params[:size])

    params = np.concatenate((r.normal(0, 1, size), [-0.7], r.normal(0, 0.5, levels - 2)))
    loss, gradient = classifier.objective(params, size, flat, row, grades, levels)
    assert math.isclose(loss, plain(params), rel_tol=1e-9)
    for k in range(len(params)):
        step = np.zeros(len(params))
        step[k] = 1e-5
        assert abs((plain(params + step) - plain(params - step)) / 2e-5 - gradient[k]) < 1e-7


def plain_features(text):
    words = (text or "").encode().split()
    if not words:
        return set()
    import re

    shape = lambda w: re.sub(rb"\d+", b"0", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", w)))
    names = set()
    for w in words:
        low = w.lower().strip(b".,;:!?\"'()")
        names |= {b"w" + low, b"4" + low[:4], b"6" + low[:6], b"s" + shape(w)}
    odd = sum(not re.fullmatch(rb"A?a?[.,;:!?]?", shape(w)) for w in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    names |= {b"fresh %d %d" % (min(len(words).bit_length(), 12), 10 * len(set(words)) // len(words)), b"odd %d" % (10 * odd // len(words)), b"again %d" % (10 * again // (len(words) - 1) if len(words) > 1 else 0)}
    return {classifier._hash(x) for x in names}


def test_scores_against_plain(spark):
    r = np.random.default_rng(4)
    model = classifier.Model(r.normal(0, 0.3, 1 << classifier.BITS).astype(np.float32), np.array([-1.0, 0.5]))
    rows = [*enumerate([None, "", " \n", "One two two 2.5 THREE... é", prose(1, 300), "a " * 50])]
    got = {x["doc_id"]: x for x in classifier.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for i, t in rows:
        chances = plain_chances(sum(float(model.weights[f]) for f in plain_features(t)), model.thresholds)
        assert math.isclose(got[i]["tail"], chances[2], rel_tol=1e-6) and math.isclose(got[i]["expected_grade"], chances[1] + 2 * chances[2], rel_tol=1e-6)
