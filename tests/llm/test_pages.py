"""Archives and main text on small pages, and the pipeline's contract."""

import base64
import gzip
import hashlib
import html
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from tabscope.llm import boosting, dom, extract, warc

SCHEMA = "page_id long, url string, html string, payload string, main_text string"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    big = "".join(random.Random(1).choices("abcdefgh <>&é\n", k=300_000))
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/%20 é\r\nX: y", ""), (5, "u", big), (5, "u", big), (6, "v", "<p>é</p>"),
            (None, "w", "<p>x</p>"), (None, None, "only"), (7, "t", "tie"), (7, "s", "tie"), (7, "s", "tie")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    letters = random.Random(3)
    rows = [(i, "u", "".join(letters.choices("abcdefgh", k=40_000 if i % 10 == 0 else 300))) for i in range(60)] + [(100, "v", None), (101, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/warc"
    warc.write_archives(pages, path, per_archive=20, archive_bytes=100_000)
    held = [sum(len(r.block) for r in warc.read_records(f.read_bytes())) for f in sorted(tmp_path.glob("warc/part-*"))]
    assert len(held) >= 5 and max(held) < 100_000 + 20 * 200
    got = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, path).collect()}
    assert got == {i: len(h or "") for i, _, h in rows}


def test_archives_round_trip(spark, pages, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write_archives(pages, path, per_archive=3)
    got = warc.read_archives(spark, path).collect()
    rows = [tuple(r)[:3] for r in pages.collect()]
    assert len(got) == len(rows)
    best = {}
    for p, _, h in rows:
        best[h or ""] = max((x for x in (best.get(h or ""), p) if x is not None), default=None)
    assert sorted((str(r["page_id"]), str(r["url"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (str(p), str(u), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, u, h in rows)
    for text, page in best.items():
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        mine = [r for r in got if r["payload_digest"] == digest]
        stored = [r for r in mine if r["record_type"] == "response"]
        assert len(stored) == 1 and stored[0]["page_id"] == page and bytes(stored[0]["payload"]) == text.encode() and stored[0]["digest_ok"]
        assert all(r["refers_to"] == page and r["payload"] is None for r in mine if r["record_type"] == "revisit")


def test_archives_are_plain_gzip_members(spark, pages, tmp_path):
    path = tmp_path / "warc"
    warc.write_archives(pages.filter("page_id in (1, 2, 6)"), str(path))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(path.glob("part-*")))
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"WARC-Type: revisit") == 1


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    warc.write_archives(pages, f"{tmp_path}/w", min_bytes=100)
    got = warc.read_archives(spark, f"{tmp_path}/w", payloads=False)
    assert got.filter("record_type = 'revisit'").select("page_id").collect() == [(5,)] and "payload" not in got.columns


def test_long_record_keeps_its_padding():
    member = gzip.compress(warc.record(1, "u", b"x" * (17 << 20), None))
    assert member[-1] != 0
    assert len(next(warc.read_records(member + b"\0")).block) > 17 << 20


@pytest.mark.parametrize("harm", ["cut", "digest", "length"])
def test_broken_archives_are_refused(harm):
    good = warc.record(1, "u", b"payload", None)
    if harm == "cut":
        data = gzip.compress(good)[:-9]
    elif harm == "digest":
        data = gzip.compress(good.replace(b"payload\r\n", b"pAyload\r\n"))
    else:
        data = gzip.compress(good + b"more")
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(data))


def test_empty_archives(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_reader_of_untidy_html():
    page = dom.Page("<p>a<p>b <b>c</b>d<br>e<script>if (x<y) '<p>'</script><ul><li>f<li>g</ul><!-- h --><div class='x y' id=z>i &amp; j&lt;</div><p>k<unclosed")
    assert [t for t in page.text if t] == ["a", "b cd e", "f", "g", "i & j<", "k<unclosed"]
    assert page.tokens[page.tag.index("div")] == ("div", "x", "y", "z")
    assert dom.Page("").tag == ["#page"] and dom.Page("<script>never closed").text == [""]


@pytest.mark.parametrize("name", ["video", "audio", "canvas", "object", "svg", "select", "template"])
def test_reader_goes_on_after_an_unclosed_element(name):
    page = dom.Page(f"<article><p>before</p><{name} class=x><p>after</p><{name}><p>end</p></article>")
    assert [t for t in page.text if t] == ["before", "after", "end"]
    assert [t for t in dom.Page(f"<p>a</p><{name}>gone</{name}><p>b</p>").text if t] == ["a", "b"]


def test_reader_keeps_the_text_of_math():
    page = dom.Page("<p>where <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds</p><p>next</p>")
    assert [t for t in page.text if t] == ["where x=2 holds", "next"]


HARD = {
    "quotes never closed": '<a b="' * 30_000, "quotes and ends": "<a b=\"x'>" * 30_000, "sections and stray ends": "<section>" * 20_000 + "</article>" * 20_000, "inline never closed": "<font>x" * 30_000,
    "no end": "<!x" * 60_000, "brackets": "<" * 200_000, "scopes in scopes": "<li><p>a<ul>" + "<x-y>" * 30_000, "raw never closed": "<svg>" * 30_000, "comments": "<!--" * 50_000,
    "nested": "<div>t" * 30_000, "headings": "<h1>a<p>b" * 20_000, "attributes": '<div class="' + "nav " * 50_000 + '">t</div>',
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_time_grows_with_the_page(name):
    """Ten times the page takes no more than some thirty times as long, where a square would take a hundred."""
    def seconds(source):
        start = time.perf_counter()
        extract.features(dom.Page(source))
        return time.perf_counter() - start

    part, whole = HARD[name][: len(HARD[name]) // 10], HARD[name]
    seconds(part)
    assert seconds(whole) < 30 * max(seconds(part), 0.01)


def test_reader_closes_what_a_tag_ends():
    page = dom.Page("<ul><li>a<div>b</div><li>c<ul><li>d</ul></section><li>e</ul><p>f<div>g<p>h</div>i")
    got = [(t, page.tag[page.parent[i]]) for i, t in enumerate(page.text) if t]
    assert got == [("a", "li"), ("b", "div"), ("c", "li"), ("d", "li"), ("e", "li"), ("f", "p"), ("g", "div"), ("h", "p"), ("i", "#page")]
    assert [t for t in dom.Page('<p class="x>one</p><p>two</p>').text if t] == ["one", "two"]


@pytest.fixture(scope="module")
def small_model(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    return extract.train(sorted(r["html"] for r in rows), layouts=3)


def test_extraction_of_pages_never_trained_on(spark, small_model):
    seen = {r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(900).collect()]
    rows = [h for h in rows if h not in seen and re.search("<article>(.*?)</article>", h, re.S)]
    texts = extract.extract(small_model, [h.encode() for h in rows])
    assert len(rows) > 500 and np.mean([a == article(h) for a, h in zip(texts, rows)]) > 0.97


def test_short_pages_headings_captions_and_comments(small_model):
    body = "<h1>A title here</h1><p>First paragraph of this article, with words.</p><ul><li>one item of it</li><li>two item</li></ul><pre>x = 1</pre><figure><figcaption>A caption of it.</figcaption></figure>"
    talk = "".join(f"<div><b>{n}</b><p>I like this text, it is a good one.</p></div>" for n in ("Ann", "Bob"))
    sources = {
        "<div><p>Short news today.</p></div>": "Short news today.",
        f"<article>{body}</article>": "A title here First paragraph of this article, with words. one item of it two item x = 1 A caption of it.",
        "<p>&lt;b&gt; R&amp;D</p>": "<b> R&D",
        "<nav><a href=x>Home</a></nav><form><input><button>Go</button></form>": "",
        '<div class="menu"><a>Home</a> <a>News</a></div><p>Body text, a short one.</p><div class="footer">&copy; us</div>': "Body text, a short one.",
        **{f'<article><h1>T</h1><p>A real paragraph of an article. It has two sentences, and a comma.</p><div {k}>{talk}</div></article>': "T A real paragraph of an article. It has two sentences, and a comma."
           for k in ('id="responses"', 'class="comment-list"', 'id="discussion"', 'class="replies"')},
    }
    assert extract.extract(small_model, [s.encode() for s in sources]) == list(sources.values())


def article(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    body = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br|div)\b[^>]*>", " ", body))
    return " ".join(html.unescape(body).split())


def test_extraction_of_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = extract.train(sorted(r["html"] for r in rows.limit(60).collect()), layouts=3)
    texts = extract.extract(model, [r["html"].encode() for r in rows.collect()])
    right = [a == article(r["html"]) for a, r in zip(texts, rows.collect())]
    assert np.mean(right) > 0.97
    unseen = ("<body><header><h1>Site</h1><nav><a href=a>x</a></nav></header><main><h1>Title</h1><p>Some text of the article, it is good.</p><p>More text, and more again.</p></main>"
              "<div class='cookie-banner'><p>We use cookies to make the site better, please accept.</p></div></body>")
    odd = extract.extract(model, [None, b"", b"<p>", unseen.encode(), b"\xff<p>x" * 3])
    assert odd[:3] == ["", "", ""] and odd[3] == "Title Some text of the article, it is good. More text, and more again."


def test_decoding_keeps_nothing_inside_a_dropped_block():
    page = dom.Page("<div><p>aaaa</p></div><div><p>bbbb</p></div>")
    odds = np.array([1, -9.0, 2, 2, 3, 1, 1])
    keep = extract.decode(page, odds)
    assert all(keep[p] for p, k in zip(page.parent[1:], keep[1:]) if k)
    assert extract.main_text(page, odds) == "bbbb"


def test_extraction_query_edges(spark, pages):
    got = extract.report(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == pages.count()
    assert all(len(r["text"]) == r["n_chars"] for r in got.collect())
    assert extract.report(pages.limit(0)).count() == 0


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = boosting.Boosted(trees=30).fit(x[:2000], y[:2000], np.ones(2000))
    assert ((model.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
    step, seen = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, FOLDER).cache()
        seen.append(step.count())
        if k < 4:
            assert step.columns == docs.columns
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.collect())) == sorted(map(str, step.collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
