import base64
import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from viewtide.llm import html_main, warc

PAGES = "page_id bigint, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_records_and_revisits(spark):
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(
        ["one", "two", "one", None, "", "one", "é" * 700, "é" * 700, "a\r\n\r\nb\r\n", "\r\n\r\n"] + ["hot"] * 30)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "digest": F.lit(2), "keeper": F.lit(3)})
    got = {r.page_id: r for r in warc.archive(df, chunk_bytes=64).collect()}
    keeper = {}
    for i, _, t in rows:
        keeper[t or ""] = i
    assert len(got) == len(rows)
    for i, url, t in rows:
        last = keeper[t or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len((t or "").encode()), sha(t), url)
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))


def test_small_payloads_are_all_stored(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    got = {r.page_id: r.record_type for r in warc.archive(df, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("size", [4, 7, 33, 1 << 20])
def test_exact_round_trip(spark, tmp_path, size):
    """Payloads that end in line breaks look like the end of a record."""
    texts = ["abc\r\n", "\r\n\r\n", "", None, "é😀" * 50 + "\r\n\r\n" + "x" * 30 + "\r\n", "\r\n", "\r", "a\r\n\r",
             "\r\n\r\n\r\n\r\n\r\n", "\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nx"]
    rows = [(i, None if i % 2 else "http://x/\r\ny", t) for i, t in enumerate(texts)] + [(None, "u", "no id"), (2, "u", "again")]
    warc.write_archive(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"), size)
    chunks = collections.defaultdict(list)
    for r in warc.read_archive(spark, str(tmp_path / "w")).collect():
        assert len(r.data.encode()) <= size
        chunks[r.page_id, r.url].append(r)
    clean = {(i, u and u.replace("\r", "%0D").replace("\n", "%0A")): t or "" for i, u, t in rows}
    assert len(chunks) == len(clean) == len(rows)
    for key, parts in chunks.items():
        parts.sort(key=lambda r: r.chunk)
        text, done = clean[key], ""
        for r in parts:
            done += r.data
            assert (r.payload_bytes, r.payload_digest) == (len(done.encode()), sha(done))
        assert done == text and [r.last for r in parts] == [False] * (len(parts) - 1) + [True]


def test_empty_archive(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).collect() == []


def test_damage_is_found():
    record = next(warc.segments(1, b"u", b"payload", None, 100, b"2000-01-01T00:00:00Z"))
    reader = warc.Reader(True)
    rows = record.replace(b"payload", b"pavload").split(warc.END)
    with pytest.raises(ValueError, match="differs"):
        for row in rows:
            reader.feed(row)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href=x>Home</a></header><nav><ul><li><a href=y>Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now, it is a very good product and you will like it a lot.</div>
<article><header><h1>A title &eacute;</h1></header><p>Short.</p><p>One is&nbsp;long
enough<br>to be text &lt;b&gt; &amp; more.<div class="ad">buy</div><p class="notice">We use cookies</p><ul><li>one</li></ul>
<section class="comments"><p>First! This is a reader comment, and it is quite long. It has sentences. Yes.</p></section></article>
<aside><p>Something else that is long enough to be text, but stands at the side.</p></aside>
<form><label>name</label><input></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE)[0] == "A title é\nShort.\nOne is long enough to be text <b> & more.\none"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>hello there, this is <b>unclosed", "hello there, this is unclosed"), ("<div", ""),
    ("<article><p>cut &am", "cut &am"), ("<article>a<p>b</p>c</article>", "a\nb\nc"), ("<script>alert(1)", "")])
def test_odd_pages(page, text):
    assert html_main.main_text(page)[0] == text


def test_long_page():
    body = "".join(f"<p>Paragraph {i} is here. And more text.</p><div class=ad>x{i}</div>" for i in range(5000))
    text, found, kept = html_main.main_text(f"<article>{body}</article>")
    assert (found, kept) == (10000, 5000) and text.count("\n") == 4999


BODY = "<article><p>A sentence that is long enough to be text.</p><p>And another one, also long enough.</p></article>"


@pytest.mark.parametrize("before, after", [
    ("<svg viewBox='0 0 1 1'/>", ""), ("<math/>", ""), ("<SVG class='share' />", "<svg><text>x</text></svg>"),
    ("<button class='share'>", ""), ("<button>Share", "<button>Menu</button>"), ("<div><button></div>", "<p></button>"),
    ("<svg><path>", "<svg></svg>"), ("<div><video src=x></div>", "</video>"), ("<div><object></div>", ""), ("<canvas>", ""),
    ("<select><option>one</option>", ""), ("<svg><svg/><text>x</text></svg>", ""), ("<div><audio><audio></div>", "</audio>"),
    ("<svg><foreignObject><p>label</p></foreignObject></svg>", ""), ("<button><p>Share</p></button>", "<select>x</select>")])
def test_elements_that_are_not_closed_take_no_article(before, after):
    alone = html_main.main_text(BODY)[0]
    got = html_main.main_text(f"<body>{before}{BODY}{after}</body>")[0]
    assert alone.count("\n") == 1 and got == alone


def test_many_elements_that_are_not_closed():
    assert html_main.main_text("<video><button><svg>" * 50_000 + BODY)[0] == html_main.main_text(BODY)[0]


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], PAGES).withColumn("text", F.lit("x"))
    rows = html_main.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in rows)[0] == (0, 0, 0)
    assert len({r.text for r in rows}) == 2 and len(rows) == 3
    assert html_main.extract(df.limit(0)).collect() == []


def test_minimum_cut_against_all_labellings():
    import itertools
    import random
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(label):
            return (sum(max(g, 0) for g, yes in zip(gain, label) if not yes) + sum(max(-g, 0) for g, yes in zip(gain, label) if yes)
                    + sum(w for a, b, w in edges if label[a] != label[b]))

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_main.minimum_cut(gain, edges)) == pytest.approx(best)


RAW = "script|style|noscript|template|textarea|iframe|title"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z", re.I | re.S)


def test_markup_is_that_of_the_plain_pattern():
    rng = random.Random(8)
    bits = ["<a ", '<a href="x">', "</a>", '<div class="ad">', "</div>", "text & more", '"', "'", ">", "<", "<!--", "-->", "<script>", "</script>",
            '<script src="a>b">', "<svg/>", "</svg >", "<!doctype", "<?x", "</", "</p", "</title  >", "<title>", "<1", "<b\n", "<textarea", "<a-b:c d='>'>"]
    for _ in range(5000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        want = [(m.start(), m.end(), m.group(2) or "", m.group(3), m.group(4) or "") for m in MARKUP.finditer(page)]
        assert [tuple(m) for m in html_main.markup(page)] == want


@pytest.mark.parametrize("page", [
    "<a " * 350_000 + '"' + ">x", "<div>" * 95_000 + "</nav>" * 95_000, "<a '" * 260_000 + "<p>x", "<a \"'<b '" * 116_000, "<a " * 350_000,
    "<!--" * 260_000, "</" * 500_000, "<" * 1_000_000, "<svg><p>" * 130_000, "<script>" + "</script " * 116_000, "<p " + "a=b " * 260_000 + ">x"])
def test_unbalanced_pages_take_linear_time(page):
    begin = time.perf_counter()
    html_main.blocks(page)
    assert time.perf_counter() - begin < 8      # one or two seconds of a free machine
