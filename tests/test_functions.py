import datetime
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import chunking, html, policy, text, urls, vectors

LIGHTHOUSE = """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>  Lamp &amp;	 Lens </title><style>b{color:red}</style></head><body><header>Menu, search</header><main><nav>Skip</nav>
<h1>The keeper's   log</h1><div>Oil was carried up<br>every evening, <b>without</b> fail.</div><table><tr><td>1881</td><td>new lens</td></tr></table>
<p>A second paragraph<p>and a third, unclosed<script>if (a < b) { "</main>" }</script><aside>Related</aside></main><footer>1999</footer></body></html>"""
LIGHTHOUSE_LINES = ["The keeper's log", "Oil was carried up", "every evening, without fail."]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_page_to_text():
    title, content = html.clean(LIGHTHOUSE)
    lines = content.split("\n")
    assert title == "Lamp & Lens" and lines[:3] == LIGHTHOUSE_LINES and lines[-2:] == ["A second paragraph", "and a third, unclosed"]
    assert not {"Menu, search", "Skip", "1999"} & set(lines) and "</main>" not in content and "color" not in content


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<article><h1>Tides</h1>at noon</article>", ("Tides", "Tides\nat noon")),
        ("<p>salt<p>wind<ul><li>a<li>b</ul>", (None, "salt\nwind\na\nb")),
        ("<p>up<br>down</p>", (None, "up\ndown")),
        ("", (None, "")),
        ("<article>outer</article><main><h1>inner</h1></main>", ("inner", "inner")),
    ],
)
def test_clean(page, expected):
    assert html.clean(page) == expected


def shape(node):
    """A tree on one line; html and body are left out."""
    if isinstance(node, str):
        return node
    inner = "".join(map(shape, node.children))
    return inner if node.tag in ("#document", "html", "body") else f"{node.tag}({inner})"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        # formatting that crosses a block is parted
        ("<em>tide<p>high</em>low</p>end", "em(tide)p(em(high)low)end"),
        ("<em>tide<i>ebb<p>high</em>low", "em(tide" + "i(ebb))i(p(em(high)low))"),
        ("<p>one<u>two<i>three</u>four</i>five</p>", "p(oneu(twoi(three))i(four)five)"),
        ("<a>1<div>2<div>3</a>4</div>5</div>", "a(1)div(a(2)div(a(3)4)5)"),
        ("<a>one<a>two", "a(one)a(two)"),
        # formatting that is not closed goes on, three times at most
        ("<p><tt>x<p>y", "p(tt(x))p(tt(y))"),
        ("<p><s><s><s><s><p>y", "p(s(s(s(s()))))p(s(s(s(y))))"),
        ("<table><tr><td><tt>x<td>y</table>z", "table(tbody(tr(td(tt(x))td(y))))z"),
        # what a table cannot hold goes before it
        ("<table>up<tr>side<td>in</table>after", "upsidetable(tbody(tr(td(in))))after"),
        ("<table><tt><tr><td>in</td></tr>out</table>after", "tt()tt(out)table(tbody(tr(td(in))))tt(after)"),
        ("<table> <tr> <td>in</td> </tr> </table>", "table( tbody(tr( td(in) ) ))"),
        ("<table><tr><td><table>x<tr><td>i</table>o</table>", "table(tbody(tr(td(xtable(tbody(tr(td(i))))o))))"),
        ("<table><tr><td>a<table><tr><td>b</table></table><table><table>", "table(tbody(tr(td(atable(tbody(tr(td(b))))))))table()table()"),
        ("<table><col><tr><td>x<tbody><td>y</table>", "table(colgroup(col())tbody(tr(td(x)))tbody(tr(td(y))))"),
        ("<table><caption>k<tr><td>v", "table(caption(k)tbody(tr(td(v))))"),
        ("<table><tr><td>v</p></caption></table>", "table(tbody(tr(td(vp()))))"),
        ("<td>x<tr>y</table>z", "xyz"),
        # a paragraph holds a table only in pages without a document type
        ("<p>x<table><tr><td>y</table>z", "p(xtable(tbody(tr(td(y))))z)"),
        ("<!DOCTYPE html><p>x<table><tr><td>y</table>z", "p(x)table(tbody(tr(td(y))))z"),
        ("<ul><li>x<div><li>y<section><li>z</ul>", "ul(li(xdiv())li(ysection(li(z))))"),
        ("<h1>x<h2>y</h1>z", "h1(x)h2(y)z"),
        ("<object><b>x</object>y", "object(b(x))y"),
    ],
)
def test_tree(page, expected):
    assert shape(html.parse(page)) == expected


def test_read_page(spark):
    pages = [LIGHTHOUSE, "<em>tide<p>high</em>low</p>end", "<table>lost<tr><td>kept</table>", "", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, h string")
    got = df.select("i", html.read_page(F.col("h")).alias("p")).select("i", "p.title", "p.content", "p.tables").orderBy("i").collect()
    assert [(r.title, r.content) for r in got] == [html.clean(p or "") for p in pages] and got[1].content == "tidehighlow\nend" and got[2].content == "lostkept"
    assert [[t.asDict() for t in r.tables] for r in got] == [html.tables(p or "") for p in pages] and got[2].tables[0]["rows"] == [["kept"]]


def test_tree_is_sound():
    """Pages of random tags: each node once, below its parent, and all text kept in some order."""
    rng = random.Random(12)
    tags = "a b i p div table tr td th tbody caption colgroup li h1 h2 span form template object button nobr".split()
    for _ in range(3000):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", rng.choice("xyz")]) for _ in range(rng.randrange(1, 40)))
        root, seen = html.parse(page), set()
        for node in root.walk():
            assert id(node) not in seen and any(c is node for c in node.parent.children)
            seen.add(id(node))
        assert sorted(root.text()) == sorted(html.re.sub("<[^>]*>", "", page))


def test_clean_deep_pages(spark):
    deep = "<div>" * 50_000 + "<nav>no</nav>core" + "</div>" * 50_000
    assert html.clean(deep) == (None, "core")
    assert html.clean("<b><i>" * 20_000 + "x<title>t</title>") == ("t", html.clean("<b><i>x<title>t</title>")[1])
    assert html.links(deep + '<a href="/x">x</a>', "https://a.example/", "https://a.example") == ["https://a.example/x"]
    assert html.tables("<div>" * 5000 + "<table><tr><th>k</th></tr><tr><td>v</td></tr></table>")[0]["rows"] == [["v"]]


def test_normalize_text_native_and_plain(spark):
    rng = random.Random(4)
    alphabet = "ab  \t\n\r  ﻿ \x0b"
    samples = ["  one  two \r\n \n three ", ""] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(text.normalize_text(F.col("t"))).collect()]
    assert got == [html.normalize_text(s) for s in samples]
    assert got[0] == "one two\nthree"


RIVERS = """<table><caption> Long  rivers </caption><thead><tr><th>Name</th><th>km</th></tr></thead><tbody><tr><td>Loire</td><td>1006</td></tr>
<tr><td>&nbsp;</td><td></td></tr><tr><td>Oder <i>(Odra)</i></td><td>840</td></tr></tbody></table>"""


def test_tables(spark):
    rows = [["Loire", "1006"], ["Oder (Odra)", "840"]]
    assert html.tables(RIVERS) == [{"caption": "Long rivers", "headers": ["Name", "km"], "rows": rows}]
    df = spark.createDataFrame([(RIVERS,), ("no table",)], "h string")
    got = [r[0] for r in df.select(html.serialize_tables(html.extract_tables(F.col("h")))).collect()]
    assert got == ["\n".join(["Structured tables:", "Table 1: Long rivers", "Name | km", *map(" | ".join, rows)]), ""]


def test_tables_without_head():
    # the first row of th cells gives the headers, wherever it stands
    late, none = html.tables("<table><tr><td>before</td></tr><tr><th>k</th><th>v</th></tr><tr><td>p</td><td>q</td></tr></table><table><tr><td>alone</td></tr></table>")
    assert late["headers"] == ["k", "v"] and late["rows"] == [["before"], ["p", "q"]] and none["headers"] == [] and none["rows"] == [["alone"]]


def test_table_limits():
    wide = "<tr>" + "<td>n</td>" * (html.MAX_CELLS + 7) + "</tr>"
    [rows, *others] = html.tables("<table>" + "<tr><td>" + "w" * (html.MAX_CELL + 5) + "</td></tr>" + wide * (html.MAX_ROWS + 3) + "</table>" + "<table><tr><td>o</td></tr></table>" * (html.MAX_TABLES + 4))
    assert len(others) == html.MAX_TABLES - 1 and len(rows["rows"]) == html.MAX_ROWS
    assert len(rows["rows"][0][0]) == html.MAX_CELL and len(rows["rows"][1]) == html.MAX_CELLS


def test_links():
    here, origin = "https://harbour.example/log/", "https://harbour.example"
    kept = ["/tides?y=2020", "july/", "../map#north", "//harbour.example/a/../b"]
    dropped = ["", "#top", "ftp://harbour.example/x", "https://other.example/log", "sms:123", "data:,x", "/chart.zip", "https://user:pw@harbour.example/"]
    page = "".join(f"<p><a href='{h}'>t</a>" for h in [*kept, *dropped, *kept[:2]])
    page += '<a download href="/raw">t</a><a href="/paid" rel="sponsored nofollow">t</a><a>t</a>'
    assert html.links(page, here, origin) == [f"{origin}/tides?y=2020", f"{origin}/log/july/", f"{origin}/map", f"{origin}/b", here]
    based = '<base href="{}"><a href="one">t</a>'
    assert html.links(based.format("/deep/er/"), here, origin) == [f"{origin}/deep/er/one"]
    assert html.links(based.format("https://other.example/"), here, origin) == [f"{origin}/log/one"]
    assert html.links('<head><meta content="NoFollow" name=robots></head><a href="/one">t</a>', here, origin) == []


@pytest.mark.parametrize(
    ("value", "options", "expected"),
    [
        ("hTTps://Harbour.EXAMPLE:443/Log?q=B&q=a#end", {}, "https://harbour.example/Log?q=B&q=a"),
        ("http://harbour.example:8080", {}, "http://harbour.example:8080/"),
        ("./a/./c/../d?", {"base_url": "http://harbour.example/x/y"}, "http://harbour.example/x/a/d?"),
        ("?only=query", {"base_url": "http://harbour.example/x/y?z"}, "http://harbour.example/x/y?only=query"),
        ("http://[2001:DB8::7]/", {}, "http://[2001:db8::7]/"),
        ("http://0300.0250.1/", {}, "http://192.168.0.1/"),
        ("http://harbour.example/ñ 1", {}, "http://harbour.example/%C3%B1%201"),
        ("\\\\pier.example/x", {"base_url": "https://harbour.example/"}, "https://pier.example/x"),
    ],
)
def test_normalize_url(value, options, expected):
    assert urls.normalize(value, **options) == expected


@pytest.mark.parametrize(
    ("value", "options", "code"),
    [
        ("\t", {}, "EMPTY_URL"),
        ("log/july", {}, "INVALID_URL"),
        ("http://har bour.example", {}, "INVALID_URL"),
        ("http://keeper@harbour.example/", {}, "CREDENTIALS_NOT_ALLOWED"),
        *[(v, {}, "UNSUPPORTED_PROTOCOL") for v in ("gopher://harbour.example/", "tel:+331", "blob:x", "about:blank", "ws://harbour.example/")],
        ("http://harbour.example/", {"allowed_origin": "https://harbour.example"}, "EXTERNAL_ORIGIN"),
        ("https://harbour.example/log.7Z#x", {}, "DOWNLOADABLE_URL"),
        ("https://harbour.example/?" + "k" * 3000, {}, "URL_TOO_LONG"),
    ],
)
def test_rejected_url(value, options, code):
    assert urls.try_normalize(value, **options) == (None, code)


def test_origin(spark):
    assert urls.origin("HTTP://Harbour.example:80/x?y") == "http://harbour.example"
    assert one(spark, urls.url_origin(F.lit("http://k:p@Harbour.example:81/x"))) == "http://harbour.example:81"


def test_chunks_of_short_texts():
    assert chunking.chunk("") == chunking.chunk(" \n \t") == []
    assert [c[1:2] + c[3:] for c in chunking.chunk("  one tide  ")] == [("one tide", 2, 10)]


def test_chunks_of_even_words():
    value = " ".join(["lanterns"] * 500)  # cells of nine units
    found = chunking.chunk(value)
    for before, after in zip(found, found[1:]):
        assert 990 < before[4] - before[3] <= 1000
        assert before[3] % 9 == after[3] % 9 == 0 and abs(before[4] - after[3] - 150) <= 9
    assert found[-1][4] == len(value) and all(c[1].startswith("lanterns") and c[1].endswith("lanterns") for c in found)


def test_chunks_end_at_paragraphs():
    value = "\n\n".join("tide " * 38 + "end" for _ in range(30))
    assert all(c[1].endswith("end") for c in chunking.chunk(value))


def test_chunk_invariants():
    rng = random.Random(9)
    for _ in range(60):
        value = "".join(rng.choice("ab \n\n \U0001f600é") * rng.randrange(1, 9) for _ in range(rng.randrange(400)))
        units = value.encode("utf-16-le")
        for target, overlap in ((100, 15), (37, 0), (1000, 150)):
            found = chunking.chunk(value, target, overlap)
            for c in found:
                assert units[2 * c[3] : 2 * c[4]].decode("utf-16-le") == c[1] and 0 < c[4] - c[3] <= target and c[1].strip(text.WHITESPACE) == c[1]
            covered = set().union(*[range(c[3], c[4]) for c in found]) if found else set()
            for i in range(len(units) // 2):
                if units[2 * i : 2 * i + 2].decode("utf-16-le", "replace") not in text.WHITESPACE:
                    assert i in covered
    with pytest.raises(ValueError):
        chunking.check_options(100, 100)


def test_retry(spark):
    now = F.lit(datetime.datetime(2026, 7, 24, 12, 0, 0))
    df = spark.createDataFrame([("5",), ("Fri, 24 Jul 2026 12:00:05 GMT",), ("invalid",), (None,), ("999999999",)], "v string")
    assert [r[0] for r in df.select(policy.retry_after_ms(F.col("v"), now)).collect()] == [5000, 5000, None, None, 86400000]
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (1, 7000), (40, None)], "n int, r long")
    assert [r[0] for r in df.select(policy.backoff_ms(F.col("n"), F.col("r"))).collect()] == [1000, 2000, 4000, 7000, 60000]


def test_unsafe_addresses(spark):
    bad = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.169.254", "0.0.0.0", "::1", "fd00::1", "::ffff:10.0.0.1", "100.64.0.1", "224.0.0.1", "not-an-ip", "2002::1"]
    good = ["8.8.8.8", "93.184.216.34", "2606:2800:220:1:248:1893:25c8:1946", "172.32.0.1"]
    assert all(map(policy.is_unsafe, bad)) and not any(map(policy.is_unsafe, good))
    four = [a for a in bad + good if a.count(".") == 3 and ":" not in a]
    df = spark.createDataFrame([(a,) for a in four], "a string")
    assert [r[0] for r in df.select(policy.unsafe_v4(F.col("a"))).collect()] == [policy.is_unsafe(a) for a in four]


def test_robots():
    body = "User-agent: webloom\nDisallow: /private\nAllow: /private/open\nDisallow: /*.cgi$\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /"
    ask = lambda path, agent="webloom/1.0", status=200: policy.robots_decision(body, status, f"https://example.com{path}", agent)
    assert ask("/") == (True, 2000, None) and ask("/private/x")[0] is False and ask("/private/open/x")[0] is True
    assert ask("/a.cgi")[0] is False and ask("/a.cgi?x")[0] is True and ask("/", "other")[0] is False
    assert ask("/private", status=429) == (True, None, None) and ask("/", status=503)[2] == "ROBOTS_UNREACHABLE"


def test_failures(spark):
    df = spark.createDataFrame([(429, "text/html"), (500, "text/html"), (200, "application/pdf"), (200, "Text/HTML; charset=x"), (304, None)], "s int, c string")
    assert [r[0] for r in df.select(policy.classify_http(F.col("s"), F.col("c"), F.lit(1))).collect()] == ["HTTP_429", "HTTP_PERMANENT", "UNSUPPORTED_CONTENT_TYPE", None, None]
    df = spark.createDataFrame([("ETIMEDOUT", ""), ("ENOTFOUND", ""), ("X", "maxContentLength size exceeded"), (None, None)], "c string, m string")
    assert [r[0] for r in df.select(policy.classify_network(F.col("c"), F.col("m"))).collect()] == ["NETWORK_TIMEOUT", "DNS_FAILURE", "RESPONSE_TOO_LARGE", "UNKNOWN"]


def test_prefixes_and_bounds(spark):
    assert one(spark, text.passage_text(F.lit(" passage: content "))) == "passage: content"
    assert one(spark, text.query_text(F.lit("PASSAGE:  content"))) == "query: content"
    assert one(spark, F.length(text.bounded_payload(F.lit('"' * 9000)))) <= 8192
    assert one(spark, text.grounding_title(F.lit("  "))) is None


def test_lengths_count_utf16_units(spark):
    wave, values = "\U0001f30a", ["abc", "\U0001f30a" * 10, "a\U0001f30ab\U0001f30a", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(text.utf16_length(F.col("v"))).collect()] == [3, 20, 6, 0]
    for n in range(8):
        got = [r[0] for r in df.select(text.utf16_prefix(F.col("v"), n)).collect()]
        for value, cut in zip(values, got):
            assert value.startswith(cut) and len(cut.encode("utf-16-le")) <= 2 * n
            assert cut == value or len((cut + value[len(cut)]).encode("utf-16-le")) > 2 * n
    assert one(spark, F.length(text.grounding_title(F.lit(wave * 300)))) == 100


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    got = [(r[0][0], r[0][1]) for r in df.select(vectors.normalized(F.col("v"), 2)).collect()]
    assert got[0] == ([0.6, 0.8], None) and [g[1] for g in got[1:]] == ["ZERO_MAGNITUDE", "DIMENSION_MISMATCH", "NOT_FINITE", "MISSING"]
    assert vectors.literal([1.0, 0.5]) == "[1.0,0.5]"


def plain_chunks(value, target, overlap):
    """Offsets of chunks of a text without characters of two units, read from the rules one unit at a time."""
    n, blank, out = len(value), set(text.WHITESPACE), []

    def solid(at, end):
        return next((k for k in range(at, end) if value[k] not in blank), end)

    at = solid(0, n)
    while at < n:
        full = min(n, at + target)
        least = min(full - 1, at + int(0.7 * target))
        places = range(full - 1, least - 1, -1)
        marks = [[k for k in places if value[k : k + 2] == "\n\n"], [k for k in places if value[k] == "\n"], [k for k in places if value[k] in blank]]
        cut = n if full == n else next((m[0] for m in marks if m), full)
        inside = [k for k in range(at, cut) if value[k] not in blank]
        begin, end = (inside[0], inside[-1] + 1) if inside else (cut, cut)
        if inside:
            out.append((begin, end))
        if cut == n:
            break
        ideal = max(begin + 1, end - overlap)
        reach = max(1, min(75, overlap // 3))
        near = sorted(range(max(begin + 1, ideal - reach), min(end - 1, ideal + reach) + 1), key=lambda k: (abs(k - ideal), k < ideal))
        behind = [[k for k in near if k > 1 and value[k - 2 : k] == "\n\n"], [k for k in near if value[k - 1] == "\n"], [k for k in near if value[k - 1] in blank]]
        following = solid(end if overlap == 0 else next((m[0] for m in behind if m), ideal), n)
        at = following if following > at else min(cut, at + max(1, target - overlap))
    return out


def test_chunks_of_many_texts_at_once(spark):
    rng = random.Random(12)
    values = ["".join(rng.choices(["a", "word", " ", "\n", "\n\n", "\t", "é", "  "], [rng.choice([1, 5, 20]) for _ in range(8)], k=rng.randrange(150))) for _ in range(300)]
    for target, overlap in ((1, 0), (3, 1), (10, 3), (20, 0), (60, 20), (40, 39)):
        got = {}
        for t, _, content, _, begin, end in chunking._chunked(values, target, overlap):
            assert values[t][begin:end] == content
            got.setdefault(t, []).append((begin, end))
        assert got == {t: found for t, v in enumerate(values) if (found := plain_chunks(v, target, overlap))}
    rows = spark.createDataFrame(list(enumerate([*values, None, "\U0001f600" * 700])), "id int, t string")
    chunks = chunking.chunk_documents(rows, "id", "t", 200, 30).collect()
    by = {}
    for r in chunks:
        by.setdefault(r.id, []).append((r.chunk_index, r.content, r.content_hash, r.start_offset, r.end_offset))
    assert by == {i: found for i, v in enumerate([*values, None, "\U0001f600" * 700]) if (found := chunking.chunk(v, 200, 30))}
    assert all("�" not in r.content for r in chunks)


def test_chunks_never_part_a_character():
    value = "a\U0001f600" * 40
    for target, overlap in ((1, 0), (2, 1), (5, 4)):
        found = chunking.chunk(value, target, overlap)
        assert all("�" not in c[1] for c in found) and found[-1][4] == 120
