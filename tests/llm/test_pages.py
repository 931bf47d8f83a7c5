from __future__ import annotations

import base64
import gzip
import hashlib
import html
import random
import re
import time
import zlib
from html.parser import HTMLParser

import pytest

from tidemark.llm import html_extraction, queries, warc
from tidemark.llm.markup import blocks

PAGES = "page_id long, url string, html string"


def article(page):
    """The text of the article element of a page with nothing but p, h1, b and br in it."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    inner = re.sub(r"<[a-z/][^>]*$", "", m[1]) if m else ""
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_all_pages(spark, sf_dir):
    out = {r.page_id: r for r in queries.queries()["op9_html"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        assert out[p.page_id].text == article(p.html) and out[p.page_id].n_chars == len(article(p.html)) and out[p.page_id].url == p.url


def test_all_pages_without_the_tags_that_mark_an_article(spark, sf_dir):
    """article and main renamed to div: the template and the slots decide alone."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()
    out = extract(spark, [(p.page_id, p.url, re.sub(r"(</?)(article|main)\b", r"\1div", p.html)) for p in pages])
    assert sum(out[p.page_id] == article(p.html) for p in pages) >= 0.95 * len(pages)


MB = 1_000_000
HOSTILE = {
    "quote": "<a x " * (MB // 5) + '"', "open values": '<p class="' * (MB // 10), "deep": "<div>x" * (MB // 6), "deep marks": "<div class=ad>x" * (MB // 15), "deep forms": "<form><p>word word" * (MB // 18),
    "end tags": "<i><div>" + "<b>" * (MB // 6) + "</i>" * (MB // 8), "sections": "<div>" * (MB // 10) + "</section>" * (MB // 10), "attribute": "<p = " + "a" * MB + ">t", "number": "&#" + "9" * MB + ";",
    "lists": "<ul><li>x" * (MB // 9), "mains": "<main><p>x" * (MB // 10), "tables": "<table><tr><td>x" * (MB // 16), "brackets": "<" * MB, "script": "<script></script " * (MB // 17),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_pages_of_a_megabyte_take_seconds_however_deep_or_broken(name):
    began = time.process_time()
    found = list(blocks(HOSTILE[name]))
    html_extraction.main_text(found, [list(html_extraction.tokens(found))])
    assert time.process_time() - began < 20


def test_classes_are_valid_in_order_and_nested():
    assert html_extraction.in_order([5, 1, 2, 9, 3, 4]) == [1, 2, 4, 5] and html_extraction.in_order([]) == []
    assert html_extraction.nests([1, 10, 20], [12, 15]) and html_extraction.nests([12, 15], [1, 10, 20]) and html_extraction.nests([1, 2], [3, 4])
    assert not html_extraction.nests([1, 10, 20], [5, 12])
    found = list(blocks("<div class=a>top</div><p>own</p><div class=b>mid</div><p>own two</p><div class=c>end</div>"))
    a, own, b, two, c = (html_extraction.text_token(x) for x in found)
    assert html_extraction.template(found, [[a, b, c]]) == {a, b, c}
    assert html_extraction.template(found, [[b, a, c]]) == {a, c}  # one out of order
    assert html_extraction.template(found, [[c, a]]) == frozenset() and html_extraction.template(found, [[1, 2]]) == frozenset()
    assert html_extraction.template(found, [[a, c], [own, two]]) == {a, c, own, two}  # in one slot
    assert html_extraction.template(found, [[a, b], [own, two]]) == {a, b}  # across slots: the class of less support isn't valid


def test_two_layouts_of_a_host(spark):
    """Each layout has its own classes where they have enough support; one with less than that relies on the slot."""
    def page(k, side):
        text = " ".join(f"w{k}x{j}" for j in range(40))
        return f"<body><div class=x0>The Daily Page</div><div class={'x1' if side else 'y1'}><div>{text}</div><div>{text} two</div></div>" + ("<div class=x2>Ring us at noon</div>" if side else "") + "<div class=x3>All rights and lefts</div></body>"

    out = extract(spark, [(k, f"http://h.example/{k}", page(k, k % 4 > 0)) for k in range(16)])
    for k in range(16):
        text = " ".join(f"w{k}x{j}" for j in range(40))
        assert out[k] == f"{text} {text} two"


def extract(spark, rows, **options):
    return {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, PAGES), **options).collect()}


def test_what_is_left_out(spark):
    page = """<!doctype html><title>t</title><style>p{}</style><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div id=cookie-notice>We use cookies</div>
    <main><article><h1>Head &amp; <i>line</i></h1><p>One  two
three<p>Four&nbsp;five<br>six <script>var a = "<p>no</p>";</script><aside>side</aside><div class="ad-box ads">buy</div><form><input>name</form>
    <ul><li>item a<li>item b</ul><section class=comments><p>first!</p></section></article></main><div class="sidebar">links</div><footer>&copy; x</footer>"""
    out = extract(spark, [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/3", ""), (4, "x", "<p>cut off <a href='"), (5, "y", "plain &lt;text"), (6, "z", "<nav>only menu</nav>")])
    assert out[1] == "Head & line One two three Four five six item a item b"
    assert out[2] == out[3] == out[6] == "" and out[4] == "cut off" and out[5] == "plain <text"


def test_template_finds_the_slot_without_semantic_elements(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    page = lambda k: f"<body><div class=top>The Daily Page of all people and news</div><div class=x1><div>{words(k)}</div><div>{words(k + 1000)}</div></div><div class=x2>Call us today or write to us at any time</div></body>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(100, "http://other.example/", page(77)), (101, "http://h.example/0", page(0))]
    out = extract(spark, rows)
    assert all(out[k] == f"{words(k)} {words(k + 1000)}" for k in range(12)) and out[101] == out[0]
    found = html_extraction.templates(spark.createDataFrame(rows, PAGES)).collect()
    sizes = {r.host: (r.n_pages, sum(map(len, r.classes))) for r in found}
    assert sizes["h.example"][0] == 13 and sizes["h.example"][1] >= 4 and sizes["other.example"] == (1, 0)


def test_template_text_inside_a_marked_article(spark):
    page = lambda k: f"<body><article><h1>Head {k} of all</h1><p>Own text {k} one.</p><p>Read our letter every week.</p><div class=box>By the desk of the paper</div><p>Own text {k} two.</p></article></body>"
    out = extract(spark, [(k, f"http://h.example/{k}", page(k)) for k in range(8)] + [(100, "http://few.example/", page(100))])
    assert all(out[k] == f"Head {k} of all Own text {k} one. Own text {k} two." for k in range(8))
    assert "Read our letter" in out[100]


def test_the_slot_keeps_headlines_lists_and_links(spark):
    def page(k):
        teasers = "".join(f"<a href=/{k}{j}>See page {k} {j}</a><br>" for j in range(3))
        return f"""<body><div class=top>The Daily Page</div><div class=txt><h1>Head {k}</h1><p>{f"long{k} text " * 90}</p><p>Short {k}.</p><ul><li>item a {k}<li>item b {k}</ul><blockquote>Quote {k}</blockquote>
        <p><a href=/{k}>All of this paragraph {k} is a link</a></p><div class=part><p>Last {k}</p></div></div><div class=more>{teasers}</div></body>"""

    text = lambda k: " ".join(f"Head {k} {f'long{k} text ' * 90} Short {k}. item a {k} item b {k} Quote {k} All of this paragraph {k} is a link Last {k}".split())
    out = extract(spark, [(k, f"http://h.example/{k}", page(k)) for k in range(8)] + [(100, "http://few.example/", page(100))])
    assert all(out[k] == text(k) for k in (*range(8), 100))
    (only,) = extract(spark, [(1, "http://a.example", f"<div class=txt><div class=lead>Short lead</div><div class=all>{'word ' * 90}</div><ul><li>item</ul></div>")]).values()
    assert only.startswith("Short lead word") and only.endswith("word item")


WRAPS = ["form id=aspnetForm", "div class='layout sidebar-right'", "div id=page class=has-sidebar", "div class=search-page", "form id=f><div class='layout sidebar-right'"]


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("slot", ["article", "main", "div class=txt"])
def test_marks_around_the_main_slot_do_not_count(spark, wrap, slot):
    text = " ".join(f"word{j}" for j in range(60))
    name = slot.split()[0]
    inner = f"<div class=sidebar><p>Side text</p></div><{slot}><h1>Head</h1><p>{text}</p><form><p>Log in here</p></form><section class=comments><p>First!</p></section></{name}><footer><p>At the foot</p></footer>"
    page = f"<body><header><p>Site</p></header><nav><a href=/>menu</a></nav><{wrap}>{inner}</div></div></form></body>"
    comments = f"<body><{wrap}><{slot}><p>{text}</p></{name}><section class=comments><article class=comment><p>{'much said ' * 200}</p></article></section></div></div></form></body>"
    rows = [(k, f"http://h.example/{k}", page.replace("word", f"w{k}x")) for k in range(6)] + [(7, "http://a.example", page), (8, "http://b.example", comments), (9, "http://c.example", page.replace(f"<{wrap}>", f"<p>3 May</p><{wrap}>"))]
    out = extract(spark, rows)
    want = f"Head {text}"
    assert out[7] == want and out[8] == text and out[9].endswith(want)
    assert all(out[k].endswith(text.replace("word", f"w{k}x")) and "Side" not in out[k] for k in range(6))


def test_broken_markup_and_depth():
    assert [b.text for b in blocks("<p>a<b>b<p>c</b></i>d</div><!-- x")] == ["ab", "cd"]
    assert [b.text for b in blocks("<div>" * 3000 + "deep" + "</div>" * 10)] == ["deep"]
    assert [b.text for b in blocks("a < b &am <3 <")] in (["a < b &am <3"], ["a < b &am <3 <"])
    assert list(blocks(None)) == [] and [b.text for b in blocks("<script>x")] == []


def test_empty_table(spark):
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).isEmpty()


# Web archives -----------------------------------------------------------------------------------------------------------


class Texts(HTMLParser):
    """Every run of text outside scripts and styles, by the standard library's own reader."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.raw = [], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.raw = tag if tag in ("script", "style", "title") else 0
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href"]

    def handle_endtag(self, tag):
        self.raw = 0

    def handle_data(self, data):
        if not self.raw:
            self.parts.append(data)


def test_derivatives_of_all_pages(spark, sf_dir):
    """The registered query's rows against records read back by hand and texts from another reader, whole."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    made = warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()
    asked = {(r.page_id, r.record_type): r for r in queries.queries()["op4_warc"](spark, sf_dir).collect()}
    assert len(made) == 2 * len(pages) == len(asked) and len({r.record_id for r in made}) == len(made)
    for r in made:
        page = pages[r.page_id]
        source, block = warc.read_record(warc.response(page.page_id, page.url, page.html))
        headers, content = warc.read_record(bytes(r.record))
        source, headers = dict(source), dict(headers)
        body = block.partition(b"\r\n\r\n")[2]
        assert body.decode() == page.html
        assert headers["warc-refers-to"] == source["warc-record-id"] == r.refers_to and headers["warc-target-uri"] == page.url and headers["warc-date"] == source["warc-date"]
        assert headers["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode() == r.block_digest
        assert r.source_payload_digest == source["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert int(headers["content-length"]) == len(content) == r.content_length and dict(r.source_headers)["content-type"].startswith("text/html")
        row = asked[r.page_id, r.record_type]
        assert row.record_id == r.record_id and row.record_sha256 == hashlib.sha256(bytes(r.record)).hexdigest()
        other = Texts(re.sub(r"<[a-z/][^>]*$", "", page.html))
        if r.record_type == "conversion":
            assert "".join(content.decode().split()) == "".join("".join(other.parts).split())
        else:
            assert re.findall(r"^outlink: (.*)\r$", content.decode(), re.M) == other.links


def answer(headers, body):
    http = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/")], http.encode() + body)


def test_headers_and_encodings_of_the_source():
    page = "<p>é text</p><!-- <a href=no>x</a> --><script>'<a href=no>'</script><a href='/x?a=1&amp;b=2'>y</a>".encode()
    html_type = ("Content-Type", "text/html; charset=utf-8")
    chunked = b"5;x=y\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:x}\r\n".encode() + page[5:] + b"\r\n0\r\n\r\n"
    bodies = [([html_type], page), ([html_type, ("Content-Encoding", "gzip")], gzip.compress(page)), ([html_type, ("Content-Encoding", "deflate")], zlib.compress(page)),
              ([html_type, ("Transfer-Encoding", "chunked")], chunked), ([html_type, ("Transfer-Encoding", "chunked"), ("Content-Encoding", "deflate")], f"{len(zlib.compress(page)[2:-4]):x}\r\n".encode() + zlib.compress(page)[2:-4] + b"\r\n0\r\n\r\n")]
    for headers, body in bodies:
        cookies = [("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), ("X-Long", "one\r\n two")]
        meta, text = warc.derivatives(answer([*headers, *cookies], body))
        assert warc.read_record(text["record"])[1].decode() == "é text\ny"
        fields = warc.read_record(meta["record"])[1].decode()
        assert "outlink: /x?a=1&b=2\r\n" in fields and fields.count("outlink") == 1
        assert "http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\nhttp-x-long: one two\r\n" in fields
        assert [h["value"] for h in meta["source_headers"] if h["name"] == "set-cookie"] == ["a=1", "b=2"]
    for headers, body, why in (([html_type, ("Content-Encoding", "br")], b"x", "unknown encoding br"), ([html_type, ("Content-Encoding", "gzip")], b"x", "broken encoding"), ([html_type, ("Transfer-Encoding", "chunked")], b"zz\r\n", "broken encoding")):
        (meta,) = warc.derivatives(answer(headers, body))
        assert f"decoding: {why}\r\n" in warc.read_record(meta["record"])[1].decode()


@pytest.mark.parametrize("packed", [False, True, "whole"])
def test_files_of_many_records(spark, tmp_path, packed):
    records = [warc.write_record([("WARC-Type", "warcinfo")], b"x"), *[warc.response(k, f"http://a/{k}", f"<p>text {k}\r\n\r\nmore</p>") for k in range(5)]]
    data = b"".join(gzip.compress(r) if packed is True else r for r in records)
    data = gzip.compress(data) if packed == "whole" else data
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(data[: len(data) // 2])
    (tmp_path / "c.warc").write_bytes(b"")
    made = warc.derive(warc.read_files(spark, str(tmp_path)))
    texts = [warc.read_record(bytes(r.record))[1].decode() for r in made.where("record_type = 'conversion'").collect()]
    assert set(texts) == {f"text {k} more" for k in range(5)} and 5 + (packed != "whole") <= len(texts) < 10
    assert made.where("record_type = 'damaged'").count() <= 1


@pytest.mark.parametrize("data", [b"", b"junk", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", b"WARC/1.1\r\nno blank line", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"\x1f\x8bbroken"])
def test_damaged_records(data):
    assert warc.derivatives(data) == [{"record_type": "damaged"}]


def test_other_records_nulls_and_packing(spark):
    info = warc.write_record([("WARC-Type", "warcinfo")], b"software: x")
    assert warc.derivatives(info) == []
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\n\r\n\x00\xff"
    picture = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a\r\nX: y")], http)
    (only,) = warc.derivatives(picture)
    assert only["record_type"] == "metadata" and b"status: HTTP/1.1 404 Not Found" in warc.read_record(only["record"])[1] and only["target_uri"] == "http://a X: y"
    packed = warc.derivatives(warc.response(1, "u", "<a href='x'>y</a>"), packed=True)
    assert gzip.decompress(packed[0]["record"]).startswith(b"WARC/1.1") and b"outlink: x" in warc.read_record(packed[0]["record"])[1]
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None)], PAGES)
    assert warc.derive(warc.responses(rows)).count() == 6
    assert warc.derive(warc.responses(rows.limit(0))).isEmpty()


HTML_TYPE = ("Content-Type", "text/html; charset=utf-8")


def test_bad_chunks_end_and_are_reported():
    for body in (b"-6\r\nabcdef\r\n", b"5\r\nab", b"ffffffffffffff\r\nab\r\n", b"2\r\nabcd\r\n0\r\n\r\n", b"", b" 2\r\nab\r\n0\r\n\r\n"):
        (meta,) = warc.derivatives(answer([HTML_TYPE, ("Transfer-Encoding", "chunked")], body))
        assert b"decoding: broken encoding\r\n" in warc.read_record(meta["record"])[1]


def test_all_members_of_a_body_count():
    page = b"<p>first part</p>" + b"<p>second part</p>"
    body = gzip.compress(page[:17]) + gzip.compress(page[17:])
    _, text = warc.derivatives(answer([HTML_TYPE, ("Content-Encoding", "gzip")], body))
    assert warc.read_record(text["record"])[1] == b"first part\nsecond part"
    (meta,) = warc.derivatives(answer([HTML_TYPE, ("Content-Encoding", "gzip")], body), most=20)
    assert b"decoding: too large\r\n" in warc.read_record(meta["record"])[1]
    assert len(warc.derivatives(answer([HTML_TYPE, ("Content-Encoding", "gzip")], gzip.compress(b"<p>x</p>" + b" " * (300 << 20))))) == 2


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("harm", ["middle", "length", "short", "cut", "between"])
def test_records_after_a_damaged_one_are_read(packed, harm):
    good = [warc.response(k, f"http://a/{k}", f"<p>text {k} {'x' * 500}</p>") for k in range(4)]
    bad = good[1]
    pack = gzip.compress if packed else bytes
    parts = [pack(x) for x in good]
    if harm == "middle":
        parts[1] = parts[1][:40] + b"\xff\xff\xff" + parts[1][43:] if packed else bad.replace(b"WARC/1.1", b"WURC/1.1")
    elif harm == "length":
        parts[1] = pack(bad.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1) if b"\r\nContent-Length: 9" not in bad else bad)
    elif harm == "short":
        parts[1] = pack(bad.replace(b"Content-Length: ", b"Content-Size: ", 1).replace(b"Content-Length: ", b"Content-Size: "))
    elif harm == "cut":
        parts[1] = parts[1][: len(parts[1]) // 2]
    else:
        parts[1] = b"\x00\x01 nothing that is a record \x1f\x8b"
    texts = [warc.read_record(d["record"])[1].decode().split(" x")[0] for r in warc.split_records(b"".join(parts)) for d in warc.derivatives(r) if d["record_type"] == "conversion"]
    assert [t for t in texts if t != "text 1"] == ["text 0", "text 2", "text 3"], texts
    assert sum(d["record_type"] == "damaged" for r in warc.split_records(b"".join(parts)) for d in warc.derivatives(r)) >= 1


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_BYTES", 5000)
    rows = spark.createDataFrame([(k, f"u{k}", "<p>" + "y" * (3000 * (k % 3))) for k in range(20)], PAGES)
    assert warc.derive(warc.responses(rows)).where("record_type = 'conversion'").count() == 20


def odd_hosts(hosts=20, pages=8):
    """Hosts whose containers have made-up names: a box, the article, another box with texts of its own and a varying number of them, in one of three layouts."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h in range(hosts):
        a, b, c, d = (f"q{word()}" for _ in range(4))
        for k in range(pages):
            title, paragraphs = text(6), [text(r.randint(25, 60)) for _ in range(r.randint(3, 6))]
            blurb, replies = text(20), "".join(f"<p>{text(r.randint(12, 18))}</p>" for _ in range(r.randint(1, 3)))
            body = "".join(f"<p>{p}</p>" for p in paragraphs)
            article = [f"<div class={b}><h1>{title}</h1>{body}</div>", f"<div class={d}><h1>{title}</h1><div class={b}>{body}</div></div>", f"<h1>{title}</h1>{body}"][h % 3]
            page = f"<html><body><div class={a}><p>{blurb}</p></div>{article}<div class={c}>{replies}</div></body></html>"
            rows.append((len(rows), f"http://h{h}.example.com/{k}", page))
            want[len(want)] = " ".join([title, *paragraphs])
    return rows, want


def test_the_template_decides_on_unmarked_pages(spark):
    """Ablation: with the deduced template nearly all texts are exact, without it hardly any."""
    rows, want = odd_hosts()
    found = {i: html_extraction.main_text(list(blocks(p))) for i, _, p in rows}
    assert sum(found[i] == want[i] for i in want) <= 0.1 * len(want)
    out = extract(spark, rows)
    assert sum(out[i] == want[i] for i in want) >= 0.95 * len(want)


def test_paths_count_their_repetitions():
    page = list(blocks("<body><ul><li>a<li>b<li>c</ul><div class=x><p>d<p>e</div><div class=y>f</div><div class=x>g</div>"))
    n = {"/".join(b.element.path()): html_extraction.tokens(page)[-b.element.token][0] for b in page}
    assert n == {"body/ul/li": 3, "body/div.x/p": 2, "body/div.y": 1, "body/div.x": 2}
