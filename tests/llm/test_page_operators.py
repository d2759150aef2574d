import hashlib
import html.parser
import io
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm import chat, html_consensus, nearest, warc

# WARC


def test_archive_round_trip():
    r = random.Random(1)
    made = [warc.Record("response", i, f"http://h/{i}", p := ("<html>" + " ".join(r.choice(["one", "two", "three"]) for _ in range(200))).encode(), len(p), hashlib.sha1(p).hexdigest(), None) for i in range(200)]
    made.append(warc.Record("revisit", 999, "", b"", 5000, "ab", 3))
    made.append(warc.Record("response", 1000, "", b"", 0, hashlib.sha1(b"").hexdigest(), None))
    dictionary = warc.train([warc.render(x) for x in made])
    assert dictionary and warc.train([b"a"]) == b""
    sizes = []
    for d in (dictionary, b""):
        out = io.BytesIO()
        assert warc.write_archive(out, iter(made), d) == len(made)
        assert out.getvalue()[:4] == (b"\x5d\x2a\x4d\x18" if d else b"\x28\xb5\x2f\xfd")
        assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == made
        sizes.append(len(out.getvalue()) - (len(d) if d else 0))
    assert sizes[0] < sizes[1]
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_pages_round_trip(spark):
    big = "<p>" + "é" * 600 + "</p>"
    pages = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "small"), (6, "u6", "small"), (7, "u7", big), (7, "u7", big), (8, "u", "x" * 300_000), (None, "u", "z"), (None, "u", big), (None, None, None), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
    df = spark.createDataFrame([(*p, "path", 1) for p in pages], "page_id long, url string, html string, path string, salt int")
    got = list((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(spark, df).collect())
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    copies = lambda i, h: h == big and i != 7
    want = sorted(((i, len((h or "").encode()), digest(h), "revisit" if copies(i, h) else "response", 7 if copies(i, h) else None) for i, _, h in pages), key=repr)
    assert sorted(got, key=repr) == want
    assert warc.archive_pages(spark, df.limit(0)).count() == 0


def test_archives_are_cut_by_bytes_and_listed_when_whole(spark, tmp_path):
    rows = [(i, "u", str(i) * 400) for i in range(40)] + [(99, "u", "z" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/out"
    listed = warc.write_archives(spark, df, folder, bytes_an_archive=5_000)
    assert listed.agg(F.sum("records")).first()[0] == 41 and listed.count() >= 6
    (tmp_path / "out/archive-000000-0000-77.warc.zst").write_bytes(b"left by a lost attempt")
    assert sorted(r.page_id for r in warc.read_archives(listed, folder).collect()) == sorted(i for i, _, _ in rows)


def test_dictionary_sees_whole_pages(spark):
    df = spark.createDataFrame([(1, "u", "a" * 30_000 + "the tail of a page" * 200)], "page_id long, url string, html string")
    assert any(b"the tail of a page" in x for x in warc.sampled(df)) and warc.sampled(df.limit(0)) == []


def test_payloads_that_share_a_page_id(spark):
    one, two, other = "1" * 2000, "2" * 2000, "3" * 2000
    pages = [(1, one), (1, two), (1, other), (1, "small"), (8, two), (9, one), (9, one)]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_pages(spark, df).collect())
    copy_of = {(1, one): 9, (1, two): 8}
    assert got == sorted((i, hashlib.sha1(h.encode()).hexdigest(), "revisit" if (i, h) in copy_of else "response", copy_of.get((i, h), 0)) for i, h in pages)


# Page text


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p>";</script><style>p{{}}</style></head><body class="home"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="col col-{n}"><div class="post-body"><h1>Head &amp; line {n}</h1><p>First&nbsp;  para
graph <b>bold</b> {text}<p>Second &lt;tag&gt; <a href="x">link</a> in it, with more text to read.<ul><li>item one<li>item two</ul><!-- <p>hidden</p> --><div class="ad-slot">Buy</div>
<form><p>Sign up</p><input></form></div></div><aside>Side</aside><section id="comments"><p>{reader}</p></section><footer>Foot</footer></body></html>"""


def test_main_text():
    text = html_consensus.extract(PAGE.format(n=3, text="x", reader="reader says " * 100), None)
    assert text == "Head & line 3\nFirst para graph bold x\nSecond <tag> link in it, with more text to read.\nitem one\nitem two"
    assert html_consensus.extract(None, None) == "" and html_consensus.extract("", "body") == "" and html_consensus.extract("plain &lt; <", None) == "plain < <"
    assert html_consensus.extract("<p>a<p>b</p></b></div>c", None) == "a\nb\nc"
    assert html_consensus.extract("<div>" * 3000 + "deep", None) == "deep"


def test_raw_elements_and_open_heads():
    script = "<script>for(i=0;i<n;i++){f('<p>')}</script>"
    for page in (f"<body>{script}<article><p>Kept</p></article></body>", f"<body><article><style>a<b{{}}</style><p>Kept</p></article>{script}</body>"):
        assert html_consensus.extract(page, None) == "Kept"
    for head in ("<head><title>t</title><meta charset=utf-8>", f"<head>{script}<title>a<b</title>", "<head><title>t</title><link rel=x></head>"):
        for body in ("<body><p>Kept</p></body>", "<div><p>Kept</p></div>", "Kept"):
            assert html_consensus.extract(f"<html>{head}{body}</html>", None) == "Kept"


def test_whole_container():
    prose = lambda n: "word " * (n // 5)
    text = html_consensus.extract(f"<body><article><h1>Headline</h1><div class=story>{prose(4000)}</div></article></body>", None)
    assert text.startswith("Headline\n") and len(text) > 4000
    text = html_consensus.extract(f"<body><div class=content><h1>Headline</h1><p>Lead {prose(1300)}</p><div class=entry>{prose(2700)}</div></div></body>", None)
    assert text.startswith("Headline\nLead") and len(text) > 3990
    links = "<div><a href=x>a link</a> <a href=y>and another</a></div>"
    assert "link" not in html_consensus.extract(f"<body><div>{links}<div class=entry>{prose(2700)}</div></div></body>", None)


def test_names_of_boilerplate():
    for name in ("sidebar", "site-header", "ad-slot", "adSlot", "comment-list", "comments", "share-buttons", "related-posts", "cookie-notice", "nav-links", "site-header-inner", "post-comments", "entry-footer", "sidebar-1", "comment-body"):
        assert html_consensus.marked(name), name
    for name in ("has-sidebar", "with-sidebar", "no-ads", "post-header", "table-header", "table-header-row", "notice-period", "content", "post-body", "main-content-with-sidebar", "sidebar-layout", "header-image", "", "42"):
        assert not html_consensus.marked(name), name


def test_classes_that_only_seem_boilerplate():
    extract = lambda page: html_consensus.extract(page, None)
    prose = "Some words of an article that goes on for a while. " * 8
    assert extract(f'<body><div class="content has-sidebar"><p>{prose}</p></div></body>') == prose.strip()
    assert extract(f'<body><article><div class="post-header"><h1>Head</h1></div><p>{prose}</p><table><tr class="table-header"><th>Col</th></tr></table><p class="notice-period">One month.</p></article></body>') == f"Head\n{prose.strip()}\nCol\nOne month."
    # The whole page under a class that names boilerplate, and a main part under one.
    assert extract(f'<body><div class="banner"><p>{prose}</p></div></body>') == prose.strip()
    assert extract(f'<body><div class="overlay"><div class="menu">x</div><main><p>{prose}</p></main></div></body>') == prose.strip()
    # But readers' words stay out, however many.
    assert extract(f'<body><article><p>Short.</p></article><div class="comments"><p>{prose * 30}</p></div></body>') == "Short."


def test_broken_and_deep_pages_take_linear_time():
    n, began = 60_000, time.monotonic()
    extract = lambda page: html_consensus.extract(page, None)
    assert extract("<div>" * n + "deep") == "deep" and extract("<div class='a b'>x" * n).count("x") == n
    assert extract("<a " * n).startswith("<a <a") and extract("<p><i>" * n + "t") == "t" and extract("<b><i>" * n + "</b>" * n + "t") == "t"
    assert extract("<div>" * n + "</nothing>" * n + "t") == "t" and extract('<a x="> "' * n + "t").endswith("t") and extract("<script>a</script>" * n + "t") == "t"
    assert time.monotonic() - began < 60
    assert html_consensus.extract('<p title="a>b">one</p><p it\'s>two</p><p>three</p>', None) == "one\ntwo\nthree"


class Tree(html.parser.HTMLParser):
    """A page as a tree, by the standard parser; with the scoring below a plain second version for pages that are not broken."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "body", "of": None, "in": [], "drop": False, "class": ""}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.at["in"].append(" ")
        if tag in html_consensus.VOID:
            return
        ends = {"p": html_consensus.BLOCKS, "li": {"li"}, "tr": {"tr"}, "td": {"td", "tr"}, "th": {"th", "tr"}}
        while self.at["of"] and tag in ends.get(self.at["tag"], ()):
            self.at = self.at["of"]
        inside = [x["tag"] for x in self.line()]
        words = re.findall("[a-z]+", (named.get("class", "") + " " + named.get("id", "")).lower())
        drop = tag in html_consensus.DROPPED and not (tag == "header" and "article" in inside) or bool(html_consensus.BOILERPLATE.intersection(words)) and tag not in ("article", "main")
        node = {"tag": tag, "of": self.at, "in": [], "drop": drop, "class": named.get("class", "")}
        self.at["in"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        for x in self.line():
            if x["tag"] == tag and x["of"]:
                self.at = x["of"]
                return

    def handle_data(self, data):
        self.at["in"].append(data)

    def line(self):
        x = self.at
        while x:
            yield x
            x = x["of"]


def plain_text(node, link=False):
    """(blocks of a node, each a list of its texts and of whether they are linked)."""
    out = [[]]
    for x in node["in"]:
        if isinstance(x, str):
            out[-1].append((x, link))
        elif not x["drop"]:
            inner = plain_text(x, link or x["tag"] == "a")
            if x["tag"] in html_consensus.BLOCKS:
                out += [*inner, []]
            else:
                out[-1] += inner[0]
                out += inner[1:]
    return out


def plain_extract(page):
    """The text of the best container, scored afresh for each."""
    found = []

    def walk(node, depth):
        if node["tag"] in html_consensus.CONTAINERS or node["of"] is None:
            blocks = plain_text(node)
            size = sum(max(0, sum(len(t) for t, _ in b) - 2 * sum(len(t) for t, linked in b if linked)) for b in blocks if "".join(t for t, _ in b).strip())
            whole = sum(len(t) for b in blocks for t, _ in b if "".join(t for t, _ in b).strip())
            bonus = 1.5 if node["tag"] in ("article", "main") or re.search(r"\b(article|post|entry|story)\b", node["class"]) else 1
            found.append((size * bonus * (1 + 0.02 * depth), size, whole, node))
            depth += 1
        for x in node["in"]:
            if not isinstance(x, str) and not x["drop"]:
                walk(x, depth)

    walk(Tree(page).root, 0)
    by = {id(n): (s, w) for _, s, w, n in found}
    best = max(found, key=lambda x: x[0])[3]
    outer = best["of"]
    while outer:
        if id(outer) in by and by[id(outer)][0] - by[id(best)][0] > 0.5 * (by[id(outer)][1] - by[id(best)][1]):
            best = outer
        outer = outer["of"]
    texts = (re.sub(r"\s+", " ", "".join(t for t, _ in b)).strip() for b in plain_text(best))
    return "\n".join(t for t in texts if t)


def test_sample_pages_against_the_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for r in pages:
        assert html_consensus.extract(r.html, None) == plain_extract(r.html)


def test_paths_sent_and_joined_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    assert rows(html_consensus.extract_pages(spark, df)) == rows(html_consensus.extract_pages(spark, df, most_sent=-1))


def test_second_template_of_a_host(spark):
    first = [(i, "http://h/a", f"<body><div class=post><p>{'first ' * 100}</div></body>") for i in range(30)]
    second = [(40 + i, "http://h/b", f"<body><div class=post><p>tiny</div><div class=other><p>{'second ' * 500}</div></body>") for i in range(3)]
    odd = [(50, "http://h/c", f"<body><div class=post><p>tiny</div><section><p>{'third ' * 500}</section></body>")]
    df = spark.createDataFrame(first + second + odd, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in html_consensus.extract_pages(spark, df).collect()}
    assert by[0].count("first") == 100 and by[40].count("second") == 500 and by[50].count("third") == 500


def test_hosts_agree_on_a_path(spark):
    rows = [(i, f"https://Site.example:80/p/{i}", PAGE.format(n=i, text="word " * 30, reader="r")) for i in range(8)]
    # One page of the host has little in its article and much in a box that looks no different.
    rows.append((8, "http://site.example/odd", PAGE.format(n=8, text="y", reader="r").replace("<aside>", "<div class=extra><p>" + "noise " * 300 + "</div><aside>")))
    rows += [(9, None, None), (10, "not a url", "<p>x"), (10, "not a url", "<p>x")]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    got = html_consensus.extract_pages(spark, df.select("page_id", "url", "html", "path")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[8].text.startswith("Head & line 8\nFirst para graph bold y") and "noise" not in by[8].text
    assert by[9].text == "" and by[10].text == "x" and all(r.n_chars == len(r.text) for r in got)
    assert html_consensus.extract_pages(spark, df.limit(0)).count() == 0


# Nearest neighbours


def plain_nearest(rows, k):
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, q, x in good:
        if q is not None and q % 20 == 0:
            scored = []
            for m, i, y in good:
                if m != n and len(y) == len(x):
                    total = 0.0
                    for a, b in zip(x, y):
                        total += float(a) * float(b)
                    scored.append((-total, i is None, i or 0))
            out += [(q, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_bytes", [64 << 20, 5_000])
def test_nearest_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(nearest, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 8)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=16) * 10.0 ** r.integers(-3, 3))]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(150)]  # ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [None] + [1.0] * 15), (2080, [float("nan")] * 16), (2100, [float("inf")] * 16), (2120, [1.0, 2.0]), (2121, [3.0, 1.0]), (None, rows[40][1]), (None, rows[20][1])]
    rows += rows[:3] + [(40, rows[7][1])]
    df = spark.createDataFrame([(*x, "b", 0) for x in rows], "vec_id long, embedding array<float>, block string, row int")
    got = sorted((tuple(x) for x in nearest.nearest(spark, df, F.col("vec_id") % 20 == 0, 20, group_bytes).collect()), key=repr)
    assert got == plain_nearest(rows, 20)
    assert nearest.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(30, 24)) * 5, r.standard_t(2, size=(40, 24))
    near, error = nearest.tile(x, *nearest.quantise(x), y, *nearest.quantise(y))
    assert (np.abs(near - x @ y.T) <= error).all()


# Chat


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "end")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (7, None, "user", ""), (None, 0, "user", "x"), (8, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, position int, h1 int")
    got = {r.conv_id: r for r in chat.format_conversations(spark, df).collect()}
    assert set(got) == {2, 5, 6, 7, 8, None} and got[None].rendered == "<|im_start|>user\nx<|im_end|>\n" and got[None].n_copies == 1 and got[2].n_copies == 2 and got[2].n_turns == 4 and got[6].n_turns == 2
    assert got[5].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n" and got[5].n_chars == len(got[5].rendered)
    assert chat.format_conversations(spark, df.limit(0)).count() == 0


def plain_collapse(rows):
    """Maximal conversations of (conv_id, turn, role, text) rows: sorted (conv_id, n_turns, n_copies, lines)."""
    talks = {}
    for k, (c, t, role, text) in enumerate(rows):
        role, text = role or "", text or ""
        talks.setdefault((c is None, c or k), []).append((t is not None, t or 0, role, hashlib.md5(f"{role}\n{text}".encode()).hexdigest(), f"<|im_start|>{role}\n{text}<|im_end|>\n"))
    lines = {c: tuple(x[-1] for x in sorted(t)) for c, t in talks.items()}
    proper = {x[:k] for x in lines.values() for k in range(1, len(x))}
    out = {}
    for c, x in sorted(lines.items()):
        if x not in proper:
            out.setdefault(x, []).append(None if c[0] else c[1])
    return sorted(((ids[0], len(x), len(ids), "".join(x)) for x, ids in out.items()), key=repr)


def test_collapse_against_a_plain_version(spark):
    r = random.Random(4)
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 4)):
            rows.append((None if c % 9 == 0 else c, r.choice((t, t, t, 0, None)), r.choice(("user", "user", None)), r.choice(("a", "a", "b", None))))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(x.conv_id, x.n_turns, x.n_copies, x.rendered) for x in chat.format_conversations(spark, df).collect()]
    assert sorted(got, key=repr) == plain_collapse(rows)
