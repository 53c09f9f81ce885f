"""Pages, archives and conversations against hand-made cases, brute force and round trips."""

import gzip
import hashlib
import html as html_entities
import random
import re
import time

import numpy as np
import pytest

from loomtrace.llm import chat_trees, path_ratios, warc_derivatives

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><script>var p = "<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/one">One</a></li><li><a href='/two'>Two</a><li><a href=/one>Three</a></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy.</div><article><p>First long paragraph, with <b>bold words</b>, commas, and a full stop. It goes on; and on.<br>Still the same paragraph, after a break.</p>
<p>Second paragraph: it is long too, and has marks. Many, many marks!<p>Third one, never closed, yet it counts, surely. It does.</article><footer>&copy; us</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 5, "y", "z") for i, u, h in rows], "page_id bigint, url string, html string, text string, nodes int, record_id string, payload string")


ROWS = [(1, "http://a/1", PAGE), (2, None, PAGE), (3, "http://a/3", None), (4, "http://a/4", ""), (None, "http://a/5", PAGE), (1, "http://a/1", PAGE), (6, "http://a/6", "plain text, no tags"), (7, "http://a/7", "<p>open <b <i> & < 3 <!-- never closed <p>x"), (8, "http://a/8", "<div>" * 5000 + "deep, deep text." + "</div>" * 5000), (9, "http://a/9", "<p>" + "Very long, indeed. " * 50_000 + "</p>"), (10, "http://a/10", "<p>a</p>\r\n<P>b&nbsp;c</P>  <td>d")]


def test_text_nodes():
    paths = path_ratios.Paths()
    got = [(paths.name(p), t) for p, t in path_ratios.text_nodes(PAGE, paths)]
    assert got[:4] == [("html/body/nav/ul/li/a", "One"), ("html/body/nav/ul/li/a", "Two"), ("html/body/nav/ul/li/a", "Three"), ("html/body/div", "Buy.")]
    assert [p for p, _ in got[4:]] == ["html/body/article/p"] * 4 + ["html/body/footer"]
    assert got[4][1] == "First long paragraph, with bold words, commas, and a full stop. It goes on; and on." and got[-1][1] == "© us"


TRAPS = ["<a" * 500_000, "<a " * 350_000, "<a " * 350_000 + ">", '<a ">"' * 160_000 + "'", "<div>x" * 160_000, "<div>x<section>y" * 60_000, "<div>" * 100_000 + "</p></b></i>" * 60_000, "<!--" * 250_000, "<script>" * 120_000 + ">", "<" * 1_000_000, "</" * 500_000, "<title>" * 140_000, "<html " * 160_000, "<a href=x " * 100_000, "<a href " * 100_000 + ">", "<a b=\"" + "c" * 10**6]


@pytest.mark.parametrize("trap", TRAPS, ids=lambda t: t[:9])
def test_a_page_is_read_in_proportion_to_its_length(trap):
    took = []
    for page in (trap[: len(trap) // 4], trap):
        began = time.process_time()
        path_ratios.extract(page)
        for read in (warc_derivatives.plain_text, warc_derivatives.title, warc_derivatives.language, warc_derivatives.outlinks):
            read(page)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 2  # four times the page; quadratic reading would take sixteen times as long, and hours at this length


def test_paths_of_any_depth():
    paths = path_ratios.Paths()
    nodes = path_ratios.text_nodes("<div>" * 300 + "a" + "</div>" * 290 + "<p>mid</p>", paths)
    assert [(paths.depth[p], t) for p, t in nodes] == [(300, "a"), (11, "mid")]
    rng = random.Random(4)
    known = [0]
    for _ in range(2000):
        known.append(paths.below(rng.choice(known[-40:]), rng.choice("abc")))
    for _ in range(500):
        a, b = rng.choice(known), rng.choice(known)
        x, y = (paths.name(p).split("/") if p else [] for p in (a, b))
        assert paths.shared(a, b) == next((k for k, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
    tree = paths.tree(known[-5:])
    assert sorted(path_ratios.path_names(tree)) == sorted(paths.name(p) for p in set(known[-5:]))


def brute_paths(nodes, sigma, cut):
    """The same definition with plain loops."""
    paths = list(dict.fromkeys(p for p, _ in nodes))
    of = {p: [t for q, t in nodes if q == p] for p in paths}
    text = {p: sum(map(len, of[p])) / len(of[p]) for p in paths}
    marks = {p: sum(len([c for c in t if c in ".,;:!?…、。！，：；？"]) for t in of[p]) / len(of[p]) for p in paths}
    fused = []
    for i, (p, _) in enumerate(nodes):
        t = m = w = 0.0
        for j in range(max(0, i - int(np.ceil(3 * sigma))), min(len(nodes), i + int(np.ceil(3 * sigma)) + 1)):
            q = nodes[j][0]
            a, b = p.split("/"), q.split("/")
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            near = (same / max(len(a), len(b))) ** 2 * np.exp(-0.5 * ((i - j) / sigma) ** 2) if i != j else 1.0
            t, m, w = t + near * text[q], m + near * marks[q], w + near
        fused.append(t / w * (1 + m / w))
    score = {p: np.mean([f for f, (q, _) in zip(fused, nodes) if q == p]) for p in paths}
    least = min(cut * np.std(fused), max(score.values()))
    return [p for p in paths if score[p] >= least - 1e-9]


def test_content_paths_equal_plain_loops():
    rng = random.Random(3)
    for _ in range(60):
        tags = ["html/body/p", "html/body/div", "html/body/div/p", "html/body/nav/a", "html/body"]
        nodes = [(rng.choice(tags), "word, " * rng.randrange(1, 30) + rng.choice(["", "."])) for _ in range(rng.randrange(1, 25))]
        paths = path_ratios.Paths()
        held = []
        for name, text in nodes:
            at = 0
            for tag in name.split("/"):
                at = paths.below(at, tag)
            held.append((at, text))
        for sigma, cut in ((1.0, 1.0), (0.5, 2.0), (2.0, 0.0)):
            assert [paths.name(p) for p in path_ratios.content_paths(held, paths, sigma, cut)[1]] == brute_paths(nodes, sigma, cut)


def test_main_text(spark):
    got = path_ratios.main_text(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {r.page_id: r for r in got}
    assert path_ratios.path_names(by[1].paths) == ["html/body/article/p"] and by[1].text.startswith("First long") and by[1].text.endswith("It does.") and by[1].content_nodes == 4
    assert by[3].text == by[4].text == "" and by[3].nodes == 0
    assert by[6].text == "plain text, no tags" and by[8].text == "deep, deep text." and len(by[9].text) > 900_000
    assert path_ratios.main_text(pages(spark, [])).count() == 0


def test_extraction_on_pages_with_known_articles():
    rng = random.Random(2)
    hits = total = false = 0
    for _ in range(60):
        paras = [" ".join(rng.choice(["lorem", "ipsum", "dolor,", "sit.", "amet"]) for _ in range(rng.randrange(20, 120))) for _ in range(rng.randrange(2, 8))]
        links = "".join(f"<li><a href=/x>{rng.choice(['Home', 'About us', 'News'])}</a></li>" for _ in range(rng.randrange(3, 30)))
        text, *_ = path_ratios.extract(f"<html><body><nav><ul>{links}</ul></nav><article>{''.join(f'<p>{p}</p>' for p in paras)}</article><footer>All rights kept.</footer></body></html>")
        kept = text.split("\n")
        hits, total, false = hits + sum(p in kept for p in paras), total + len(paras), false + sum(k not in paras for k in kept)
    assert hits >= 0.97 * total and false <= 0.1 * total


def test_derivatives_link_and_digest(spark):
    got = warc_derivatives.derivatives(pages(spark, ROWS), "2024-05-06T07:08:09Z").collect()
    assert len(got) == 2 * sum(i is not None for i, *_ in ROWS)
    by = {(r.page_id, r.record_type): r for r in got}
    response = {r.page_id: r for r in warc_derivatives.response_records(pages(spark, ROWS)).collect()}
    for (page, kind), r in by.items():
        other = by[(page, "conversion" if kind == "metadata" else "metadata")]
        assert r.refers_to == response[page].record_id == other.refers_to and r.concurrent_to == other.record_id
        assert r.source_digest == "sha256:" + hashlib.sha256(response[page].payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert r.source_headers.endswith(f"Content-Length: {len(response[page].payload.encode())}") and r.date == "2024-05-06T07:08:09Z"
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids) - 2  # the repeated page
    assert by[(1, "metadata")].block.split("\r\n") == ["title: A &amp; B", "language: en", f"source-payload-digest: {by[(1, 'metadata')].source_digest}", "source-header: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(PAGE.encode())}", "outlink: /one", "outlink: /two", ""]
    lines = by[(1, "conversion")].block.split("\n")
    assert lines[:4] == ["One", "Two", "Three", "Buy."] and lines[-1] == "© us" and "hidden" not in by[(1, "conversion")].block
    assert by[(2, "conversion")].target_uri == "urn:page:2" and by[(3, "conversion")].block == by[(4, "conversion")].block == ""
    assert by[(10, "conversion")].block == "a\nb c\nd" and by[(8, "conversion")].block == "deep, deep text."
    assert warc_derivatives.derivatives(pages(spark, [])).count() == 0


def test_archive_round_trip(spark):
    records = warc_derivatives.derivatives(pages(spark, ROWS[:5]))
    members = [bytes(r.member) for r in warc_derivatives.to_bytes(records).collect()]
    whole = b"".join(members)
    plain = list(map(gzip.decompress, members))
    bad = bytearray(members[1])
    bad[len(bad) // 2 : len(bad) // 2 + 4] = b"\xff\xff\xff\xff"
    no_length = plain[2].replace(b"Content-Length", b"Content-Width")
    files = [("a.warc.gz", whole), ("b.warc", b"".join(plain)), ("c.warc.gz", whole[:-20]), ("d", b""), ("e", b"no archive"), ("f.warc.gz", b"".join([members[0], bytes(bad), *members[2:]])), ("g.warc", b"".join([*plain[:2], no_length, *plain[3:]])), ("h", None)]
    back = warc_derivatives.parse(spark.createDataFrame(files, "path string, content binary")).collect()
    want = {r.record_id: r.block for r in records.collect()}
    for path in ("a.warc.gz", "b.warc"):
        mine = [r for r in back if r.path == path]
        assert {r.headers["WARC-Record-ID"]: bytes(r.block).decode() for r in mine} == want and [r.at for r in mine] == list(range(len(members)))
    good = lambda path: sum(r.path == path and r.error is None for r in back)
    wrong = lambda path: sum(r.path == path and r.error is not None for r in back)
    assert good("c.warc.gz") == len(members) - 1 and wrong("c.warc.gz") >= 1
    assert good("f.warc.gz") == len(members) - 1 and wrong("f.warc.gz") >= 1  # what follows a broken member is read
    assert good("g.warc") == len(members) - 1 and wrong("g.warc") == 1
    assert not good("d") + good("e") + good("h") and wrong("e") == 1


def test_responses_of_foreign_archives(spark):
    http = "HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<title>T</title><p>body \u00e9</p>".encode()
    def record(kind, block, *extra):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://x/", "WARC-Date: 2024-01-01T00:00:00Z", *extra, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    file = record("warcinfo", b"software: y") + record("response", http, "X-Page-Id: 7") + record("response", b"HTTP/1.1 204 None\r\n", "X-Page-Id: 8") + record("request", b"GET /")
    got = warc_derivatives.responses(warc_derivatives.parse(spark.createDataFrame([("f", file)], "path string, content binary"))).collect()
    assert [(r.page_id, r.headers, r.payload) for r in got] == [(7, "HTTP/1.1 200 OK\r\nServer: x", "<title>T</title><p>body \u00e9</p>"), (8, "HTTP/1.1 204 None\r\n", "")]
    assert got[0].payload_digest == "sha256:" + hashlib.sha256(got[0].payload.encode()).hexdigest() and got[0].record_id == "<urn:uuid:1>"


def test_members_take_linear_time():
    one = gzip.compress(random.Random(1).randbytes(20_000), 1)
    began = time.process_time()
    assert sum(e is None for _, e in warc_derivatives.members(one * 4000)) == 4000  # 80 MB
    assert time.process_time() - began < 30


def test_readers_equal_their_patterns():
    rng = random.Random(11)
    bits = ["<a href=x>", "<a ", "<A HREF='y z'", "<!--", "-->", "<script>", "</script >", "<head>", "<header>", "</head>", "<title>", "</title>", "<title ", "<html lang=en>", "<html ", " lang='de' ", "<p>", "</p", ">", "text", "\n", " ", "&amp;", "<br/>", "<!doctype html>", "<div", "\xa0", "\r\n", "<template>", "href=q"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        w = warc_derivatives
        bare = re.sub(w.HIDDEN, "", html, flags=re.A).replace("\r", " ").replace("\n", " ")
        bare = html_entities.unescape(re.sub(w.TAG, "", re.sub(w.BLOCK, "\n", bare, flags=re.A)))
        bare = re.sub(" {2,}", " ", re.sub(f"[{w.ODD_SPACE}]", " ", bare))
        assert w.plain_text(html) == re.sub(r" ?\n[ \n]*", "\n", bare).strip(" \n")
        assert w.outlinks(html) == list(dict.fromkeys(re.findall(w.HREF, html, re.A)))
        m = re.search(w.TITLE, html, re.A)
        assert w.title(html) == (re.sub(r"\s+", " ", m[1], flags=re.A).strip(" ") if m else "")
        m = re.search(w.LANG, html, re.A)
        assert w.language(html) == (m[1] if m else "")


# -- chats


def brute_chats(rows, keep):
    """``rows``: (conv, turn, role, text, parent, score)."""
    convs = {}
    for c, t, role, text, parent, score in rows:
        if c is not None and t is not None:
            new = (role or "unknown", text or "", (parent is not None, parent or 0), score or 0.0)
            convs.setdefault(c, {})
            convs[c][t] = min(new, convs[c].get(t, new))
    out = set()
    for c, msgs in convs.items():
        up = {t: m[2][1] if m[2][0] and m[2][1] in msgs and m[2][1] != t else None for t, m in msgs.items()}
        leaves = set(msgs) - {p for p in up.values() if p is not None}
        ranked = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None and len(path) <= len(msgs):
                path.append(at)
                at = up[at]
            if at is None:
                ranked.append((-sum(msgs[t][3] for t in path), -len(path), leaf, path[::-1]))
        for k, (score, n, leaf, path) in enumerate(sorted(ranked)[:keep]):
            text = "".join(f"<|{msgs[t][0].replace('<|', '< |')}|>\n{msgs[t][1].replace('<|', '< |')}<|end|>\n" for t in path)
            out.add((c, leaf, k + 1, -n, -score, text))
    return out


@pytest.mark.parametrize("keep", [1, 3])
def test_trees_with_parents_and_scores(spark, keep):
    rng = random.Random(keep)
    rows = []
    for c in range(12):
        n = rng.choice([1, 2, 9, 40])
        for t in range(n):
            parent = rng.choice([None, *range(max(0, t - 3), t)]) if t else None
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([f"text {c} {t}", None, "<|end|>"]), parent, rng.choice([1.0, 2.0, None])))
    rows += [(50, t, "user", "x", t - 1 if t else None, 1.0) for t in range(300)]  # one long chain
    rows += [(51, 0, "user", "a", 1, 1.0), (51, 1, "user", "b", 0, 1.0), (51, 2, "user", "c", 1, 1.0), (51, 3, "user", "d", 3, 1.0)]  # a circle with a tail, and one that answers itself
    rows += [(None, 1, "user", "a", None, 1.0), (52, None, "user", "a", None, 1.0), (53, 4, "user", "a", 99, 1.0), rows[0], (0, 0, "aaa", "other", None, 5.0)]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, parent bigint, score double, leaf string, up int")
    got = [tuple(r) for r in chat_trees.conversations_of(df, keep).collect()]
    assert len(got) == len(set(got))
    assert {(*r[:4], round(r[4], 6), r[5]) for r in got} == brute_chats(rows, keep)


def test_columns_of_other_types(spark):
    rows = [("1", "0", "user", "q", None, "2.5"), ("1", "1", "assistant", "a", "0", "much"), ("1", "2", "assistant", "b", "zero", None), ("x", "0", "user", "lost", None, "1")]
    df = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string, parent string, score string")
    assert {(r.conv_id, r.leaf, r.n_messages, r.score) for r in chat_trees.conversations_of(df).collect()} == {(1, 1, 2, 2.5), (1, 2, 1, 0.0)}


def test_parents_from_roles(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "user", "q22"), (1, 3, "assistant", "a"), (1, 4, "assistant", "longer"), (1, 5, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert {r.turn: r.parent for r in chat_trees.messages(chat_trees.single_rows(df)).collect()} == {0: None, 1: 0, 2: 0, 3: 2, 4: 2, 5: 4}
    got = chat_trees.conversations_of(df).orderBy("rank").collect()
    assert [(r.leaf, r.n_messages, r.score) for r in got] == [(5, 4, 13.0), (3, 3, 5.0)]
    assert got[1].text == "<|system|>\ns<|end|>\n<|user|>\nq22<|end|>\n<|assistant|>\na<|end|>\n"
    assert chat_trees.conversations_of(df.limit(0)).count() == 0
