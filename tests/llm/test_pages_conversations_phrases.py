"""Main texts of pages, conversation tries and collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tests.llm.data import documents, none, prose, rows

from siegelog.llm import collocations, conversation_trie, html_pages

ARTICLE = "<h1>{0} title</h1><p>{0} first paragraph &amp; more, with <b>bold</b>ness.<p>Second<br>line   of\ntext &eacute;"
PLAIN = "{0} title {0} first paragraph & more, with boldness. Second line of text é"
FRAME = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body class="page has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, a long notice on it.</p></div>
{main}<aside>Aside</aside><div id="comments"><p>A reader's comment that is much longer than the article, really, and goes on and on and on.</p></div>
<form><p>Sign up</p><input></form><script>var x = "</p><p>no</p>";</script><footer>&copy; all</footer></body></html>"""


def page_rows():
    out = []
    for k in range(30):
        main = ARTICLE.format(f"n{k}")
        body = [f"<article>{main}</article>", f'<div class="post-{k} content">{main}</div>', f"<table><tr><td>{main}</td></tr></table>"][k % 3]
        out.append((k, f"https://h{k % 3}.example.org/{k}", FRAME.format(main=body), PLAIN.format(f"n{k}")))
    # a page whose longest container is not the article: the host's other pages tell
    teaser = "<div class='teasers'>" + "<p>Some teaser text that goes on for quite a while without an end.</p>" * 12 + "</div>"
    out.append((30, "https://h0.example.org/odd", FRAME.format(main=f"<article>{ARTICLE.format('odd')}</article>{teaser}"), PLAIN.format("odd")))
    out.append((31, None, FRAME.format(main=f"<article>{ARTICLE.format('no url')}</article>"), PLAIN.format("no url")))
    out += [(32, "https://h0.example.org/n", None, ""), (33, "", "", ""), (34, "x", "plain text < b only", "plain text < b only")]
    out += [(35, "https://h9.example.org", "<nav><p>only a menu</p></nav><p><a href=x>only a link</a></p>", "")]
    out += [(36, "https://h9.example.org", "<article><p>cut off in the mid", "cut off in the mid"), (36, "https://h9.example.org", "<article><p>same id", "same id")]
    out += [(None, "https://h9.example.org", "<main><p>no id</main>", "no id")]
    long = "word " * 100_000
    out += [(37, "https://long.example.org", f"<article><p>{long}</p></article>", long.strip())]
    return out


def test_main_texts(spark):
    data = page_rows()
    frame = spark.createDataFrame([(a, b, c, "clash", "clash", "clash") for a, b, c, _ in data], "page_id long, url string, html string, host string, path string, text string")
    got = html_pages.main_texts(frame.repartition(3)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id, r.url, r.text, r.n_chars) for r in got], key=key) == sorted([(a, b, t, len(t)) for a, b, _, t in data], key=key)
    assert html_pages.main_texts(frame.limit(0)).count() == 0


def test_consensus_overrules_a_page(spark):
    odd = next(r for r in page_rows() if r[0] == 30)[2]
    page = html_pages.Page(odd)
    assert "teasers" in html_pages.best(page.by_path())
    frame = spark.createDataFrame([r[:3] for r in page_rows()], "page_id long, url string, html string")
    won = {r.host: {w.path: w.share for w in r.winners} for r in html_pages.winning_paths(frame).collect()}
    assert won["h0.example.org"][">article"] > 0.9
    assert list(won["h1.example.org"]) == [">div.content.post-#"]
    assert html_pages.best(page.by_path(), won["h0.example.org"]) == ">article"


def test_pages_of_the_test_tables(spark):
    """Their articles have only headings, paragraphs, breaks and bold text."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_pages.main_texts(table).collect()}
    import html

    for row in table.collect():
        inside = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", "\n", inside))
        assert got[row.page_id] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "x", "<p><a b='" * 20_000, "<!--" * 20_000, "<" * 100_000, "<b>" * 20_000 + "</i>" * 20_000, "</p></div>" * 9_000])
def test_hostile_pages_end(source):
    page = html_pages.Page(source)
    assert all(len(p) <= html_pages.LONGEST_PATH for p in page.paths)


def turn_rows():
    pick = random.Random(5)
    out = []
    for c in [*range(0, 70), 100, 101, 119, 2**40, 2**40 + 1]:
        if c % 11 == 3:
            continue
        for t in range(pick.randint(1, 11)):
            out.append((c, t, ["user", "assistant"][t % 2], pick.choice(["hi there", "the same words here", "x"])))
    for c in (200, 201, 202, 219):  # long ones, alike for a while
        out += [(c, t, "user", f"turn {t}" if t < 300 + c % 7 else f"own {c} {t}") for t in range(600)]
    out += [(300, None, "user", "null turn"), (300, 0, None, "null role"), (300, 1, "user", None), (301, None, None, None)]
    out += [(302, 1, "b", "tie"), (302, 1, "a", "tie"), (302, 1, "a", "tie"), (None, 0, "user", "of no conversation")]
    out += [(220 + k, 0, "user", "same start") for k in range(20)]
    return out


def brute_trie(data, family=20, most=4):
    by = defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            by[c].append((-1 if t is None else t, r or "", x or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    again = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        again[c] = turns.get(c - c % family, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(again):
        for d in range(len(again[c]) + 1):
            members[tuple(again[c][:d])].append(c)
    leaves, saved, children = Counter(), Counter(), Counter(p[:-1] for p in members if p)
    for path, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * words
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in who if len(again[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((who[0], len(path), parent, len(who), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [4, 3])
def test_trie(spark, size):
    data = turn_rows()
    frame = spark.createDataFrame([(*r, "clash", b"clash") for r in data], "conv_id long, turn long, role string, text string, parent string, node binary")
    got = conversation_trie.prefix_trie(frame.repartition(5), size=size).drop("node", "parent_node").collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(data)
    assert conversation_trie.prefix_trie(frame.limit(0)).count() == 0


def test_trie_nodes_link_up(spark):
    frame = spark.createDataFrame(turn_rows(), "conv_id long, turn long, role string, text string")
    got = {bytes(r.node): r for r in conversation_trie.prefix_trie(frame).collect()}
    for r in got.values():
        assert r.depth == 0 or got[bytes(r.parent_node)].depth == r.depth - 1


def brute_phrases(data, support, top, longest=4, contained=80):
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: v for k, v in f.items() if v >= support}
    held = {}
    for (lang, p), v in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held.get((lang, p[i : i + k]), 0), v)
    by = defaultdict(list)
    for (lang, p), a in found.items():
        if len(p) > 1 and 100 * held.get((lang, p), 0) < contained * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, v in by.items() for k, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_collocations(spark, shards):
    data = [(r[2], r[1]) for r in rows()]
    got = collocations.collocations(documents(spark), support=6, top=300, shards=shards).collect()
    assert sorted(map(tuple, got)) == brute_phrases(data, 6, 300)


def test_collocations_of_odd_texts(spark):
    data = [("en", "A b\tc  d, a B C d. a b\nc d;a-b c d  e f " * 40), (None, "ZÉ zé \U0001f600 " * 50), ("und", "zÉ zé, a"), ("", "x y " * 40)]
    data += [("de", prose(3, 30_000)), ("en", None), ("en", ""), ("en", "..,,\n"), ("fr", "solo")]
    frame = spark.createDataFrame([(k, *r, 1, "clash") for k, r in enumerate(data)], "doc_id long, lang string, text string, n int, phrase string")
    got = collocations.collocations(frame).collect()
    assert sorted(map(tuple, got)) == brute_phrases(data, 30, 2000)
    assert collocations.collocations(none(spark)).count() == 0


def test_equal_hashes_do_not_add_up(monkeypatch):
    """Phrases with one hash are counted apart."""
    import numpy as np

    t = collocations.Tokens([("en", 0, 1, b"a b c a b d a b c"), ("de", 0, 1, b"a b c")])
    monkeypatch.setattr(t, "hashes", lambda size: np.zeros(len(t.code) - size + 1, np.uint64))
    at = np.flatnonzero(t.whole(3))
    first, n = collocations._equal_runs(t, at, 3)
    found = {(t.langs[t.lang[k]], tuple(t.texts[int(c)].as_py() for c in t.code[k : k + 3])): int(x) for k, x in zip(first, n, strict=True)}
    assert found[("en", (b"a", b"b", b"c"))] == 2 and found[("de", (b"a", b"b", b"c"))] == 1 and sum(found.values()) == 8


def test_names_that_speak_of_other_parts():
    marked = lambda name: html_pages._marked(html_pages._words(name))
    assert all(map(marked, ["sidebar", "left-sidebar", "adSlot-3", "post-comments", "cookieBanner", "content-sidebar", "site_footer"]))
    assert not any(map(marked, ["content-with-sidebar", "no-ads", "has-comments", "tag-cookie", "category-social", "download", "commentary", "", "x1"]))
