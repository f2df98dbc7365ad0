"""Operators on texts against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tests.llm.data import documents, none, rows

from siegelog.llm import ngram_join, packing, quality, trie_lm
from siegelog.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_join(data):
    sets = [shingles(t) for _, t, *_ in data]
    root, links = list(range(len(data))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (data[a][0], data[b][0]) and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links.update((a, b))
    least = defaultdict(list)
    for k, r in enumerate(data):
        if r[0] is not None:
            least[find(k)].append(r[0])
    return sorted(
        (r[0] if r[0] is not None else -1, len(sets[k]), min(least[find(k)]) if r[0] is not None else -1, links[k]) for k, r in enumerate(data)
    )


def test_join(spark):
    got = ngram_join.similar_documents(documents(spark)).collect()
    plain = sorted(tuple(-1 if x is None else x for x in r) for r in got)
    assert plain == brute_join(rows())
    assert ngram_join.similar_documents(none(spark)).count() == 0


@pytest.mark.parametrize("block", [1000, 5])
def test_join_by_blocks_and_deletions(spark, monkeypatch, block):
    """Families over several blocks, and each way to index a band."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    how = ngram_join.allocate

    def halved(low, high, sets, like):
        need = like.differ(high, like.partner(high)) + 1
        return ngram_join.Allocation(math.ceil(need / 2), True) if need > 1 else how(low, high, sets, like)

    monkeypatch.setattr(ngram_join, "allocate", halved)
    got = ngram_join.similar_documents(documents(spark)).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute_join(rows())


def base(text):
    text = text or ""
    w, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    threes = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if threes[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality(spark):
    got = quality.quality_rules(documents(spark)).collect()
    counts = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert sorted(counts) == sorted(base(r[1]) for r in rows())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.perplexity_failed)
    assert quality.quality_rules(none(spark)).count() == 0


def symbol(character):
    point = ord(character)
    return 32 if 9 <= point < 14 else point


def brute_log_perplexities(texts):
    """log10 perplexities of texts by a modified Kneser-Ney model of their own trigrams of symbols, from its definition."""
    lines = [[32, 32, *map(symbol, t)] for t in texts]
    grams = {3: Counter(tuple(s[k - 2 : k + 1]) for s in lines for k in range(2, len(s)))}
    for order in (2, 1):
        grams[order] = Counter(g[1:] for g in grams[order + 1])
    discount = {}
    for order, counts in grams.items():
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        discount[order] = [0.0] + [min(max(k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.5), 0.05), k - 0.05) for k in (1, 2, 3)]
    total, cut = Counter(), Counter()
    for order, counts in grams.items():
        for g, c in counts.items():
            total[g[:-1]] += c
            cut[g[:-1]] += discount[order][min(c, 3)]

    def p(g):
        if not g:
            return 1 / 0x110000
        shorter, context = p(g[1:]), g[:-1]
        if not total[context]:
            return shorter
        c = grams[len(g)][g]
        return (c - discount[len(g)][min(c, 3)]) / total[context] + cut[context] / total[context] * shorter

    out = []
    for s in lines:
        costs = [-math.log10(p(tuple(s[k - 2 : k + 1]))) for k in range(2, len(s))]
        parts = max(1, len(costs) // 64)
        edges = [k * len(costs) // parts for k in range(parts + 1)]
        means = sorted(sum(costs[a:b]) / (b - a) for a, b in zip(edges, edges[1:], strict=False))
        out.append((means[(parts - 1) // 2] + means[parts // 2]) / 2)
    return out


def verdicts(data, width=6.0):
    """(id, log perplexity, kept) of rows (id, text, lang) by brute force."""
    scores, failed = {}, []
    for k, (_, text, _) in enumerate(data):
        n, *_, repeats = base(text)
        failed.append(n < 50 or 100 * repeats > 50 * n)
    for lang in {r[2] for r in data}:
        own = [k for k, r in enumerate(data) if r[2] == lang and r[1]]
        for k, score in zip(own, brute_log_perplexities([data[k][1] for k in own]), strict=True):
            scores[k] = score if WORD.search(data[k][1]) else None
    lower = lambda values: sorted(values)[(len(values) - 1) // 2]
    band = {}
    for lang in {r[2] for r in data}:
        own = [scores[k] for k, r in enumerate(data) if r[2] == lang and not failed[k]]
        if own:
            band[lang] = (middle := lower(own)), lower([abs(x - middle) for x in own]), len(own)
    pooled = sum(s * n for _, s, n in band.values()) / max(1, sum(n for *_, n in band.values()))
    out = []
    for k, (i, _, lang) in enumerate(data):
        inside = lang in band and scores.get(k) is not None
        if inside:
            middle, spread, n = band[lang]
            inside = abs(scores[k] - middle) <= width * (spread + 3 * pooled / math.sqrt(n))
        out.append((i, scores.get(k), not failed[k] and inside))
    return out


def quality_rows():
    import random

    pick = random.Random(4)
    words = {"en": "the of and house river walks slowly green under stone".split(), "ru": "и в не дом река идёт медленно зелёный под камень".split(), "zh": list("的一是不了人我在有他")}
    data = []
    for lang, own in words.items():
        for _ in range(25):
            data.append((len(data), " ".join(pick.choice(own).title() if pick.random() < 0.1 else pick.choice(own) for _ in range(pick.randint(60, 160))), lang))
    english = data[0][1]
    data += [(900, english, "ru"), (901, data[30][1], "en"), (902, data[30][1].upper(), "ru"), (903, " ".join("%x#q" + str(k) for k in range(99)), "en")]
    data += [(910, english + "\n" + " ".join(data[26][1].split()[:12]), "en"), (911, None, "en"), (912, "", "zh"), (913, "one two", "rare"), (914, english, "rare"), (None, data[1][1], "en")]
    return data + [data[3], data[3]]


def test_quality_verdicts(spark, monkeypatch):
    """Perplexities and verdicts are those of each language's own model, whatever the number of packs."""
    data = quality_rows()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, text string, lang string, row string, n_words int").repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(verdicts(data), key=key)
    for size in (quality.PACK_BYTES, 1):
        monkeypatch.setattr(quality, "PACK_BYTES", size)
        got = sorted(((r.doc_id, r.log_perplexity, r.kept) for r in quality.quality_rules(frame).collect()), key=key)
        for a, b in zip(got, want, strict=True):
            assert (a[0], a[2]) == (b[0], b[2])
            assert (a[1] is None) == (b[1] is None) and (a[1] is None or a[1] == pytest.approx(b[1], abs=1e-5))
    kept = {i for i, _, k in want if k}
    assert not kept & {901, 903, 911, 912, 913} and {*range(75), 910, 914, None} <= kept
    rows_ = quality.kept_rows(frame)
    assert rows_.columns == frame.columns
    assert sorted((r.doc_id or -1) for r in rows_.collect()) == sorted((i or -1) for i, _, k in want if k)


def test_quality_tells_all_characters_apart(spark):
    """No two characters share a symbol, so a text of unknown characters has the least likely ones."""
    import numpy as np

    points = [p for p in range(14, 0x3000) if not 0xD800 <= p < 0xE000]
    grams = quality.grams_of("".join(map(chr, points)).encode())
    assert len(np.unique(grams % quality.SYMBOLS)) == len(points) and (grams >= 0).all()
    known = "".join(chr(0x4E00 + k) for k in range(400))
    other = "".join(chr(0x5200 + k) for k in range(400))
    model = quality._model(spark.createDataFrame([(1, known)], "doc_id long, text string").selectExpr("'zh' lang", "encode(text, 'utf-8') text")
        .mapInArrow(quality._counted, "lang string, gram long, count long").toPandas())
    scorer = quality.Scorer({"zh": model["arrays"][0]})
    (seen,), (unseen,) = (scorer.log_perplexities("zh", [t.encode()]) for t in (known, other))
    assert seen < 3 and unseen > 5.5


def test_kneser_ney_is_a_distribution():
    import numpy as np
    import pandas as pd

    grams, counts = np.unique(quality.grams_of(b"the cat sat on the mat, the dog sat on the log. " * 3), return_counts=True)
    fitted = quality._model(pd.DataFrame({"lang": "en", "gram": grams.astype(np.int64), "count": counts}))
    model = quality.Scorer({"en": fitted["arrays"][0]}).models["en"]
    for context in (grams[:5] // quality.SYMBOLS, np.array([12_345])):
        for c in context.astype(np.int64):
            p = 10 ** quality.gram_log10(c * quality.SYMBOLS + np.arange(quality.SYMBOLS), model)
            assert abs(p.sum() - 1) < 1e-5


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_that_collide_under_polynomial_hashes(spark):
    """Two long words of the same multiset and structure are told apart by all operators on hashed words."""
    from tokenizers import Tokenizer

    one, two = thue_morse(1024, 0), thue_morse(1024, 1)
    frame = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two}"), (4, one)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in ngram_join.similar_documents(frame).collect()) == [(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 1, 1)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = defaultdict(list)
    for r in packing.pack_documents(frame, tokenizer_path()).orderBy("doc_id", "start").collect():
        pieces[r.doc_id] += list(memoryview(bytes(r.ids)).cast("I"))
    assert pieces == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in ((1, one), (2, two), (3, f"{one} {two}"), (4, one))}
    known = {r.doc_id: r.n_known for r in trie_lm.score_documents(spark.createDataFrame([(1, one), (2, two), (6, "x")], "doc_id long, text string")).collect()}
    held = {k for k in (1, 2, 6) if zlib.crc32(str(k).encode()) % 10 == 0}
    assert known == {k: (1 if k in held else 2) for k in (1, 2, 6)}


def test_packing(spark):
    import numpy as np
    from tokenizers import Tokenizer

    hard = ["don't I'LL 's", "<|endoftext|> <|ENDOFTEXT|>", "İstanbul Σ ß é ½ 日本語", "3.14 a1b2\x0b\x1c\x85", "😀 naïve"]
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(hard)], "doc_id long, text string")
    got = packing.pack_documents(documents(spark).select("doc_id", "text").union(extra), tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [r[1] or "" for r in rows()] + hard
    want = Counter(tuple([*e.ids, 2]) for e in tokenizer.encode_batch(texts, add_special_tokens=False))
    assert len({r.sequence_id for r in got}) == len(got)
    pieces, made = defaultdict(list), Counter()
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.bucket == r.length
    for r in sorted(got, key=lambda r: r.sequence_id):
        key = r.doc_id
        pieces[key].append(r)
        if r.start + r.length == r.doc_tokens:
            ids = np.concatenate([np.frombuffer(x.ids, "<u4") for x in pieces.pop(key)])
            assert len(ids) == r.doc_tokens
            made[tuple(ids.tolist())] += 1
    assert made == want and not pieces
    assert packing.pack_documents(none(spark), tokenizer_path()).count() == 0
    digest = packing.digests(packing.pack_documents(extra, tokenizer_path())).select("ids_crc32").first()[0]
    assert digest >= 0


def test_packing_holds_little():
    """What a worker holds follows neither the bytes of a task's texts nor their distinct units; results go out in small parts."""
    import tracemalloc
    from itertools import islice, product

    import pyarrow as pa
    from tokenizers import Tokenizer

    names = ["".join(x) for x in islice(product("abcdefghijklmnop", repeat=5), 700_000)]
    texts = [" ".join(names[k : k + 2000]).encode() for k in range(0, len(names), 2000)]
    texts += [texts[0] * 9] * 20
    rows_ = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["id", "text"])
    made, largest = defaultdict(list), 0
    packing._encoder.cache_clear()
    tracemalloc.start()
    try:
        for part in packing._packed(tokenizer_path(), 4096)(iter([rows_])):
            largest = max(largest, part.nbytes)
            for doc_id, ids in zip(part.column("id").to_pylist(), part.column("ids").to_pylist(), strict=True):
                made[doc_id] = zlib.crc32(ids, made[doc_id] or 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        packing._encoder.cache_clear()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for k in (0, 200, len(texts) - 1):
        ids = [*tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids, 2]
        assert made[k] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert len(made) == len(texts) and peak < 150 << 20 and largest < 3 << 20


def test_python_workers_get_bounded_batches(spark):
    """Rows are sent to Python by their bytes, not only by their number."""
    import pyarrow as pa

    packing.pack_documents(none(spark), tokenizer_path())
    sizes = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 3000) text").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long"
    )
    got = [r.n for r in sizes.collect()]
    assert sum(got) >= 27_000_000 and max(got) < 5 << 20


@pytest.mark.parametrize("shard", [2_000_000, 3000])
def test_language_model(spark, monkeypatch, shard):
    monkeypatch.setattr(trie_lm, "SHARD_TOKENS", shard)
    data = rows()
    tokens = [[*WORD.findall(lowered(r[1])), None] for r in data]
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 == 0 for r in data]
    c, pairs, before = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
            before.update([0, *t[:-1]])
    n, v = sum(c.values()), len(c)
    types = Counter(h for h, _ in pairs)
    once, twice = (sum(x == k for x in pairs.values()) for k in (1, 2))
    cut = min(0.95, once / (once + 2 * twice))
    want = []
    for r, t, h in zip(data, tokens, held, strict=True):
        uni = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        full = [
            (max(pairs[x, w] - cut, 0) + cut * types[x] * p) / before[x] if before[x] else p
            for x, w, p in zip([0, *t[:-1]], t, uni, strict=True)
        ]
        want.append((r[0] if r[0] is not None else -1, h, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, uni)), sum(map(math.log10, full))))
    got = sorted((tuple(-1 if x is None else x for x in r) for r in trie_lm.score_documents(documents(spark)).collect()), key=lambda r: r[:6])
    for a, b in zip(got, sorted(want, key=lambda r: r[:6]), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        if shard > n:  # else discounts and the types of hot contexts are a shard's own
            assert abs(a[6] - b[6]) < 0.03 * a[2]
        assert a[6] <= 0
    assert trie_lm.score_documents(none(spark)).count() == 0


def test_language_model_over_many_shards(spark, monkeypatch):
    """Contexts with fewer successors than shards, and discounts, are those of all data."""
    monkeypatch.setattr(trie_lm, "SHARD_TOKENS", 20)
    data = [(k, f"dear {['sir', 'madam', 'all'][k % 3]} the " + " the ".join(f"w{k * j % 37}" for j in range(2, 12))) for k in range(60)]
    tokens = [[*t.split(), None] for _, t in data]
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in data]
    c, pairs, before = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
            before.update([0, *t[:-1]])
    n, v = sum(c.values()), len(c)
    types = Counter(h for h, _ in pairs)
    assert n // 20 > max(types.values())
    once, twice = (sum(x == k for x in pairs.values()) for k in (1, 2))
    cut = min(0.95, once / (once + 2 * twice)) if once else 0.5
    got = {r.doc_id: r for r in trie_lm.score_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for (k, _), t in zip(data, tokens, strict=True):
        want = 0.0
        for x, w in zip([0, *t[:-1]], t, strict=True):
            p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            want += math.log10((max(pairs[x, w] - cut, 0) + cut * types[x] * p) / before[x] if before[x] else p)
        assert got[k].n_tokens == len(t) and abs(got[k].score - want) < 0.03 * len(t)


def test_elias_fano():
    import numpy as np

    from siegelog.llm.elias_fano import EliasFano, Levels

    pick = np.random.default_rng(5)
    for n, universe in [(0, 10), (1, 1), (5, 7), (2000, 1 << 64), (1000, 1500)]:
        values = np.unique(pick.integers(0, universe, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        sequence = EliasFano(Levels(), "x", values, universe).open()
        asked = np.concatenate([values, pick.integers(0, universe, 500, dtype=np.uint64)])
        assert (sequence.access(np.arange(len(values))) == values).all()
        assert (sequence.find(values) == np.arange(len(values))).all()
        if n:
            assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
