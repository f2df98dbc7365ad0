"""The pipeline stage by stage, and a run, against brute force."""

from __future__ import annotations

from collections import Counter

from tests.llm.data import documents, none, rows
from tests.llm.test_text_operators import brute_join, quality_rows, verdicts

from siegelog.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, row string, once boolean"


def full(data):
    return [(i, t, lang, "src1", len(t or ""), "clash", "clash", True) for i, t, lang in data]


def test_quality_stage(spark):
    import corpus_pipeline as P

    data = quality_rows()
    frame = spark.createDataFrame(full(data), SCHEMA).repartition(3)
    out = P.quality_stage(spark, frame, "")
    assert out.columns == frame.columns and out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    want = Counter(r for r, (_, _, kept) in zip(full(data), verdicts(data), strict=True) if kept)
    assert Counter(map(tuple, out.collect())) == want
    assert P.quality_stage(spark, none(spark), "").count() == 0


def survivors(data):
    """Rows (id, text) that stay: of each component the smallest, told apart by row and not by id."""
    from tests.llm.test_text_operators import shingles

    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (data[a][0], data[b][0]) and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups: dict = {}
    for k, (i, t) in enumerate(data):
        groups.setdefault(("alone", k) if i is None or not sets[k] else find(k), []).append((i, t))
    return groups.values()


def test_near_duplicate_stage(spark):
    import corpus_pipeline as P

    data = [(r[0], r[1]) for r in rows()] + [(2, "a text under an id that another text has"), (7001, rows()[7][1]), (7001, "unique words under seven thousand and one")]
    frame = spark.createDataFrame([(i, t, "en", "src1", 0, "clash", "clash", True) for i, t in data], SCHEMA).repartition(3)
    out = P.near_duplicate_stage(spark, frame, "")
    assert out.columns == frame.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    for group in survivors(data):
        kept = [row for row in set(group) if left[row]]
        assert len(kept) == 1 and kept[0][0] == (min(i for i, _ in group) if group[0][0] is not None else None)
        left[kept[0]] -= 1
    assert not +left
    assert P.near_duplicate_stage(spark, none(spark), "").count() == 0


def test_pseudonym_and_mixing_stages(spark):
    import corpus_pipeline as P

    df = documents(spark)
    hidden = P.pseudonym_stage(spark, df, "")
    assert hidden.columns == df.columns and hidden.filter("text like '%4539578763621486%' or text like '%a.b@c.example.org%'").count() == 0
    assert hidden.count() == df.count()
    mix = P.mixing_stage(spark, df, "")
    assert mix.columns == df.columns
    have, left = Counter(map(tuple, df.collect())), Counter(map(tuple, mix.collect()))
    assert 0 < left.total() < have.total() and not left - have
    tokens = lambda c: sum(n * len((r[1] or "").split()) for r, n in c.items())
    assert tokens(left) >= 0.9 * tokens(have) - 3


def test_run(spark, tmp_path):
    """Stage after stage on what the one before kept: the pieces hold the tokens of the texts that reach the end."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    frame = spark.createDataFrame(full(quality_rows()), SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t, k in ((i, t, k) for (i, t, _), (_, _, k) in zip(quality_rows(), verdicts(quality_rows()), strict=True)) if k]
    reach = [next(iter(g)) for g in survivors(kept)]
    out = P.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out[0].asDict())
    ids = {r.doc_id for r in out}
    assert ids <= {i for i, _ in reach} and len(ids) >= 0.8 * len({i for i, _ in reach})
    tokenizer = Tokenizer.from_file(tokenizer_path())
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in reach}
    assert all(r.doc_tokens == length[r.doc_id] for r in out)
    assert sum(r.length for r in out) == sum(length[i] for i in ids)
    assert docs.count() == len(quality_rows()) and [n for n, _ in P.STAGES] == ["quality rules", "n-gram join", "pseudonyms", "mixing", "packing"]
    assert brute_join([(i, t) for i, t in reach])
