"""Small documents with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, n long, leaf string, rest string"


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(["the", "an", "er", "on", "ti", "re"]) for _ in range(pick.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    texts: list[tuple] = []
    for k in range(12):
        body = prose(k, 60 + 10 * k)
        texts += [body, body.upper(), body + " tail", body.replace("the", "The", 1)]
        words = body.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \n\t", "one", "One", "one two", "a b c d", "a b c d e", prose(99, 20_000), "x" * 50_000]
    texts += ["line one here\nline one here\nother", "#*$%&|<> " * 60, "mail a.b@c.example.org card 4539578763621486"]
    out = [(k, t, ["en", "de", None][k % 3], ["src0", "src1", "src12", None][k % 4], len(t or "")) for k, t in enumerate(texts)]
    out += [(None, "no id at all", "en", "src0", 12), out[3], out[3], (2, "another text under an id", "en", "src0", 5)]
    return [(*r, "clash", 7, "clash", "clash") for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
