"""Small documents with the odd cases that every operator has to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tile string, id bigint, starts string"
WORDS = "the of and tion ande Erre ouin é ßen thatst blé x".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", rng.choice("abcdefgh"), str(rng.randrange(90))]) for _ in range(n))


def odd_rows(seed: int = 3, n: int = 40) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, one long text, exact and near copies, repeated rows, no id."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(5, 120)) for _ in range(n)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(n, n + 25):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((k, " ".join(words)))
    passage = sentence(rng, 60)
    rows += [(200 + k, f"{sentence(rng, 9)}\n{passage}\n{sentence(rng, k)}") for k in range(5)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "two words"), (305, "ONE"), (306, "two  WORDS")]
    rows += [(307, sentence(rng, 4000)), (308, "-" * 300), (309, "ab " * 200), (310, "-" * 300)]
    rows += [(None, base[0]), (None, None), (400, base[1]), (400, base[1]), (400, base[1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple]):
    """With extra columns whose names operators use inside."""
    full = [(k, t, "en", "s", None if t is None else len(t), "tile", 5, "starts") for k, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
