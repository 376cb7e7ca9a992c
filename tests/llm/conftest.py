from __future__ import annotations

import random

import pytest

ODD = [None, "", " \t\n", "a", "two words", "TWO words", "日本語 ñandú ß", "x" * 3000, "12 34 !!", "don't  stop\r\n"]


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with odd texts, near and exact copies and columns whose names clash."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    texts = list(ODD)
    for n in (3, 12, 40, 200, 900):
        for _ in range(4):
            texts.append(" ".join(draw.choice(words) for _ in range(n)))
    for base in texts[-8:]:
        copy = base.split()
        for _ in range(2):
            copy[draw.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts.append(base.upper())
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens int, score string")
