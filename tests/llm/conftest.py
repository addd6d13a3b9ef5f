"""Documents with every awkward case, and the brute-force helpers."""

from __future__ import annotations

import random
import re

import pytest

from tests.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, target double, shard int, _h string"


def make_rows(seed: int = 5) -> list[tuple]:
    """Null and empty texts, null keys and sources, copies, near copies, shared passages, long words, clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(150)] + ["straße", "éèê", "日本語", "x" * 300]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120)
    texts = [None, "", " \n\t ", "one", "a b c", "aaa " * 400, "the same line\n" * 30, base, base, base, passage, text(3000)]
    for _ in range(12):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{text(rng.randint(1, 40))} {passage} {text(rng.randint(1, 40))}\n{text(10)}" for _ in range(10)]
    texts += [text(rng.randint(1, 90)) for _ in range(25)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or ""), i, 1.0, 7, "clash") for i, t in enumerate(texts)]
    return rows + [rows[9], rows[-1]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def keyless(spark):
    """Rows whose every column may be null."""
    return spark.createDataFrame([(None,) * 9, (None, "some words here", None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None, None), *[(None, " ".join(f"w{i}" for i in range(200)), None, None, None, None, None, None, None)] * 2], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
