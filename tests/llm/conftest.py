import random

import pytest

WORDS = "the and of stone river quiet lamp follow orange seven paper window under garden letter bridge morning silver table carry".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, short and very long ones, odd characters, copies."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 60)
    out = [None, "", " \n\t ", "one", "two words", "a b c d", "\n\nline\n\nline\nline\n", "é😀 中文 Ünïcode ß\u0130 Σίσυφος", long, long, base, base, base.replace("stone", "rock", 1), base + " tail end", "x" * 5000, "a  b   c \n d", "AKIA" + "A1" * 10 + " password: 'hunter2222' token=abcdef0123456789abcdef0123456789"]
    return out + [prose(rng, rng.randint(1, 80)) for _ in range(40)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with a repeated row, a null id and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t), "x", 1.5, 7) for i, t in enumerate(texts)]
    rows += [rows[10], (None, "a text without an id", None, "src1", 20, "y", 2.5, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score double, n_tokens int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
