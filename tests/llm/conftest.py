import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, id string, h string"


def frame(spark, texts, ids=None):
    """A table of documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if t else None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


#: Null, empty, blank, short, repeated, very long, one endless word, control and other characters.
ODD = [
    None, "", " \n\t ", "One", "one", "One two three", sentence(1, 200), sentence(1, 200), sentence(2, 9000), "a" * 3000, "x\x00y \x1c\x85 z ", "<|endoftext|> don't <|startoftext|>x",
    "ÀÉ ﬁ İstanbul ΑΣ 日本語 é", sentence(3, 60) + " " + sentence(1, 150), "a\n\nb\n", "\n\n\n", "line one here\nline two here\nline three here\nline four\n" * 20,
]


@pytest.fixture
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])
