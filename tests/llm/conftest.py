"""Documents with every edge the operators must bear."""

import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, spans string, gram bigint, part int, label string"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("aeioubcdrstl") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    rnd = random.Random(3)
    passage, long = sentence(rnd, 70), sentence(rnd, 6000)
    base = sentence(rnd, 120)
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "ONE TWO three", "!!! ??? 123", "漢字 かな 🎉 ퟿",
        long, long, long + " end", passage, f"start {passage} stop", f"{sentence(rnd, 40)} {passage}", passage.upper(),
        f"mail A.B@example.com, +49 (30) 1234567, 4111 1111 1111 1111 and 10.0.0.1 {sentence(rnd, 30)}",
        "x " * 300, ("same line here\n" * 20), "the of and to in a is that for " * 9, "<|endoftext|> don't 's ½ İ Σ",
        " ".join(["word"] * 49), " ".join(["word"] * 50), "a b c", base,
    ]
    for _ in range(12):
        words = base.split()
        for _ in range(2):
            words[rnd.randrange(len(words))] = sentence(rnd, 1)
        texts.append(" ".join(words))
    langs = ["en", None, "de", "en", "fr"]
    return [(i, t, langs[i % 5], f"s{i % 3}", None if i % 4 == 0 else len(t or ""), f"r{i}", "x", i, 1, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, COLUMNS)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def doubled(spark, edge_rows):
    """Every row twice."""
    return spark.createDataFrame(edge_rows * 2, COLUMNS)
