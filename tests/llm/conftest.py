import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, set long, size long, rank int, part string, label int, v binary, th long"


def row(doc_id, text, lang="en", source="s"):
    """With columns named as operators name their own."""
    return (doc_id, text, lang, source, len(text or ""), 1, "k", 2, 3, 4, "p", 5, b"v", 6)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choices(words, k=40_000))
    rows = [
        row(1, "one line that is long enough\nshort"), row(2, "one line that is long enough\nother"), row(3, None), row(4, ""), row(None, "one line that is long enough"), row(None, None, None, None),
        row(5, long), row(6, long + " end"), row(7, "same text for both rows here"), row(7, "same text for both rows here"), row(8, "MIT License, mit license", None, None), row(9, "!!! ... 123 \n\n", "de", "t"),
        row(10, "é ü 漢字 👩‍👩‍👧   a b", "fr", "t"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """300 documents with exact copies, near copies, shared lines and shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(2000)]
    passage = " ".join(rng.choices(words, k=90))
    header = "a header that very many documents have"
    texts = []
    for k in range(300):
        kind = rng.random()
        if kind < 0.1 and texts:
            text = rng.choice(texts)
        elif kind < 0.3 and texts:
            own = rng.choice(texts).split(" ")
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        else:
            text = "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.2:
            text = text + " " + passage + " " + rng.choice(words)
        if rng.random() < 0.3:
            text = header + "\n" + text
        texts.append(text)
    return spark.createDataFrame([row(k, text, rng.choice(["en", "de"]), f"src{k % 5}") for k, text in enumerate(texts)], SCHEMA)


def pairs(df, *names):
    return [tuple(x[name] for name in names) for x in df.select("doc_id", "text").collect()] if not names else [tuple(x[n] for n in names) for x in df.collect()]
