import random

import pytest

#: Names that operators might use inside, to clash with.
CLASHES = ["row", "_row", "all", "_text", "_d", "fp", "score", "matches", "n_words", "ids", "host", "a"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def sentences(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage, copied = sentences(rng, 50), sentences(rng, 90)
    near = copied.split()
    near[40] = "changed"
    texts = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Three words only"), (6, copied), (7, copied), (8, " ".join(near)),
        (9, sentences(rng, 40) + "\n" + passage + " " + sentences(rng, 30)), (10, passage + "\n" + sentences(rng, 5)), (11, sentences(rng, 20) + " " + passage),
        (12, sentences(rng, 30000)), (13, "x" * 50000), (14, "ha " * 300), (15, "née Übergröße İstanbul x　y \x1c z <|endoftext|>"),
        (16, (passage + " . ") * 2), (17, sentences(rng, 35)), (17, sentences(rng, 60)), (None, "no id at all"), (None, copied), (None, None),
        (18, "same row"), (18, "same row"), (18, "same row"), (19, copied), (20, copied), (20, copied), (-3, "negative id " + sentences(rng, 45)),
    ]
    return [(d, t, "en" if k % 2 else None, "s", len(t) if t else None, *[f"c{k}"[: 1 + len(t or "") % 3]] * len(CLASHES)) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
