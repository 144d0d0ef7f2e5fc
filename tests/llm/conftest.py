import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, size long, row_key string"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and odd texts, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["été", "naïve", "The", "THE", "a"]
    passage = " ".join(rng.choice(words) for _ in range(55))
    texts: list[str | None] = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        texts.append(" ".join(body) + ("\n" if i % 2 else "\t ") + " ".join(body[:12]))
    for k in range(0, 30, 3):
        near = texts[k].split(" ")
        near[len(near) // 2] = "changed"
        texts += [texts[k], " ".join(near)]
    texts += [None, "", " \n\t ", "one", "one two three", "x " * 60, "!!! ??? 12"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", None]), len(t or ""), i, i * 7, str(i)) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], "en", "c", 1, 1, 1, "x")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Columns beside those of documents have names that operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
