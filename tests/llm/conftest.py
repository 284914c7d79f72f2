import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, label string, _w string, bucket int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, runs, periods, empties, nulls and a long one."""
    rng = random.Random(5)
    out, base, passage = [], words(rng, 300), words(rng, 60)
    for k in range(60):
        out.append(" ".join(words(rng, rng.randrange(1, 200))))
        if k % 6 == 0:
            out.append(" ".join(base))
        if k % 5 == 0:
            near = list(base)
            for _ in range(rng.randrange(1, 14)):
                near[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(near))
        if k % 4 == 0:
            out.append(" ".join(words(rng, 30) + passage + words(rng, 30)) + "\n")
    out += ["a " * 200, "a " * 120, "ab " * 77, "x y " * 90, "y x " * 80, "", None, " \n\t ", "one", "One", "two words", "é ü 😀 " * 40, "<|endoftext|> tail", " ".join(words(rng, 12_000, 10**6)), "line\nline\nline\n"]
    order = list(range(len(out)))
    rng.shuffle(order)
    return {3 * k + 1: out[i] for k, i in enumerate(order)}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 7 == 0 else "en", "s1" if i % 2 else None, 0, 9, "x", "y", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
