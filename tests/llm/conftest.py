import random

import pytest

#: Columns that clash with names the operators use inside or return.
CLASHING = "kept string, start string, n long, id string, block int, label int, x int, component string, bucket string, raw string"


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "an", "é", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def hostile_rows():
    """Nulls, blanks, repeats, ties, near copies, shared passages, one very long text."""
    rng = random.Random(11)
    base = words(rng, 120)
    passage = words(rng, 25)
    rows = [
        (1, base), (2, None), (3, ""), (4, "  \n\t "), (5, words(rng, 40_000)), (6, base), (6, base), (None, base),
        (None, None), (7, "ab"), (8, "a <|endoftext|> b"), (9, "two  spaces\tand tabs "), (10, "one two three four"),
        (11, "ONE TWO three four"), (12, base.replace(" ", "  ", 1)), (13, words(rng, 30) + "\n" + passage),
        (14, passage + "\n" + words(rng, 30)), (15, "\n\n" + passage + "\n"), (16, "é" * 200), (17, "a" * 500),
        (18, "a" * 120 + "b" + "a" * 70),
    ]
    near = base.split()
    for k in range(20, 40):  # near copies of a near copy, and so on
        near[rng.randrange(len(near))] = words(rng, 1)
        rows.append((k, " ".join(near)))
    return rows


@pytest.fixture(scope="session")
def hostile(spark):
    rows = [(k, t, "kept", None, 3, "id", 1, 0, 1, None, "b", "raw") for k, t in hostile_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASHING}")
