import random

import pytest

#: Columns whose names occur inside the operators, beside those of documents.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, sk string, z string, n_words string, spans string, token long, root long, digest string, mark long, items string, rid long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}{rng.choice(['', '', ',', '.'])}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, a very long text, copies, near copies, shared passages, repeated rows, ties."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(24)]
    passage = prose(rng, 60)
    rows: list[tuple] = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(24, 40):  # near copies of a few
        w = list(base[i % 4 + 3])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    for i in range(40, 50):  # a passage that many share, in new surroundings
        rows.append((i, " ".join(prose(rng, 20) + passage + prose(rng, 30))))
    rows += [(i, rows[2][1]) for i in range(50, 56)]  # exact copies
    rows += [(56, None), (57, ""), (58, " \n\t "), (59, "one"), (60, "Ünïcode é ß – ＡＢ 漢字\n" * 30), (61, "a b c"), (62, "a b c")]
    rows += [(63, " ".join(prose(rng, 30_000))), (64, "x" * 5_000), (65, "the end. " * 400)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (None, "of no id, twice"), (None, "of no id, twice"), (7, "the same id as another, with a text of its own")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "x", "x", "x", 1, 1, "x", 1, "x", 1) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
