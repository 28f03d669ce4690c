import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, h long, digest string, n long, size long, start long, _id long, words string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, nulls, blanks and one long text."""
    rng = random.Random(3)
    words = vocabulary(rng)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randrange(40, 120)) for _ in range(20)]
    passage = prose(60)
    out = [None, "", " \t\n", "one", "One  two", "one two", "...!?", "é ü 漢字", *base, *base[:5], base[0].replace(" ", "  ").upper()]
    for t in base[:8]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed" + str(rng.randrange(99))
            out.append(" ".join(v))
    out += [f"{prose(30)} {passage} {prose(20)}" for _ in range(6)]
    out.append(prose(9000))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with columns whose names clash with the operators' own."""
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", None]), 0, *[7] * 3, "x", *[7] * 4, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
