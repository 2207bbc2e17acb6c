import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def make_rows(seed=1, n=60):
    """Texts of made-up words with exact and near copies, shared passages, periodic stretches, NULLs and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 5))) for _ in range(60)]

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage = words(70)
    rows = []
    for i in range(n):
        kind = i % 10
        w = words(rng.randint(1, 160))
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            at = rng.randrange(len(w))
            text = " ".join(w[:at] + passage[rng.randint(0, 15) : rng.randint(55, 70)] + w[at:])
        elif kind == 3:
            base = (rows[0][1] or "").split()
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 4:
            text = "ab " * rng.randint(1, 200)
        elif kind == 5:
            text = rng.choice([None, "", " \n\t ", "x", "#|$ 12 <>"])
        else:
            text = " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :])
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), None))
    rows += [rows[0], rows[0], rows[12], (None, rows[0][1], "en", "a", 1), (None, None, None, None, None), (7, "same id", "en", "a", 2)]
    rows.append((900, " ".join(words(6000)), "en", "b", 3))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
