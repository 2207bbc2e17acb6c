import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import simhash
from noticelake.llm.common import read_table


def word_sets(text, shingle=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_groups(rows, similarity=0.8):
    """Least id of each row's group, over all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, word_sets(t)) for i, t in rows]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            small, large = sorted((len(x), len(y)))
            if small >= similarity * large and jaccard(x, y) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def made_up(rng, n):
    return [f"w{rng.randrange(4_000)}" for _ in range(n)]


def test_planted_edits_are_found(spark):
    # Two rows a pair: at the similarity itself up to nearly equal, next to texts of nobody's kind.
    rng, rows, pairs = random.Random(5), [], {}
    for i in range(600):
        words = made_up(rng, rng.randint(60, 300))
        other = edited(words, rng.randint(1, max(1, len(words) // 30)), rng)
        s = jaccard(word_sets(" ".join(words)), word_sets(" ".join(other)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other).upper() if i % 9 == 0 else " ".join(other))]
        pairs[2 * i + 1] = s
    rows += [(5_000 + i, " ".join(made_up(rng, 120))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(docs).collect()}
    close = [i for i, s in pairs.items() if s >= 0.8]
    edge = [i for i, s in pairs.items() if 0.8 <= s < 0.85]
    assert len(close) > 350 and len(edge) > 60
    assert sum(i not in kept for i in close) / len(close) >= 0.95
    assert sum(i not in kept for i in edge) / len(edge) >= 0.9
    assert all(i in kept for i, s in pairs.items() if s < 0.8)
    assert {i for i, _ in rows if i % 2 == 0 or i >= 5_000} <= kept


@pytest.mark.parametrize("tree_size", [2_000, 20])
def test_one_large_group(spark, tree_size):
    rng = random.Random(6)
    base = made_up(rng, 200)
    rows = [(i, " ".join(edited(base, rng.randint(0, 3), rng))) for i in range(1_500)]
    rows += [(10_000 + i, " ".join(made_up(rng, 50))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(docs, tree_size=tree_size).collect()}
    assert {i for i in kept if i >= 10_000} == {10_000 + i for i in range(50)}
    assert 0 in kept and len(kept) <= 52


def test_groups_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(docs).collect()}
    want = set(brute_groups(rows).values())
    assert want <= kept and len(kept - want) <= 1


def test_rows_without_words_ids_or_equals(spark):
    given = [(3, None), (4, ""), (5, " \n"), (None, "a b"), (7, "A  b"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "b a"), (None, "lonely"), (None, "lonely")]
    docs = spark.createDataFrame(given, "doc_id long, text string").coalesce(1).withColumn("row", F.lit("x")).withColumn("fp", F.lit("y"))
    found = simhash.keep_one_of_similar(docs)
    assert found.columns == ["doc_id", "text", "row", "fp"]
    assert sorted(map(str, found.collect())) == sorted(
        f"Row(doc_id={i}, text={t!r}, row='x', fp='y')" for i, t in [(3, None), (7, "A  b"), (8, "a b c d e f"), (9, "b a"), (None, "lonely")]
    )
    assert simhash.keep_one_of_similar(docs.limit(0)).count() == 0


def test_blocks_grow_slowly():
    widths = [simhash.blocks_for(n) for n in (1, 10**3, 10**5, 10**7, 10**10)]
    assert widths == sorted(widths) and widths[-1][0] <= 34 and widths[-1][1] < 900
    for width, blocks in widths:
        same = 1 - np.arccos(1.6 / 1.8) / np.pi
        assert 1 - (1 - same**width) ** blocks >= simhash.FOUND
