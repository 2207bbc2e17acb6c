import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from noticelake.llm import phrase_dedup, repeats, suffix_dedup
from noticelake.llm.common import merged, sliding_min, window_hashes



def brute_bytes(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = merged(np.array([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]).reshape(-1, 2))
        edges = [0, *(x for g in gone for x in g), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append((doc_id, len(t), len(t) - len(kept), len(gone), kept))
    return Counter(out)


def brute_words(rows, width):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    for doc_id, w in texts:
        for i in range(len(w) - width + 1 if doc_id is not None else 0):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, doc_id), doc_id)
    out = []
    for doc_id, w in texts:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1 if doc_id is not None else 0):
            if least[tuple(w[i : i + width])] < doc_id:
                gone[i : i + width] = True
        out.append((doc_id, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("limit", [1_000, 1])
@pytest.mark.parametrize("length,gram", [(40, 8), (100, 48)])
def test_bytes_against_brute_force(docs, rows, length, gram, limit):
    found = suffix_dedup.remove_repeats(docs, length, gram, limit).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found) == brute_bytes(rows, length)


@pytest.mark.parametrize("limit", [1_000, 1])
@pytest.mark.parametrize("width,gram", [(12, 4), (50, 8)])
def test_words_against_brute_force(docs, rows, width, gram, limit):
    found = phrase_dedup.remove_passages(docs, width, gram, limit).collect()
    assert Counter((r[0], r[1], r[2], bytes(r[3])) for r in found) == brute_words(rows, width)


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert phrase_dedup.remove_passages(no_docs).count() == 0


def test_suffix_array_orders_suffixes():
    rng = random.Random(3)
    for _ in range(30):
        pieces = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        joined = b"\0".join(pieces) + b"\0"
        ends, at = {}, 0
        for p in pieces:
            for i in range(len(p) + 1):
                ends[at + i] = at + len(p)
            at += len(p) + 1
        order = suffix_array_of(pieces)
        assert sorted(order) == list(range(len(joined)))
        strings = [joined[p : ends[p]] for p in order]
        assert strings == sorted(strings)


def suffix_array_of(pieces):
    return suffix_dedup.suffix_array(pieces, 1_000).tolist()


def test_common_prefixes():
    joined = np.frombuffer(b"abcdefghijabcdefghikabc", np.uint8)
    left, right = np.array([0, 1, 0]), np.array([10, 11, 20])
    assert suffix_dedup.common_prefixes(joined, left, right, 400).tolist()[:2] == [9, 8]
    assert suffix_dedup.common_prefixes(joined, left, right, 5).tolist()[:2] == [5, 5]


def test_windows():
    values = np.array([5, 3, 9, 1, 1, 8, 7], np.uint64)
    for width in range(1, 8):
        assert sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(8 - width)]
    units = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    for length in range(1, 7):
        h = window_hashes(units, length)
        same = {(tuple(units[i : i + length]), int(h[i])) for i in range(len(h))}
        assert len(same) == len({k for k, _ in same}) == len({v for _, v in same})


def test_shards_hold_exact_windows():
    a, b = [b"x%d" % i for i in range(20)], [b"y"] * 3 + [b"x%d" % i for i in range(5, 18)] + [b"z"]
    found = phrase_dedup.shard_matches([a, b], [9, 4], 10)
    assert found[1] == [(3, 7, 4)]
    assert found[0] == [(5, 9, 4)]


def test_segments_with_an_inner_repeat_meet_the_others(spark):
    # A holds its minimizer V twice, B once; both hold V + tail.
    rng = random.Random(11)

    def letters(k):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))

    rows = []
    for i in range(20):
        v = min((letters(48) for _ in range(4_000)), key=lambda t: window_hashes(np.frombuffer(t.encode(), np.uint8), 48)[0])
        tail = letters(rng.randint(352, 420))
        rows.append((2 * i, letters(50) + v + letters(rng.randint(1, 250)) + v + tail))
        rows.append((2 * i + 1, letters(60) + v + tail))
    want = brute_bytes(rows, 400)
    assert all(r[2] >= 400 for r in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(docs, 400, 48, 1_000).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found) == want


@pytest.mark.parametrize("bits", [4, 16, 24])
def test_marks_never_miss(spark, bits):
    rows = spark.range(5_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    found = rows.where("a % 10 = 3").unionByName(rows.where("a = 13"))
    marked = repeats.marked(rows, ["a", "b"], found, bits)
    assert marked.columns == ["a", "b", "maybe"] and marked.count() == 5_000
    assert marked.where("a % 10 = 3 and not maybe").count() == 0
    others = marked.where("a % 10 <> 3 and maybe").count()
    assert others < 10 if bits == 24 else others > 0
    assert repeats.marked(rows, ["a", "b"], found.limit(0), bits).where("maybe").count() == 0


def test_planted_passages_show_and_clean_documents_stay(spark):
    rng = random.Random(21)

    def letters(k):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))

    passage, rows = letters(420), []
    for i in range(400):
        rows.append((i, letters(900) + (passage if i % 8 == 0 else "") + letters(900)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("maybe", F.lit(True))
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert all(found[i] >= 420 if i % 8 == 0 else found[i] == 0 for i in range(400))
    words = " ".join(letters(5).replace(" ", "q") for _ in range(60))
    given = [(i, letters(500) + (f" {words} " if i % 8 == 0 else " ") + letters(500)) for i in range(400)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("id", F.lit(2))
    found = {r["doc_id"]: r["n_removed"] for r in phrase_dedup.remove_passages(docs).collect()}
    assert all(found[i] == (60 if i % 8 == 0 and i else 0) for i in range(400))
