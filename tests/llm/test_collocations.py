import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticelake.llm import collocations, queries
from noticelake.llm.collocations import Summary
from oracle import connect, difference


def brute(rows, threshold, share, top):
    counts, totals = {}, {}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] = totals.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: c for k, c in counts.items() if c >= threshold and len(k[1]) > 1}
    out = {}
    for (lang, w), a in often.items():
        score, _, left, right = min(
            (1_000_000 * a * a // (counts[lang, w[:c]] * counts[lang, w[c:]]), c, counts[lang, w[:c]], counts[lang, w[c:]])
            for c in range(1, len(w))
        )
        inside = len(w) == 2 and any(
            m == lang and len(v) == 3 and w in (v[:2], v[1:]) and 100 * b >= share * a for (m, v), b in often.items()
        )
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    ]


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(3)
    words = [rng.choice("abcé") + rng.choice("xyzÄ") + rng.choice(["", "q", "Q"]) for _ in range(25)]
    rows = []
    for i in range(300):
        w = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", "\x0b"]) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice(["", "big deal of "]) + "".join(w), rng.choice(["en", "en", "fr", None]), "s", 1))
    rows += [(None, None, None, None, None), (1, "", "xx", "s", 1), rows[3], rows[3], (9, "new york city " * 4_000, "en", "s", 1)]
    rows.append((10, "alone " * 2 + "!", "de", "s", 1))
    return rows


@pytest.mark.parametrize("threshold,most_bits", [(10, collocations.MOST_BITS), (3, 1 << 12), (1, 1 << 14)])
def test_against_brute_force(spark, phrases, threshold, most_bits):
    docs = spark.createDataFrame(phrases, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    clashing = docs.withColumn("k", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("score", F.lit(1))
    found = collocations.collocations(clashing, threshold, 50, 40, most_bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(brute(phrases, threshold, 50, 40))


def test_blocks_do_not_matter(phrases, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in phrases], "text": [r[1] or "" for r in phrases]})

    def summed():
        blocks, counts = 0, Counter()
        for out in collocations._summarise(3)(iter([batch])):
            blocks += 1
            for row in out.to_pylist():
                if row["keys"] is None:
                    counts["mass", row["part"]] += row["mass"]
                    continue
                for key in np.frombuffer(row["once"], "<u4").tolist():
                    counts[row["part"], key] += 1
                for key, n in zip(np.frombuffer(row["keys"], "<u4").tolist(), np.frombuffer(row["counts"], "<u4").tolist()):
                    counts[row["part"], key] += n
        return blocks, counts

    one, whole = summed()
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 50)
    monkeypatch.setattr(collocations, "BLOCK_KINDS", 20)
    many, pieces = summed()
    assert one == 1 and many > 50 and whole == pieces


def test_empty_tables(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    blank = spark.createDataFrame([(1, " \n", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(blank).count() == 0


def test_counts_beyond_64_bits_of_product(spark):
    a = 3_000_000_000
    row = spark.createDataFrame([(a, a + 7, a + 9)], "a long, l long, r long")
    score = "(cast(a as decimal(38, 0)) * a * 1000000) div (cast(l as decimal(38, 0)) * r)"
    assert row.select(F.expr(score)).first()[0] == 1_000_000 * a * a // ((a + 7) * (a + 9))


@pytest.mark.parametrize("threshold", [2, 5, 10])
def test_no_frequent_key_is_lost(threshold):
    rng = np.random.default_rng(threshold)
    for trial in range(30):
        stream = np.concatenate((rng.zipf(1.3, 4_000) % 5_000, np.repeat(rng.integers(5_000, 5_200, 40), threshold)))
        rng.shuffle(stream)
        summary = Summary(len(stream) // threshold + 1)
        for block in np.array_split(stream, 1 + trial):
            summary.add(*np.unique(block, return_counts=True))
            if trial % 2:
                summary.merge()
        kept = set(summary.frequent(threshold).tolist())
        assert {k for k, c in Counter(stream.tolist()).items() if c >= threshold} <= kept
        assert summary.short < threshold and len(summary.keys) <= summary.capacity


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op11_collocations(spark, sf), connect(sf), queries.OP11_SQL) is None
