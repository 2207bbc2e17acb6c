import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from noticelake.llm import periodic_runs, queries
from noticelake.llm.common import read_table


def brute_runs(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in out.items())


def brute_row(doc_id, words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least,times", [(6, 4), (4, 2), (6, 3)])
def test_runs_against_brute_force(least, times):
    rng = random.Random(4)
    for _ in range(1_500):
        letters, w = rng.choice([1, 2, 3, 5, 20]), []
        for _ in range(rng.randint(0, 5)):
            u = [rng.randrange(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9)
            w += u[: rng.randint(1, len(u))]
        assert periodic_runs.runs_of(w, least, times) == brute_runs(w, least, times)


def test_last_occurrences_are_exact():
    rng = random.Random(5)
    for _ in range(150):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        seen = periodic_runs.LastOccurrences()
        for i, x in enumerate(w):
            pieces, low = seen.append(x), 0
            pieces.sort(key=lambda p: p[1])
            for end, longest in pieces:
                for k in range(low + 1, longest + 1):
                    assert end == max(e for e in range(i) if e + 1 >= k and w[e + 1 - k : e + 1] == w[i + 1 - k : i + 1])
                low = longest
            assert low == max((k for k in range(i + 1) if any(w[e + 1 - k : e + 1] == w[i + 1 - k : i + 1] for e in range(k - 1, i))), default=0)


def test_long_runs_take_time_in_proportion():
    base = list(range(900))
    assert periodic_runs.runs_of([base[i % 900] for i in range(20_000)]) == [(0, 20_000, 900)]
    assert periodic_runs.runs_of([0] * 30_000) == [(0, 30_000, 1)]


def test_rows(docs, rows):
    clashing = docs.withColumn("runs", F.lit(1)).withColumn("best", F.lit(2)).withColumn("collapsed", F.lit("x"))
    found = periodic_runs.collapse_runs(clashing)
    assert found.columns == ["doc_id", "n_words", "runs", "best", "collapsed", "runs_sha256"]
    got = []
    for r in found.collect():
        best = r.best and (*r.best, 1000 * r.best.length // r.best.period)
        got.append((r.doc_id, len(r.runs), *(best or (None,) * 4), r.runs_sha256, hashlib.sha256(r.collapsed.encode()).hexdigest()))
    want = [brute_row(r[0], (r[1] or "").encode().split()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(no_docs):
    assert periodic_runs.collapse_runs(no_docs).count() == 0


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = []
    for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append(brute_row(r.doc_id, words))
    got = queries.op13_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5
