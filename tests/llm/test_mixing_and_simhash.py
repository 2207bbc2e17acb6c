import itertools
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from noticelake.llm import mixing, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius=2):
    """items: (id, fingerprint). Least id each fingerprint reaches."""
    prints = sorted({f for _, f in items})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in items:
        if i is not None:
            least[find(f)].append(i)
    return {f: min(least[find(f)], default=None) for f in prints}


def test_simhash_against_brute_force(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = brute_components(prints)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == Counter((i, f, want[f]) for i, f in prints)


@pytest.mark.parametrize("tree_size", [2_000, 3])
def test_links_join_all_near_fingerprints(spark, tree_size):
    base = [0, 0x123456789ABCDEF0, (1 << 64) - 1]
    values = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 5) for j in range(0, 64, 9)} | set(base)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), tree_size=tree_size)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = brute_components([(v, v) for v in values])
    groups, wanted = defaultdict(set), defaultdict(set)
    for (s,) in signed:
        groups[roots.get(s, s)].add(s % (1 << 64))
        wanted[want[s % (1 << 64)]].add(s % (1 << 64))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {tuple(r) for r in simhash.components(links).collect()} == {(i, 0) for i in range(1, 201)}


def test_one_of_each_stays(docs, rows, no_docs):
    kept = simhash.keep_one_of_each(docs.withColumn("fp", F.lit("x")).withColumn("row", F.lit(1)))
    assert kept.columns == [*docs.columns, "fp", "row"]
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == set(want.values())
    # One row of each component: as many as there are links missing between the different fingerprints.
    near = {frozenset(g for g in want if (f ^ g).bit_count() <= 2) for f in want}
    groups = []
    for n in near:
        met = [g for g in groups if g & n]
        groups = [g for g in groups if not g & n] + [n.union(*met)]
    assert len(ids) == len(groups)
    assert simhash.keep_one_of_each(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def filled(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= limit * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_fill_up(docs, rows, no_docs):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = filled(sizes)
    for r in mixing.source_targets(docs).collect():
        assert r["mix_source_size"] == sizes[r["mix_source"]]
        assert r["mix_target"] == pytest.approx(want[r["mix_source"]])
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_repeats_rows(docs, rows):
    clashing = docs.withColumns({"mix_size": F.lit("a"), "w": F.lit(1), "level": F.lit(2)})
    rated = mixing.mixing_rates(clashing).collect()
    assert len(rated) == len(rows)
    for r in rated:
        assert int(r["mix_rate"]) <= r["mix_copies"] <= min(2, int(r["mix_rate"]) + 1)
    mixed = mixing.mix_sources(clashing)
    assert mixed.columns == clashing.columns
    again = mixing.mix_sources(clashing.repartition(5))
    count = Counter(r["doc_id"] for r in mixed.collect())
    assert count == Counter(r["doc_id"] for r in again.collect())
    copies = Counter()
    for r in rated:
        copies[r["doc_id"]] += r["mix_copies"]
    assert count == +copies
