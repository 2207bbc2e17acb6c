"""Benchmark decontamination by spaced seeds: masks that ignore fixed token positions, joined, then verified around hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import U64, WordHashes, mix, row_key, texts

#: Positions a seed looks at are 1. A substituted token spoils a seed only where it looks. One of these two fits into every
#: run that counts by the numbers below: without four agreeing tokens in a row, k mismatches leave at most 3 (k + 1)
#: agreeing ones; of at least 4 k, and 10 or a short item's share, that leaves room for single mismatches only, between
#: stretches of which two neighbours have two tokens or more.
MASKS = ("1111", "11011")
#: Tokens of a run that must agree, and the share of agreeing tokens in it; a mismatch costs what that share allows.
MIN_TOKENS = 10
MIN_SHARE = 0.8
#: Items with fewer tokens match only where all of them stand in a row.
LEAST_ITEM = 8
#: Positions of the filter documents are tested with before the join: 2**FILTER_BITS bits, whatever the number of items.
FILTER_BITS = 24
_PUNCTUATION = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words, ASCII punctuation taken as blanks."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PUNCTUATION).split() if text else []


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the tokens a mask looks at, from every position it fits at."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        h = np.full(n, len(mask), U64)
        for i, c in enumerate(mask):
            if c == "1":
                h = (h + ids[i : i + n]) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(29)
        return mix(h + U64(int(mask, 2)))


def item_seeds(items: DataFrame, masks: Sequence[str] = MASKS) -> tuple[DataFrame, DataFrame]:
    """``seed, item_id, item_at`` of all items, and ``item_id, item_tokens`` (hashes of its tokens)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = [hashes.of(tokens(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([x.view(np.int64) for x in ids], pa.list_(pa.int64()))],
                names=["item_id", "item_tokens"],
            )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    encoded = rows.mapInArrow(compute, "item_id long, item_tokens array<long>").where(F.size("item_tokens") > 0)
    encoded = encoded.distinct()
    shortest = min(map(len, masks))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, ids in zip(batch.column("item_id").to_pylist(), batch.column("item_tokens").to_pylist(), strict=True):
                fitting = masks if len(ids) >= shortest else ["1" * len(ids)]
                found = [seed_hashes(np.array(ids, np.int64).view(U64), m) for m in fitting]
                at = np.concatenate([np.arange(len(f)) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.full(len(at), item, np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["seed", "item_id", "item_at"],
                )

    return encoded.mapInArrow(seeds, "seed long, item_id long, item_at int"), encoded


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each seed's leading bits, put together by Spark; at most ``2**bits`` bits come to the driver."""
    at = F.shiftrightunsigned(F.col("seed"), 64 - bits)
    parts = seeds.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.collect():
        # Bucket 0 holds the value 0, bucket k those from (k - 1) * 32768 + 1; bit positions count from 0 in each.
        raw = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        found = np.flatnonzero(raw) + (r["bucket"] - 1) * 32768 + 1 if r["bucket"] else np.zeros(1, np.int64)
        np.bitwise_or.at(out, found >> 3, (1 << (found & 7)).astype(np.uint8))
    return out


def document_hits(
    docs: DataFrame, passed: np.ndarray, masks: Sequence[str] = MASKS, bits: int = FILTER_BITS, wholes: Sequence[int] = ()
) -> DataFrame:
    """``key, seed, doc_at``: the seeds of every text, at all positions, that pass the filter.

    ``wholes`` are the lengths of items too short for a mask; each text has the first place of every seed of those.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, seeds, places = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
                ids = hashes.of(tokens(text))
                for mask in [*masks, *("1" * k for k in wholes)]:
                    found = seed_hashes(ids, mask)
                    index = (found >> U64(64 - bits)).astype(np.int64)
                    at = np.flatnonzero(passed[index >> 3] >> (index & 7).astype(np.uint8) & 1)
                    if len(mask) in wholes:
                        at = at[np.unique(found[at], return_index=True)[1]]
                    if len(at):
                        keys += [key] * len(at)
                        seeds.append(found[at].view(np.int64))
                        places.append(at.astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(np.concatenate(seeds)), pa.array(np.concatenate(places))],
                    names=["key", "seed", "doc_at"],
                )

    return docs.mapInArrow(scan, "key binary, seed long, doc_at int")


def best_run(same: np.ndarray, share: float = MIN_SHARE) -> tuple[int, int, int]:
    """Agreeing tokens, start and end of the run with most of those that has ``share`` of its tokens agreeing; of equals the shortest."""
    part = round(share * 1000)
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1000 - part, -part))))
    agreeing = np.concatenate(([0], np.cumsum(same)))
    # The earliest start of a run up to each end: where the sum is not above that at the end.
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    found = agreeing - agreeing[starts]
    most = int(found.max())
    if not most:
        return 0, 0, 0
    ends = np.flatnonzero(found == most)
    starts = np.flatnonzero(same)[agreeing[starts[ends]]]
    i = int(np.argmin(ends - starts))
    return most, int(starts[i]), int(ends[i])


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, min_tokens: int = MIN_TOKENS, share: float = MIN_SHARE
) -> DataFrame:
    """``doc_id, item_id, doc_start, n_tokens, n_same`` for each document and item that overlap, on the overlap of most equal tokens.

    An overlap is a run of aligned tokens, ``share`` of them equal, with ``min_tokens`` equal ones or, for a shorter item,
    that share of the item; all tokens of an item of fewer than ``LEAST_ITEM``. The whole of every text and item is seeded; seeds meet in a shuffled join, so a seed held by
    many documents only splits its partition, and each meeting alignment is verified once. ``MASKS`` miss no overlap of
    ``MIN_TOKENS`` and ``MIN_SHARE``; lower numbers need other masks. NULL ids of items, NULL texts and items without
    tokens match nothing. Equal rows give equal rows.
    """
    seeds, encoded = item_seeds(benchmark.select("item_id", "text"), masks)
    passed = seed_filter(seeds)
    keyed = docs.select(F.col("doc_id").alias("doc_id"), row_key().alias("key"), F.col("text").alias("text"))
    sizes = encoded.select(F.size("item_tokens").alias("n")).where(F.col("n") < min(map(len, masks))).distinct().collect()
    hits = document_hits(keyed.select("key", "text"), passed, masks, wholes=sorted(r["n"] for r in sizes))
    shifts = hits.join(seeds, "seed").select("key", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    work = shifts.join(encoded, "item_id").groupBy("key").agg(
        F.collect_list(F.struct("item_id", "shift", "item_tokens")).alias("alignments")
    )
    kind = docs.schema["doc_id"].dataType

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text, work in zip(
                batch.column("doc_id").to_pylist(), texts(batch), batch.column("alignments").to_pylist(), strict=True
            ):
                ids, best = hashes.of(tokens(text)), {}
                for w in work:
                    item, shift = np.array(w["item_tokens"], np.int64).view(U64), w["shift"]
                    a, b = max(0, -shift), min(len(item), len(ids) - shift)
                    if a >= b:
                        continue
                    n_same, start, end = best_run(item[a:b] == ids[a + shift : b + shift], share)
                    enough = min(min_tokens, -(-len(item) * round(share * 1000) // 1000)) if len(item) >= LEAST_ITEM else len(item)
                    if n_same >= enough:
                        found = (n_same, -(a + shift + start), end - start)
                        best[w["item_id"]] = max(found, best.get(w["item_id"], found))
                rows += [(doc_id, item, -f[1], f[2], f[0]) for item, f in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], batch.schema.field("doc_id").type),
                    *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)),
                ],
                names=["doc_id", "item_id", "doc_start", "n_tokens", "n_same"],
            )

    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("item_id", "doc_start", "n_tokens", "n_same")])
    return keyed.join(work, "key").select("doc_id", "text", "alignments").mapInArrow(verify, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that overlap with no item, with the input's columns. Rows of one id share their fate by text."""
    named = docs.withColumn("decontaminate_key", row_key())
    found = contaminated_pairs(
        named.select(F.col("decontaminate_key").alias("doc_id"), "text"), benchmark, **options
    ).select(F.col("doc_id").alias("decontaminate_key")).distinct()
    kept = named.join(found, "decontaminate_key", "left_anti")
    return kept.select(*[kept[c] for c in docs.columns])
