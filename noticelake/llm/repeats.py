"""Windows that recur in a corpus, dealt out by content: what the two operators on long repeated passages share.

Every window of ``width`` units has a minimizer: the least hash of its runs of ``gram`` units. Equal windows have equal
minimizers, so windows of different minimizers are never compared. Neighbouring windows mostly share theirs; such a
stretch of windows is a *segment*, and a corpus has about one per ``(width - gram) / 2`` units. Segments travel as a few
numbers; contents are fetched only for one of each kind of segment whose minimizer several different segments have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import U64, sliding_min, stage, texts, window_hashes

#: Different segments of a minimizer that are compared with each other; where there are more, their windows are dealt out
#: one by one by a hash of 128 bits, which Spark groups with map-side combine.
GROUP_LIMIT = 1_000
#: Positions of the filters that keep rows without a partner out of the joins: 2**FILTER_BITS bits, whatever the corpus.
FILTER_BITS = 24


def keyed(docs: DataFrame) -> DataFrame:
    """``id, doc_id, t, text``: rows equal in id and text share ``(doc_id, t)`` and get equal results.

    ``id`` is the input's; ``doc_id`` has the least number in place of NULL, so that rows without id can be joined.
    """
    number = F.col("doc_id").cast("long")
    return docs.select(
        number.alias("id"),
        F.coalesce(number, F.lit(-(1 << 63))).alias("doc_id"),
        F.xxhash64("text", F.lit("row")).alias("t"),
        F.col("text").alias("text"),
    )


def segments_of(units: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each segment; and the hashes of all grams.

    No segment has more than ``width - gram + 1`` windows, so periodic texts give bounded ones too.
    """
    grams = window_hashes(units, gram)
    span = width - gram + 1
    least = sliding_min(grams, span)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.concatenate((first, [len(least)])))
    if (n > span).any():
        pieces = -(-n // span)
        ahead = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(first + n, pieces)
        first = np.repeat(first, pieces) + ahead * span
        n = np.minimum(first + span, ends) - first
    return least[first], first, n, grams


def stored_segments(rows: DataFrame, cut: Callable[[bytes], tuple[list, ...] | None]) -> DataFrame:
    """Segments of all texts, stored: ``sid, doc_id, t, m, h1, h2, start, n, inner, place``.

    ``cut`` gives minimizers, starts, window counts, 16-byte content digests, whether the minimizer occurs twice, and its
    first place in the content.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                parts = []
                for doc_id, t, text in zip(
                    batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), texts(batch), strict=True
                ):
                    if text and (found := cut(text)) is not None:
                        m, start, n, digests, inner, place = found
                        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                        parts.append((np.full(len(m), doc_id), np.full(len(m), t), m, h[:, 0], h[:, 1], start, n, inner, place))
                if parts:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    columns[2] = columns[2].view(np.int64)
                    kinds = [np.int64] * 5 + [np.int32, np.int32, np.bool_, np.int32]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(k, copy=False)) for c, k in zip(columns, kinds, strict=True)],
                        names=["doc_id", "t", "m", "h1", "h2", "start", "n", "inner", "place"],
                    )

    found = rows.mapInArrow(emit, "doc_id long, t long, m long, h1 long, h2 long, start int, n int, inner boolean, place int")
    return stage(found.withColumn("sid", F.monotonically_increasing_id()), "segments")


def segment_kinds(segments: DataFrame, recurring: str) -> DataFrame:
    """One row per minimizer and content, stored: how often it occurs, its least and greatest id, one example, and ``kinds``.

    ``kinds`` counts the different segments of the minimizer. Rows for which neither ``recurring`` holds nor another kind
    or an inner repeat exists are left out: their windows are unique.
    """
    each = segments.groupBy("m", "h1", "h2").agg(
        F.count("*").alias("occurs"),
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"),
        F.min("sid").alias("sid"),
        F.max("n").alias("n"),
        F.max("inner").alias("inner"),
        F.max("place").alias("place"),
    )
    by_minimizer = each.groupBy("m").agg(F.count("*").alias("kinds"), F.sum("occurs").alias("all")).where("all > 1 or kinds > 1")
    inner = each.where("inner and occurs = 1").join(by_minimizer.select("m"), "m", "left_anti").withColumn("kinds", F.lit(1).cast("long"))
    joined = each.join(by_minimizer.select("m", "kinds"), "m").where(f"kinds > 1 or inner or {recurring}")
    columns = ["m", "h1", "h2", "occurs", "first", "last", "sid", "n", "inner", "place", "kinds"]
    return stage(joined.select(columns).unionByName(inner.select(columns)), "kinds")


def with_contents(kinds: DataFrame, segments: DataFrame, rows: DataFrame, content: Callable[[bytes], Callable[[int, int], bytes]]) -> DataFrame:
    """``m, h1, h2, n, first, last, kinds, inner, place, content`` of the given kinds, from the document of their example.

    A document's segments are gathered with it: as many as its text has.
    """
    places = (
        kinds.select("sid", "kinds", "first", "last", "h1", "h2", "m", "n", "inner", "place")
        .join(segments.select("sid", "doc_id", "t", "start"), "sid")
        .groupBy("doc_id", "t")
        .agg(F.collect_list(F.struct("m", "h1", "h2", "start", "n", "first", "last", "kinds", "inner", "place")).alias("places"))
    )
    once = rows.join(places, ["doc_id", "t"]).select("doc_id", "t", "text", "places")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "h1", "h2", "n", "first", "last", "kinds", "inner", "place"]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                lists = batch.column("places")
                offsets = lists.offsets.to_numpy()
                flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
                starts, n = flat.field("start").to_pylist(), flat.field("n").to_pylist()
                out = []
                for i, text in enumerate(texts(batch)):
                    piece = content(text)
                    out += [piece(starts[j], n[j]) for j in range(int(offsets[i] - offsets[0]), int(offsets[i + 1] - offsets[0]))]
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), pa.array(out, pa.binary())], names=[*names, "content"])

    kind = "m long, h1 long, h2 long, n int, first long, last long, kinds long, inner boolean, place int, content binary"
    found = once.mapInArrow(fetch, kind)
    # Rows given twice fetch twice.
    return stage(found.dropDuplicates(["m", "h1", "h2"]), "contents")


def window_groups(contents: DataFrame, units: Callable[[bytes], np.ndarray], width: int) -> DataFrame:
    """Windows of crowded minimizers one by one: ``m, h1, h2, a, w1, w2, first, last``, the window's hash in two halves."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                u = units(row["content"])
                w1 = window_hashes(u, width)
                w2 = window_hashes(u, width, 0xD6E8FEB86659FD93)
                k = len(w1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(k, row[c], np.int64)) for c in ("m", "h1", "h2")),
                        pa.array(np.arange(k, dtype=np.int32)),
                        pa.array(w1.view(np.int64)),
                        pa.array(w2.view(np.int64)),
                        *(pa.array([row[c]] * k, pa.int64()) for c in ("first", "last")),
                    ],
                    names=["m", "h1", "h2", "a", "w1", "w2", "first", "last"],
                )

    return contents.mapInArrow(emit, "m long, h1 long, h2 long, a int, w1 long, w2 long, first long, last long")


def dealt(contents: DataFrame) -> DataFrame:
    """Contents by minimizer, sorted, so that a task meets all segments of one together."""
    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contents.repartition(n, "m").sortWithinPartitions("m")


def marked(rows: DataFrame, keys: list[str], found: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` and ``maybe``: false only where no row of ``found`` has the same keys.

    ``found`` is stored. Its keys' hashes set bits of a table of at most ``2**bits`` bits, which is broadcast.
    """
    at = F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)
    table = found.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")
    )
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8 + 1).cast("int")))
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(table), "_bucket", "left")
    return joined.withColumn("maybe", F.coalesce(bit > 0, F.lit(False))).drop("_bucket", "_bits")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text, spans`` of all rows; only rows that may have spans meet them, the others stay where they are."""
    stored = stage(spans, "spans")
    known = marked(rows, ["doc_id", "t"], stored)
    kind = spans.schema["spans"].dataType
    met = known.where("maybe").join(stored, ["doc_id", "t"], "left")
    others = known.where("not maybe").withColumn("spans", F.lit(None).cast(kind))
    return met.select("id", "text", "spans").unionByName(others.select("id", "text", "spans")).withColumnRenamed("id", "doc_id")


def spans_by_row(found: DataFrame, segments: DataFrame, width: int, condition: str = "true") -> DataFrame:
    """``doc_id, t, spans``: from windows ``a`` up to ``b`` of segment kinds to the units they cover in each row."""
    stored = stage(found, "found")
    likely = marked(segments.select("doc_id", "t", "m", "h1", "h2", "start"), ["m", "h1", "h2"], stored).where("maybe").drop("maybe")
    return (
        likely.join(stored, ["m", "h1", "h2"])
        .where(condition)
        .groupBy("doc_id", "t")
        .agg(
            F.collect_list(
                F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + width - 1).alias("b"))
            ).alias("spans")
        )
    )
