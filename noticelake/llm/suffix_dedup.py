"""Repeated byte strings by suffix arrays, built by two-stage sorting.

Suffixes smaller than their successors are sorted directly, all others induced by one scan over the buckets, and adjacent
common prefixes tell which strings start anywhere else. Arrays are built over segments that share a minimizer, the only
ones that can hold equal strings, a few hundred kilobytes at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import repeats
from noticelake.llm.common import U64, key_runs, merged, texts

LENGTH = 400
GRAM = 48
#: Bytes of segments in one suffix array, about.
ARRAY_BYTES = 300_000


def _later_type(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than its successor; the end marks 0 are not."""
    n = len(symbols)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(symbols[:-1].astype(np.int32) - symbols[1:])
    # Equal neighbours are decided by the next unequal ones.
    at = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    larger = step[decided] > 0
    larger[symbols == 0] = False
    return larger


def suffix_array(pieces: list[bytes], depth: int) -> np.ndarray:
    """Order of all suffixes of the pieces, at least by their first ``depth`` bytes; end marks, one per piece, come first.

    Positions count through the pieces, each followed by its end mark.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes + 1) - 1
    joined = b"\0".join(pieces) + b"\0"
    symbols = np.frombuffer(joined, np.uint8).astype(np.uint16) + 1
    symbols[ends] = 0
    larger = _later_type(symbols)
    # Stage one: the smaller suffixes, sorted directly.
    stops = np.repeat(ends, sizes + 1)
    small = np.flatnonzero(~larger & (symbols > 0))
    text = joined.decode("latin-1")
    keys = [text[p:q] for p, q in zip(small.tolist(), np.minimum(small + depth, stops[small]).tolist(), strict=True)]
    small = small[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(small) else small
    del keys
    # Stage two: buckets by first symbol, induced suffixes ahead of sorted ones, scanned once.
    n_symbols = 257
    counts = np.bincount(symbols, minlength=n_symbols)
    starts = np.concatenate(([0], np.cumsum(counts)))
    head = starts[:-1].copy()
    sorted_counts = np.bincount(symbols[small], minlength=n_symbols)
    sorted_counts[0] = counts[0]
    order = np.empty(len(symbols), np.int64)
    order[: counts[0]] = ends
    at = 0
    for c in range(1, n_symbols):
        k = sorted_counts[c]
        order[starts[c + 1] - k : starts[c + 1]] = small[at : at + k]
        at += k

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return
        first = symbols[before]
        by = np.argsort(first, kind="stable")
        first, before = first[by], before[by]
        new = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        n = np.diff(np.concatenate((new, [len(first)])))
        order[head[first] + np.arange(len(first)) - np.repeat(new, n)] = before
        head[first[new]] += n

    for c in range(n_symbols):
        if not counts[c]:
            continue
        done = starts[c]
        while done < head[c]:
            block = order[done : head[c]]
            done = head[c]
            induce(block)
        induce(order[starts[c + 1] - sorted_counts[c] : starts[c + 1]])
    return order


def common_prefixes(joined: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the strings at two lists of positions, counted up to ``most``."""
    padded = np.concatenate((joined, np.zeros(most + 8, np.uint8)))
    words = np.zeros(len(padded) - 7, U64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(U64) << U64(8 * i)
    out = np.full(len(left), most, np.int64)
    open_ = np.arange(len(left))
    for step in range(0, most, 8):
        differ = words[left[open_] + step] ^ words[right[open_] + step]
        ended = differ != 0
        if ended.any():
            d = differ[ended]
            low = d & (~d + U64(1))
            same = np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8
            out[open_[ended]] = step + same
            open_ = open_[~ended]
        if not len(open_):
            break
    return np.minimum(out, most)


def repeated_windows(pieces: list[bytes], windows: list[int], length: int) -> np.ndarray:
    """Which windows, counted through the pieces, start anywhere else in them too."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    n = np.array(windows, np.int64)
    number = np.full(int((sizes + 1).sum()), -1, np.int64)
    starts = np.repeat(offsets - (np.cumsum(n) - n), n) + np.arange(n.sum())
    number[starts] = np.arange(n.sum())
    order = suffix_array(pieces, length)
    order = order[number[order] >= 0]
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    same = common_prefixes(joined, order[:-1], order[1:], length) >= length
    out = np.zeros(len(number[starts]), bool)
    out[number[order[1:][same]]] = True
    out[number[order[:-1][same]]] = True
    return out


def _cutter(length: int, gram: int):
    from xxhash import xxh3_128_digest

    span = length - gram + 1

    def cut(text: bytes):
        if len(text) < length:
            return None
        m, first, n, grams = repeats.segments_of(np.frombuffer(text, np.uint8), length, gram)
        digests, inner, place = [], [], []
        for v, a, k in zip(m, first.tolist(), n.tolist(), strict=True):
            digests.append(xxh3_128_digest(text[a : a + k - 1 + length]))
            found = np.flatnonzero(grams[a : a + k - 1 + span] == v)
            inner.append(len(found) > 1)
            place.append(found[0])
        return m, first, n, digests, np.array(inner), np.array(place)

    return cut


def _related(table: pa.Table, length: int, gram: int) -> np.ndarray:
    """Segments that agree with another of their minimizer on enough bytes before or behind it, and those that hold it twice.

    A string holds the minimizer and ``length - gram`` other bytes, at least half of them on one side. A segment that holds
    the minimizer more than once is looked at around each of its places.
    """
    side = (length - gram + 1) // 2
    keys: list[set[tuple]] = []
    inner = table.column("inner").to_pylist()
    rows = zip(*(table.column(c).to_pylist() for c in ("m", "place", "content")), inner, strict=True)
    for m, place, content, again in rows:
        own, minimizer = set(), content[place : place + gram]
        while place >= 0:
            left, right = content[max(0, place - side) : place], content[place + gram : place + gram + side]
            if len(left) == side:
                own.add((m, 0, left))
            if len(right) == side:
                own.add((m, 1, right))
            place = content.find(minimizer, place + 1) if again else -1
        keys.append(own)
    times = Counter(k for own in keys for k in own)
    return np.array([again or any(times[k] > 1 for k in own) for again, own in zip(inner, keys, strict=True)], bool)


def _arrays(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "m", max(1, ARRAY_BYTES // length)):
            table = table.filter(pa.array(_related(table, length, gram)))
            if not table.num_rows:
                continue
            pieces, windows = table.column("content").to_pylist(), table.column("n").to_pylist()
            again = repeated_windows(pieces, windows, length)
            owner = np.repeat(np.arange(len(windows)), windows)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = np.flatnonzero(again)
            if not len(at):
                continue
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
            heads = np.flatnonzero(new)
            tails = np.concatenate((heads[1:], [len(at)])) - 1
            kinds = owner[at[heads]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(table.column(c).to_numpy()[kinds]) for c in ("m", "h1", "h2")),
                    pa.array(offset[at[heads]].astype(np.int32)),
                    pa.array((offset[at[tails]] + 1).astype(np.int32)),
                ],
                names=["m", "h1", "h2", "a", "b"],
            )

    return find


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """``doc_id, t, spans``: the bytes of each row covered by a string of ``length`` that also starts elsewhere.

    Spans may overlap. Rows without any are missing.
    """
    rows = repeats.keyed(docs)
    segments = repeats.stored_segments(rows.where(F.octet_length("text") >= length), _cutter(length, gram))
    kinds = repeats.segment_kinds(segments, "occurs > 1")
    several = kinds.where("kinds > 1 or inner")
    contents = repeats.with_contents(several, segments, rows, lambda text: lambda a, n: text[a : a + n - 1 + length])
    whole = kinds.where("occurs > 1").select("m", "h1", "h2", F.lit(0).alias("a"), F.col("n").alias("b"))
    compared = repeats.dealt(contents.where(F.col("kinds") <= group_limit)).mapInArrow(
        _arrays(length, gram), "m long, h1 long, h2 long, a int, b int"
    )
    windows = repeats.window_groups(
        contents.where(F.col("kinds") > group_limit), lambda c: np.frombuffer(c, np.uint8), length
    )
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1")
    crowded = windows.join(often, ["w1", "w2"]).select("m", "h1", "h2", "a", (F.col("a") + 1).alias("b"))
    return repeats.spans_by_row(whole.unionByName(compared).unionByName(crowded), segments, length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """Every row's ``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes that no repeated string covers.

    All occurrences go, the first included; whether a string repeats is judged on the input, and strings do not cross
    rows. NULL texts are empty. Equal rows repeat each other, as copies under different ids do, NULL ids too.
    """
    rows = repeats.keyed(docs)
    joined = repeats.with_spans(rows, repeated_spans(docs, length, gram, group_limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, runs = [], [], []
            sizes = []
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                gone = merged(np.array([(s["a"], s["b"]) for s in spans], np.int64)) if spans else []
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )

