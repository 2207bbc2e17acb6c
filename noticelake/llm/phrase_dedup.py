"""Repeated passages of words by sharded Aho-Corasick automata.

Passages that recur are confirmed first, shard by shard; a shard's automaton holds every confirmed window of its passages,
and one of each kind of stretch that can hold one of them is streamed through it. Shards are minimizers, so each window
meets the one automaton that may know it. Stretches equal as wholes are found by their digests, and the windows of
minimizers with too many kinds by hashes that Spark groups; neither meets an automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import repeats
from noticelake.llm.common import WordHashes, key_runs, merged, texts, window_hashes

WIDTH = 50
GRAM = 8
#: Segments in one automaton, about; no minimizer is cut.
SHARD_SEGMENTS = 1_500


def _cutter(width: int, gram: int):
    from xxhash import xxh3_128_digest

    hashes: list[WordHashes] = []

    def cut(text: bytes):
        words = text.split()
        if len(words) < width:
            return None
        if not hashes:
            hashes.append(WordHashes())
        m, first, n, _ = repeats.segments_of(hashes[0].of(words), width, gram)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        a, b = starts[first].tolist(), ends[first + n - 2 + width].tolist()
        digests = [xxh3_128_digest(joined[i:j]) for i, j in zip(a, b, strict=True)]
        return m, first, n, digests, np.zeros(len(m), bool), np.zeros(len(m), np.int32)

    return cut


def _content(width: int):
    def of(text: bytes):
        words = text.split()
        return lambda a, n: b" ".join(words[a : a + n - 1 + width])

    return of


def _letters(words: list[list[bytes]]) -> list[str]:
    """Texts of one character per word; equal words have equal characters. The surrogates are passed over."""
    known: dict[bytes, str] = {}
    out = []
    for line in words:
        for w in line:
            if w not in known:
                k = len(known) + 1
                known[w] = chr(k if k < 0xD800 else k + 0x800)
        out.append("".join([known[w] for w in line]))
    return out


def shard_matches(
    segments: list[list[bytes]], first: list[int], width: int, hashes: WordHashes | None = None
) -> list[list[tuple[int, int, int]]]:
    """For each segment, windows ``[a, b)`` that recur among the segments, with the least ``first`` of those that hold them.

    A window is confirmed when its hash occurs twice; the automaton then finds its occurrences word by word. Segments
    without a confirmed window have nothing to find.
    """
    from ahocorasick import STORE_INTS, Automaton

    hashes = WordHashes() if hashes is None else hashes
    found = [window_hashes(hashes.of(s), width) for s in segments]
    _, which, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    again = times[which] > 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in segments]
    at = np.flatnonzero(again)
    if not len(at):
        return out
    edges = np.cumsum([len(f) for f in found])
    owner = np.searchsorted(edges, at, side="right")
    offset = at - np.concatenate(([0], edges[:-1]))[owner]
    chosen = np.unique(owner).tolist()
    lines = dict(zip(chosen, _letters([segments[i] for i in chosen]), strict=True))
    automaton = Automaton(STORE_INTS)
    added: set[int] = set()
    for i, a, w in zip(owner.tolist(), offset.tolist(), which[at].tolist(), strict=True):
        if w not in added:
            automaton.add_word(lines[i][a : a + width], w)
            added.add(w)
    automaton.make_automaton()
    hits = {i: list(automaton.iter(line)) for i, line in lines.items()}
    least: dict[int, int] = {}
    for i, own in hits.items():
        for _, p in own:
            least[p] = min(least.get(p, first[i]), first[i])
    for i, own in hits.items():
        for end, p in own:
            a = end - width + 1
            if out[i] and out[i][-1][1] == a and out[i][-1][2] == least[p]:
                out[i][-1] = (out[i][-1][0], a + 1, least[p])
            else:
                out[i].append((a, a + 1, least[p]))
    return out


def _automata(width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for table in key_runs(batches, "m", SHARD_SEGMENTS):
            segments = [c.split() for c in table.column("content").to_pylist()]
            first, last = table.column("first").to_pylist(), table.column("last").to_pylist()
            keys = list(zip(*(table.column(c).to_pylist() for c in ("m", "h1", "h2")), strict=True))
            rows = [
                (*keys[i], a, b, doc)
                for i, spans in enumerate(shard_matches(segments, first, width, hashes))
                for a, b, doc in spans
                if doc < last[i]
            ]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                names=["m", "h1", "h2", "a", "b", "earliest"],
            )

    return find


def _word_units(content: bytes) -> np.ndarray:
    return WordHashes().of(content.split())


def repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """``doc_id, t, spans``: the words of each row inside a window that also starts in a row with a smaller id.

    Spans may overlap. Rows without any are missing.
    """
    rows = repeats.keyed(docs).where("id is not null")
    segments = repeats.stored_segments(rows.where(F.length("text") >= 2 * width - 1), _cutter(width, gram))
    kinds = repeats.segment_kinds(segments, "first < last")
    contents = repeats.with_contents(kinds.where("kinds > 1"), segments, rows, _content(width))
    whole = kinds.where("first < last").select(
        "m", "h1", "h2", F.lit(0).alias("a"), F.col("n").alias("b"), F.col("first").alias("earliest")
    )
    streamed = repeats.dealt(contents.where(F.col("kinds") <= group_limit)).mapInArrow(
        _automata(width), "m long, h1 long, h2 long, a int, b int, earliest long"
    )
    windows = repeats.window_groups(contents.where(F.col("kinds") > group_limit), _word_units, width)
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min("first").alias("earliest")).where("times > 1")
    crowded = (
        windows.join(often, ["w1", "w2"]).where("earliest < last").select("m", "h1", "h2", "a", (F.col("a") + 1).alias("b"), "earliest")
    )
    found = whole.unionByName(streamed).unionByName(crowded)
    return repeats.spans_by_row(found, segments, width, "doc_id > earliest")


def remove_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group_limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """Every row's ``doc_id, n_words, n_removed, kept``: its words, joined by blanks, without repeated passages.

    The row with the smallest id keeps a passage, all rows of that id alike; judged on the input. NULL texts have no
    words. Rows with a NULL id keep all and repeat nothing.
    """
    rows = repeats.keyed(docs)
    joined = repeats.with_spans(rows, repeated_passages(docs, width, gram, group_limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                gone = merged(np.array([(s["a"], s["b"]) for s in spans], np.int64)) if spans else []
                n.append(len(words))
                removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
