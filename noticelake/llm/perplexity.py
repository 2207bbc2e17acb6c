"""Quality rules with n-gram perplexity: a modified Kneser-Ney model counted in Spark, and bands per language.

The model predicts each byte of a text from the four before it, every stretch of blanks taken as one, so n-grams run on from
word to word; those of each language are apart. Counts cover every text from its first byte to its last. Orders are sorted arrays
of n-gram hashes of ``ID_BITS`` bits, so the model grows with the different n-grams of the corpus.

Texts are counted and scored in blocks of ``_BLOCK`` bytes, whose n-grams are sorted, so that each different one is met once; long
texts are cut into pieces that overlap by a context.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import U64, WordHashes, mix, small_side, stage, texts, window_hashes

ORDER = 5
ID_BITS = 63
#: From this order on, n-grams that were met once are left out.
PRUNED_FROM = 3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Bounds lie this many times the way from the median to the quartiles beyond the median, and at least so far off. The outer
#: tenths would hold the junk itself. Chosen on labelled documents and shuffled words; the README has the shares rejected.
BAND_WIDTH = 5.0
BAND_LEAST = 0.1
#: Short texts spread wider: a text of this many words has bounds the square root of two as far off as a long one.
BAND_SHORT = 20
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text whose n-grams are sorted at a time.
_BLOCK = 4_000_000
_CONTEXT = ORDER - 1


def language_seed(lang: str | None) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest((lang or "").encode())


def text_pieces(words: list[bytes]) -> list[bytes]:
    """A text with single blanks, a context of blanks ahead and one behind, in pieces that share no n-gram and leave none out."""
    joined = b" " * _CONTEXT + b" ".join(words) + b" "
    return [joined[i : i + _BLOCK + _CONTEXT] for i in range(0, len(joined) - _CONTEXT, _BLOCK)] if words else []


def piece_grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of ``ORDER`` bytes of each piece; and how many per piece."""
    raw = np.frombuffer(b"".join(pieces), np.uint8).astype(U64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = len(raw) - _CONTEXT
    keys = np.zeros(n, U64)
    for i in range(ORDER):
        keys = keys << U64(8) | raw[i : i + n]
    # Drop the positions whose n-gram would reach into the next piece.
    inside = np.ones(n, bool)
    ends = np.cumsum(sizes)[:-1]
    for i in range(1, ORDER):
        inside[ends - i] = False
    return keys[inside], sizes - _CONTEXT


def gram_ids(keys: np.ndarray, order: int, seeds: np.ndarray | int, bits: int) -> np.ndarray:
    """Hash, of ``bits`` bits, of n-grams of ``order`` bytes of a language."""
    with np.errstate(over="ignore"):
        salted = keys ^ mix(np.asarray(seeds, U64) + U64(order))
        return (mix(salted) >> U64(64 - bits)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, key, n``: how often each n-gram of the highest order occurs, over all texts. NULL languages are one."""

    def flush(lang: str, pieces: list[bytes]) -> pa.RecordBatch:
        keys, n = np.unique(piece_grams(pieces)[0], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
            names=["lang", "key", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                for piece in text_pieces((text or b"").split()):
                    held.setdefault(lang, []).append(piece)
                    sizes[lang] += len(piece)
                    if sizes[lang] >= _BLOCK:
                        del sizes[lang]
                        yield flush(lang, held.pop(lang))
                if len(held) > 64:  # languages by the thousand: none is kept waiting
                    yield from (flush(k, p) for k, p in held.items())
                    held, sizes = {}, Counter()
        yield from (flush(k, p) for k, p in held.items())

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k * 0.95) for k, d in enumerate(found[1:], 1))])


@dataclass
class NgramModel:
    """Per order: sorted hashes of n-grams with log probabilities, and of contexts with log back-off weights."""

    bits: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def log_probabilities(self, pieces: list[bytes], seed: int) -> np.ndarray:
        """Sum over the n-grams of each piece."""
        met, per_piece = piece_grams(pieces)
        # Pieces share most of their n-grams, so each is looked up once.
        keys, which = np.unique(met, return_inverse=True)
        total = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = keys[open_] & U64((1 << 8 * order) - 1)
            ids, values = self.grams[order - 1]
            hit, at = _find(ids, gram_ids(own, order, seed, self.bits))
            total[open_[hit]] += values[at[hit]]
            open_, own = open_[~hit], own[~hit]
            ids, values = self.contexts[order - 1]
            hit, at = _find(ids, gram_ids(own >> U64(8), order - 1, seed, self.bits))
            total[open_[hit]] += values[at[hit]]
        total[open_] += np.log(1 / 256)
        return np.add.reduceat(total[which], np.cumsum(per_piece) - per_piece)


def _find(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ids):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return ids[at] == wanted, at


def fit_model(docs: DataFrame, bits: int = ID_BITS) -> NgramModel:
    """Count in Spark, derive continuation counts order by order in Spark, and interpolate on the hashed tables.

    The driver gets a row of five numbers for each different n-gram of a language and order.
    """
    level = stage(gram_counts(docs), "grams")
    orders = level.select(F.lit(ORDER).alias("order"), "lang", "key", "n")
    for order in range(ORDER - 1, 0, -1):
        cut = F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1).cast("long"))
        level = level.groupBy("lang", cut.alias("key")).agg(F.count("*").alias("n"))
        orders = orders.unionByName(level.select(F.lit(order).alias("order"), "lang", "key", "n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            seeds = np.array([language_seed(x) for x in lang.dictionary.to_pylist()], U64)[lang.indices.to_numpy()]
            order, keys = batch.column("order").to_numpy(), batch.column("key").to_numpy().astype(U64)
            out = {k: np.zeros(len(keys), np.int64) for k in ("id", "context", "suffix")}
            for k in np.unique(order).tolist():
                own = order == k
                for name, cut, size in (
                    ("id", keys[own], k),
                    ("context", keys[own] >> U64(8), k - 1),
                    ("suffix", keys[own] & U64((1 << 8 * (k - 1)) - 1), k - 1),
                ):
                    out[name][own] = gram_ids(cut, size, seeds[own], bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), *(pa.array(out[k]) for k in out), batch.column("n")],
                names=["order", "id", "context", "suffix", "n"],
            )

    table = (
        orders.mapInArrow(hashed, "order int, id long, context long, suffix long, n long")
        .groupBy("order", "id")
        .agg(F.sum("n").alias("n"), F.max("context").alias("context"), F.max("suffix").alias("suffix"))
        .toArrow()
    )
    columns = {c: table.column(c).to_numpy() for c in table.column_names}
    model = NgramModel(bits, [], [])
    lower_ids = lower = np.zeros(0)
    for order in range(1, ORDER + 1):
        own = np.flatnonzero(columns["order"] == order)
        own = own[np.argsort(columns["id"][own])]
        ids, n = columns["id"][own], columns["n"][own].astype(np.float64)
        context, at = np.unique(columns["context"][own], return_inverse=True)
        discount = _discounts(n)
        taken = discount[np.minimum(n, 3).astype(int)]
        # A long n-gram met once says nothing about the text it was counted in: its whole count goes to the shorter ones.
        once = (n <= 1) & (order >= PRUNED_FROM)
        taken[once] = n[once]
        total, freed = np.bincount(at, n), np.bincount(at, taken)
        weight = freed / np.maximum(total, 1e-9) if len(at) else np.zeros(0)
        if order == 1:
            below = np.full(len(ids), 1 / 256)
        else:
            hit, place = _find(lower_ids, columns["suffix"][own])
            below = np.full(len(ids), 1 / 256)
            below[hit] = lower[place[hit]]
        p = (n - taken) / total[at] + weight[at] * below if len(at) else np.zeros(0)
        model.grams.append((ids[~once], np.log(np.maximum(p[~once], 1e-12)).astype(np.float32)))
        model.contexts.append((context, np.log(np.maximum(weight, 1e-6)).astype(np.float32)))
        lower_ids, lower = ids, p
    return model


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    found = window_hashes(hashes, window)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    again = np.zeros(len(found), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def base_statistics(text: bytes | None, hashes: WordHashes) -> tuple[int, int, int, int, int, list[bytes]]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the words."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = text.split()
    characters = len(text.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return (
        len(words),
        characters - (len(text) - len(text.translate(None, BLANKS))),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(hashes.of(words)) if len(words) > WINDOW else 0,
        words,
    )


def text_scores(model: NgramModel, seed: int, documents: list[list[bytes]]) -> list[float]:
    """Log probability of each text of a language, given as its pieces, in blocks."""
    total, block, owners, size = np.zeros(len(documents)), [], [], 0
    for at, pieces in enumerate(documents):
        for piece in pieces:
            block.append(piece)
            owners.append(at)
            size += len(piece)
            if size >= _BLOCK:
                np.add.at(total, owners, model.log_probabilities(block, seed))
                block, owners, size = [], [], 0
    if block:
        np.add.at(total, owners, model.log_probabilities(block, seed))
    return total.tolist()


def score_documents(docs: DataFrame, model: NgramModel) -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity``.

    The perplexity is per byte, a blank behind each word included; NULL without words.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                found, by_lang = [], {}
                for at, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), texts(batch), strict=True)):
                    *numbers, words = base_statistics(text, hashes)
                    found.append(numbers)
                    if words:
                        own = by_lang.setdefault(lang, ([], []))
                        own[0].append(at)
                        own[1].append(text_pieces(words))
                rated: list[float | None] = [None] * batch.num_rows
                for lang, (places, documents) in by_lang.items():
                    for at, pieces, total in zip(
                        places, documents, text_scores(model, language_seed(lang), documents), strict=True
                    ):
                        rated[at] = -total / sum(len(p) - _CONTEXT for p in pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("lang"),
                        *(pa.array([f[i] for f in found], pa.int64()) for i in range(5)),
                        pa.array(rated, pa.float64()),
                    ],
                    names=["doc_id", "lang", *names, "log_perplexity"],
                )

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(
        score, f"doc_id {kind}, lang string, " + ", ".join(f"{n} long" for n in names) + ", log_perplexity double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def perplexity_bands(scored: DataFrame, width: float = BAND_WIDTH, least: float = BAND_LEAST) -> DataFrame:
    """``band_lang, middle, below, above``: median log perplexity of a language and how far off long texts may lie, from all its
    documents that pass the base rules.

    Quantile sketches are merged map-side; one row per language.
    """
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000)
    found = scored.where("not base_failed").groupBy(F.col("lang").alias("band_lang")).agg(q.alias("q"))

    def reach(gap: Column) -> Column:
        return F.greatest(gap * width, F.lit(least))

    low, mid, high = (F.col("q")[i] for i in range(3))
    return found.select("band_lang", mid.alias("middle"), reach(mid - low).alias("below"), reach(high - mid).alias("above"))


def judge_scored(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """Scored rows with ``kept``, ``perplexity`` and the bounds, which are wider for short texts. Languages without a band: not kept."""
    joined = scored.join(bands, scored["lang"] == bands["band_lang"], "left")
    spread = F.sqrt(1 + BAND_SHORT / F.greatest("n_words", F.lit(1)))
    joined = joined.withColumn("lower", F.col("middle") - F.col("below") * spread)
    joined = joined.withColumn("upper", F.col("middle") + F.col("above") * spread)
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("lower").alias("lower"),
        F.exp("upper").alias("upper"),
    )


def judge_quality(docs: DataFrame, bits: int = ID_BITS, width: float = BAND_WIDTH, least: float = BAND_LEAST) -> DataFrame:
    """Statistics, ``base_failed``, ``perplexity``, the bounds and ``kept`` of every row.

    A row is kept when the base rules pass and its perplexity lies within its language's bounds. Texts above them are unlike their
    language (noise, words in no order), texts below repeat what it repeats most. NULL, empty and blank texts have no words and
    fail; NULL languages count as one. Equal texts of a language get equal results. Other columns of ``docs`` are not read.
    """
    scored = stage(score_documents(docs, fit_model(docs, bits)), "scored")
    return judge_scored(scored, small_side(perplexity_bands(scored, width, least), "bands"))
