"""Phrase collocations: mergeable Misra-Gries summaries per hash partition, then exact counts of what survives.

*First pass.* Every occurrence of one to three words falls into a part by its hash. A task summarises what it reads in
blocks, without loss; the summaries of a part merge into one with more counters than the part's occurrences divided by the
threshold. Merging beyond that capacity takes the largest surplus counter off all, so a counter falls short of its count by
less than the threshold: no frequent phrase is lost, however the text is dealt out. Equal hashes only raise a counter.

*Second pass.* The survivors' places in a bitmap of bounded size are broadcast; the occurrences they let through are counted
by the words themselves, and counts below the threshold go. More survivors than a bitmap holds take several passes over
ranges of parts, each with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import U64, mix, stage

THRESHOLD = 10
LONGEST = 3
SHARE = 50
TOP = 2_000
#: Words of a block, and different words a task remembers: what bounds a task's memory.
BLOCK_WORDS = 1 << 20
BLOCK_KINDS = 300_000
#: Bits of one broadcast bitmap at most (64 MB), and bits per survivor.
MOST_BITS = 1 << 29
BITS_EACH = 24
#: Text bytes per part, about.
PART_BYTES = 16 << 20

_ID_BITS = 21
_MOST_COUNT = 1 << 31
# A byte that no UTF-8 text has stands between pieces.
_BREAK = b"\xff"
_PREPARE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10
)


class _Numbers(dict):
    """Numbers of one language's words; new ones are entered in the block's lists."""

    def __init__(self, block: Block, lang: str):
        from xxhash import xxh3_64_intdigest

        super().__init__({_BREAK: 0})
        self.block, self.lang, self.digest = block, lang, xxh3_64_intdigest
        self.seed = xxh3_64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        block = self.block
        number = self[word] = len(block.words)
        block.words.append(word)
        block.langs.append(self.lang)
        block.hashes.append(self.digest(word, self.seed))
        return number


class Block:
    """Texts as one sequence of word numbers, 0 between pieces. A number names a language and a word."""

    def __init__(self):
        self.tables: dict[str, _Numbers] = {}
        self.words, self.langs, self.hashes = [b""], [""], [0]
        self.clear()

    def clear(self) -> None:
        """Forget the texts; words too, when there are many."""
        if len(self.words) > BLOCK_KINDS:
            self.tables.clear()
            self.words, self.langs, self.hashes = [b""], [""], [0]
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.totals: dict[str, int] = {}

    def add(self, lang: str, text: bytes) -> None:
        """Take up a text; a long one in several steps would end in the same block, so it is taken whole."""
        table = self.tables.get(lang)
        if table is None:
            table = self.tables[lang] = _Numbers(self, lang)
        tokens = text.translate(_PREPARE).replace(_BREAK, b" \xff ").split()
        numbers = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
        self.parts += [numbers, np.zeros(1, np.int64)]
        self.size += len(tokens)
        self.totals[lang] = self.totals.get(lang, 0) + int(np.count_nonzero(numbers))

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_WORDS or len(self.words) > BLOCK_KINDS

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the length, where its occurrences start, and their hashes; then see :meth:`sequence`."""
        sequence = self.sequence = np.concatenate(self.parts) if self.parts else np.empty(0, np.int64)
        hashes = np.array(self.hashes, U64)[sequence]
        whole, h = sequence > 0, np.zeros(len(sequence), U64)
        with np.errstate(over="ignore"):
            for k in range(1, LONGEST + 1):
                if len(sequence) < k:
                    return
                n = len(sequence) - k + 1
                whole = whole[:n] & (sequence[k - 1 :] > 0)
                h = mix(h[:n] * U64(0x9E3779B97F4A7C15) + hashes[k - 1 :] + U64(k))
                at = np.flatnonzero(whole)
                yield k, at, h[at]

    def packed(self, k: int, at: np.ndarray) -> np.ndarray:
        """The numbers of ``k`` words from each place, in one integer."""
        out = self.sequence[at]
        for i in range(1, k):
            out = out << _ID_BITS | self.sequence[at + i]
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            block.add(lang, text.as_py())
            if block.full:
                yield block
                block.clear()
    yield block


def _place(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each hash, and its 32-bit key there."""
    return (h >> U64(32)) * U64(parts) >> U64(32), h & U64(0xFFFFFFFF)


def _summarise(parts: int):
    """Blocks as lossless summaries: for each part its mass, and keys met once, keys met more often and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = []
            for _, _, h in block.grams():
                part, key = _place(h, parts)
                part <<= U64(32)
                part |= key
                found.append(part)
            both = np.concatenate(found or [np.empty(0, U64)])
            del found
            both.sort()
            if not len(both):
                continue
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            counts = np.diff(np.concatenate((first, [len(both)])))
            keys = (both[first] & U64(0xFFFFFFFF)).astype("<u4")
            owner = (both[first] >> U64(32)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]))
            rows: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                c = counts[a:b]
                once = c == 1
                rows.append((int(owner[a]), int(c.sum()), None, None, None))
                more = np.minimum(c[~once], _MOST_COUNT).astype("<u4")
                rows.append((int(owner[a]), 0, keys[a:b][once].tobytes(), keys[a:b][~once].tobytes(), more.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["part", "mass", "once", "keys", "counts"],
            )

    return run


class Summary:
    """A Misra-Gries summary of known capacity: merged summaries, cut back whenever it has more counters than that."""

    def __init__(self, capacity: int):
        self.capacity, self.short = capacity, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge another summary, when enough of them wait."""
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[first], np.minimum(np.add.reduceat(counts, first), _MOST_COUNT)
        if len(keys) > self.capacity:
            surplus = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.short += surplus
            counts = counts - surplus
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys whose count may reach the threshold: counters fall short by no more than ``short``."""
        self.merge()
        return self.keys[self.counts + self.short >= threshold]


def _merge(threshold: int):
    """One row per part from its sorted summaries: the masses come first and give the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def done() -> pa.RecordBatch:
            keys = (summary.frequent(threshold) if summary else np.empty(0)).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())],
                names=["part", "n", "keys"],
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("part", "mass", "once", "keys", "counts")]
            for row in zip(*columns, strict=True):
                here, size, once, keys, counts = (x.as_py() for x in row)
                if here != part:
                    if part is not None:
                        yield done()
                    part, mass, summary = here, 0, None
                if keys is None:
                    mass += size
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1)
                single = np.frombuffer(once, "<u4").astype(np.int64)
                summary.add(single, np.ones(len(single), np.int64))
                summary.add(np.frombuffer(keys, "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64))
        if part is not None:
            yield done()

    return run


def _bits(keys: np.ndarray, power: int) -> list[np.ndarray]:
    """Three places of each 32-bit key among ``2 ** power`` bits."""
    with np.errstate(over="ignore"):
        spread = mix(keys.astype(U64) + U64(0x632BE59BD9B4E019))
        again = mix(spread + U64(0x9E3779B97F4A7C15))
    most = U64((1 << power) - 1)
    return [(spread & most).astype(np.int64), (spread >> U64(32) & most).astype(np.int64), (again & most).astype(np.int64)]


def _slices(power: int):
    """A part's survivors as a bitmap of ``2 ** power`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys in zip(batch.column("part").to_pylist(), batch.column("keys"), strict=True):
                bits = np.zeros(1 << power, bool)
                for places in _bits(np.frombuffer(keys.as_py(), "<u4"), power):
                    bits[places] = True
                packed = np.packbits(bits, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packed], pa.binary())], names=["part", "bits"])

    return run


def _count(parts: int, first: int, stop: int, power: int, bitmap, totals: bool):
    """Counts by words of the occurrences that the bitmap of parts ``first`` to ``stop`` lets through, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)

        def rows(lang: list, k: int, phrase: list, n: np.ndarray | list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(lang, pa.string()),
                    pa.array(np.full(len(lang), k, np.int32)),
                    pa.array(phrase, pa.binary()).cast(pa.string()),
                    pa.array(n, pa.int64()),
                ],
                names=["lang", "k", "phrase", "f"],
            )

        for block in _blocks(batches):
            if totals and block.totals:
                yield rows(list(block.totals), 0, [b""] * len(block.totals), list(block.totals.values()))
            for k, at, h in block.grams():
                part, key = _place(h, parts)
                own = np.flatnonzero((part >= first) & (part < stop))
                base = (part[own].astype(np.int64) - first) << power
                for j in range(3):
                    places = base + _bits(key[own], power)[j]
                    met = bits[places >> 3] >> (places & 7).astype(np.uint8) & 1 > 0
                    own, base = own[met], base[met]
                kinds, n = np.unique(block.packed(k, at[own]), return_counts=True)
                lasts, words, langs = (1 << _ID_BITS) - 1, block.words, block.langs
                ids = [(kinds >> _ID_BITS * i & lasts).tolist() for i in reversed(range(k))]
                if k == 1:
                    phrases = [words[a] for a in ids[0]]
                elif k == 2:
                    phrases = [b"%b %b" % (words[a], words[b]) for a, b in zip(*ids, strict=True)]
                else:
                    phrases = [b"%b %b %b" % (words[a], words[b], words[c]) for a, b, c in zip(*ids, strict=True)]
                if phrases:
                    yield rows([langs[a] for a in ids[0]], k, phrases, n)

    return run


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang, k, phrase, f``: exact counts of all phrases of one to three words met ``threshold`` times or more.

    Rows with ``k`` 0 hold the number of words of each language that has any. A NULL ``lang`` is ``und``; NULL and empty
    texts have no words; ids do not matter, repeated rows count again, other columns are left out.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * n, -(-size // PART_BYTES))
    summaries = texts.mapInArrow(_summarise(parts), "part long, mass long, once binary, keys binary, counts binary")
    sorted_parts = summaries.repartition(n, "part").sortWithinPartitions(F.col("part"), F.col("keys").isNotNull())
    survivors = stage(sorted_parts.mapInArrow(_merge(threshold), "part long, n long, keys binary"), "survivors")
    fullest = survivors.agg(F.max("n")).first()[0] or 1
    power = min(32, max(10, (BITS_EACH * fullest - 1).bit_length()))
    width = max(1, most_bits >> power)
    counted = None
    for first in range(0, parts, width):
        stop = min(parts, first + width)
        own = survivors.where(F.col("part").between(first, stop - 1)).mapInArrow(_slices(power), "part long, bits binary")
        # At most ``most_bits`` bits, whatever the corpus.
        bitmap = bytearray((stop - first) << power >> 3)
        for row in own.toLocalIterator():
            at = (row["part"] - first) << power >> 3
            bitmap[at : at + len(row["bits"])] = row["bits"]
        shared = spark.sparkContext.broadcast(bytes(bitmap))
        found = texts.mapInArrow(
            _count(parts, first, stop, power, shared, first == 0), "lang string, k int, phrase string, f long"
        )
        exact = found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(f"(k = 0 and f > 0) or (k > 0 and f >= {threshold})")
        exact = stage(exact, "phrases")
        counted = exact if counted is None else counted.unionByName(exact)
    return counted


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, share: int = SHARE, top: int = TOP, most_bits: int = MOST_BITS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases of two or three words.

    ``a`` is the phrase's count, ``n`` the language's number of words; of the cuts into a first part counted ``l`` and a
    rest counted ``r``, the one with the least ``score``, floor(1,000,000 a a / (l r)), counts, of equal ones the first.
    Phrases that lie in a longer one with at least ``share`` percent of their count are left out. Ordered by score and
    count, falling, then by phrase. Counts up to 10**16 are exact. See :func:`frequent_phrases` for NULLs, repeated rows
    and other columns; a table without words gives no rows.
    """
    counts = frequent_phrases(docs, threshold, most_bits)
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where("k between 1 and 2").select("lang", "phrase", "f")
    wanted = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    cut = wanted.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cut = cut.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    ahead = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    behind = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = "(cast(a as decimal(38, 0)) * a * 1000000) div (cast(l as decimal(38, 0)) * r)"
    scored = cut.join(ahead, ["lang", "first"]).join(behind, ["lang", "rest"]).withColumn("score", F.expr(score))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "k", "l", "r")).alias("least"))
    weakest = weakest.select("lang", "phrase", "least.*")
    # Phrases of two words inside longer ones; longer ones have none around them.
    longer = wanted.where("k > 2").select(
        "lang",
        F.col("a").alias("outer"),
        F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"),
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(f"k > 2 or outer is null or 100 * outer < {share} * a")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
