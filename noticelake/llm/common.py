"""Helpers the operators of this subpackage share: words, staged tables, runs of equal keys, packed columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.storage import shared_dir

# A word is a run of characters that are neither a blank nor one of the controls tab to carriage return. ``bytes.split()``
# without arguments cuts at exactly these six bytes, and ``bytes.lower()`` changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back, so that lost executors do not mean computing them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noticelake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_side(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """A summary table, stored, as a side of a join: broadcast when it has at most ``most`` rows, else left to Spark."""
    stored = stage(df, name)
    return F.broadcast(stored) if stored.count() <= most else stored


def schema_with(df: DataFrame, **added: str) -> T.StructType:
    """A frame's schema and further columns, given as name and type."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in added.items()]
    return T.StructType([*df.schema.fields, *more])


def size_in_words(text: str = "text") -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Sixteen bytes that name a row by id and text: equal rows share them, and get equal results."""
    return F.unhex(
        F.md5(
            F.concat(
                F.coalesce(F.col(doc_id).cast("string"), F.lit("-")),
                F.lit("|"),
                F.coalesce(F.col(text), F.lit("")),
            )
        )
    )


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A column's texts as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered for words seen before; :meth:`of` forgets all of them beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.limit, self.digest = limit, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def window_hashes(units: np.ndarray, length: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every ``length`` consecutive units, by doubling: O(n log length), wrapping at 64 bits."""
    n = len(units) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    # power[k] holds hashes of 2**k units; the wanted length is put together from its binary digits.
    result, covered = np.zeros(n, U64), 0
    power, width = mix(units.astype(U64) + U64(1)), 1
    factor = U64(multiplier)
    with np.errstate(over="ignore"):
        scale = factor
        while True:
            if length & width:
                result = result * scale + power[covered : covered + n]
                covered += width
            if covered == length:
                return mix(result)
            power = power[:-width] * scale + power[width:]
            scale = scale * scale
            width *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima within blocks."""
    n = len(values)
    if width == 1:
        return values
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def key_runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Cut sorted rows into tables of about ``at_least`` rows, never between rows of one key."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        while (i := int(np.searchsorted(cuts, at + at_least))) < len(cuts):
            yield table.slice(at, int(cuts[i]) - at)
            at = int(cuts[i])
        held = [table.slice(at)]
    if held and held[0].num_rows:
        yield held[0]


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans as ascending spans that neither touch nor overlap."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    starts = spans[first, 0]
    last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(spans) - 1]))
    return list(zip(starts.tolist(), ends[last].tolist(), strict=True))


def with_digest(kept: DataFrame) -> DataFrame:
    """``kept`` as ``kept_sha256``, lowercase hex."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
