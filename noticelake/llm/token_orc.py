"""Token ids in ORC: integer run-length encoded stripes with row indexes and a Bloom filter on the document id.

Rows lie in ascending order of ``doc_id`` over all files. Each row holds its ids, the file part it is in and the number of
ids before it in that part; a part's first row and total give the global start, so no task sees more than its own part.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import texts

END_ID = 1
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 2_000
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"


# Words that normalizing leaves as they are: lower-case letters of Latin-1, and what ASCII prints but blank and apostrophe,
# with which some pieces begin. Their pieces are runs of letters, digits, and runs of marks.
_PLAIN = re.compile("[!-&(-~\u00df-\u00f6\u00f8-\u00ff]+")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# The preparation a vocabulary must have for its words to be encoded apart, with pieces of letters, digits or neither.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """Ids of words as bytes, remembered for words seen lately: beyond ``limit`` words, all not met since the last time go.

    Where white space never joins tokens, words encode apart, each when it is first asked for. The model encodes the pieces
    of a plain word without the steps before it. All else goes through the tokenizer as it is, and so do whole texts if the
    vocabulary prepares them in another way.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.older = self.tokenizer.model, {}
        self.packed = [array("i", [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.specials = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100)]
        self.as_bytes = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        plan = json.loads(self.tokenizer.to_str())
        normalizers = [n["type"] for n in (plan.get("normalizer") or {}).get("normalizers", [])]
        first = ((plan.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = normalizers == _NORMALIZERS and first.get("pattern") == {"Regex": _PIECES}

    def _encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode(self, text: bytes) -> bytes:
        found = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return array("i", found[0].ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            tokenize, packed = self.model.tokenize, self.packed
            if word.isalpha():  # ASCII only
                ids = b"".join([packed[t.id] for t in tokenize(word.decode())])
            elif not _PLAIN.fullmatch(low := word.decode("utf-8", "replace").lower()):
                ids = self._encode(word)
            else:
                parts = _PARTS.findall(low)
                if not low.isascii():
                    parts = [p.translate(self.as_bytes) for p in parts]
                ids = b"".join([packed[t.id] for p in parts for t in tokenize(p)])
        self[word] = ids
        return ids

    def documents(self, docs: list[bytes]) -> list[bytes]:
        """Ids of each text, as native 32-bit integers. A text that spells a special token is encoded whole."""
        get, out = self.__getitem__, []
        for text in docs:
            if len(self) > self.limit:
                self.older = dict(self)
                self.clear()
            low = text.lower()
            if not self.by_word or any(s in low for s in self.specials):
                out.append(self._encode(text))
            else:
                out.append(b"".join(map(get, low.split())))
        return out


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words this Python process knows: its next tasks use them too."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def _encoder(path: str, end_id: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("part", pa.int32()),
            ("local_start", pa.int64()),
            ("n_tokens", pa.int32()),
            ("ids", pa.list_(pa.int32())),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, start = word_ids(path), TaskContext.get().partitionId(), 0
        end = array("i", [end_id]).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = words.documents([t or b"" for t in texts(batch)])
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1
                offsets = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(end.join(ids) + end, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(np.full(len(n), part), pa.int32()),
                        pa.array(start + offsets[:-1], pa.int64()),
                        pa.array(n, pa.int32()),
                        lists,
                    ],
                    schema=schema,
                )
                start += int(offsets[-1])

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    stripe_bytes: int = STRIPE_BYTES,
    index_stride: int = INDEX_STRIDE,
) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of ``doc_id``, NULL first.

    NULL texts are empty: one id. Equal ids are ordered by text, so the layout does not depend on the input's; rows equal
    in both are dealt out by a salt, so a hot id does not make one file. Other columns of the input are not written.
    """
    # A salt that depends on the row's place only; rows it tells apart are equal.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["doc_id", "digest", "salt"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ordered.select("doc_id", "text")
        .mapInArrow(_encoder(tokenizer, end_id), FILE_SCHEMA)
        .write.mode("overwrite")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` as written; a condition on ``doc_id`` skips files, stripes and row groups.

    The starts of the parts come from two integer columns of the files: one row per part, whatever the tokens.
    """
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    rows = files if where is None else files.where(where)
    # One row of two numbers per part, and no more parts than tasks that wrote them.
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids"
    )


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the ids as little-endian 32-bit numbers, in one checksum per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().tolist()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                schema=schema,
            )

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
