"""SimHash near-duplicates: BK-trees over fingerprints that share a block of bits, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import U64, key_runs, mix, schema_with, stage, texts
from noticelake.llm.repeats import marked as marked_rows

SHINGLE = 3
RADIUS = 2
BITS = 64
#: Trees hold at most so many fingerprints; larger groups are cut by further bits. At the last level the bits left bound them.
TREE_SIZE = 2_000
LEVELS = 4

# Similar texts, by Jaccard similarity of their sets of word shingles.
SIMILARITY = 0.8
WIDE_SHINGLE = 5
#: Chance that a pair at the similarity itself shares a block of bits.
FOUND = 0.95
#: 64-bit words of a wide fingerprint; the first two are also compared as a whole.
LANES = 10
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of all word shingles, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    n = len(starts)
    for at in range(0, n, 8192):
        part = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + 8192], stops[at : at + 8192])]
        rows = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts(batch)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, fp long")


class BKTree:
    """Children hang on their parent by distance; a search follows only the edges within the radius of its own distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.children[node]
            for d in range(distance - radius, distance + radius + 1):
                if (child := edges.get(d)) is not None:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while new:
            distance = (value ^ self.values[node]).bit_count()
            child = self.children[node].setdefault(distance, new)
            if child == new:
                return
            node = child


def linked_groups(values: list[int], radius: int) -> list[int]:
    """For each of the distinct values, the first one of those it is linked with, over any number of links."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
        tree.add(value)
    return [find(i) for i in range(len(values))]


def _masks(radius: int) -> list[dict[int, list[int]]]:
    """By level, each mask of shared bits and the masks it is cut into.

    Values that differ in ``radius`` bits agree on one of ``radius + 1`` blocks; the bits outside it are cut again.
    """

    def cut(mask: int) -> list[int]:
        free = [b for b in range(BITS) if not mask >> b & 1]
        size = -(-len(free) // (radius + 1))
        blocks = [free[i : i + size] for i in range(0, len(free), size)]
        return [mask | sum(1 << b for b in block) for block in blocks]

    levels, masks = [], [0]
    for _ in range(LEVELS):
        levels.append({m: cut(m) for m in masks})
        masks = sorted({c for children in levels[-1].values() for c in children})
    return levels


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _trees(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "bucket", 50_000):
            mask, fp = table.column("mask").to_numpy(), table.column("fp").to_numpy()
            shared = fp & mask
            order = np.lexsort((fp, shared, mask))
            mask, fp, shared = mask[order], fp[order], shared[order]
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])) + 1
            edges = np.concatenate(([0], cuts, [len(fp)]))
            many = np.flatnonzero(np.diff(edges) > 1)
            left, right = [], []
            for a, b in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
                values = fp[a:b]
                roots = linked_groups(values.view(U64).tolist(), radius)
                for i, r in enumerate(roots):
                    if r != i:
                        left.append(values[i])
                        right.append(values[r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"]
            )

    return link


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints that join the same values as all pairs within ``radius`` would.

    Each fingerprint goes to the tree of each block of its bits: two within the radius meet in one of them. A tree too
    large to search is not built; its members go on to trees that share still more bits, at the last level at most
    2**13 values. No pair is lost and none is written out beyond one link per member of a tree.
    """
    found, rows = None, distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    levels = _masks(radius)
    for level, cuts in enumerate(levels):
        table = F.create_map(
            *[
                x
                for m, cs in cuts.items()
                for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(c)).cast("long") for c in cs]))
            ]
        )
        rows = rows.select("fp", F.explode(table[F.col("mask")]).alias("mask")).withColumn(
            "shared", F.col("fp").bitwiseAND(F.col("mask"))
        )
        if level:
            rows = rows.distinct()
        counts = rows.groupBy("mask", "shared").agg(F.count("*").alias("n")).where("n > 1")
        met = stage(rows.join(counts, ["mask", "shared"]), f"blocks{level}")
        last = level == len(levels) - 1
        small = (met if last else met.where(F.col("n") <= tree_size)).select(
            "mask", "fp", F.xxhash64("mask", "shared").alias("bucket")
        )
        n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        links = small.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_trees(radius), "u long, v long")
        found = links if found is None else found.unionByName(links)
        rows = met.where(F.col("n") > tree_size).select("fp", "mask")
        if last or rows.isEmpty():
            break
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node: the least node it reaches, by large-star and small-star rounds.

    Each round is two aggregates and joins over the links; no node's neighbours are gathered.
    """
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    known = sign(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stage(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "stars",
        )
        now = sign(edges)
        if now == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest ``doc_id`` that it reaches over links of fingerprints.

    Texts that are NULL, empty or blank have fingerprint 0, linked like any other. A NULL id is smaller than none; a
    component of NULL ids only has NULL. Equal texts cost one fingerprint in the trees, however many rows there are.
    """
    marked = stage(with_fingerprints(docs, shingle), "fingerprints")
    return marked.join(_classes(marked, radius, tree_size), "fp").select("doc_id", "fp", "component_id")


def _classes(marked: DataFrame, radius: int, tree_size: int) -> DataFrame:
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius, tree_size))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id, of equal ids that first in the input.

    Rows with a NULL id stay only where a component has no other.
    """
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts(batch, at["text"])], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "fp"])

    marked = stage(named.mapInArrow(mark, schema_with(named, fp="long")).withColumn("row", F.monotonically_increasing_id()), "marked")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("row"))
    light = marked.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), "fp", "row")
    firsts = light.groupBy("fp").agg(F.min(rank).alias("first"))
    classes = _classes(light, radius, tree_size).select("fp", "root")
    kept = classes.join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return marked.join(kept, "row", "left_semi").select(*[F.col(at[c]).alias(c) for c in columns])


def shingles(text: bytes | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's different shingles, A-Z lower-cased; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], U64)
    h = np.fromiter((xxh64_intdigest(w, SEED) for w in words), U64, len(words))
    n = len(words) - shingle + 1
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def wide_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> bytes:
    """Majority bits of 64 * ``lanes`` hash functions over a set of shingles."""
    out, n = [], len(hashes)
    for lane in range(lanes):
        counts = np.zeros(BITS, np.int64)
        with np.errstate(over="ignore"):
            for at in range(0, n, 8192):
                own = mix(hashes[at : at + 8192] + U64(0x632BE59BD9B4E019) * U64(lane + 1))
                counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > n, bitorder="little").tobytes())
    return b"".join(out)


def blocks_for(n: int, similarity: float = SIMILARITY, found: float = FOUND) -> tuple[int, int]:
    """Bits of a block and number of blocks for ``n`` texts.

    A bit differs with the chance of the angle between two sets over half a turn; sets of one size and Jaccard similarity s
    have the cosine 2 s / (1 + s). Blocks have about as many values as there are texts, so that texts which only share a
    block by chance stay few, and there are as many blocks as it takes for similar texts to share one.
    """
    width = min(40, max(10, int(n).bit_length() - 2))
    same = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return width, int(np.ceil(np.log(1 - found) / np.log1p(-(same**width))))


def _block_keys(width: int, blocks: int):
    """``bucket, row, near`` for each block of each fingerprint; ``near`` is the part compared as a whole."""
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(BITS * LANES) for _ in range(-(-width * blocks // (BITS * LANES)) + 1)])
    at = order[: width * blocks]
    powers = (1 << np.arange(width, dtype=np.int64)).astype(np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                fp = batch.column("fp").to_pylist()
                bits = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
                values = bits[:, at].reshape(len(fp), blocks, width).astype(np.int64) @ powers
                with np.errstate(over="ignore"):
                    bucket = mix(values.astype(U64) * U64(2 * blocks + 1) + np.arange(blocks, dtype=U64)[None, :])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.view(np.int64).ravel()),
                        pa.array(np.repeat(batch.column("row").to_numpy(), blocks)),
                        pa.array(np.repeat(np.array([f[:16] for f in fp], dtype=object), blocks), pa.binary()),
                    ],
                    names=["bucket", "row", "near"],
                )

    return emit


def spanning_links(values: list[int], radius: int, tree_size: int = TREE_SIZE) -> list[tuple[int, int]]:
    """Links, as places, between values within the radius: one from each value to every group it meets in the tree.

    A tree takes at most ``tree_size`` values; later ones that meet none of them go on to a tree of their own.
    """
    links, todo = [], list(range(len(values)))
    while len(todo) > 1:
        tree, places, left = BKTree(), [], []
        root: dict[int, int] = {}

        def find(i: int, root=root) -> int:
            while root.get(i, i) != i:
                i = root[i]
            return i

        for i in todo:
            met: dict[int, tuple[int, int]] = {}
            for node in tree.near(values[i], radius):
                j = places[node]
                distance = (values[i] ^ values[j]).bit_count()
                group = find(j)
                if group not in met or (distance, j) < met[group]:
                    met[group] = (distance, j)
            for group, (_, j) in met.items():
                links.append((j, i))
                root[group] = i
            if len(places) < tree_size:
                tree.add(values[i])
                places.append(i)
            elif not met:
                left.append(i)
        todo = left
    return links


def _candidate_links(radius: int, tree_size: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "bucket", 50_000):
            bucket, row = table.column("bucket").to_numpy(), table.column("row").to_numpy()
            near = [int.from_bytes(b, "little") for b in table.column("near").to_pylist()]
            edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            found = [
                (row[a + i], row[a + j])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                if b - a > 1
                for i, j in spanning_links(near[a:b], radius, tree_size)
            ]
            u = np.array([min(x) for x in found], np.int64)
            v = np.array([max(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return link


def similar_links(
    marked: DataFrame,
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = WIDE_SHINGLE,
    found: float = FOUND,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """``u, v`` between rows of different texts of at least that similarity, enough to connect those that blocks find.

    ``marked`` is stored, with ``row, fp, digest`` and the text; of equal texts the least row stands for all. Candidates
    share a block of bits and lie within the radius of three deviations; each link is checked on the exact sets.
    """
    firsts = stage(marked.groupBy("digest").agg(F.min("row").alias("row"), F.min("fp").alias("fp")), "firsts")
    width, blocks = blocks_for(max(1, firsts.count()), similarity, found)
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius = int(128 * differ + 3 * (128 * differ * (1 - differ)) ** 0.5)
    spark = marked.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = firsts.select("row", "fp").mapInArrow(_block_keys(width, blocks), "bucket long, row long, near binary")
    dealt = keys.repartition(n, "bucket").sortWithinPartitions("bucket", "row")
    links = stage(dealt.mapInArrow(_candidate_links(radius, tree_size), "u long, v long").distinct(), "candidates")
    ends = stage(links.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "ends")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, shingle).tobytes() for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.binary())], names=["row", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                good.append(either == 0 or both >= similarity * either - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    likely = marked_rows(marked.select("row", text), ["row"], ends).where("maybe")
    held = likely.join(ends, "row", "left_semi").select("row", text).mapInArrow(sets, "row long, own binary")
    held = stage(held, "shingles")
    left = held.select(F.col("row").alias("u"), F.col("own").alias("a"))
    right = held.select(F.col("row").alias("v"), F.col("own").alias("b"))
    return links.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def keep_one_of_similar(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = WIDE_SHINGLE,
    found: float = FOUND,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """The rows of ``docs``, one of each group of similar texts: that with the smallest id, of equal ids the first.

    Texts are similar whose sets of word shingles have that Jaccard similarity; groups are connected over any number of
    links. Equal texts are always found, pairs at the similarity itself with a chance of about ``found``, closer ones more
    surely. Texts without words, NULL ones too, are one group; texts shorter than a shingle are similar when their words are
    the same. Rows with a NULL id stay only where a group has no other. Columns come back as they were, whatever their names.
    """
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    text = at["text"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [wide_fingerprint(shingles(t, shingle)) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, "fp"])

    marked = named.mapInArrow(mark, schema_with(named, fp="binary")).withColumn("row", F.monotonically_increasing_id())
    marked = stage(marked.withColumn("digest", F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))), "marked")
    links = stage(similar_links(marked, text, similarity, shingle, found, tree_size), "links")
    joined = components(links)
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("row"))
    light = marked.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), "digest", "row")
    firsts = light.groupBy("digest").agg(F.min("row").alias("node"), F.min(rank).alias("first"))
    rooted = firsts.join(joined, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = stage(light.select("row").join(kept, "row", "left_anti"), "gone")
    # Only rows that may go meet the list of those that do; the others stay where they are.
    known = marked_rows(marked, ["row"], gone)
    out = known.where("maybe").join(gone, "row", "left_anti").select(*at.values())
    return out.unionByName(known.where("not maybe").select(*at.values())).toDF(*columns)
