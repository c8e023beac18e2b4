"""MinHash near-duplicates by an LSH forest.

A document's signature has TREES labels of DEPTH minima each. Every tree sorts the documents by label (one
shuffle by label prefix, sorted within), and those with the longest common prefix are neighbours. A region,
the documents that share DEPTH minima, is searched whole while it is small; a larger one is split at a
greater depth, where the next minima differ, until its parts are small, and adjoining parts are tied through
one document. In a region, 2-bit sketches of all minima rule out pairs far below the threshold. What is left
joins documents into blocks, and within blocks links are confirmed on full shingle sets (blocks.py).

With similarity s a pair meets in one tree with s**DEPTH: 25 trees miss a pair of 0.85 with odds of 4e-7
and one of 0.8 with 5e-5. Equal sets are one class from the start, so copies meet no limits at all.

Words are runs of bytes other than ASCII white space, A-Z in lower case; shingles are hashed to 64 bits.
Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat, with equal or different texts under one id, are classes of
their texts; component_id is the least non-null id reachable (null where there is none), and kept means that
a row's id equals it, null with null.

Odds in large regions: a region over REGION documents is split by up to DEEPER further minima, so a pair whose
meetings all fall into such regions is missed with (1 - s**9)**25: 1.4e-3 at 0.85, 2.7e-2 at 0.8, and parts that are
still too large are cut into steps tied through one document. Such regions hold families of thousands of
different near copies, where pairs are tied through others as well; test_near_dedup_of_large_groups measures it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, chunked, dealt
from .common import NUMBER_ROWS, WordHashes, as_bytes, batches_of, bounds, connected_components, materialise, prepare, row_key, runs, shingle_hashes, spanning, unused

TREES, DEPTH, DEEPER = 25, 5, 4
#: Documents that a region may have before it is split at a greater depth.
REGION = 2048
#: Standard deviations below the threshold at which a sketch rules a pair out.
SLACK = 4.75


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and masks of n hash orders."""
    r = np.random.Generator(np.random.PCG64(20240229))
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def minima(shingles: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash under each order, as 32 bits."""
    out = np.full(len(orders[0]), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        x = (shingles[i : i + 2048, None] ^ orders[1]) * orders[0]
        np.minimum(out, (x ^ (x >> np.uint64(29))).min(axis=0), out=out)
    return out >> np.uint64(32)


def labels(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each tree's key (its DEPTH minima, hashed) and extension (16 bits of each of the next DEEPER)."""
    tree = least.reshape(TREES, DEPTH)
    key = np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(DEPTH):
        key = (key ^ tree[:, d]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    deeper = np.zeros(TREES, np.uint64)
    for d in range(1, DEEPER + 1):
        deeper = (deeper << np.uint64(16)) | (np.roll(tree[:, 0], -d) & np.uint64(0xFFFF))
    return key.view(np.int64), (deeper ^ np.uint64(1 << 63)).view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    """Two bits of each minimum."""
    two = (least & np.uint64(3)).astype(np.uint8)
    return np.packbits(np.stack([two >> 1, two & 1], axis=1).ravel()[: 2 * TREES * DEPTH], bitorder="little").tobytes().ljust(32, b"\0")


ODD = np.uint64(0x5555555555555555)


def agreeing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Minima of equal two bits, of sketches as rows of four words."""
    x = others ^ one
    return TREES * DEPTH - np.bitwise_count((x | (x >> np.uint64(1))) & ODD).sum(axis=1).astype(np.int64)


def least_agreeing(similarity: float) -> float:
    p, n = similarity + 0.25 * (1 - similarity), TREES * DEPTH
    return n * p - SLACK * (n * p * (1 - p)) ** 0.5


def doc_words(value: pa.Scalar) -> list[bytes]:
    text = value.as_py()
    return text.lower().split() if text else []


def signed(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """doc, row, digest (null without words), n_shingles and, a class's first row in a batch only, the signature."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        hashes, orders = WordHashes(), seeds(TREES * DEPTH)
        import xxhash

        for batch in batches:
            digests, sizes, keys, deeper, sketches = [], [], [], [], []
            known: dict[bytes, int] = {}
            for value in as_bytes(batch.column(1)):
                shingles = np.unique(shingle_hashes(hashes.of(doc_words(value)), width))
                sizes.append(len(shingles))
                digest = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
                digests.append(digest)
                if digest is None or digest in known:
                    keys.append(None), deeper.append(None), sketches.append(None)
                    continue
                known[digest] = 1
                m = minima(shingles, orders)
                k, d = labels(m)
                keys.append(k), deeper.append(d), sketches.append(sketch(m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(deeper, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), batch.column(2), batch.column(3)],
                names=["doc", "digest", "n_shingles", "keys", "deeper", "sketch", "at", "row"],
            )

    return docs.select(docs[key].alias("doc"), docs[text].cast("string").alias("t"), place(docs, text, key), row_key(docs, key, text).alias("row")).mapInArrow(work, f"doc {kind}, digest binary, n_shingles bigint, keys array<bigint>, deeper array<bigint>, sketch binary, at bigint, row struct<h:bigint,g:bigint>")


def place(docs: DataFrame, text: str, key: str):
    """Where a class's text is found again: its id, or a hash of it where that is null or no number."""
    number = docs[key].cast("bigint") if docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(docs[key])
    return F.coalesce(number, F.xxhash64(docs[text])).alias("at")


def regions(deeper: np.ndarray, limit: int):
    """Parts of a region sorted by extension: whole while small, else by the next 16 bits, and so on.

    Yields index arrays. Parts too large at full depth are cut into steps; adjoining ones share a document.
    """

    def split(lo: int, hi: int, depth: int):
        if hi - lo <= limit:
            yield np.arange(max(0, lo - (lo > 0 and depth > 0)), hi)
        elif depth == DEEPER:
            for i in range(lo, hi, limit):
                yield np.arange(max(0, i - 1), min(hi, i + limit))
        else:
            starts, ends = bounds(deeper[lo:hi] >> np.int64(16 * (DEEPER - 1 - depth)))
            for a, b in zip(starts.tolist(), ends.tolist()):
                yield from split(lo + a, lo + b, depth + 1)

    yield from split(0, len(deeper), 0)


def loose_edges(signatures: DataFrame, similarity: float, region: int = REGION) -> DataFrame:
    """(a, b): trees over the documents of each region whose sketches may be as similar."""
    need = least_agreeing(similarity)

    def work(batches):
        for table in runs(batches, "key"):
            keys, deeper = table["key"].to_numpy(), table["deeper"].to_numpy()
            starts, ends = bounds(keys)
            many = ends - starts > 1
            if not many.any():
                continue
            nodes = table["digest"].combine_chunks()
            words = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, 4)
            a, b = [], []
            for lo, hi in zip(starts[many].tolist(), ends[many].tolist()):
                for part in regions(deeper[lo:hi], region):
                    own = words[lo + part]
                    label = spanning(len(part), lambda i, rest, own=own: agreeing(own[i], own[rest]) >= need)
                    tied = np.flatnonzero(label != np.arange(len(part)))
                    a.extend((lo + part[tied]).tolist()), b.extend((lo + part[label[tied]]).tolist())
            if a:
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

    labelled = signatures.select("digest", "sketch", F.explode(F.arrays_zip("keys", "deeper")).alias("l")).select(F.col("l.keys").alias("key"), F.col("l.deeper").alias("deeper"), "digest", "sketch")
    return dealt(labelled, signatures.sparkSession, "key", "deeper").mapInArrow(work, "a binary, b binary")


def exact_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(task, node, t) -> (a, b): trees of links with 100 * intersection >= percent * union on full sets."""

    def linked(sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in sets])
        vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        marked = np.zeros(len(vocabulary), np.int32)

        def test(i: int, rest: np.ndarray) -> np.ndarray:
            fits = (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])).nonzero()[0]
            out = np.zeros(len(rest), bool)
            if len(fits):
                own = ids[offsets[i] : offsets[i + 1]]
                marked[own] = 1
                chosen = rest[fits]
                if len(chosen) == len(sizes) - 1 or len(chosen) > 64:
                    which = np.concatenate([np.arange(offsets[j], offsets[j + 1]) for j in chosen])
                    shared = np.add.reduceat(marked[ids[which]], np.concatenate(([0], np.cumsum(sizes[chosen])[:-1])))
                else:
                    shared = np.array([marked[ids[offsets[j] : offsets[j + 1]]].sum() for j in chosen])
                marked[own] = 0
                out[fits] = 100 * shared >= percent * (sizes[chosen] + sizes[i] - shared)
            return out

        return spanning(len(sets), test)

    def work(batches):
        hashes = WordHashes()
        import xxhash

        for table in runs(batches, "task"):
            starts, ends = bounds(table["task"].to_numpy())
            nodes, texts = table["node"].combine_chunks(), pc.cast(table["t"], pa.binary()).combine_chunks()
            a, b = [], []
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                sets, at, seen = [], [], set()
                for i in range(lo, hi):
                    node = nodes[i].as_py()
                    if node in seen:
                        continue
                    shingles = np.unique(shingle_hashes(hashes.of(doc_words(texts[i])), width))
                    if xxhash.xxh3_128_digest(shingles.tobytes()) == node:  # another text can have the same id
                        seen.add(node), sets.append(shingles), at.append(i)
                if len(sets) > 1:
                    for i, root in enumerate(linked(sets).tolist()):
                        if i != root:
                            a.append(at[i]), b.append(at[root])
            if a:
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

    return rows.mapInArrow(work, "a binary, b binary")


def components(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id, kept for every row."""
    found, group = grouped(docs, width, percent, text, key)
    found = found.join(group.select("digest", "component_id"), "digest", "left").select("doc", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return found.select(F.col("doc").alias(key), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, width: int, percent: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, row, digest, n_shingles), and of each class (digest) its component with the least id and least row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = materialise(signed(docs, width, text, key), spark)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)  # noqa: E731  equal within a class
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc").alias("id"), F.min("at").alias("at"), first("n_shingles"), first("keys"), first("deeper"), first("sketch"))
    with batches_of(spark, NUMBER_ROWS):
        loose = connected_components(loose_edges(classes, percent / 100), spark)
    members = blocks_of(loose).join(rows.filter("digest is not null").groupBy("digest").agg(F.min("at").alias("at"), F.first("n_shingles").alias("units")).withColumnRenamed("digest", "node"), "node")
    tasks = chunked(members)
    texts = docs.select(place(docs, text, key), docs[text].cast("string").alias("t"))
    with_text = dealt(tasks.join(texts, "at").select("task", "node", "t"), spark, "task", "node")
    tight = connected_components(exact_links(with_text, width, percent), spark)
    ids = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc").alias("id"), F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "row")).alias("first"))
    group = ids.join(tight.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "id", "first", F.coalesce("component", "digest").alias("component"))
    least = group.groupBy("component").agg(F.min("id").alias("component_id"), F.min("first").alias("first"))
    return rows, group.select("digest", "component").join(least, "component").select("digest", "component_id", "first")


def clean(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group, that of the least id; rows equal in id and text are one, and stay if it does.

    Rows go, not ids: a row whose id another row has too is judged by its own text.
    """
    spark = docs.sparkSession
    rows, group = grouped(docs, width, percent, text, key)
    dropped = rows.join(group, "digest").filter(F.col("row") != F.col("first.row")).select("row").distinct()
    own, gone = unused(docs, "row"), materialise(dropped, spark)
    return docs.withColumn(own, row_key(docs, key, text)).join(gone.withColumnRenamed("row", own), own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
