"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Test items are partitioned by the size of their shingle set. An item's sketch is its bottom-k MinHash sketch
with k = size - ceil(threshold * size) + 1: a document that contains the threshold's share of the shingles
misses fewer than k of them, so it has one of the sketch at least, however long the document is. Each
size partition is searched only with documents that are large enough for it. Candidates are verified on the
whole sets. The sketch makes no mistakes, and nothing is shuffled: documents stay where they are read.

Items are a stated query set: they are sent to the tasks in slices of a bounded size, and every slice is
searched in all documents.

Words are runs of characters other than ASCII punctuation and white space, in lower case. Defined results:
null and empty texts and items match nothing; an item of fewer words than a shingle is one shingle of its
own width; items and documents that repeat are matched one by one; null ids are carried as they are.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHashes, prepare, row_key, shingle_hashes, unused, worker_state

WIDTH, THRESHOLD = 5, (4, 5)
#: Characters of items that are sent to the tasks at a time.
SLICE_CHARS = 32_000_000
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()


class Partition:
    """Items of one shingle width whose sizes lie in one power of two."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], threshold: tuple[int, int]):
        self.width, self.items = width, items
        self.need = [-(-len(s) * threshold[0] // threshold[1]) for _, s in items]
        self.least = min(self.need)
        keys = [(h, i) for i, (_, s) in enumerate(items) for h in s[: len(s) - self.need[i] + 1].tolist()]  # sorted: the least hashes
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.uint64)
        self.owner = np.array([i for _, i in keys], np.int64)
        self.marks = np.zeros(1 << max(16, (len(keys) * 16).bit_length()), bool)  # a first, cheap test
        self.mask = np.uint64(len(self.marks) - 1)
        self.marks[(self.keys & self.mask).astype(np.int64)] = True

    def search(self, shingles: np.ndarray):
        """Item places and shared counts for a document's sorted set."""
        if len(shingles) < self.least:
            return
        hits = shingles[self.marks[(shingles & self.mask).astype(np.int64)]]
        if not len(hits):
            return
        lo, hi = np.searchsorted(self.keys, hits, "left"), np.searchsorted(self.keys, hits, "right")
        found = {i for a, b in zip(lo.tolist(), hi.tolist()) for i in self.owner[a:b].tolist()}
        for i in sorted(found):
            item = self.items[i][1]
            at = np.minimum(np.searchsorted(shingles, item), len(shingles) - 1)
            shared = int((shingles[at] == item).sum())
            if shared >= self.need[i]:
                yield i, shared


def partitions(items: list[tuple[int, str]], width: int, threshold: tuple[int, int]) -> list[Partition]:
    hashes, by = WordHashes(), {}
    for n, (_, text) in enumerate(items):
        if w := words(text):
            own = min(width, len(w))
            shingles = np.unique(shingle_hashes(hashes.of(w), own))
            by.setdefault((own, len(shingles).bit_length()), []).append((n, shingles))
    return [Partition(own, rows, threshold) for (own, _), rows in sorted(by.items())]


def found(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """matches() and a key of the document's row."""
    spark = docs.sparkSession
    prepare(spark)
    query = items.select(items[item_key].alias("i"), items[item_text].cast("string").alias("t")).filter("t is not null")
    chars = query.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = math.ceil(chars / SLICE_CHARS) or 1
    kind, item_kind = (df.schema[c].dataType for df, c in ((docs, key), (items, item_key)))
    schema = f"`{key}` {kind.simpleString()}, `{item_key}` {item_kind.simpleString()}, n_item bigint, n_shared bigint, row struct<h:bigint,g:bigint>"
    item_type = to_arrow_type(item_kind)
    source, out = docs.select(docs[key], docs[text].cast("string").alias("t"), row_key(docs, key, text).alias("row")), None
    for s in range(slices):
        rows = [(r.i, r.t) for r in query.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s).collect()]  # at most about SLICE_CHARS
        sent, name = spark.sparkContext.broadcast(rows), f"items:{uuid.uuid4().hex}"

        def work(batches, sent=sent, name=name):
            hashes, names = WordHashes(), [i for i, _ in sent.value]
            parts = worker_state("decontaminate", name, lambda: partitions(sent.value, width, threshold))
            widths = sorted({p.width for p in parts})
            for batch in batches:
                row, item, size, shared = [], [], [], []
                for k, value in enumerate(batch.column(1)):
                    if w := words(value.as_py()):
                        h = hashes.of(w)
                        sets = {x: np.unique(shingle_hashes(h, x)) if len(w) >= x else None for x in widths}
                        for p in parts:
                            if sets[p.width] is not None:
                                for i, n in p.search(sets[p.width]):
                                    row.append(k), item.append(names[p.items[i][0]]), size.append(len(p.items[i][1])), shared.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type), *(pa.array(x, pa.int64()) for x in (size, shared)), batch.column(2).take(pa.array(row, pa.int64()))], names=[key, item_key, "n_item", "n_shared", "row"])

        part = source.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Every pair (doc, item) with shared >= threshold * item's shingles: key, item_key, n_item, n_shared."""
    return found(docs, items, **options).drop("row")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Documents that contain no item. Rows go, not ids."""
    own = unused(docs, "row")
    gone = found(docs, items, text=text, key=key, **options).select(F.col("row").alias(own)).distinct()
    return docs.withColumn(own, row_key(docs, key, text)).join(gone, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
