"""What several operators share: worker state, shared tables, runs of sorted rows, components."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: bounds a worker's memory where texts are long.
BATCH_ROWS = 200
#: The same where rows are a few numbers.
NUMBER_ROWS = 20_000


def prepare(spark: SparkSession) -> None:
    """Settings that bound the memory of Arrow exchanges."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting that holds for what is computed inside; the session's own is put back."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what is computed inside; the session's own setting is put back."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def row_key(docs: DataFrame, *columns: str) -> Column:
    """128 bits that tell rows of different columns apart; equal rows are equal."""
    values = [docs[c] for c in columns]
    return F.struct(F.xxhash64(*values).alias("h"), F.xxhash64(F.lit(7), *[F.coalesce(F.length(v.cast("string")), F.lit(-1)) for v in values], *reversed(values)).alias("g"))


def worker_home() -> types.ModuleType:
    """Where this Python process keeps things between tasks. Functions travel by value, so their globals don't last."""
    return sys.modules.setdefault("_bomlake_worker_state", types.ModuleType("_bomlake_worker_state"))


def worker_state(operator: str, name: str, make):
    """An object of an operator's that lives as long as the Python worker, made on first use.

    A worker that turns to another operator lets go of what the last one kept.
    """
    home = worker_home()
    if getattr(home, "operator", None) != operator:
        home.operator, home.kept = operator, {}
    if name not in home.kept:
        home.kept[name] = make()
    return home.kept[name]


#: White space that ends a word.
GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A random weight of each byte, and an odd base with its inverse modulo 2**64.
WEIGHTS = np.random.Generator(np.random.PCG64(20240307)).integers(1, (1 << 64) - 1, 256, np.uint64)
BASE = 0xC2B2AE3D27D4EB4F
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; a longer word is hashed whole.
SLICE = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, or more; those of a slice are kept."""
    home, size = worker_home(), max(n, SLICE)
    kept = getattr(home, "powers", None)
    if kept is None or size > SLICE:
        kept = tuple(np.cumprod(np.array([1] + [x] * (size - 1), np.uint64), dtype=np.uint64) for x in (BASE, INVERSE))
        if size == SLICE:
            home.powers = kept
    return kept


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all bits of `values`."""
    for shift in (32, 29):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text, and where the words start.

    A word is a polynomial of its bytes, modulo 2**64, then mixed; all of a slice come from one running sum.
    """
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(GAPS[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        first = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + SLICE, "right")))
        n = int(ends[hi - 1] - first)
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(WEIGHTS[data[first : first + n]] * up[:n], out=sums[1:])
        at = starts[lo:hi] - first
        out[lo:hi] = (sums[ends[lo:hi] - first] - sums[at]) * down[at]
        lo = hi
    return mixed(out), starts


class WordHashes:
    """word_hashes() of words that are already apart."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return word_hashes(b" ".join(words))[0]


#: Odd multipliers, one for each place in a shingle.
PLACES = [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xC2B2AE3D27D4EB4F * i)) & (2**64 - 1) | 1 for i in range(64)]


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every run of `width` words; a shorter text is one shingle; none without words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out += word_hashes[i : n - width + 1 + i] * np.uint64(PLACES[i])
    out ^= out >> np.uint64(31)
    return out * np.uint64(PLACES[-1])


#: Bytes that a writer of intermediate tables gathers before it writes them.
BLOCK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, a folder of its own where that is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bomlake-"))
        path = sc.getCheckpointDir()
    return path


#: Whether shuffle files go when the query that made them ends, and not when the driver happens to collect its garbage.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back, so lost executors cost no lineage and no step keeps the shuffle files of those before."""
    path = f"{shared_dir(spark)}/bomlake-{uuid.uuid4().hex}"
    with setting(spark, SWEPT, "true"):
        df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.bomlake_path = path
    return out


def size_of(df: DataFrame, spark: SparkSession) -> int:
    """Bytes of a table that materialise() wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.bomlake_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def forget(df: DataFrame, spark: SparkSession) -> None:
    """Deletes a table that materialise() wrote and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.bomlake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, whatever the number of its uses."""
    return F.transform(F.array(value), body)[0]


def as_bytes(column: pa.Array) -> pa.Array:
    return pc.cast(column, pa.binary())


def runs(batches, key: str):
    """Record batches sorted by `key` -> tables that each hold whole runs of equal keys.

    Rows of the last key of a batch wait for the next batch, so memory is one batch and one run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        if held and held[-1].column(key)[0] == last and keys[0] == last:
            held.append(batch)
            continue
        differs = pc.not_equal(keys, last).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut or held:
            ready = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            if ready.num_rows:
                yield ready
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.append(starts[1:], len(keys))


def spanning(n: int, linked) -> np.ndarray:
    """Component labels 0..n-1 (the least member) of a graph over n nodes.

    linked(i, rest) -> boolean mask over `rest`. A node is compared only with nodes that no earlier
    one has reached, so a dense group costs about n comparisons and no pair is ever listed.
    """
    label = np.full(n, -1)
    rest = np.arange(n)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        rest = rest[rest != root]
        queue = [root]
        while queue and len(rest):
            hit = linked(queue.pop(), rest)
            found = rest[hit]
            label[found] = root
            queue.extend(found.tolist())
            rest = rest[~hit]
    return label


def connected_components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(a, b) -> (node, component): the least node that each node of an edge reaches.

    Alternates two contractions until nothing changes: every larger neighbour is tied to a node's least
    neighbour, then every smaller one. Minima are pre-aggregated and joined back, so a hub never gathers
    its neighbours in one task, and each round is a table in the shared folder.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    current = materialise(tidy(edges), spark)
    seen = state(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tidy(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        new = materialise(tidy(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))), spark)
        forget(current, spark)
        current, before = new, seen
        seen = state(current)
        if seen == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
