"""First-seen line stripping: a stream that remembers in how many documents it has met each line.

Documents come in numbered batches. A line's key is the line without white space at its ends and with A-Z
lower-cased; a line goes if its key has at least `least` code points and documents of earlier batches that held it are at
least `seen`. Batches are written as tables, and a streaming query is started on one checkpoint for each of them.

Documents are cut into pieces of bounded rows. A worker combines the repeated lines of a piece and deals its keys (SHA-256) to
shards, a row a piece and shard, so a common line is one entry of a row whatever its repeats. transformWithStateInPandas, grouped
by shard, keeps a map state. A state call is a round trip of some 0.2 ms, so a map entry holds the
packed counters of all keys that share a bucket: documents, the last batch with its documents, the first batch that removed the key, lines removed. The answer
is as compact: a row a piece and shard with the digests that go. Pieces and answers meet by piece, and documents
are written, a folder a batch. Counters tell the running batch from earlier ones, so neither the order of rows nor a
batch that runs again changes a result.

A null or empty text is one empty line; null stays null. A null number of a batch counts as 0. Ids may be null or repeat:
rows are documents. Other columns pass, whatever their names. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import BLOCK_BYTES, as_bytes, batches_of, shared_dir

#: Groups of the state, and map entries of each; for more keys raise both, so that an entry stays at some hundred keys.
SHARDS, BUCKETS = 64, 64
#: Input rows from which a piece is made, over all batches: a power of two.
PIECE_ROWS = 4096
#: Keys of unpacked entries that a shard's task holds before it writes them back.
HELD_KEYS = 400_000
#: MB that all open state stores of an executor share for blocks and write buffers.
STORE_MB = 16
#: MB of a store's write buffer. Each state task is served by a thread of its own, and the C library keeps what a thread's buffers took.
WRITE_MB = 1
#: Bytes of the written documents for which the state gets a partition. Each opens a store in each batch, and a closed store leaves memory on its executor.
STATE_BYTES = 32 << 20
ROWS = 200
#: White space at the ends of a line.
ENDS = b"\x20\x09\x0a\x0b\x0c\x0d"
DIGEST = 32
KEYS = "shard int, piece long, number int, keys binary, docs binary, lines binary, last boolean"
ANSWERS = "piece long, removed binary, key binary, first int, docs long, lines long"
DOCS_FILES, ANSWER_FILES = "documents", "answers"


def digest(line: bytes, least: int) -> bytes | None:
    """SHA-256 of a line's key, None if the key is too short."""
    key = line.strip(ENDS)
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return hashlib.sha256(key.lower()).digest()


def keys_of(batches, least: int, shards: int):
    """(piece, number, last, text) rows in order -> KEYS rows, the keys of a piece combined."""

    def emitted(piece, number, held):
        by_shard: dict[int, list] = {}
        for key, counts in held.items():
            by_shard.setdefault(int.from_bytes(key[:4], "big") % shards, []).append((key, *counts))
        for shard, rows in by_shard.items():
            keys, docs, lines = zip(*rows)
            out.append((shard, piece, number, b"".join(keys), np.array(docs, np.int64).tobytes(), np.array(lines, np.int64).tobytes(), False))

    def batch(rows):
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in KEYS.split(", ")])

    out, held, at = [], {}, None
    for b in batches:
        for piece, number, last, text in zip(*(b.column(i).to_pylist() for i in range(3)), as_bytes(b.column(3))):
            if at != (piece, number):
                if held:
                    emitted(*at, held)
                held, at = {}, (piece, number)
            if last is not None:
                out.extend((s, -1, number, b"", b"", b"", True) for s in range(shards) if last)
                continue
            own: dict[bytes, int] = {}
            for line in (text.as_py() or b"").split(b"\n"):
                if key := digest(line, least):
                    own[key] = own.get(key, 0) + 1
            for key, n in own.items():
                counts = held.setdefault(key, [0, 0])
                counts[0] += 1
                counts[1] += n
        while len(out) >= ROWS:
            yield batch(out[:ROWS])
            del out[:ROWS]
    if held:
        emitted(*at, held)
    if out:
        yield batch(out)


class Counters(StatefulProcessor):
    """Per shard: bucket -> digests and, for each, documents, last batch, documents of it, first removing batch, lines removed."""

    def __init__(self, seen: int, buckets: int):
        self.seen, self.buckets = seen, buckets

    def init(self, handle) -> None:
        self.state = handle.getMapState("counters", "bucket int", "keys binary, numbers binary")

    @staticmethod
    def unpacked(value) -> dict:
        if value is None:
            return {}
        keys, numbers = bytes(value[0]), np.frombuffer(value[1], np.int64).reshape(-1, 5).tolist()
        return {keys[i * DIGEST : (i + 1) * DIGEST]: n for i, n in enumerate(numbers)}

    def write_back(self, held: dict) -> None:
        for bucket, entry in held.items():
            self.state.updateValue((bucket,), (b"".join(entry), np.array(list(entry.values()), np.int64).tobytes()))
        held.clear()

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        held, size, last = {}, 0, False
        for frame in rows:
            answers = []
            for piece, number, keys, docs, lines, end in zip(*(frame[c] for c in ("piece", "number", "keys", "docs", "lines", "last"))):
                last |= bool(end)
                gone = []
                for i, (n_docs, n_lines) in enumerate(zip(np.frombuffer(docs, np.int64).tolist(), np.frombuffer(lines, np.int64).tolist())):
                    k = bytes(keys[i * DIGEST : (i + 1) * DIGEST])
                    bucket = int.from_bytes(k[4:8], "big") % self.buckets
                    entry = held.get(bucket)
                    if entry is None:
                        entry = held[bucket] = self.unpacked(self.state.getValue((bucket,)))
                        size += len(entry)
                    c = entry.get(k)
                    if c is None:
                        c, size = entry.setdefault(k, [0, -1, 0, -1, 0]), size + 1
                    if c[1] != number:
                        c[1], c[2] = number, 0
                    if c[0] - c[2] >= self.seen:
                        gone.append(k)
                        c[3] = number if c[3] < 0 else c[3]
                        c[4] += n_lines
                    c[0] += n_docs
                    c[2] += n_docs
                if gone:
                    answers.append((piece, b"".join(gone), None, 0, 0, 0))
                if size > HELD_KEYS:
                    self.write_back(held)
                    size = 0
            if answers:
                yield self.frame(pd, answers)
        self.write_back(held)
        if last:
            for _, value in self.state.iterator():
                if removed := [(-1, None, k, c[3], c[0], c[4]) for k, c in self.unpacked(value).items() if c[4]]:
                    yield self.frame(pd, removed)

    @staticmethod
    def frame(pd, rows):
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession, **values):
    """Settings of the session for what is started inside; its own are put back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(key: tuple, docs: pa.Table, answers: pa.Table, least: int) -> pa.Table:
    """Documents of a piece without the lines that its answers name."""
    gone = set()
    for x in answers.column("removed").to_pylist():
        gone.update(x[i : i + DIGEST] for i in range(0, len(x), DIGEST))
    texts, n_all, n_removed = [], [], []
    for value in as_bytes(docs.column("text")).to_pylist():
        lines = (value or b"").split(b"\n")
        stay = [x for x in lines if digest(x, least) not in gone] if gone else lines
        n_all.append(len(lines)), n_removed.append(len(lines) - len(stay))
        texts.append(value if len(stay) == len(lines) else b"\n".join(stay))
    at = docs.schema.get_field_index("text")
    docs = docs.drop_columns(["piece"]).set_column(at - 1, "text", pa.array(texts, pa.binary()).cast(pa.string()))
    return docs.append_column("n_all", pa.array(n_all, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))


def written(docs: DataFrame, number: Column, n: int, root: str, text: str) -> None:
    """Batches as folders number=0.. under `root`: (number, piece, last, text, own). Each has a marker row; only the last one's is true."""
    spark = docs.sparkSession
    own = F.struct(*[docs[c] for c in docs.columns if c != text])
    rows = docs.select(F.coalesce(number.cast("int"), F.lit(0)).alias("number"), F.shiftright(F.monotonically_increasing_id(), PIECE_ROWS.bit_length() - 1).alias("piece"), F.lit(None).cast("boolean").alias("last"), docs[text].cast("string").alias("text"), own.alias("own"))
    marks = spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("number"), F.lit(-1).cast("long").alias("piece"), (F.col("id") == n - 1).alias("last"))
    rows.unionByName(marks, allowMissingColumns=True).write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).partitionBy("number").parquet(f"{root}/cut")


def state_partitions(spark: SparkSession, root: str, shards: int) -> int:
    """Partitions of the state: as the documents that written() left need, not more than there are shards or the session has for a shuffle."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/cut")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // STATE_BYTES)


def landed(spark: SparkSession, root: str, number: int) -> str:
    """Moves a batch into the folder that the stream watches, unless it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    cut, feed = path(f"{root}/cut/number={number}"), path(f"{root}/feed/number={number}")
    fs = feed.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(feed.getParent())
    if not fs.exists(feed) and not fs.rename(cut, feed):
        raise OSError(f"{cut} can't be moved to {feed}")
    return f"{root}/feed/number={number}"


def fed(spark: SparkSession, root: str, number: int, least: int, seen: int, shards: int, buckets: int) -> None:
    """Starts the stream on the checkpoint under `root`, feeds it one batch and waits for its end.

    The batch's answers and documents are written as folders that a batch that runs again replaces.
    """
    folder = landed(spark, root, number)
    source = spark.read.parquet(folder)
    columns = [x for x in source.columns if x not in ("last", "piece")]

    def emit(answers: DataFrame, _: int) -> None:
        session, at = answers.sparkSession, f"{root}/{ANSWER_FILES}/number={number}"
        answers.write.mode("overwrite").parquet(at)
        said = session.read.schema(ANSWERS).parquet(at).filter("removed IS NOT NULL").select(F.col("piece").alias("at"), "removed")
        rows = session.read.schema(source.schema).parquet(folder).filter("last IS NULL").select("piece", *columns)
        schema = [*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), "n_all bigint", "n_removed bigint"]
        out = rows.groupBy("piece").cogroup(said.groupBy("at")).applyInArrow(lambda k, d, a: kept(k, d, a, least), ", ".join(schema))
        out.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{DOCS_FILES}/number={number}")

    rows = spark.readStream.schema(source.schema).parquet(f"{root}/feed")
    stream = rows.select("piece", F.lit(number).alias("number"), "last", "text").mapInArrow(lambda b: keys_of(b, least, shards), KEYS)
    answers = stream.groupBy("shard").transformWithStateInPandas(Counters(seen, buckets), ANSWERS, "Append", "None")
    query = answers.writeStream.foreachBatch(emit).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def stripped(docs: DataFrame, number: Column, n: int, text: str = "text", least: int = 20, seen: int = 2, shards: int = SHARDS, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Documents without lines that earlier batches held, and the lines that went.

    number: each row's batch, 0 to n - 1. Documents: their columns in one struct `own` but for the text, `text`, `number`, n_all, n_removed (lines).
    Lines: key (SHA-256), first (the batch that first removed it), docs (that held it in any batch), lines (removed).
    """
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/bomlake-lines-{uuid.uuid4().hex}"
    written(docs, number, n, root, text)
    partitions = state_partitions(spark, root, shards)
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    for k in range(n):
        # a store that stays open keeps 4 MB of disk and its caches on an executor until the next batch's stream has its own; the block cache
        # of a store of its own is not freed when the store is closed, so all share one
        stores = dict(spark__sql__streaming__stateStore__providerClass=store, spark__sql__streaming__stateStore__unloadOnCommit="true", spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true", spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB=STORE_MB, spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB=WRITE_MB)
        with settings(spark, **stores, spark__sql__shuffle__partitions=partitions), batches_of(spark, ROWS):
            fed(spark, root, k, least, seen, shards, buckets)
    own = spark.read.parquet(f"{root}/feed").schema
    schema = f"text string, own {own['own'].dataType.simpleString()}, n_all long, n_removed long, number int"
    return spark.read.schema(schema).parquet(f"{root}/{DOCS_FILES}"), spark.read.schema(f"{ANSWERS}, number int").parquet(f"{root}/{ANSWER_FILES}").filter("key IS NOT NULL").select("key", "first", "docs", "lines")
