"""Alignment of two tokenizers' tokens: groups between shared ends, links within groups, counts over the corpus.

A text is cut at spaces between two characters that aren't white space. Neither tokenizer joins anything
across such a space: the byte-level one's pattern starts a new match there, and no piece of the other's has a
word mark after another character (checked when the model is read). So a chunk, a space and what follows,
has the same tokens wherever it stands, and chunks that a worker remembers aren't encoded again.

DuckDB aligns the new chunks of an Arrow batch: token intervals as tables, the last end of B at or before each end of A (ASOF
join), groups as running sums of shared ends, tokens of B put into groups by their start (ASOF join). Of the kinds of groups, which are few, a worker
keeps the id pairs. A block is a run of documents of bounded bytes in one Arrow partition. It emits its documents as counts of kinds of groups, the
kinds with their id pairs, and the number of its documents that hold each pair, by another join in DuckDB. Spark sums these
partial counts, finds each A id's highest, and hands every block the counts of its own pairs; documents are summed
within their block. Neither links nor pairs of a document are ever shuffled one by one.

Null and empty texts, and texts whose joined token bytes differ from the text, have zeros and ''. A null or
repeated id is an id as any other: rows are counted one by one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise, worker_state

#: Characters of text after which a block ends, and Arrow rows at a time.
BLOCK_TEXT, ROWS = 16 << 20, 200
#: Chunks and kinds of groups that a worker remembers between blocks; of more chunks the short ones stay.
REMEMBERED, KINDS, OFTEN = 300_000, 400_000, 8
#: Tokens of one side up to which groups are compared as rows of numbers.
FEW = 4
MIX = np.random.Generator(np.random.PCG64(13)).integers(1, (1 << 64) - 1, 2 * FEW, np.uint64) | np.uint64(1)
#: Where neither tokenizer joins; white space is what any Unicode version counts as such.
CUT, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|^\s|\s\Z")
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def chunks_of(text: str | None) -> list[str]:
    if not text:
        return []
    return CUT.split(text) if ODD.search(text) else text.split(" ")


class Tokens:
    """Token ids of chunks, one after the other: chunk number, id, start and end in the chunk's bytes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, chunk_ends: np.ndarray):
        ends = np.cumsum(sizes[ids])
        self.c = np.searchsorted(chunk_ends, ends).astype(np.int32)
        begin = np.concatenate(([0], chunk_ends))[self.c]
        self.ids = ids
        self.table = pa.table({"c": self.c, "k": np.arange(len(ids)), "s": ends - sizes[ids] - begin, "e": ends - begin})


class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation(), self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters, vocabulary = byte_alphabet(), self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of the second tokenizer goes on over a space")
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in self.bytes]

    def encoded(self, text: str) -> list[list[int]]:
        """Ids of A for a space and the text, and of B for the text, to which it adds the space itself."""
        return [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]

    def tokens(self, chunks: list[str]) -> list[Tokens] | None:
        """Tokens of both for chunks that start and end without white space, encoded as one text; None if the bytes differ."""
        whole = " " + " ".join(chunks)
        both = self.encoded(whole[1:])
        if any(b"".join(map(spelt.__getitem__, ids)) != whole.encode() for ids, spelt in zip(both, self.bytes)):
            return None
        ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in chunks), np.int64, len(chunks)))
        return [Tokens(np.array(ids, np.int32), size, ends) for ids, size in zip(both, self.sizes)]


#: Groups of chunks from token intervals: g numbers the groups of a chunk by the shared ends before; the rows of a group's tokens follow each other.
GROUPS = """
    WITH ga AS (
        SELECT c, k, s, coalesce(sum(CAST(shared AS INT)) OVER (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
        FROM (SELECT a.c, a.k, a.s, b.e IS NOT DISTINCT FROM a.e AS shared FROM a ASOF LEFT JOIN b ON a.c = b.c AND a.e >= b.e)),
    spans AS (SELECT c, g, min(s) AS s, min(k) AS a, count(*) AS na FROM ga GROUP BY ALL),
    gb AS (SELECT b.k, spans.c, spans.g, spans.a, spans.na FROM b ASOF JOIN spans ON b.c = spans.c AND b.s >= spans.s)
    SELECT c, a, na, min(k) AS b, count(*) AS nb FROM gb GROUP BY c, g, a, na ORDER BY a
"""


def database():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})


class Kinds(dict):
    """Chunk -> codes of its groups as bytes, or None where the bytes differ; and what is known of the kinds of groups."""

    def __init__(self, pair: Pair):
        self.pair, self.con = pair, database()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.codes, self.said, self.shape, self.pairs = {}, [], [], []

    def bounded(self) -> None:
        """At the start of a block, when no codes are in use. Short chunks come again more often."""
        if len(self.said) > KINDS:
            self.forget()
        if len(self) > REMEMBERED:
            short = {c: x for c, x in self.items() if len(c) <= OFTEN}
            self.clear()
            self.update(short if len(short) <= REMEMBERED else {})

    def kind(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        """The code of a group by its ids."""
        code = self.codes.get((a, b))
        if code is None:
            code = self.codes[a, b] = len(self.said)
            self.said.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            self.shape.append((len(a), len(b), 1, len(a) * len(b)))
            self.pairs.append(np.array([(x, y, n * m) for x, n in Counter(a).items() for y, m in Counter(b).items()], np.int32))
        return code

    def grouped(self, n: int, tokens: list[Tokens]) -> list[bytes]:
        """Codes of the groups of n chunks."""
        for name, t in zip("ab", tokens):
            self.con.register(name, t.table)
        g = {k: v for k, v in self.con.execute(GROUPS).fetchnumpy().items()}
        for name in "ab":
            self.con.unregister(name)
        (ia, ib), codes = (t.ids for t in tokens), np.zeros(len(g["c"]), np.int32)
        # groups of up to so many tokens, nearly all, are told apart as rows of numbers, longer ones by themselves
        small = (g["na"] <= FEW) & (g["nb"] <= FEW)
        rows = np.full((int(small.sum()), 2 * FEW), -1, np.int32)
        for side, ids, lo, size in ((0, ia, g["a"][small], g["na"][small]), (FEW, ib, g["b"][small], g["nb"][small])):
            for k in range(FEW):
                there = size > k
                rows[there, side + k] = ids[lo[there] + k]
        mixed = (rows.astype(np.uint64) * MIX).sum(1, dtype=np.uint64)
        first, which = np.unique(mixed, return_index=True, return_inverse=True)[1:]
        if not np.array_equal(rows[first][which], rows):  # rows of one hash that differ
            first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)[1:]
        kinds = [self.kind(*(tuple(x for x in half if x >= 0) for half in (row[:FEW], row[FEW:]))) for row in rows[first].tolist()]
        codes[small] = np.array(kinds, np.int32)[which] if kinds else 0
        for i in np.flatnonzero(~small).tolist():
            a, b = int(g["a"][i]), int(g["b"][i])
            codes[i] = self.kind(tuple(ia[a : a + int(g["na"][i])].tolist()), tuple(ib[b : b + int(g["nb"][i])].tolist()))
        edges = np.searchsorted(g["c"], np.arange(n + 1)).tolist()
        whole = codes.tobytes()
        return [whole[4 * lo : 4 * hi] for lo, hi in zip(edges[:-1], edges[1:])]

    def learn(self, new: list[str]) -> None:
        """Aligns chunks that aren't known yet, together."""
        plain = [c for c in new if c and not (c[0].isspace() or c[-1].isspace())]
        tokens = self.pair.tokens(plain) if plain else None
        if tokens:
            self.update(zip(plain, self.grouped(len(plain), tokens)))
        for c in new:
            if c not in self:  # alone: with white space at its ends, or in a batch that holds a chunk whose bytes differ
                one = self.alone(c)
                self[c] = one and self.grouped(1, one)[0]

    def alone(self, chunk: str) -> list[Tokens] | None:
        whole, both = (" " + chunk).encode(), self.pair.encoded(chunk)
        if any(b"".join(map(spelt.__getitem__, ids)) != whole for ids, spelt in zip(both, self.pair.bytes)):
            return None
        return [Tokens(np.array(ids, np.int32), size, np.array([len(whole)])) for ids, size in zip(both, self.pair.sizes)]


#: What a block emits: documents, kinds of groups with their id pairs, and the number of documents of each id pair.
COLUMNS = {"row": pa.int64(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()), "sha": pa.string(), "held": pa.binary(), "width": pa.int32(), "pairs": pa.binary()}
SCHEMA = "kind int, block long, id {id}, row long, a int, b int, n long, n_a long, n_b long, n_groups long, n_links long, sha string, held binary, width int, pairs binary"
DOC, GROUP, COUNT = 0, 1, 2
CODEC = "zstd"


def squeezed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and how often each comes."""
    return pa.compress(np.concatenate((np.diff(codes, prepend=0), times)).astype(np.int32).tobytes(), codec=CODEC, asbytes=True)


def unsqueezed(held: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(held, 8 * width, codec=CODEC), np.int32)
    return np.cumsum(both[:width]), both[width:]


class Block:
    def __init__(self, kinds: Kinds):
        kinds.bounded()
        self.kinds, self.docs, self.chars = kinds, [], 0

    def add(self, rows: list[tuple]) -> None:
        """(id, text) rows."""
        kinds = self.kinds
        split = [chunks_of(t) for _, t in rows]
        kinds.learn(list(set(chain.from_iterable(split)).difference(kinds)))
        shape, said = np.array(kinds.shape, np.int64).reshape(-1, 4), kinds.said
        for (i, text), chunks in zip(rows, split):
            own = list(map(kinds.__getitem__, chunks))
            self.chars += 16 + len(text or "")
            if not own or None in own:
                self.docs.append((i, 0, 0, 0, 0, "", None, None))
                continue
            codes = np.frombuffer(b"".join(own), np.int32)
            digest = hashlib.sha256(";".join(map(said.__getitem__, codes.tolist())).encode()).hexdigest()
            self.docs.append((i, *shape[codes].sum(0).tolist(), digest, *np.unique(codes, return_counts=True)))

    def emitted(self, block: int, id_type: pa.DataType):
        """Record batches of the block's rows. Codes are those of the block, from 0."""
        docs = list(zip(*self.docs))
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *[x for x in docs[6] if x is not None]]))

        def batch(kind: int, size: int, **columns):
            types = {"id": id_type, **COLUMNS}
            return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), pa.array([block] * size, pa.int64()), *[pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()]], names=["kind", "block", *types])

        local = [None if x is None else np.searchsorted(used, x) for x in docs[6]]
        for lo in range(0, len(local), 2000):
            hi = min(lo + 2000, len(local))
            held = [None if x is None else squeezed(x, t) for x, t in zip(local[lo:hi], docs[7][lo:hi])]
            yield batch(DOC, hi - lo, id=docs[0][lo:hi], row=range(lo, hi), held=held, width=[None if x is None else len(x) for x in local[lo:hi]], **dict(zip(("n_a", "n_b", "n_groups", "n_links", "sha"), (x[lo:hi] for x in docs[1:6]))))
        if not len(used):
            return
        each = [self.kinds.pairs[k] for k in used.tolist()]
        flat = np.concatenate(each)
        owner = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
        for lo in range(0, len(flat), 500_000):
            rows = np.column_stack((owner[lo : lo + 500_000], flat[lo : lo + 500_000]))
            yield batch(GROUP, 1, pairs=[rows.astype(np.int32).tobytes()])
        # a pair counts once for a document, whichever of its groups hold it
        con = self.kinds.con
        con.register("arrow_pairs", pa.table({"c": owner, "a": flat[:, 0], "b": flat[:, 1]}))
        con.execute("CREATE OR REPLACE TEMP TABLE pairs AS SELECT * FROM arrow_pairs; CREATE OR REPLACE TEMP TABLE partial (a INT, b INT, n BIGINT)")
        some = [x for x in local if x is not None]
        for lo in range(0, len(some), 256):
            part = some[lo : lo + 256]
            con.register("arrow_docs", pa.table({"d": np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part]), "c": np.concatenate(part).astype(np.int32)}))
            con.execute("INSERT INTO partial SELECT a, b, count(*) FROM (SELECT DISTINCT d, a, b FROM arrow_docs JOIN pairs USING (c)) GROUP BY ALL")
        con.unregister("arrow_docs"), con.unregister("arrow_pairs")
        counts = con.execute("SELECT a, b, sum(n)::BIGINT AS n FROM partial GROUP BY ALL").fetchnumpy()
        con.execute("DROP TABLE partial; DROP TABLE pairs")
        for lo in range(0, len(counts["a"]), 50_000):
            cut = {c: v[lo : lo + 50_000] for c, v in counts.items()}
            yield batch(COUNT, len(cut["a"]), **cut)


def blocks(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """SCHEMA rows of all blocks."""
    spark = docs.sparkSession
    schema = SCHEMA.format(id=docs.schema[key].dataType.simpleString())
    # both files are of a fixed size, whatever the corpus, and workers need not have them
    files = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))

    def work(batches):
        from pyspark import TaskContext

        kinds = worker_state("alignment", f"{a_path}:{b_path}", lambda: Kinds(Pair(*files.value)))
        block, n, id_type = Block(kinds), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            block.add(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            if block.chars >= BLOCK_TEXT:
                yield from block.emitted(n, id_type)
                block, n = Block(kinds), n + 1
        if block.docs:
            yield from block.emitted(n, id_type)

    with batches_of(spark, ROWS):
        return materialise(docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).mapInArrow(work, schema), spark)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold a pair linked, and whether no other pair of `a` has more."""
    n = rows.filter(f"kind = {COUNT}").groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = n.groupBy("a").agg(F.max("n").alias("most"))  # a row an id of the vocabulary
    return n.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
    """Documents of a block with n_best and count_sum, from the block's groups and the counts of its pairs."""
    import pyarrow.compute as pc

    con = worker_state("alignment sums", "database", database)
    groups = known.filter(pc.equal(known.column("kind"), GROUP)).column("pairs").to_pylist()
    flat = np.frombuffer(b"".join(groups), np.int32).reshape(-1, 4)
    con.register("counts", known.filter(pc.equal(known.column("kind"), COUNT)).select(["a", "b", "n", "best"]))
    con.register("pairs", pa.table({"c": flat[:, 0], "a": flat[:, 1], "b": flat[:, 2], "times": flat[:, 3]}))
    sums = con.execute("SELECT c, sum(times * n)::BIGINT AS total, coalesce(sum(times) FILTER (WHERE best), 0)::BIGINT AS best FROM pairs JOIN counts USING (a, b) GROUP BY c").fetchnumpy()
    con.unregister("counts"), con.unregister("pairs")
    totals, bests = np.zeros((2, int(flat[:, 0].max(initial=-1)) + 1), np.int64)
    totals[sums["c"]], bests[sums["c"]] = sums["total"], sums["best"]
    n_best, count_sum = [], []
    for held, width in zip(docs.column("held").to_pylist(), docs.column("width").to_pylist()):
        codes, times = unsqueezed(held, width) if held else (np.zeros(0, np.int32),) * 2
        n_best.append(int((bests[codes] * times).sum())), count_sum.append(int((totals[codes] * times).sum()))
    return docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "sha"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    rows = blocks(docs, a_path, b_path, key, text)
    own = rows.filter(f"kind = {COUNT}").select("block", "a", "b").join(pair_counts(rows), ["a", "b"])
    groups = rows.filter(f"kind = {GROUP}").select("kind", "block", "pairs")
    known = own.withColumn("kind", F.lit(COUNT)).unionByName(groups, allowMissingColumns=True)
    texts = rows.filter(f"kind = {DOC}").select(F.col("block").alias("at"), "id", "n_a", "n_b", "n_groups", "n_links", "sha", "held", "width")
    kind = docs.schema[key].dataType.simpleString()
    out = texts.groupBy("at").cogroup(known.groupBy("block")).applyInArrow(summed, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, n_best bigint, count_sum bigint")
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
