"""First-seen lines, mixing and alignment against plain versions, on odd rows."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import brute
import public_tokenizers
import pytest
from bomlake.llm import alignment, firstseen, mixing
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, size int, number int, own string, mix string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, 1, n, "x", "y") for i, t, s, n in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def lined():
    """(id, text, source, batch): lines that repeat within and over batches, short ones, odd white space, nulls, an empty batch."""
    r = random.Random(11)
    common = ["A line that many of the documents hold", "  a LINE that many of the documents hold\t", "\x0bÉa line of letters beyond ASCII\r", "éa line of letters beyond ascii", "short line", "ÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀ", "", " " * 30]
    rows = []
    for i in range(300):
        lines = [r.choice(common) if r.random() < 0.5 else f"this is line {r.randrange(60)} of some" for _ in range(r.randrange(9))]
        rows.append((r.randrange(200), "\n".join(lines) + r.choice(["", "\n", "\n\n"]), r.choice(["s", "t", None]), r.choice([0, 1, 2, 4])))
    return rows + [(None, None, None, 1), (7, "", "s", 2), (7, common[0], "s", None), (None, "\n".join(common * 400), "t", 4)]


def batches(rows, n):
    out = [[] for _ in range(n)]
    for i, t, _, k in rows:
        out[k or 0].append((i, t))
    return out


def first_seen(spark, rows, n, **options):
    kept, gone = firstseen.stripped(table(spark, rows), F.col("number"), n, **options)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    docs = [("doc", None if r.own.doc_id is None else str(r.own.doc_id), r.number, r.n_all, r.n_removed, sha(r.text)) for r in kept.collect()]
    return Counter(docs + [("line", r.key.hex(), r.first, r.docs, r.lines, None) for r in gone.collect()]), kept


def test_first_seen_lines(spark, lined, monkeypatch):
    # two batches without documents, one of them the last; pieces of a few rows; entries written back at once
    monkeypatch.setattr(firstseen, "PIECE_ROWS", 16)
    found, kept = first_seen(spark, lined, 6, shards=3, buckets=2)
    assert found == Counter(brute.first_seen(batches(lined, 6)))
    assert {"size", "number", "own", "mix", "source"} <= set(kept.schema["own"].dataType.names)
    assert [r.text for r in kept.filter("own.doc_id IS NULL AND text IS NULL").collect()] == [None]
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_first_seen_of_nothing(spark):
    assert not first_seen(spark, [], 2)[0]


def test_a_batch_that_fails_runs_again(spark, lined, monkeypatch, tmp_path):
    """A stream that dies after it has written its answers starts again on its checkpoint and changes nothing."""
    rows = table(spark, lined)
    root, real, fails = str(tmp_path / "lines"), firstseen.kept, [True]
    firstseen.written(rows, F.col("number"), 5, root, "text")
    store = {"spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    with firstseen.settings(spark, **store):
        for k in range(5):
            if k == 2:
                monkeypatch.setattr(firstseen, "kept", lambda *a: 1 / 0)
                with pytest.raises(Exception, match="division"):
                    firstseen.fed(spark, root, k, 20, 2, 4, 4)
                monkeypatch.setattr(firstseen, "kept", real)
            firstseen.fed(spark, root, k, 20, 2, 4, 4)
    got = spark.read.parquet(f"{root}/documents").select("number", "n_all", "n_removed").collect()
    assert Counter(map(tuple, got)) == Counter((x[2], x[3], x[4]) for x in brute.first_seen(batches(lined, 5)) if x[0] == "doc")


def test_stores_of_first_seen_lines_share_a_bounded_cache(spark, monkeypatch):
    """The cache of a store of its own outlives the store: ten batches leave one a shard and batch on an executor."""
    prefix, seen, real = "spark.sql.streaming.stateStore.rocksdb.", [], firstseen.fed
    monkeypatch.setattr(firstseen, "fed", lambda *a: (seen.append((spark.conf.get(f"{prefix}boundedMemoryUsage", "false"), int(spark.conf.get(f"{prefix}maxMemoryUsageMB", "500")))), real(*a)))
    rows = spark.createDataFrame([(i, "a line that is long enough to count", i % 3) for i in range(6)], "doc_id long, text string, number int")
    kept, _ = firstseen.stripped(rows, F.col("number"), 3)
    assert sum(r.n_removed for r in kept.collect()) == 4
    assert seen == [("true", firstseen.STORE_MB)] * 3 and firstseen.STORE_MB <= 100
    assert spark.conf.get(f"{prefix}boundedMemoryUsage", None) is None


def test_stores_of_first_seen_lines_have_small_write_buffers(spark, monkeypatch):
    """A buffer's memory stays with the thread that served its task, so at 64 MB of buffer each thread keeps what a store wrote."""
    key, seen, real = "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", [], firstseen.fed
    monkeypatch.setattr(firstseen, "fed", lambda *a: (seen.append(int(spark.conf.get(key, "-1"))), real(*a)))
    lines = [f"line {i} that is long enough to count" for i in range(3000)]
    rows = spark.createDataFrame([(i, "\n".join(lines), i) for i in range(3)], "doc_id long, text string, number int")
    kept, gone = firstseen.stripped(rows, F.col("number"), 3, shards=1, buckets=8)
    assert [r.n_removed for r in kept.orderBy("number").collect()] == [0, 0, 3000] and gone.count() == 3000
    assert seen == [firstseen.WRITE_MB] * 3 and 1 <= firstseen.WRITE_MB <= 4 and spark.conf.get(key, None) is None


def test_stores_of_first_seen_lines_are_as_many_as_the_input_needs(spark, lined, monkeypatch):
    """A closed store leaves memory on its executor: a small input opens one a batch, whatever the session's partitions."""
    roots, real = [], firstseen.fed
    monkeypatch.setattr(firstseen, "fed", lambda *a: (roots.append(a[1]), real(*a)))
    for size, stores in ((firstseen.STATE_BYTES, {"0"}), (1, set("01234567"))):
        monkeypatch.setattr(firstseen, "STATE_BYTES", size)
        assert first_seen(spark, lined, 5, shards=16, buckets=4)[0] == Counter(brute.first_seen(batches(lined, 5)))
        assert {p.name for p in Path(roots[-1].removeprefix("file:"), "checkpoint/state/0").iterdir() if p.name.isdigit()} == stores


def test_state_is_kept_by_transform_with_state():
    assert issubclass(firstseen.Counters, StatefulProcessor)


def mix_rows(r, sources, n=400):
    return [(r.randrange(300) if r.random() < 0.9 else None, r.choice([None, "", " \t", "word " * r.randrange(1, 40), "é b c"]), r.choice(sources), 0) for _ in range(n)]


@pytest.mark.parametrize("sources", [["b", "a", None], ["é", "z", "Z", "", "\U0001f600", "￿", None, "aa"]])
def test_mixing_targets(spark, sources):
    """Targets by plain water filling; copies are floor or ceiling of the rate; the same rows toss the same coin."""
    rows = mix_rows(random.Random(5), sources) + [(1, "w " * 3000, "a", 0)] * 2
    df = table(spark, rows)
    size = lambda t: len(brute.WORD.findall(t or ""))
    total = Counter()
    for _, t, s, _ in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(total.values()), {s for s in order if total[s]}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else share[s]
            left -= target[s] if over else 0
        free = free - over if over else set()
    judged, mix = mixing.drawn(df, mixing.rates(df, (3, 1, 2), 1.5, 2.0))
    assert mix == "mix_" and judged.columns[: len(df.columns)] == df.columns
    got = judged.select("doc_id", "text", "source", f"{mix}.*").collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, t, s) for i, t, s, _ in rows)
    coins = {}
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == total[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        rate = target[r["source"]] / total[r["source"]] if total[r["source"]] else 0
        assert math.floor(rate + 1e-9) <= r["copies"] + 1e-9 and r["copies"] <= math.ceil(rate - 1e-9)
        assert coins.setdefault((r["doc_id"], r["text"], r["source"]), r["copies"]) == r["copies"]
    out = mixing.mixed(df, (3, 1, 2), 1.5, 2.0)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == Counter({k: v for k, v in sum((Counter({(r[0], r[1], r[2]): r["copies"]}) for r in got), Counter()).items() if v})


def test_mixing_comes_near_its_targets_and_agrees(spark):
    r = random.Random(8)
    df = table(spark, [(i, "word " * r.randrange(1, 60), f"s{i % 5 if i % 3 else 0}", 0) for i in range(6000)])
    runs = []
    for parts in (2, 7):
        judged, mix = mixing.drawn(df.repartition(parts), mixing.rates(df, (3, 1, 2), 1.5, 2.0))
        runs.append(sorted(map(tuple, judged.select("doc_id", f"{mix}.copies", f"{mix}.target").collect())))
        for row in judged.groupBy("source").agg(F.sum(F.col(f"{mix}.size") * F.col(f"{mix}.copies")).alias("taken"), F.max(f"{mix}.target").alias("target")).collect():
            assert abs(row.taken - row.target) < 0.06 * row.target
    assert runs[0] == runs[1]


def test_mixing_by_a_table_of_weights(spark, monkeypatch):
    df = table(spark, [(i, "a b c", s, 0) for i, s in enumerate(["x", "y", None, "z"] * 25)])
    weights = spark.createDataFrame([("x", 1.0), (None, 1.0), ("y", 0.0)], "source string, weight double")
    whole = Counter(r.source for r in mixing.mixed(df, weights, 0.5, 1.0).collect())
    assert whole == {"x": 25, None: 25}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert Counter(r.source for r in mixing.mixed(df, weights, 0.5, 1.0).collect()) == whole
    assert mixing.mixed(df.limit(0), (1, 2), 1.0).count() == 0


@pytest.fixture(scope="module")
def mingled():
    r = random.Random(3)
    bits = [" ", "  ", "\n", "\t", " ", "a", "b", "the ", "don't", "'s", "▁", "<|endoftext|>", "<s>", "é", "漢字", "\x00", "\x1c", " ", "\xa0", "🙂", "123", "!!", "<0x41>", "é", "Ā"]
    rows = [(i % 500, "".join(r.choice(bits if i % 2 else [x for x in bits if x != "▁"]) for _ in range(r.randrange(40)))) for i in range(1200)]
    return rows + [(None, None), (1, ""), (1, "x" * 20_000), (2, " " * 300), (None, " lead"), (3, "\nlead"), (4, " ".join(str(i) for i in range(9000)))]


@pytest.mark.parametrize("block", [alignment.BLOCK_TEXT, 2000])
def test_alignment(spark, mingled, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_TEXT", block)
    df = table(spark, [(i, t, None, 0) for i, t in mingled])
    assert Counter(map(tuple, alignment.aligned(df, A, B).collect())) == Counter(brute.alignment(mingled, A, B))


def test_alignment_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(map(tuple, alignment.aligned(documents, A, B).collect())) == Counter(brute.alignment(rows, A, B))
    assert alignment.aligned(documents.limit(0), A, B).count() == 0


def test_columns_of_the_same_names_stay(spark):
    """A table that has columns named as the results has them still, and the results beside them."""
    from bomlake.llm import pii, quality

    docs = spark.createDataFrame([("write to a.b@c.org now", 1, 2)], "text string, quality int, pii int")
    row = quality.verdicts(docs).first()
    assert (row.quality, row.pii) == (1, 2) and row.quality_.n_words == 4
    row = pii.found(docs).first()
    assert (row.quality, row.pii) == (1, 2) and len(row.pii_.base) == 1


def test_shards_against_plain_draws(spark):
    """Every document's way down the tree, level by level, and the same for the grown tree."""
    from bomlake.llm import sharding
    from bomlake.llm.queries import SHARDS

    def shard(key, node):
        while node.children:
            draws = [(-math.log((int(hashlib.md5(f"{c.name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / c.weight, i) for i, c in enumerate(node.children)]
            node = node.children[min(draws)[1]]
        return node.shard

    tree = sharding.topology(SHARDS)
    more = sharding.grown(tree, SHARDS)
    docs = spark.createDataFrame([(i * 7919, f"text {i}") for i in range(1500)] + [(None, None), (7919, "again")], "doc_id long, text string")
    rows = sharding.place(docs, tree, more).collect()
    assert len(rows) == 1502
    for r in rows:
        key = "\0null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (shard(key, tree), shard(key, more))
        assert r.grown_shard in (r.shard, SHARDS)
    for s in range(SHARDS):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
