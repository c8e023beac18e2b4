import random
import time
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as spark_functions
from tokenizers import Tokenizer

import bomlake
from bomlake.llm import bpe, classifier, common, decontaminate, lines, near, pii, quality, queries, sharding, urls, wordpieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def spark_of(df):
    return df.sparkSession


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1


def encoded(text, block):
    return np.frombuffer(b"".join(bpe.encode(text, bpe.vocabulary(PATH), block)), "<u4").tolist()


def test_bpe_matches_the_library(odd_rows, documents):
    library = Tokenizer.from_file(PATH)
    r = random.Random(1)
    alphabet = [*"abcdethinAZ019'''.,!_ ", "é", "e\u0301", "Σ", "İ", "中", "\u0301", "\x1c", "\x85", "\u2003", "½", "👍", "<|endoftext|>", "<|endof", "'ll"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([1, 8, 60, 700]))) for _ in range(300)]
    texts += ["".join(r.choice([c for c in alphabet if not c.isspace()]) for _ in range(9000)), "a" * 20_000, "中é" * 4000, "!?" * 5000, "ab'll" * 3000]
    texts += [t for _, t in odd_rows if t] + [t for _, t in pairs(documents)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        for block in (1 << 16, 777):
            assert encoded(text, block) == ids
        decoder = bpe.Decoder(bpe.vocabulary(PATH))
        assert "".join(decoder.feed(bpe.packed(ids[i : i + 5])) for i in range(0, len(ids), 5)) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_bpe_matches_the_library_on_every_code_point():
    """Every scalar value between letters, alone, before a number and after a mark; runs without white space, in parts."""
    library = Tokenizer.from_file(PATH)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c} {c}1 e\u0301{c}" for c in every[i : i + 400]) for i in range(0, len(every), 400)]
    assert [encoded(t, 1 << 16) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    r = random.Random(4)
    marks = [c for c in every if bpe.unicodedata.combining(c)]
    dense = ["".join(r.choice(every) + (r.choice(marks) if r.random() < 0.2 else "") for _ in range(6000)) for _ in range(12)]
    dense += ["\u4e00\u4e8c\u4e09" * 3000, "\u0558\u1c89" * 3000, "\u2167\u00bd" * 3000]
    assert [encoded(t, 777) for t in dense] == [x.ids for x in library.encode_batch(dense, add_special_tokens=False)]


def test_bpe_memory_is_bounded():
    v = bpe.vocabulary(PATH)
    word = bpe.WordTransducer(v)
    for _ in range(200):
        word.feed(v.symbols("abthein" * 40))
        assert len(word.held) <= 2 * v.lookahead + 1024 + 280


def test_bpe_query(odd, empty, odd_rows):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), brute.hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert rows(bpe.digests(odd, PATH)) == want
    assert bpe.digests(empty, PATH).count() == 0


# 2


def line_classes(docs, least=lines.LEAST):
    """(id, text) -> {normal form: [((id, text), line)]}, in order."""
    found = {}
    for i, t in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            w = lines.normal_words(line)
            if len(w) >= least:
                found.setdefault(b" ".join(w), []).append(((i, t), k))
    return found


def fingerprinted(forms):
    joined = b" ".join(forms)
    hashes, at = common.word_hashes(joined)
    return lines.fingerprints(hashes, np.diff(np.append(at, len(joined) + 1)) - 1, np.cumsum([0, *(len(f.split()) for f in forms[:-1])]))


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_line_dedup(source, request):
    """Groups by the rule as stated: a shared block and close SimHashes make loose groups, edit similarity the rest."""
    docs = request.getfixturevalue(source)
    if source == "documents":
        docs = docs.filter("doc_id < 70")
    docs = docs.withColumn("text", queries.F.expr("left(text, 3000)"))
    found = line_classes(pairs(docs))
    forms = list(found)
    texts = [f.decode() for f in forms]
    sims, blocks = fingerprinted(forms)
    loose = brute.components(len(forms), lambda i, j: bool((blocks[i] == blocks[j]).any()) and int(sims[i] ^ sims[j]).bit_count() <= lines.DISTANCE)
    group = brute.components(len(forms), lambda i, j: loose[i] == loose[j] and int(sims[i] ^ sims[j]).bit_count() <= lines.DISTANCE and brute.levenshtein(texts[i], texts[j]) * 100 <= (100 - lines.PERCENT) * max(len(texts[i]), len(texts[j])))
    got = {(r.doc_id, r.text): [int(x) for x in r.dropped.split(",") if x] for r in lines.report(docs, least=lines.LEAST).join(docs.select("doc_id", "text").distinct(), "doc_id").collect() if r.doc_id is not None}
    by_group = {}
    for f, g in zip(forms, group):
        by_group.setdefault(g, []).extend(found[f])
    assert lines.report(docs).count() == docs.count()
    unique = Counter(i for i, _ in set(pairs(docs)))
    for places in by_group.values():
        dropped = [(row, k) for row, k in places if row[0] is not None and unique[row[0]] == 1 and k in got[row]]
        known = [(row, k) for row, k in places if row[0] is not None and unique[row[0]] == 1]
        if len(known) == len(places):
            assert len(dropped) == len(places) - 1
            first = min(places, key=lambda p: (p[0][0], p[1]))
            assert first not in dropped


def test_recall_of_similar_lines(spark, sf):
    """Against edit similarity alone, no SimHash: whole texts of a few hundred documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 160")
    found = line_classes(pairs(docs))
    texts = [f.decode() for f in found]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    letters = lines.letter_counts([texts[i] for i in order]).astype(np.int64)
    label = list(range(len(texts)))

    def root(i):
        return i if label[i] == i else root(label[i])

    for k, i in enumerate(order):
        to = int(np.searchsorted(sizes, sizes[k] / 0.85 + 1, "right"))
        more = letters[k + 1 : to] - letters[k]
        apart = np.maximum(np.where(more > 0, more, 0).sum(axis=1), -np.where(more < 0, more, 0).sum(axis=1))
        for m in np.flatnonzero(100 * apart <= 15 * sizes[k + 1 : to]).tolist():
            j = order[k + 1 + m]
            if root(i) != root(j) and lines.similar(texts[i], texts[j], 85):
                label[max(root(i), root(j))] = min(root(i), root(j))
    places = {}
    for i, rows_ in enumerate(found.values()):
        places.setdefault(root(i), []).extend((row[0], k) for row, k in rows_)
    want = {p for group in places.values() for p in sorted(group)[1:]}
    got = {(r.doc_id, int(k)) for r in lines.report(docs).collect() for k in r.dropped.split(",") if k}
    exact = {p for group in found.values() for p in sorted((row[0], k) for row, k in group)[1:]}
    assert len(want - exact) > 10
    assert len(got & want) >= 0.9 * len(want) and len((got & want) - exact) >= 0.9 * len(want - exact)
    assert len(got - want) <= 0.02 * len(want)  # another first of the same group


def test_line_dedup_texts(odd, empty, odd_rows):
    out = lines.clean(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = dict((r.doc_id, r.text) for r in out.collect() if r.doc_id in (3, 12, 13))
    assert texts[3] == "a" and texts[12] == odd_rows[12][1] and texts[13] == ""  # its lines are in 12 and 5
    assert lines.report(empty).count() == 0 and lines.clean(empty).count() == 0


def test_fuzzy_lines(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for i in range(500)]
    line = [r.choice(words) for _ in range(150)]
    other = line.copy()
    other[70] = "different"
    texts = [" ".join(line), " ".join(other), " ".join(r.choice(words) for _ in range(150))]
    got = {x.doc_id: x.n_dropped for x in lines.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_fingerprints_against_a_plain_version():
    """Blocks and SimHashes word by word; long lines, repeated words, widened blocks."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 40))).encode() for _ in range(3000)]
    forms = [b" ".join(r.choice(words[:m]) for _ in range(n)) for n, m in [(1, 9), (2, 9), (5, 9), (40, 9), (40, 3000), (3000, 3000), (9000, 3000)] * 3]
    sims, blocks = fingerprinted(forms)
    low = lines.WORD_BITS + lines.LENGTH_BITS
    for f, sim, own in zip(forms, sims, blocks):
        parts = [{} for _ in range(lines.PARTS)]
        for w in f.split():
            h = int(common.WordHashes().of([w])[0]) >> (64 - lines.WORD_BITS)
            feature = int(common.mixed(np.array([h << lines.LENGTH_BITS | min(len(w), 31)], np.uint64))[0])
            parts[h >> (lines.WORD_BITS - 3)][feature] = min(len(w), 31)

        def majority(features):
            bits = [sum(x.to_bytes(8, "little")[b // 8] >> (7 - b % 8) & 1 for x in features) > len(features) // 2 for b in range(64)]
            return int.from_bytes(np.packbits(bits).tobytes(), "little")

        assert int(sim) == majority([x for p in parts for x in p]) and low == 47
        for k in range(lines.PARTS):
            seen, weight = [], 0
            for p in (*parts[k:], *parts[:k]):
                seen += p
                weight += sum(p.values())
                if weight >= lines.WEIGHT:
                    break
            assert int(own[k]) == majority(seen) & 0xFFFFFFFF


def test_close_pairs_of_buckets():
    """Small and large buckets, and families: the same trees as by plain comparison."""
    r = random.Random(9)
    base = r.getrandbits(64)
    family = sorted({base ^ sum(1 << b for b in r.sample(range(64), 6)) for _ in range(1500)})
    sims = [r.getrandbits(64) for _ in range(300)] + family + [s ^ 5 for s in family[:200]] + [r.getrandbits(64) for _ in range(40)]
    keys = [7] * 300 + [9] * len(family) + [9] * 200 + [k // 2 for k in range(100, 140)]
    order = np.argsort(keys, kind="stable")
    keys, sims = np.array(keys)[order], np.array(sims, np.uint64)[order]
    i, j = lines.close_pairs(keys, sims)
    root = list(range(len(keys)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in zip(i.tolist(), j.tolist()):
        assert keys[a] == keys[b] and int(sims[a] ^ sims[b]).bit_count() <= lines.DISTANCE
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = common.spanning(len(keys), lambda x, rest: (keys[rest] == keys[x]) & (np.bitwise_count(sims[rest] ^ sims[x]) <= lines.DISTANCE))
    assert [find(x) for x in range(len(keys))] == want.tolist()
    assert len(i) <= 8 * len(keys)


def test_most_lines_of_high_edit_similarity_are_linked(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    texts = []
    for n in (20, 30):
        for _ in range(60):
            line = [r.choice(words) for _ in range(n)]
            other = line.copy()
            other[r.randrange(n)] = r.choice(words)
            texts += [" ".join(line), " ".join(other)]
    alike = {j for j in range(len(texts)) for i in range(j) if lines.similar(texts[i], texts[j], 85)}
    found = {x.doc_id for x in lines.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if x.n_dropped}
    assert len(alike) >= 110 and found <= alike
    assert len(found) >= 0.95 * len(alike)


def test_short_lines_are_deduplicated(spark):
    texts = ["Home\n\u4e2d\u6587\u7684\u4e00\u884c\n\nRead more\n...", "home!\n\u4e2d\u6587\u7684\u4e00\u884c\n\nRead less\n...", "read  more\nabout us"]
    got = {x.doc_id: x.dropped for x in lines.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "0,1", 2: "0"}  # lines without a word stay


def test_edit_distance():
    r = random.Random(2)
    for _ in range(800):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(25))) for _ in "ab")
        assert lines.edit_distance(a, b, 99) == brute.levenshtein(a, b)
        assert lines.similar(a, b, 85) == (100 * brute.levenshtein(a, b) <= 15 * max(len(a), len(b)))


# 3


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(documents, odd, empty, width, percent):
    for docs in (documents, odd):
        data = pairs(docs)
        want = Counter((i, n, c if n else i, i == (c if n else i)) for i, n, c in brute.near(data, width, percent))
        assert rows(near.components(docs, width, percent)) == want
    assert near.components(empty).count() == 0
    out = near.clean(odd, width=width, percent=percent)
    assert out.columns == odd.columns


def test_near_dedup_of_large_groups(spark):
    """A hub, many variants, regions and chunks far smaller than the group: the same components."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    hub = [r.choice(words) for _ in range(90)]
    texts = [" ".join(hub)]
    for _ in range(150):
        w = hub.copy()
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(words) for _ in range(80)) + " " + " ".join(hub[:25]) for _ in range(80)]
    data = list(enumerate(texts))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = Counter((i, n, c, i == c) for i, n, c in brute.near(data, 3, 85))
    assert rows(near.components(docs, 3, 85)) == want
    classes = near.signed(docs, 3, "text", "doc_id")
    for region in (8, 64):
        edges = common.connected_components(near.loose_edges(classes, 0.85, region), spark)
        assert edges.groupBy("component").count().agg({"count": "max"}).first()[0] >= 100
    members = spark.createDataFrame([(bytes([i]), 7, 10, i) for i in range(100)], "node binary, block long, units long, at long")
    tasks = near.chunked(members, units=200, records=30)
    together = {frozenset((a, b)) for group in tasks.groupBy("task").agg(queries.F.collect_set("at").alias("m")).collect() for a in group.m for b in group.m}
    assert len(together) == 100 + 100 * 99 // 2


def test_connected_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    adjacent = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges for n in e})
    want = brute.components(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in adjacent)
    assert {n: got.get(n, n) for n in nodes} == {n: nodes[g] for n, g in zip(nodes, want)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


def test_clean_drops_rows_and_not_ids(spark):
    """Rows that share an id are judged by their own texts; other key names and types."""
    t, other = "one two three four five six seven eight nine", "another text altogether with ten words in it or so"
    data = [("b", t, 0), ("e", t, 1), ("e", other, 2), (None, t, 3), ("a", None, 4), ("f", other, 5), ("a", "", 6), ("b", t, 7)]
    docs = spark.createDataFrame(data, "id string, body string, row long")
    assert sorted(r["row"] for r in near.clean(docs, text="body", key="id").collect()) == [0, 2, 4, 6, 7]
    items = spark.createDataFrame([("a1", other), ("a2", None)], "name string, text string")
    left = decontaminate.clean(docs, items, text="body", key="id", item_key="name")
    assert left.columns == docs.columns and sorted(r["row"] for r in left.collect()) == [0, 1, 3, 4, 6, 7]
    assert {(r.id, r.name) for r in decontaminate.matches(docs, items, text="body", key="id", item_key="name").collect()} == {("e", "a1"), ("f", "a1")}
    clashing = spark.createDataFrame([(1, "a line of text\nb", 1, 2), (2, "a line of text", 3, 4)], "doc_id long, text string, dropped long, row long")
    assert sorted(tuple(r) for r in lines.clean(clashing).collect()) == [(1, "a line of text\nb", 1, 2), (2, "", 3, 4)]


def test_executors_without_the_repository(tmp_path, small):
    """Functions travel by value: workers that can't import the package run every operator that needs Python."""
    import os
    import re
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(bomlake.__file__))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import bomlake.llm.queries as q
for name in ("op1_bpe", "op2_line_dedup", "op3_near_dedup", "op4_token_counts", "op10_decontamination", "op11_first_seen", "op13_alignment"):
    print(name, q.QUERIES[name](spark, {small!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.isdir(f"{p}/bomlake"))}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0 and len(re.findall(r"^op\d+_", ran.stdout, re.M)) == 7, ran.stderr[-3000:]


# 4


def test_word_pieces(odd, empty, odd_rows, documents):
    model = public_tokenizers.path("piece_bpe_32k.model")
    starts, continues = map(set, wordpieces.vocabulary(model))

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            to = next((j for j in range(min(len(word), at + 40), at, -1) if word[at:j] in (continues if n else starts)), 0)
            if not to:
                return 0
            at, n = to, n + 1
        return n

    for docs, data in ((odd, odd_rows), (documents, pairs(documents))):
        want = Counter()
        for i, t in data:
            each = [greedy(w) for w in (t or "").split()]
            want[i, len(each), sum(max(1, n) for n in each), each.count(0)] += 1
        assert rows(wordpieces.counts(docs, model)) == want
    assert wordpieces.counts(empty, model).count() == 0
    small = wordpieces.Automaton(["ab", "a", "abcd"], ["b", "c", "cd", "e"])
    assert [small.count(w) for w in ("abcd", "abcde", "abce", "abcb", "xa", "abx")] == [1, 2, 3, 3, 0, 0]


def test_words_are_spelled_from_the_whole_model(spark, odd_rows, documents, small):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    octets = {int(sp.id_to_piece(i)[3:-1], 16) for i in ids if sp.is_byte(i)}
    pieces = {sp.id_to_piece(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}

    def greedy(word):
        word, at, n = "\u2581" + word, 0, 0
        while at < len(word):
            to = next((j for j in range(min(len(word), at + 40), at, -1) if word[at:j] in pieces), 0)
            spelt = b"" if to else word[at].encode("utf-8", "surrogatepass")
            if not octets.issuperset(spelt):
                return 0
            at, n = to or at + 1, n + (1 if to else len(spelt))
        return n

    automaton = wordpieces.Automaton(*wordpieces.spelling(path))
    words = {w for _, t in [*odd_rows, *pairs(documents)] for w in (t or "").split()} | {"2024", "4111111111111111", "\u00f1and\u00fa", "\u00e7a", "\u4e2d\u6587\u7684\u4e00\u884c", "\U0001d4b3x", "a\u2581b", "\u2581"}
    assert {w: automaton.count(w) for w in words} == {w: greedy(w) for w in words}
    assert automaton.count("2024") == 5
    r = queries.op4_token_counts(spark, small).agg(queries.F.sum("n_unknown")).first()
    assert r[0] == 0


# 5


def test_pii(spark, odd, empty, odd_rows, documents):
    r = random.Random(6)
    fuzz = [(1000 + k, "".join(r.choice(["1", "23", "456", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "é", "\n", "4111111111111111", "255", "%"]) for _ in range(60))) for k in range(400)]
    for docs, data in ((odd, odd_rows), (documents, pairs(documents)), (spark.createDataFrame(fuzz, "doc_id long, text string"), fuzz)):
        got = {(x.doc_id, x.text): x for x in pii.found(docs.select("doc_id", "text")).select("doc_id", "text", pii.listed(queries.F.col("pii.base")).alias("base"), pii.listed(queries.F.col("pii.all")).alias("all")).collect()}
        for i, t in data:
            want = brute.pii(t)
            assert got[i, t].base == ",".join(want)
            assert set(want) <= set(filter(None, got[i, t].all.split(",")))
    assert pii.found(empty).count() == 0


def test_pii_adds_and_redacts(spark):
    texts = ["you can call ###-###-#### now".replace("#", "5"), "order 555-555-5555 shipped", "write to jane.doe [at] mail.com please", "nothing here 12 34", "mail a@b.org and +1 (499) 555-6503"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.found(docs).select("doc_id", pii.listed(queries.F.col("pii.all")).alias("s")).collect()}
    assert got[0].startswith("phone:") and got[1] == "" and got[2].startswith("email:") and got[3] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[4] == "mail [email] and [phone]" and clean[3] == texts[3]


def test_pii_of_planted_forms(spark, sf):
    """Precision and recall of added spans on sentences other than the templates; secrets of the driver's documents."""
    r = random.Random(13)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    digits, hexa, lower = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    good = [lambda: f"please call us at ({of(digits, 3)}) {of(digits, 3)}-{of(digits, 4)} soon", lambda: f"you may contact {of(lower, 6)} [at] {of(lower, 7)}.com about it", lambda: f'export token = "{of(hexa, 40)}" here', lambda: f"set api_key: {of(hexa, 32)} there"]
    bad = [lambda: f"the order {of(digits, 3)}-{of(digits, 3)}-{of(digits, 4)} has left", lambda: f"see commit {of(hexa, 40)} for more", lambda: f"its checksum: {of(hexa, 32)} is right", lambda: f"a word {of(lower, 30)} and {of(lower, 12)}-{of(lower, 12)}", lambda: f"invoice {of(digits, 4)}.{of(digits, 4)}.{of(digits, 4)}.{of(digits, 4)} paid"]
    data = [(k, r.choice(good)() if k % 2 else r.choice(bad)()) for k in range(400)]
    got = {x.doc_id: x.n for x in pii.found(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", (queries.F.size("pii.all") - queries.F.size("pii.base")).alias("n")).collect()}
    hits, wrong = sum(got[k] > 0 for k in got if k % 2), sum(got[k] > 0 for k in got if not k % 2)
    assert hits >= 0.9 * 200 and hits >= 0.95 * (hits + wrong), (hits, wrong)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {x.doc_id: x for x in queries.op5_pii(spark, sf).collect()}
    held = {x.doc_id for x in docs.filter("text rlike '(?i)token = .[0-9a-f]{40}'").collect()}
    assert len(held) > 5 and all(found[i].n_secret > 0 for i in held)
    assert sum(found[i].n_spans > 0 for i in found if not found[i].base_sha256 or i not in held) <= 0.2 * len(found)
    overlapping = spark.createDataFrame([(1, "call 555-123-4567 555-123-4567 or card 4111.1111.1111.1111.1111")], "doc_id long, text string")
    for x in pii.found(overlapping).collect():
        ends = sorted((c.start, c.end) for c in x.pii["all"])
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


# 6


def test_classifier(spark, sf, odd, empty):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = classifier.train(docs, labels)
    scored = classifier.scores(docs, model)
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    assert all(r.held_out == (brute.crc(str(r.doc_id)) % 5 == 0) for r in scored.collect())
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert classifier.scores(odd, model).filter("score is null or score < 0 or score > 1").count() == 0
    assert classifier.scores(odd, model).count() == odd.count()
    assert classifier.scores(empty, model).count() == 0
    none = classifier.train(docs, labels.limit(0))
    assert {r.score for r in classifier.scores(odd, none).collect()} == {0.5}
    again = classifier.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights)


# 7


def test_urls(spark, sf, empty):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://A.Example.COM/en/7x?y#z"), (5, "x://com/en/"), (6, "x://notcom/en/"), (7, "x://a.net?/de/"), (8, "x://É.Example.NET/de/8"), (8, "x://É.Example.NET/de/8"), (None, "x://b.org/es/#")]
    pages = pages.select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = urls.verdicts(pages, queries.RULES).collect()
    assert len(got) == pages.count()
    ascii_lower = lambda s: brute.re.sub("[A-Z]+", lambda m: m.group().lower(), s)
    want = Counter()
    for r in pages.collect():
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            host = brute.re.match(r"[^/?#]*", rest).group()
            path = brute.re.match(r"[^?#]*", rest[len(host) :]).group()
            host = ascii_lower(host)
        fits = [x for x in queries.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        want[r.page_id, host, path, best and best.text, best and best.verdict] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == want
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0


def test_stated_rules_are_those_of_the_contract(spark):
    """Each rule with its word as the contract lists it, and the verdict on a URL that only it decides."""
    stated = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.text}" for r in queries.RULES] == stated.split(", ")
    hits = ["http://a.com/en/1", "http://b.example.com/en/71", "http://casino.net/de/7", "http://example.net/de/81", "http://c.org/es/"]
    got = urls.verdicts(spark.createDataFrame(list(enumerate(hits)), "page_id long, url string"), queries.RULES).collect()
    assert [f"{r.verdict} {r.rule}" for r in sorted(got)] == stated.split(", ")


def test_url_rules_are_mined(spark):
    data = [(["host:spam", "path:win", f"host:h{i}"], "block") for i in range(30)] + [(["path:win", f"host:g{i}"], None) for i in range(30)] + [(["path:news"], None)] * 60
    data += [(["path:few", f"host:f{i}"], "block") for i in range(4)]  # too few to be sure
    rules = urls.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), support=0.02)
    assert [(r["items"], r["verdict"]) for r in rules] == [(["host:spam"], "block")]
    df = spark.createDataFrame([(["host:spam", "x"],), (["path:win"],), ([],)], "tokens array<string>")
    assert [r[0] for r in df.select(urls.judged(df["tokens"], rules)).collect()] == ["block", "allow", "allow"]
    assert urls.mine(spark.createDataFrame([], "tokens array<string>, verdict string")) == []
    many = [[f"path:{i:02}" for i in range(40)]] * 300  # 2**40 combinations, were it not for one that stands for all
    hot = [(t, "block") for t in many] + [([f"path:x{i}"], None) for i in range(600)]
    assert [r["items"] for r in urls.mine(spark.createDataFrame(hot, "tokens array<string>, verdict string"))] == [["path:00"]]


def test_planted_hosts_are_blocked(spark):
    """Hosts with a seed word, and with words that go along with one; others stay."""
    data = [(i, f"https://{h}{i % 7}.example.com/fr/{i}") for i, h in enumerate(["m.casino-win.a", "www.cheap-pills.b", "casino-win.c"] * 30)]
    data += [(1000 + i, f"https://www.host{i % 40}.example.com/fr/{i}") for i in range(900)] + [(5000, "http://cheap-deals.example.com/fr/9"), (5001, "http://win.example.org/x"), (5002, "http://news.example.org/es/1")]
    got = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame(data, "page_id long, url string"), queries.RULES).collect()}
    assert all(got[i] == "block" for i in range(90)) and got[5000] == got[5001] == "block"
    assert all(got[1000 + i] == "allow" for i in range(900)) and got[5002] == "block"  # by a stated rule


# 8


def test_quality(odd, empty, odd_rows, documents):
    for docs, data in ((odd, odd_rows), (documents, pairs(documents))):
        got = quality.verdicts(docs.select("doc_id", "text")).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept")])
        want = Counter()
        for i, t in data:
            base, failing, lines_ = brute.quality(t), brute.failing_lines(t), (t or "").split("\n")
            lost = sum(len(brute.WORD.findall(lines_[k])) for k in failing)
            want[i, *base, lost, not base[-1] and 100 * lost <= quality.MAX_LOST * base[0]] += 1
        assert rows(got) == want
    assert quality.verdicts(empty).count() == 0
    out = quality.clean(odd)
    assert out.columns == odd.columns and {r.quality for r in out.collect()} == {"own"}
    r = random.Random(12)  # windows that repeat, overlap and adjoin
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(300)]
    got = quality.verdicts(spark_of(odd).createDataFrame([(t,) for t in texts], "text string")).select("text", "quality.n_repeat_words").collect()
    assert [x.n_repeat_words for x in got] == [brute.quality(x.text)[4] for x in got]


def test_line_rules(spark):
    good = "A plain line of words, with a comma and some more of them, goes on and on. " * 2
    cases = [(good, False), ("WIN!! A!! PRIZE!! NOW!!", True), ("home | news | sport | contact | help", True), ("buy### now*** cheap$$$ pills&&&", True), ("Read more", True), ("", False), ("   ", False), ("HTML and CSS are fine here too", False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    assert [r[0] for r in df.select(quality.line_fails(df["text"])).collect()] == [f for _, f in cases]
    assert [bool(brute.failing_lines(t)) for t, _ in cases] == [f for _, f in cases]
    menus = ["Home\nAbout us\nContact", "Home\nAbout us", "Home\n\nAbout us\nNews", "Yes.\nNo!\nWell, then;", "a\nb\nc\nd e f g\nh\ni\nj\nk"]
    df = spark.createDataFrame([(t,) for t in menus], "text string")
    want = [[x for k, x in enumerate(t.split("\n")) if k not in brute.failing_lines(t)] for t in menus]
    assert [r[0] for r in df.select(quality.good_lines(quality.lines_of(df["text"]), quality.BOILERPLATE)).collect()] == want
    text = "\n".join([" ".join(f"word{i}," for i in range(40)), "Read more", "home | news | sport | contact | help"])
    (row,) = quality.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == text.split("\n")[0]


def test_clean_documents_are_kept(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(labels.select("doc_id", labels["quality"].alias("label")), "doc_id").filter("not quality.base_failed")
    kept = {r["label"]: r["k"] for r in judged.groupBy("label").agg(queries.F.avg(queries.F.col("quality.kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.5


# 9


def test_sharding(spark, odd, empty, odd_rows, sf):
    tree = sharding.topology(24)
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sharding.place(docs, tree, sharding.grown(tree, 24)).collect()
        data = pairs(docs)
        assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == Counter((i, len((t or "").encode()) + 8, brute.crc(t), "key") for i, t in data)
        for s in range(24):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
        assert all(r.grown_shard in (r.shard, 24) for r in got)
        assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({i for i, _ in data})
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) < 2.2 * len(got) / 24
    assert 10 < sum(r.grown_shard == 24 for r in got) < 90
    assert sharding.place(empty, tree, tree).count() == 0


def test_changed_weights_move_only_their_subtrees(spark):
    def tree(weight):
        rack = lambda r, n, w: sharding.Node(f"{r}/{n}", tuple(sharding.Node(f"s{i}", shard=i, own_weight=w if i == 0 else 1.0) for i in range(*{"a": (0, 3), "b": (3, 6), "c": (6, 9), "d": (9, 12)}[n])))
        return sharding.Node("root", (sharding.Node("x", (rack("x", "a", weight), rack("x", "b", 1.0))), sharding.Node("y", (rack("y", "c", 1.0), rack("y", "d", 1.0)))))

    ids = spark.range(6000).select(queries.F.col("id").cast("string").alias("k"))
    moved = ids.select(sharding.shard_of(ids["k"], tree(1.0)).alias("a"), sharding.shard_of(ids["k"], tree(3.0)).alias("b")).collect()
    assert not any(r.a != r.b and r.b >= 6 for r in moved)  # none into the other region
    assert not any(r.a in range(3, 6) and r.b in range(3, 6) and r.a != r.b for r in moved)  # none within the other rack
    assert 0.15 < np.mean([r.b == 0 for r in moved]) < 0.28  # three of fourteen


# 10


def test_decontamination(spark, odd, empty, odd_rows):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    item = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, item(30)), (2, item(6)), (3, "Only Three, words"), (4, None), (5, ""), (6, item(200)), (6, item(12)), (None, item(20))]
    filler = item(25_000)
    part = items[0][1].split()
    texts = [filler + " " + items[0][1].upper() + "!", " ".join(part[:27]), " ".join(part[:20]), items[1][1], "now ONLY three words", "only three", items[5][1].replace("w1 ", "w1, "), None, "", items[7][1]]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[3]), *((100 + i, t) for i, t in enumerate(t for _, t in odd_rows))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets = [(i, [decontaminate.words(t)]) for i, t in items]
    want = Counter()
    for d in docs.collect():
        w = decontaminate.words(d.text)
        for i, (iw,) in sets:
            k = min(5, len(iw))
            mine = brute.shingles("", k, [x.decode() for x in iw]) if iw else frozenset()
            shared = len(mine & (brute.shingles("", k, [x.decode() for x in w]) if len(w) >= k else frozenset())) if mine else 0
            if mine and 5 * shared >= 4 * len(mine):
                want[d.doc_id, i, len(mine), shared] += 1
    assert rows(decontaminate.matches(docs, bench)) == want and len(want) >= 7
    decontaminate.SLICE_CHARS, before = 300, decontaminate.SLICE_CHARS
    try:
        assert rows(decontaminate.matches(docs, bench)) == want
    finally:
        decontaminate.SLICE_CHARS = before
    left = decontaminate.clean(odd, bench)
    assert left.columns == odd.columns
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(odd, bench.limit(0)).count() == 0


def test_similarity_is_decided_as_by_edit_distance():
    draw = random.Random(11)
    for _ in range(1500):
        a = " ".join("".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(draw.randint(1, 9)))
        b = list(a)
        for _ in range(draw.randint(0, max(1, len(a) // 4))):
            k = draw.randrange(len(b) + 1)
            b[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "b", " "])
        b = " ".join("".join(b).split())
        assert lines.similar(a, b, 85) == (brute.levenshtein(a, b) <= 15 * max(len(a), len(b)) // 100)


def test_forest_ties_what_its_edges_tie():
    draw = random.Random(12)
    for _ in range(200):
        pairs = [(draw.randrange(40) - 20, draw.randrange(40) - 20) for _ in range(draw.randint(1, 60))]
        root = {x: x for p in pairs for x in p}
        for _ in pairs:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        tied = dict(zip(*(x.tolist() for x in lines.forest(*(np.array(x) for x in zip(*pairs))))))
        assert tied == {x: r for x, r in root.items() if x != r}


def test_distances_at_once():
    """Distances of many pairs at once are those of pairs one by one, as far as the band goes."""
    r = random.Random(8)
    for m in (1, 20, 63, 64, 65, 128, 200):
        a = "".join(r.choice("abcé d") for _ in range(m))
        texts = [a]
        for _ in range(12):
            b = list(a)
            for _ in range(r.randint(0, m // 5 + 2)):
                p = r.randrange(len(b) + 1)
                b[p : p + r.randrange(2)] = r.choice(["", "x", "é", "bc"])
            texts.append("".join(b) or "z")
        most = 15 * m // 100 + 2
        texts = [t for t in texts if abs(len(t) - m) <= most]
        letter, codes = np.unique(np.array(list("".join(texts))), return_inverse=True)
        points = np.split(codes, np.cumsum([len(t) for t in texts])[:-1])
        i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
        fit = np.array([abs(len(texts[x]) - len(texts[y])) <= most for x, y in zip(i, j)])
        i, j = i[fit], j[fit]
        for x, y, got in zip(i, j, lines.distances(points, len(letter), i, j, most).tolist()):
            want = brute.levenshtein(texts[x], texts[y])
            assert got == want if want <= most else got > most


def test_family_with_a_passage(monkeypatch):
    """Lines that have a passage in common and little else: the pairs that are no links aren't compared one by one."""
    r, called, plain = random.Random(5), [], lines.similar
    words = ["".join(r.choice("aeiouthnsrdl") for _ in range(r.randint(2, 9))) for _ in range(500)]
    passage = " ".join(r.choice(words) for _ in range(30))
    texts = [" ".join([*(r.choice(words) for _ in range(r.randint(4, 7))), passage, *(r.choice(words) for _ in range(r.randint(0, 3)))]) for _ in range(150)]
    sims = fingerprinted([t.encode() for t in texts])[0]
    monkeypatch.setattr(lines, "similar", lambda *a: called.append(a) or plain(*a))
    got = lines.linked(texts, sims, 85)
    assert len(called) < 10 * len(texts)
    near = lambda i, j: int(sims[i] ^ sims[j]).bit_count() <= lines.DISTANCE and plain(texts[i], texts[j], 85)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and near(i, j):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert got.tolist() == label and 10 < len(set(label)) < len(texts)


def test_steps_leave_no_shuffle_files(spark):
    """What a step has shuffled goes when its table is written, so disk is that of the largest step and not of all."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    made = common.materialise(spark.range(100_000).groupBy((spark_functions.col("id") % 1000).alias("k")).count(), spark)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and made.count() == 1000
    assert spark.conf.get(common.SWEPT) == "false"


def test_lines_in_turns(spark, documents, monkeypatch):
    """A table over TURN_BYTES is shuffled in turns, with the same lines dropped."""
    whole = rows(lines.report(documents))
    monkeypatch.setattr(lines, "TURN_BYTES", 0)
    assert rows(lines.report(documents)) == whole
