"""Queries over the operators of this subpackage, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, classifier, decontaminate, firstseen, lines, mixing, near, pii, quality, sharding, urls, wordpieces

#: Stated URL rules of the query, and the number of shards.
RULES = [urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "allow"), urls.Rule("example.net", "/de/8", "block"), urls.Rule("org", "/es/", "block")]
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), spelled=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("pii.base", lambda c: c["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *map(n, pii.KINDS), F.sha2(F.encode(pii.listed(F.col("pii.base")), "UTF-8"), 256).alias("base_sha256"), pii.listed(F.col("pii.all")).alias("spans"), F.size(F.filter("pii.all", lambda c: c["kind"] == pii.ALL_KINDS.index("secret"))).cast("long").alias("n_secret"), F.size("pii.all").cast("long").alias("n_spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.scores(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.topology(SHARDS)
    return sharding.place(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, SHARDS))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    batch = F.floor(10 * (F.crc32(docs["doc_id"].cast("string")) % 64) / 64)
    kept, gone = firstseen.stripped(docs, batch, 10)
    kept = kept.select(F.lit("doc").alias("row_kind"), F.col("own.doc_id").cast("string").alias("row_id"), F.col("number").alias("batch"), "n_all", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
    return kept.unionByName(gone.select(F.lit("line").alias("row_kind"), F.lower(F.hex("key")).alias("row_id"), F.col("first").alias("batch"), F.col("docs").alias("n_all"), F.col("lines").alias("n_removed"), F.lit(None).cast("string").alias("kept_sha256")))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged, mix = mixing.drawn(docs, mixing.rates(docs, (3, 1, 2), share=1.5, most=2.0))
    return judged.select("doc_id", f"{mix}.size", f"{mix}.source_size", f"{mix}.target", (F.col(f"{mix}.size") * F.col(f"{mix}.copies")).alias("taken"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_near_dedup, op4_token_counts, op5_pii, op6_quality_classifier, op7_url_filter, op8_quality_rules, op9_sharding, op10_decontamination, op11_first_seen, op12_mixing, op13_alignment)}

WHITE = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op3_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WHITE}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT a AS d, a AS t FROM e UNION SELECT d, b FROM r JOIN e ON a = t)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(t) AS m FROM r GROUP BY 1) ON d = w.doc_id""",
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F:-@\[-`{-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F:-@\[-`{-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i+least(5, len(w))-1], ' '))) AS s FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
        n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
        c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM i JOIN g USING (k, s) GROUP BY 1, 2)
        SELECT doc_id, item_id, n AS n_item, n_shared FROM c JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n""",
    "op12_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WHITE}')) AS size, concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, '')) AS toss FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, 2.0::DOUBLE * sum(size) AS most FROM d GROUP BY 1),
        w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight FROM s),
        l AS (SELECT most / weight AS r, (1.5::DOUBLE * (SELECT sum(words) FROM w) - coalesce((SELECT sum(most) FROM w y WHERE y.most / y.weight < x.most / x.weight), 0)) / (SELECT sum(weight) FROM w y WHERE y.most / y.weight >= x.most / x.weight) AS level FROM w x),
        t AS (SELECT source, words, CASE WHEN words = 0 THEN 0 ELSE least(most, (SELECT arg_min(level, r) FROM l WHERE level <= r) * weight) END AS target FROM w),
        c AS (SELECT doc_id, size, words, target, CASE WHEN words > 0 THEN target / words ELSE 0 END AS rate, CAST(concat('0x', left(md5(toss), 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
}
