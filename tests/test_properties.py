from bomlake.operators import properties, resolving
from bomlake.streaming import metrics
from pyspark.sql import functions as F


def test_property_maps(spark):
    """Null and empty maps, keys that come twice, comments of other forms."""
    df = spark.createDataFrame([(1, ["k=1", "nothing", "=x", " k =2=3", None, "l="], {"cpe:a": "1", "b": "2"}), (2, None, None), (3, [], {})], "id long, notes array<string>, props map<string,string>")
    got = df.select("id", properties.from_annotations(F.col("notes")).alias("m"), properties.cleared(F.col("props"), "cpe:").alias("c"), properties.filled(F.col("props"), F.create_map(F.lit("b"), F.lit("x"), F.lit("d"), F.lit("4"))).alias("f"), properties.to_annotations(F.col("props")).alias("a")).orderBy("id").collect()
    assert [r.m for r in got] == [{"k": "2=3", "l": ""}, {}, {}]
    assert [r.c for r in got] == [{"b": "2"}, {}, {}]
    assert [r.f for r in got] == [{"cpe:a": "1", "b": "2", "d": "4"}, {"b": "x", "d": "4"}, {"b": "x", "d": "4"}]
    assert [r.a for r in got] == [["b=2", "cpe:a=1"], [], []]


def test_labels_and_times(spark):
    df = spark.createDataFrame([({properties.BASE_NAMES[0]: "", properties.BASE_NAMES[1]: "a", properties.BASE_DIGEST: "sha256:1"}, "2024-02-30T00:00:00Z"), (None, None), ({properties.BASE_DIGEST: "d"}, "2024-01-02T03:04:05.5+01:00")], "labels map<string,string>, t string")
    got = df.select(properties.base_reference(F.col("labels")), F.unix_micros(properties.moment(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [("a@sha256:1", None), ("", None), ("", 1704161045500000)]


def test_modes_of_sources(spark):
    rows = [("a", "pattern", 50, 0, False, 0.9), ("a", "api", 80, 1, True, 0.9), ("a", "notices", 50, 2, True, 0.5), ("b", "local", 90, 0, False, 0.69), ("b", "api", 80, 1, True, None), (None, "local", 90, 0, False, 0.7), (None, "api", 80, 1, True, 0.9), ("c", "local", None, 0, None, None)]
    df = spark.createDataFrame(rows, "key string, source string, priority int, registered int, network boolean, confidence double")
    kept = lambda mode: sorted((str(r.key), r.source) for r in resolving.resolve(df, mode).collect())
    assert kept("hybrid") == kept("odd") == [("None", "local"), ("a", "api"), ("a", "pattern"), ("b", "api"), ("b", "local"), ("c", "local")]
    assert kept("offline") == [("None", "local"), ("a", "pattern"), ("b", "local"), ("c", "local")]
    assert len(kept("online")) == len(rows) and resolving.resolve(df.limit(0)).count() == 0


def test_image_references(spark):
    data = [(None, None), ("", "file"), ("oci://x", None), ("OCI://x", "layout"), ("https2://x", None), ("://x", None), ("dir", "directory"), ("img:1", None)]
    df = spark.createDataFrame(data, "r string, k string")
    got = [tuple(r.s) for r in df.select(resolving.image_source(F.col("r"), F.col("k")).alias("s")).collect()]
    assert got == [("empty", ""), ("empty", ""), ("layout", "x"), ("layout", "OCI://x"), ("detect", "https2://x"), ("detect", "://x"), ("invalid", "dir"), ("detect", "img:1")]


def test_windows_of_a_stream(spark, tmp_path):
    """A late event is left out, one within the limit counts; files that arrive are handled once."""
    source, at = str(tmp_path / "in"), lambda t: f"2024-01-01 {t}:00"
    schema = "ts timestamp, event_type string, value double"
    arrive = lambda rows: spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = metrics.windowed(spark.readStream.schema(schema).parquet(source))
        write = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        write.awaitTermination()

    for rows in ([(at("00:10"), "a", 1.0), (at("01:05"), "a", 2.0)], [(at("00:58"), "a", 4.0), (at("05:00"), "a", 8.0)], [(at("00:20"), "a", 16.0), (at("09:00"), "b", 0.0)]):
        arrive(rows)
        run()
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("hour(start) AS h", "event_type", "n", "total").collect()
    assert sorted(tuple(r) for r in got) == [(0, "a", 2, 5.0), (1, "a", 1, 2.0), (5, "a", 1, 8.0)]
    for _ in range(2):
        metrics.on_arrival(spark.readStream.schema(schema).parquet(source), lambda b: b.filter("event_type = 'a'"), str(tmp_path / "kept"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5


def test_maps_are_computed_once(spark):
    """However long a chain of maps, what it starts from is an expression that stands once."""
    made = properties.stamped(properties.filled(properties.cleared(properties.from_annotations(F.col("mark")), "x:"), F.create_map(F.lit("a"), F.lit("b"))), "by", "me", "version", "1")
    plan = spark.createDataFrame([(["a=1"],)], "mark array<string>").select(made.alias("m"))._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert plan.count("mark#") == 1
