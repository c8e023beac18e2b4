"""How images were built: the tool that built them, the instruction of each layer, the trust in an attribution.

An image is one row: image, author, labels and annotations (maps), entrypoint (array), layers (digests in
order) and history (array of struct<created_by, author, comment, empty_layer>). Nulls count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY = "array<struct<created_by:string,author:string,comment:string,empty_layer:boolean>>"
#: Signs that a tool leaves (fixed values), the most telling tools first.
ATTESTATION = ("vnd.docker.reference.type", "attestation-manifest")
LABEL_SIGNS = {"buildkit": r"^moby\.buildkit", "jib": r"^(jib\.image\.|com\.google\.cloud\.tools\.jib)", "ko": r"^(ko\.build\.|dev\.ko\.build$)"}
BUILDER_LABEL, SOURCE_LABEL = "org.opencontainers.image.builder", "org.opencontainers.image.source"
FRONTEND = "buildkit.dockerfile.v"
JIB_LAYERS = "jib-(dependencies|resources|classes)"
HISTORY_SIGNS = [("buildah", r"/usr/bin/buildah|^buildah:"), ("podman", r"^containers-storage:|^podman:|/usr/bin/podman")]
#: What a tool puts before an instruction.
PREFIXES = {"podman": r"^(containers-storage:)?\s*(buildah:)?", "buildah": r"^(containers-storage:)?\s*(buildah:)?", "buildkit": r"^(buildkit:)?\s*(buildkit\.dockerfile\.v0:)?"}
INSTRUCTIONS = "FROM|RUN|COPY|ADD|ENV|LABEL|ARG"
#: More history than this on fewer layers than that looks squashed.
SQUASHED_HISTORY, SQUASHED_LAYERS = 5, 2


def sign(runtime: str, test: Column, field: Column, value: Column) -> Column:
    return F.when(test, F.struct(F.lit(runtime).alias("runtime"), field.alias("field"), F.coalesce(value, F.lit("")).alias("value")))


def first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def label_sign(runtime: str, labels: Column) -> Column:
    """By the first label, in order of names, that fits."""
    hits = F.array_sort(F.filter(F.map_entries(labels), lambda e: e["key"].rlike(LABEL_SIGNS[runtime])))
    return sign(runtime, F.size(hits) > 0, F.concat(F.lit("label "), F.get(hits, F.lit(0))["key"]), F.get(hits, F.lit(0))["value"])


def detected(images: DataFrame) -> DataFrame:
    """Adds runtime (docker where nothing tells), field and value of the sign that decided."""
    empty = F.create_map().cast("map<string,string>")
    labels, notes = F.coalesce("labels", empty), F.coalesce("annotations", empty)
    history, layers = F.coalesce("history", F.array().cast(HISTORY)), F.coalesce("layers", F.array().cast("array<string>"))
    at = lambda i, what: F.concat(F.lit("history "), i, F.lit(what))
    front = first(F.transform(history, lambda h, i: sign("buildkit", h["created_by"].contains(FRONTEND), at(i, " created_by"), h["created_by"])))
    builder, source = F.try_element_at(labels, F.lit(BUILDER_LABEL)), F.try_element_at(labels, F.lit(SOURCE_LABEL))
    n_history, n_layers = F.size(history), F.size(layers)
    jib = F.size(F.filter(history, lambda h: F.concat_ws("\n", h["created_by"], h["comment"]).rlike(JIB_LAYERS)))
    ko_app = F.exists(F.coalesce("entrypoint", F.array().cast("array<string>")), lambda e: e.startswith("/ko-app/"))

    def from_entry(h: Column, i: Column) -> Column:
        by = F.lower(h["created_by"])
        return F.coalesce(sign("buildah", F.lower(h["author"]) == "buildah", at(i, " author"), h["author"]), *[sign(name, by.rlike(p), at(i, " created_by"), h["created_by"]) for name, p in HISTORY_SIGNS])

    note = F.try_element_at(notes, F.lit(ATTESTATION[0]))
    signs = [
        sign("buildkit", note == ATTESTATION[1], F.lit(f"annotation {ATTESTATION[0]}"), note),
        label_sign("buildkit", labels),
        front,
        sign("kaniko", F.col("author") == "Kaniko", F.lit("author"), F.col("author")),
        sign("kaniko", F.lower(builder).contains("kaniko"), F.lit(f"label {BUILDER_LABEL}"), builder),
        sign("kaniko", (n_history >= SQUASHED_HISTORY) & (n_layers <= SQUASHED_LAYERS), F.lit("squash"), F.concat_ws("/", n_history.cast("string"), n_layers.cast("string"))),
        label_sign("jib", labels),
        sign("jib", jib >= 2, F.lit("history"), jib.cast("string")),
        label_sign("ko", labels),
        sign("ko", source.isNotNull() & ko_app, F.lit(f"entrypoint, label {SOURCE_LABEL}"), source),
        first(F.transform(history, from_entry)),
    ]
    found = images.withColumn("sign__", F.coalesce(*signs))
    return found.withColumns({"runtime": F.coalesce("sign__.runtime", F.lit("docker")), "field": F.coalesce("sign__.field", F.lit("")), "value": F.coalesce("sign__.value", F.lit(""))}).drop("sign__")


def instruction(created_by: Column) -> Column:
    """The Dockerfile instruction of a history entry, UNKNOWN where it can't be told."""
    text = F.trim(created_by)
    word = lambda c: F.upper(F.regexp_extract(c, f"(?i)^({INSTRUCTIONS}) ", 1))
    marked = F.regexp_extract(text, r"(?s)^.*?#\(nop\)\s*(.*)$", 1)
    found = F.when(text.contains("#(nop)"), word(marked)).when(word(text) != "", word(text)).when(text.rlike("^/bin/(ba)?sh -c"), "RUN")
    return F.when(found != "", found).otherwise("UNKNOWN")


def aligned(images: DataFrame) -> DataFrame:
    """(detected) -> one row a layer: image, runtime, layer, digest, created_by, instruction.

    The k-th history entry that made a layer is of the k-th layer; layers beyond have no entry.
    """
    made = F.filter(F.coalesce("history", F.array().cast(HISTORY)), lambda h: ~F.coalesce(h["empty_layer"], F.lit(False)))
    by = F.col("created_by")
    plain = by
    for runtime, prefix in PREFIXES.items():
        plain = F.when(F.col("runtime") == runtime, F.trim(F.regexp_replace(by, prefix, ""))).otherwise(plain)
    rows = images.select("image", "runtime", made.alias("made"), F.posexplode("layers").alias("layer", "digest"))
    rows = rows.select("image", "runtime", "layer", "digest", F.coalesce(F.get("made", F.col("layer"))["created_by"], F.lit("")).alias("created_by"))
    rows = rows.withColumn("plain", plain).withColumn("instruction", F.when(instruction(by) != "UNKNOWN", instruction(by)).otherwise(instruction(F.col("plain"))))
    return rows.select("image", "runtime", "layer", "digest", F.col("plain").alias("created_by"), "instruction")


def trust(images: DataFrame, layers: DataFrame, attested: DataFrame) -> DataFrame:
    """(detected), (aligned), (image) with provenance -> image, confidence of layer attributions."""
    known = layers.groupBy("image").agg(F.count("*").alias("n"), F.bool_and(F.col("created_by") != "").alias("whole"))
    sure = attested.select("image").distinct().withColumn("sure", F.lit(True))
    rows = images.select("image", "runtime").join(known, "image", "left").join(sure, "image", "left")
    return rows.select("image", F.when(F.col("sure"), "high").when(F.col("n").isNull(), "none").when(F.col("runtime") == "kaniko", "low").when(F.col("whole"), "medium").otherwise("low").alias("confidence"))


#: Provenance statements that are understood (fixed values).
PREDICATES = ("https://slsa.dev/provenance/v0.2", "https://slsa.dev/provenance/v1")
STATEMENT = "_type string, predicateType string, predicate struct<buildType:string,builder:struct<id:string>,metadata:struct<buildStartedOn:string,buildFinishedOn:string>,materials:array<struct<uri:string,digest:map<string,string>>>>"


def attestations(manifests: DataFrame, images: DataFrame) -> DataFrame:
    """(index, pos, digest, annotations), (image, digest) -> image, digest of the first attestation that names it."""
    refers = manifests.filter(F.try_element_at("annotations", F.lit(ATTESTATION[0])) == ATTESTATION[1]).select("pos", F.col("digest").alias("found"), F.try_element_at("annotations", F.lit("vnd.docker.reference.digest")).alias("digest"))
    return images.join(refers, "digest").groupBy("image").agg(F.min_by("found", "pos").alias("digest"))


def provenance(statements: DataFrame) -> DataFrame:
    """(image, text) -> image, predicate, build type, builder with its version, times, materials; other texts give nothing.

    Of a predicate that isn't understood only its type is given.
    """
    s = statements.select("image", F.explode(F.array(F.from_json("text", STATEMENT))).alias("s")).filter("s._type <> '' and s.predicateType <> ''")
    known = F.col("s.predicateType").isin(*PREDICATES)
    field = lambda path: F.when(known, F.coalesce(F.col(f"s.predicate.{path}"), F.lit(""))).otherwise("")
    return s.select("image", F.col("s.predicateType").alias("predicate"), field("buildType").alias("build_type"), field("builder.id").alias("builder"), F.regexp_extract(field("builder.id"), "@([^@]+)$", 1).alias("builder_version"), field("metadata.buildStartedOn").alias("started"), field("metadata.buildFinishedOn").alias("finished"), F.when(known, F.col("s.predicate.materials")).alias("materials"))
