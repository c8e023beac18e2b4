"""Image archives and layers: tar streams to rows, a layer at a time.

A layer's archive is one row of `content`; its members are read as a stream, so that memory holds the archive
and one batch of rows. Archives that can't be read to their end raise an error.
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed over at a time, and bytes of content among them.
ROWS, BYTES = 5_000, 32 << 20
WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"


def normal(name: str) -> str:
    """A member's path without leading './' or '/', '' for the root."""
    clean = posixpath.normpath(name.replace("\\", "/")).lstrip("/")
    return "" if clean == "." else clean


def event(member: tarfile.TarInfo) -> tuple[str, str] | None:
    """(operation, path): add, wh for a path that goes, opq for a directory whose former content goes."""
    path = normal(member.name)
    parent, base = posixpath.split(path)
    if not path:
        return None
    if base == OPAQUE:
        return "opq", parent
    if base.startswith(WHITEOUT):
        return "wh", posixpath.join(parent, base[len(WHITEOUT) :])
    return None if member.isdir() else ("add", path)


def layer_entries(layers: DataFrame, most: int = 0) -> DataFrame:
    """(image, layer, content) -> image, layer, seq, op, path, size, body.

    body: the content of regular files of up to `most` bytes, else null. Plain and compressed archives are read.
    """
    names = ["image", "layer", "seq", "op", "path", "size", "body"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def work(batches):
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for image, layer, content in zip(*batch.columns):
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r|*") as tar:
                    for seq, member in enumerate(tar):
                        found = event(member)
                        if not found:
                            continue
                        body = tar.extractfile(member).read() if found[0] == "add" and member.isreg() and 0 < most >= member.size else None
                        rows.append((image.as_py(), layer.as_py(), seq, *found, member.size, body))
                        held += len(body or b"")
                        if len(rows) >= ROWS or held >= BYTES:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    kept = layers.select(F.col("image").cast("string"), F.col("layer").cast("int"), "content")
    return kept.mapInArrow(work, "image string, layer int, seq bigint, op string, path string, size bigint, body binary")


def saved_images(spark: SparkSession, path: str) -> DataFrame:
    """Archives as `docker save` writes them -> image, layer, digest, content; the manifest orders the layers."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), "content")

    def work(batches):
        for batch in batches:
            for image, content in zip(*batch.columns):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    manifest = json.load(tar.extractfile("manifest.json"))
                    for entry in manifest[:1]:
                        for i, name in enumerate(entry["Layers"]):
                            yield pa.RecordBatch.from_arrays([pa.array([image.as_py()]), pa.array([i], pa.int32()), pa.array([name]), pa.array([tar.extractfile(name).read()], pa.binary())], names=["image", "layer", "digest", "content"])

    return files.mapInArrow(work, "image string, layer int, digest string, content binary")


def layout_layers(spark: SparkSession, root: str, system: str = "linux", machine: str = "amd64") -> DataFrame:
    """An OCI layout folder -> image, layer, digest, content.

    Of an index the manifest of the platform is taken, else the first; one index may be nested. The index and
    manifests are a few lines each and read on the driver; layers are read by the executors.
    """

    def load(*parts: str) -> dict:
        return json.loads(spark.read.text("/".join([root.rstrip("/"), *parts]), wholetext=True).head()["value"])

    def pick(index: dict) -> dict:
        fits = [m for m in index["manifests"] if (p := m.get("platform")) and p.get("os") == system and p.get("architecture") == machine]
        return (fits or index["manifests"])[0]

    blob = lambda d: load("blobs", *d.split(":"))
    manifest = blob(pick(load("index.json"))["digest"])
    if "manifests" in manifest:
        manifest = blob(pick(manifest)["digest"])
    order = spark.createDataFrame([(i, layer["digest"], layer["digest"].split(":")[1]) for i, layer in enumerate(manifest["layers"])], "layer int, digest string, file string")
    folders = sorted({layer["digest"].split(":")[0] for layer in manifest["layers"]})
    blobs = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/blobs/{f}" for f in folders]).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return blobs.join(F.broadcast(order), "file").select(F.lit(root).alias("image"), "layer", "digest", "content")
