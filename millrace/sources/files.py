"""Readers: item files, folders of images, recognition engines, imported texts."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_text, join_wrapped_lines, title_from_lines, truncate
from millrace.operators.store import content_hash, document_id, mime_type, present

NOTE = "title string, kind string, source string, capturedAt string, location string, url string, body string"
IMAGE = "file string, kind string, app string, title string, capturedAt string, location string, album string, caption string"
# Images by extension, and folders that hold none.
EXTENSIONS = "png,jpg,jpeg,webp,bmp,gif"
SKIPPED = "node_modules|dist|build|target|vendor|__pycache__"


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records below ``items`` of JSON files; none where a file is damaged. ``schema`` names the records' fields."""
    raw = spark.read.schema(f"items array<struct<{schema.replace(' string', ': string')}>>").option("multiLine", True).json(path)
    return raw.select(F.explode("items").alias("i")).select("i.*").withColumn("captured_at", F.try_to_timestamp("capturedAt")).drop("capturedAt")


def image_files(spark: SparkSession, folder: str, limit: int | None = None, every: bool = False) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the images below ``folder``, the ``limit`` newest if given, else all in no order.

    Hidden files and build folders are left out; with ``every`` other files come too, which :func:`recognise` reports. Which are the
    newest is told by their paths and times alone; only the chosen ones are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (files if every else files.option("pathGlobFilter", f"*.{{{EXTENSIONS},{EXTENSIONS.upper()}}}")).load(folder)
    inside = F.substring("path", F.length(F.lit(folder.rstrip("/"))) + F.position(F.lit(folder.rstrip("/").removeprefix("file://")), F.col("path")), F.lit(10_000))
    kept = files.where(~inside.rlike(rf"/(\.[^/]*|{SKIPPED})(/|$)"))
    if not limit:
        return kept
    newest = kept.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(limit)
    return kept.join(newest.select("path"), "path", "left_semi")


def is_image(name: Column, mime: Column | None = None) -> Column:
    """Whether a file is an image, by its type if there is one, or its extension."""
    by_name = F.coalesce(name.rlike(rf"(?i)\.({EXTENSIONS.replace(',', '|')})$"), F.lit(False))
    return by_name if mime is None else F.coalesce(mime.startswith("image/"), F.lit(False)) | by_name


class OcrEngine(Protocol):
    """Reads images. One is opened a task, so a model is loaded once a task."""

    def read(self, content: bytes) -> list[tuple[str, float]]:
        """The lines of an image with their confidence; raises where it can't be read."""


RECOGNISED = "path string, hash string, size bigint, status string, error string, lines array<string>, confidence double, ms int"


def recognise(images: DataFrame, open_engine, stored: DataFrame | None = None) -> DataFrame:
    """Memories of images: ``id, hash, name, title, mime_type, size, body, confidence, ms, status, error``, a row an image.

    The status is created, or skipped where ``stored`` has the image's ``id`` and ``hash`` (it isn't read then), or error where
    it is no image or can't be read; the rest go on. ``images`` may have a ``mime_type``. ``open_engine`` makes an
    :class:`OcrEngine` in each task.
    """
    digest = F.sha1("content")
    fits = is_image(F.col("path"), F.col("mime_type") if "mime_type" in images.columns else None)
    todo = images.select("path", digest.alias("hash"), F.col("length").alias("size"), "content", fits.alias("fits"))
    if stored is None:
        todo = todo.withColumn("held", F.lit(False))
    else:
        known = stored.where(F.col("id") == document_id(F.col("hash"))).select("hash", F.lit(True).alias("held")).distinct()
        todo = todo.join(known, "hash", "left").withColumn("held", F.coalesce("held", F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if not r.fits:
                    out.append((r.path, r.hash, r.size, "error", "not an image", None, None, None))
                elif r.held:
                    out.append((r.path, r.hash, r.size, "skipped", None, None, None, None))
                else:
                    engine = engine or open_engine()
                    began = time.monotonic()
                    try:
                        found = engine.read(bytes(r.content))
                        sure = [c for t, c in found if c >= 55 and any(x.isalnum() for x in t)] or [c for _, c in found]
                        ms = round(1000 * (time.monotonic() - began))
                        out.append((r.path, r.hash, r.size, "created", None, [t for t, _ in found], round(sum(sure) / len(sure), 1) if sure else None, ms))
                    except Exception as e:  # noqa: BLE001
                        out.append((r.path, r.hash, r.size, "error", str(e)[:200], None, None, None))
            rows = pd.DataFrame(out, columns=["path", "hash", "size", "status", "error", "lines", "confidence", "ms"])
            yield rows.astype({"confidence": "Float64", "ms": "Int32"})

    lines = F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x: clean_text(F.regexp_replace(x, r"^[\s•·*»>-]+", "")))
    name = F.element_at(F.split("path", "/"), -1)
    rows = todo.select("path", "hash", "size", F.when(F.col("fits") & ~F.col("held"), F.col("content")).alias("content"), "fits", "held").mapInPandas(run, RECOGNISED).withColumn("body", join_wrapped_lines(F.array_join(F.filter(lines, lambda x: x != ""), "\n")))
    return rows.select(document_id(F.col("hash")).alias("id"), "hash", name.alias("name"), F.coalesce(title_from_lines(F.col("body")), name).alias("title"), mime_type(name).alias("mime_type"), "size", "body", "confidence", "ms", "status", "error")


def import_texts(rows: DataFrame) -> DataFrame:
    """Memories of texts (``title, kind, source, body``) with ``id, hash, size, status``.

    The body is cleaned; without one the status is error. A missing title is the body's first line, at most 70 characters; kind and
    source have defaults.
    """
    body = clean_text(F.coalesce("body", F.lit("")))
    titled = rows.withColumn("body", body).withColumn("title", F.coalesce(present(clean_text(F.col("title"))), truncate(F.element_at(F.split("body", "\n"), 1), 70)))
    h = content_hash(F.col("title"), F.col("body"))
    return titled.select(
        document_id(h).alias("id"), h.alias("hash"), "title", F.coalesce(present(F.col("kind")), F.lit("note")).alias("kind"), F.coalesce(present(F.col("source")), F.lit("Imported")).alias("source"),
        "body", F.octet_length("body").cast("bigint").alias("size"), F.when(F.col("body") == "", "error").otherwise("created").alias("status"),
    )
