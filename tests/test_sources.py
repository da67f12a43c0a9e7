import json
import os

from pyspark.sql import functions as F

from millrace.sources.files import NOTE, image_files, import_texts, read_items, recognise
from millrace.streaming.ingest import ingest_stream


def test_read_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"title": "A", "body": "b", "capturedAt": "2026-01-02T03:04:05+02:00"}, {"title": "B"}]}))
    (tmp_path / "b.json").write_text("{ broken")
    got = {r["title"]: str(r["captured_at"]) for r in read_items(spark, str(tmp_path), NOTE).collect()}
    assert got == {"A": "2026-01-02 01:04:05", "B": "None"}


class Reader:
    def read(self, content):
        if content == b"bad":
            raise ValueError("no image")
        return [(t, 90.0) for t in content.decode().split("\n")]


def test_images(spark, tmp_path):
    for name, content in {"one.png": b"12:30\n- Cheap Flights Express\nFly at 9", "sub/two.JPG": b"bad", ".hidden/x.png": b"x", "node_modules/y.png": b"y", "z.txt": b"z", "same.png": b"12:30\n- Cheap Flights Express\nFly at 9"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    images = image_files(spark, str(tmp_path))
    got = {r["name"]: (r["status"], r["title"], r["mime_type"]) for r in recognise(images, Reader).collect()}
    assert got == {"one.png": ("created", "Cheap Flights Express", "image/png"), "same.png": ("created", "Cheap Flights Express", "image/png"), "two.JPG": ("error", "two.JPG", "image/jpeg")}
    stored = recognise(images, Reader).where("name = 'one.png'")
    again = {r["name"]: (r["status"], r["error"], r["body"]) for r in recognise(image_files(spark, str(tmp_path), every=True), Reader, stored).collect()}
    assert again == {"one.png": ("skipped", None, ""), "same.png": ("skipped", None, ""), "two.JPG": ("error", "no image", ""), "z.txt": ("error", "not an image", "")}
    other = {r["name"]: r["status"] for r in recognise(images, Reader, stored.withColumn("id", F.lit("doc_else"))).collect()}
    assert other == {"one.png": "created", "same.png": "created", "two.JPG": "error"}  # the digest alone doesn't make it the same record
    typed = recognise(image_files(spark, str(tmp_path), every=True).withColumn("mime_type", F.lit("image/png")), Reader)
    assert {r["name"]: r["status"] for r in typed.collect()}["z.txt"] == "created"
    assert image_files(spark, str(tmp_path), 1).count() == 1 and recognise(images.limit(0), Reader).count() == 0


def test_newest_images_are_told_without_their_content(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(b"x" * i)
        os.utime(tmp_path / f"{i}.png", (1_000_000 + i, 1_000_000 + i))
    assert {r["path"].rsplit("/", 1)[1] for r in image_files(spark, str(tmp_path), 2).collect()} == {"3.png", "4.png"}


def test_import_texts(spark):
    df = spark.createDataFrame([("", None, "", " Hello  there\nmore"), ("T", "page", "Web", "x"), (None, None, None, None)], "title string, kind string, source string, body string")
    got = {(r["title"], r["kind"], r["source"], r["status"]) for r in import_texts(df).collect()}
    assert got == {("Hello there", "note", "Imported", "created"), ("T", "page", "Web", "created"), ("", "note", "Imported", "error")}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, store = tmp_path / "in", f"file://{tmp_path}/store"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(f"{source}/1")
    spark.createDataFrame([(9, "z")], "k int, v string").write.parquet(f"{source}/1/sub")
    flat = lambda: sorted((r["k"], r["v"]) for r in ingest_stream(spark, f"{source}/1", "k", store).collect())
    first = flat()
    assert first[:2] == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "again"), (3, "c")], "k int, v string").write.mode("append").parquet(f"{source}/1")
    assert set(flat()) >= {(1, "a"), (2, "b"), (3, "c")} and len([k for k, _ in flat() if k == 2]) == 1
    spark.createDataFrame([(None, "n"), (None, "n"), (3, "late")], "k int, v string").write.mode("append").parquet(f"{source}/1")
    third = {(r["k"], r["v"]) for r in ingest_stream(spark, f"{source}/1", "k", store).collect()}
    assert (None, "n") in third and (3, "late") not in third
    spark.createDataFrame([(None, "n again"), (4, "d")], "k int, v string").write.mode("append").parquet(f"{source}/1")
    last = [(r["k"], r["v"]) for r in ingest_stream(spark, f"{source}/1", "k", store).collect()]
    assert (4, "d") in last and [v for k, v in last if k is None] == ["n"]
