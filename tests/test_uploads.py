"""Uploads with status: in batches and as a stream that is stopped half way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.operators import chunk, upload
from granary.operators.ingest import embedded_or_failed
from granary.streaming.uploads import current_status, start_uploads

SCHEMA = "doc_id long, file_name string, mime_type string, content binary, tenant_id string, owner_user_id string"


def files(spark, rows):
    return spark.createDataFrame([(i, name, None, text if text is None else text.encode(), tenant, "u") for i, name, text, tenant in rows], SCHEMA).repartition(2)


def chunker(text, sections, name):
    return chunk.semantic(text, sections, name, 60, 0)


def embed(texts):
    if any("no vector" in t for t in texts):
        raise RuntimeError("no vector for this " + "x" * 600)
    return [[float(len(t)), 1.0] for t in texts]


ROWS = [(1, "a.txt", "A first text. It has two sentences.", "t"), (2, "b.txt", "A first text. It has two sentences.", "t"), (3, "c.txt", "A first text. It has two sentences.", "other"), (4, "d.txt", "There is no vector for this text.", "t"), (5, "e.exe", "binary", "t"), (6, "f.txt", "", "t"), (7, "g.docx", "no archive", "t"), (8, "h.txt", " \n ", "t"), (9, "i.txt", None, "t")]
WANT = {1: "success", 2: "rejected", 3: "success", 4: "failed", 5: "rejected", 6: "rejected", 7: "failed", 8: "warning", 9: "rejected"}


def test_a_batch_of_uploads(spark):
    out = upload.upload(files(spark, ROWS), None, chunker, embed)
    got = {r.doc_id: r for r in out["status"].collect()}
    assert {i: r.status for i, r in got.items()} == WANT
    assert got[2].message == "duplicate" and got[5].message == "extension" and got[4].message.startswith("no vector for this x") and len(got[4].message) == 500
    assert got[8].message.startswith("empty") and got[4].chunk_count == 0 and got[1].chunk_count == 1
    assert {r.doc_id for r in out["chunks"].collect()} == {r.doc_id for r in out["vectors"].collect()} == {1, 3}
    assert {r.status for r in out["started"].collect()} == {"processing", "rejected"}
    basic = upload.upload(files(spark, ROWS), None, chunker, embed, basic=True)["status"]
    assert {r.doc_id: r.status for r in basic.collect()}[8] == "success"


def test_only_the_texts_that_fail_have_no_vector(spark):
    rows = spark.createDataFrame([(i, "no vector" if i == 5 else f"text {i % 3}") for i in range(10)] + [(10, " "), (11, None)], "id long, content string").coalesce(1)
    got = {r.id: (list(r.embedding), r.error) for r in embedded_or_failed(rows, embed, size=4).collect()}
    assert got[5][0] == [] and len(got[5][1]) == 500 and got[10] == got[11] == ([], None)
    assert all(got[i] == ([6.0, 1.0], None) for i in range(10) if i != 5)


def test_uploads_by_another_provider(spark):
    """The first provider fails in each task; the next one of the same dimension answers."""

    def broken(texts):
        raise upload.EmbeddingError(503)

    providers = upload.Providers([("first", 2, broken, None), ("wide", 3, lambda t: [[0.0] * 3 for _ in t], None), ("second", 2, embed, 1)], sleep=lambda _: None)
    got = {r.doc_id: r.status for r in upload.upload(files(spark, ROWS), None, chunker, providers.embed)["status"].collect()}
    assert got[1] == "success" and got[4] == "failed"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_a_stream_that_stops_half_way(spark, tmp_path):
    src, store, checkpoint, mark = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/checkpoint", tmp_path / "stop"
    files(spark, ROWS).write.parquet(src)
    mark.touch()
    at = str(mark)

    def stopping(text, sections, name):
        import os

        if os.path.exists(at):
            raise SystemError("the machine is gone")
        return chunk.semantic(text, sections, name, 60, 0)

    with pytest.raises(Exception, match="the machine is gone"):
        start_uploads(stream(spark, src), store, checkpoint, stopping, embed).awaitTermination(90)
    half = {r.doc_id: r.status for r in current_status(spark, store).collect()}
    assert half == {i: s if s == "rejected" else "processing" for i, s in WANT.items()}
    mark.unlink()
    for _ in range(2):  # the second run finds nothing new
        start_uploads(stream(spark, src), store, checkpoint, stopping, embed).awaitTermination(90)
    assert {r.doc_id: r.status for r in current_status(spark, store).collect()} == WANT
    assert sorted(r.doc_id for r in spark.read.parquet(f"{store}/chunks").collect()) == [1, 3]
    # a later micro-batch knows the contents of earlier ones
    files(spark, [(20, "z.txt", "A first text. It has two sentences.", "t"), (21, "y.txt", "A new text.", "t"), (19, "x.txt", "A new text.", "t")]).write.mode("append").parquet(src)
    start_uploads(stream(spark, src), store, checkpoint, stopping, embed).awaitTermination(90)
    last = {r.doc_id: (r.status, r.message) for r in current_status(spark, store).collect()}
    assert last[20] == last[21] == ("rejected", "duplicate") and last[19][0] == "success" and {i: last[i][0] for i in WANT} == WANT


def test_status_before_the_first_batch(spark, tmp_path):
    assert current_status(spark, f"{tmp_path}/none").count() == 0
