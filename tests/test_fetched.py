"""The stream of fetched feeds: what the offset remembers, over restarts."""

import json

from storyloom.sources import feeds, fetched

RSS = "<rss><channel><title>c</title><item><title>{0}</title><link>http://a/{0}</link><description>d</description></item></channel></rss>"


def respond(folder, name, records):
    path = folder / "in" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records))


def drained(spark, folder):
    stream = fetched.read_stream(spark, f"{folder}/in")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(fetched.SCHEMA).parquet(f"{folder}/out")
    return sorted((r.source_id, r.etag, r.record) for r in rows.collect()), {r.source_id: (r.etag, r.last_modified, r.error_count) for r in fetched.states(spark, f"{folder}/state").collect()}


def test_tags_errors_and_restarts(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"b{k}.xml").write_text(RSS.format(k))
    body = [f"{tmp_path}/b{k}.xml" for k in range(3)]
    respond(tmp_path, "0/a.json", [{"source_id": 1, "status": 200, "etag": "x", "last_modified": "Mon", "body_path": body[0]}, {"source_id": 2, "status": 503}, {"source_id": 2, "status": 0}])
    respond(tmp_path, "0/_SUCCESS", [])
    rows, states = drained(spark, tmp_path)
    assert rows == [(1, "x", "0/a.json:0")] and states == {1: ("x", "Mon", 0), 2: (None, None, 2)}
    # not modified, the same tag again, a new one, an error after it; a body without a tag is always new
    respond(tmp_path, "1/a.json", [{"source_id": 1, "status": 304}, {"source_id": 1, "status": 200, "etag": "x", "body_path": body[0]}, {"source_id": 2, "status": 200, "body_path": body[1]}])
    respond(tmp_path, "1/b.json", [{"source_id": 1, "status": 200, "etag": "y", "body_path": body[2]}, {"source_id": 1, "status": 500}, {"source_id": 2, "status": 200, "body_path": "/no/such/file"}])
    (tmp_path / "in/0/a.json").unlink()  # no older file is needed
    rows, states = drained(spark, tmp_path)
    assert rows == [(1, "x", "0/a.json:0"), (1, "y", "1/b.json:0"), (2, None, "1/a.json:2"), (2, None, "1/b.json:2")]
    assert states == {1: ("y", "Mon", 1), 2: (None, None, 0)}
    assert drained(spark, tmp_path)[0] == rows  # a restart reads nothing twice
    found = fetched.with_bodies(spark.read.schema(fetched.SCHEMA).parquet(f"{tmp_path}/out"))
    assert sorted(r.title for r in feeds.entries(found, "source_id", "body").collect()) == ["0", "1", "2"]
    assert [r.record for r in found.collect() if r.body is None] == ["1/b.json:2"]


def test_a_batch_is_read_again_as_it_was(tmp_path):
    respond(tmp_path, "a.json", [{"source_id": 1, "status": 200, "etag": "x"}])
    respond(tmp_path, "b.json", [{"source_id": 1, "status": 200, "etag": "x"}, {"source_id": 3, "status": 200, "etag": "z"}])
    reader = fetched.Reader(f"{tmp_path}/in")
    first, end = reader.read(reader.initialOffset())
    first = list(first)
    respond(tmp_path, "c.json", [{"source_id": 9, "status": 200}])
    assert list(reader.readBetweenOffsets(reader.initialOffset(), end)) == first and len(first) == 2
    rows, last = reader.read(end)
    assert [r[0] for r in rows] == [9] and last["file"] == "c.json" and reader.read(last)[1] == last
    assert fetched.Reader(f"{tmp_path}/none").read({"file": "", "sources": {}})[1]["file"] == ""
