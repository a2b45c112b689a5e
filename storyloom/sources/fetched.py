"""A stream of fetched feeds: a data source over the records of responses, whose offset remembers each source's state.

A fetcher writes what came back as JSON lines (``source_id, status, etag, last_modified, body_path``; status 0 is a network
error) into files whose paths grow in order. The source walks the new files' records only; an offset holds the last file
and, for each source, its etag, its Last-Modified and its errors in a row. A response that isn't modified (304, or a known
etag again) gives no row and keeps the tag; one with a new body gives a row; an error counts. Bodies are read later, by
the executors. As offsets are in the checkpoint, a restarted stream reads nothing twice and needs no older file.

Paths are those that Arrow's file systems open (local and shared folders, HDFS, S3).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "source_id long, etag string, last_modified string, body_path string, record string"
STATES = "source_id long, etag string, last_modified string, error_count int"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}" if not path.startswith("file:") else path)


def step(state: dict, record: dict) -> tuple[dict, bool]:
    """A source's state (etag, last_modified, errors) after a response, and whether that has a new body."""
    status, etag = record.get("status", 0), record.get("etag") or None
    if status == 304 or (status == 200 and etag is not None and etag == state["etag"]):
        return state | {"errors": 0}, False
    if status == 200:
        return {"etag": etag or state["etag"], "last_modified": record.get("last_modified") or state["last_modified"], "errors": 0}, True
    return state | {"errors": state["errors"] + 1}, False


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "sources": {}}

    def _files(self, after: str, upto: str | None = None) -> list[str]:
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = sorted(f.path[len(root.rstrip("/")) + 1 :] for f in found if f.is_file)
        return [n for n in names if not any(p[:1] in "._" for p in n.split("/")) and n > after and (upto is None or n <= upto)]

    def _walk(self, start: dict, upto: str | None = None) -> tuple[list[tuple], dict]:
        system, root = _opened(self.path)
        sources, rows, last = dict(start["sources"]), [], start["file"]
        for name in self._files(start["file"], upto):
            with system.open_input_stream(f"{root.rstrip('/')}/{name}") as lines:
                for k, line in enumerate(lines.read().decode().splitlines()):
                    if not line.strip():
                        continue
                    r = json.loads(line)
                    key = str(r["source_id"])
                    sources[key], new = step(sources.get(key, {"etag": None, "last_modified": None, "errors": 0}), r)
                    if new:
                        rows.append((int(r["source_id"]), sources[key]["etag"], sources[key]["last_modified"], r.get("body_path"), f"{name}:{k}"))
            last = name
        return rows, {"file": last, "sources": sources}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._walk(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._walk(start, end["file"])[0])


class FetchedFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetched_feeds"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> Reader:  # noqa: N802
        return Reader(self.options["path"])


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The new bodies of a folder of response records, as a stream of SCHEMA: ``record`` tells file and line."""
    spark.dataSource.register(FetchedFeeds)
    return spark.readStream.format("fetched_feeds").option("path", path).load()


def with_bodies(rows: DataFrame, most: int = 64) -> DataFrame:
    """The rows with ``body``, read where they lie: null where a path can't be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), most):
                part, bodies = pdf.iloc[k : k + most], []
                for path in part["body_path"]:
                    try:
                        system, at = _opened(path)
                        with system.open_input_stream(at) as f:
                            bodies.append(f.read().decode(errors="replace"))
                    except (OSError, TypeError, AttributeError):
                        bodies.append(None)
                yield part.assign(body=bodies)

    return rows.mapInPandas(run, f"{SCHEMA}, body string")


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sources' states (STATES) in the newest offset of a stream's checkpoint."""
    lines = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(F.col("_metadata.file_name").cast("int").alias("k"), "value")
    newest = lines.orderBy(F.desc("k")).first()
    offset = json.loads(newest["value"].splitlines()[2]) if newest else {"sources": {}}
    rows = [(int(k), s["etag"], s["last_modified"], s["errors"]) for k, s in offset["sources"].items()]
    return spark.createDataFrame(rows, STATES)
