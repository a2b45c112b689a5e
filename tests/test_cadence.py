"""The cadence of topics at the edge of a second, and with what is missing, against the SQL."""

from datetime import datetime, timedelta

import duckdb

from storyloom.plans import catalog

NOW = datetime(2024, 1, 31)


def test_the_second_begun_counts(spark, tmp_path):
    ago = lambda user, micros: NOW - timedelta(hours=1 + user % 48) + timedelta(microseconds=micros)
    users = [0, 1, 2, 46, 50]
    rows = [(u, f"e{k}", ago(u, m)) for u in users for k, m in enumerate([-1, 0, 1, 400_000, 999_999, 1_000_000])]
    rows += [(4, "late", NOW + timedelta(microseconds=7)), (4, "old", datetime(1969, 12, 31, 23, 59, 59, 500_000)), (4, None, NOW), (None, "e", NOW), (4, "never", None), (5, "never", None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(catalog.ORACLES["cadence_gate"]).fetchall()
    got = [(r.topic_key, r.due) for r in catalog.QUERIES["cadence_gate"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and ("0.e4", True) in got and ("0.e5", False) in got
