"""The driver's contract, and a part of the queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["url_normalize", "exact_dedup", "simhash", "near_dup_pairs", "three_factors", "five_factors", "topic_topk", "final_selection", "best_title", "upsert_source", "claim_support", "seo_rules", "stream_tumbling", "ingest_run", "entry_normalize", "article_claims", "article_validation", "topic_run", "leader_existing", "keywords_topn"])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    want = sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_only_missing_modules_are_left_out(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "storyloom.llm", None)
    monkeypatch.delitem(sys.modules, "storyloom.llm.queries", raising=False)
    assert entry._extra() == [] and "final_selection" in entry.queries() and not any(n.startswith("op") for n in entry.queries())

    def broken(name):
        raise ModuleNotFoundError("no xxhash", name="xxhash")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
