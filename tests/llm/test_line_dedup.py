import random
from collections import Counter, defaultdict

import pytest

from storyloom.llm import line_dedup as L

SPACE = " \t\x0b\x0c\r"


def brute(rows, sites):
    """Rows (text, source) as (text, lines, removed)."""
    seen = defaultdict(set)
    for text, source in rows:
        for x in (text or "").split("\n"):
            if source is not None:
                seen[x.strip(SPACE)].add(source)
    out = []
    for text, _ in rows:
        parts = [] if text is None else text.split("\n")
        left = [x for x in parts if not x.strip(SPACE) or len(seen[x.strip(SPACE)]) < sites]
        out.append((None if text is None else "\n".join(left), len(parts), len(parts) - len(left)))
    return out


def rows_of(sites, seed=5):
    """Lines on just under, just as many and just over the number of sites; CRLF, tabs, blanks, nulls, repeats."""
    rng = random.Random(seed)
    shared = {f"shared line {k}": sites + k for k in range(-4, 5)} | {"everywhere": 3 * sites}
    texts = defaultdict(list)
    for line, n in shared.items():
        for s in rng.sample(range(4 * sites), n):
            texts[s].append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "\r", "  "]))
    rows = []
    for s in range(4 * sites):
        lines = [*texts[s], f"own line {s}", "", " \t", "\r", f"own line {s}"]
        rng.shuffle(lines)
        rows.append(("\n".join(lines), f"site{s}"))
    rows += rows[:7]  # the same row twice
    rows += [(None, "site1"), ("", "site2"), ("everywhere", None), ("everywhere\nshared line 4", "site3"), ("\r\n" * 3, "site4"), ("shared line -4\n" * 3000 + "end", None)]
    return rows


@pytest.mark.parametrize("sites", [5, 10, 40])
@pytest.mark.parametrize("small", [L.SMALL, 0])
def test_against_brute_force(spark, sites, small):
    rows = rows_of(sites)
    ids = [None if i % 5 == 0 else i // 2 for i in range(len(rows))]  # some without, some shared
    df = spark.createDataFrame([(i, *r, k) for k, (i, r) in enumerate(zip(ids, rows, strict=True))], "doc_id long, text string, source string, k int")
    got = L.strip(df.repartition(3), sites, small=small, counts="told")
    assert got.columns == [*df.columns, "told"]
    found = {r.k: (r.text, r.told.lines, r.told.removed) for r in got.collect()}
    assert [found[k] for k in range(len(rows))] == brute(rows, sites)


def test_only_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(f"many {i % 3}\nsome {i % 40}", f"s{i}") for i in range(600)]
    found = {r.docs: r for r in L.spread(spark.createDataFrame(rows, "text string, source string"), 15).collect()}
    assert found[200].exact is None and abs(found[200].sites - 200) < 20
    assert found[15].exact == found[15].sites == 15
    assert sum(r.sites == 15 for r in L.spread(spark.createDataFrame(rows, "text string, source string"), 15).collect()) == 40


def test_empty_table_clashing_columns_and_native(spark):
    names = ["_bad", "line", "_lines", "_removed", "_t", "_row", "_parts", "_left", "_hash", "_text", "counts", "a.b", "site"]
    df = spark.createDataFrame([("a\nb", "x", *range(13))], "text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for small in (L.SMALL, 0):
        got = L.strip(df, 1, small=small, counts="told")
        assert got.columns == [*df.columns, "told"]
        assert [tuple(r) for r in got.collect()] == [("", "x", *range(13), (2, 2))]
        assert L.strip(df, 2, small=small).collect() == df.collect()
    assert L.strip(df.limit(0), 1).count() == 0
    assert L.free_name("Counts", df.columns) == "Counts_"
    with pytest.raises(ValueError, match="counts"):
        L.strip(df, 1, counts="counts")
    for small in (L.SMALL, 0):
        plan = L.strip(spark.createDataFrame(rows_of(5), "text string, source string"), 5, small=small)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_the_query_on_a_small_table(spark, tmp_path):
    from storyloom.llm import queries

    rows = rows_of(queries.SITES)
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_line_dedup(spark, str(tmp_path)).collect()
    assert Counter((r.n_lines, r.n_removed) for r in got) == Counter(x[1:] for x in brute(rows, queries.SITES))
