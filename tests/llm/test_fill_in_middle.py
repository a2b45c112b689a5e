import hashlib
import random
import re

from storyloom.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The transformation by lists of units."""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    parts = ["a", "word", " ", "  ", "\t", "\n", "\x0b", "\x01", "\x02", "\x02a", "\x02b", "<", "<P", "S>", ">", "🙂", "é", " ", "\x85", "$0", "\\", "<M>"]
    fixed = [None, "", " ", "x", " lead", "trail \n", "\x01\x02", "\x02a\x01 \x02b", "has <S> inside"]
    return fixed + ["".join(rng.choice(parts[: 21 + (i % 9 == 0)]) for _ in range(rng.randint(1, 40))) for i in range(300)] + ["many words " * 40_000]


def test_by_lists_of_units(spark):
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts())]
    table = spark.createDataFrame([(d, t, "own", 1) for d, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    got = fim.transform(table).withColumn("back", fim.restore(fim.F.col("output"), fim.F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(d, t or "", *plain(d, t or "")) for d, t in rows], key=key)
    assert sorted([(r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got], key=key) == want
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_repeats_and_empty_table(spark):
    table = spark.createDataFrame([(i // 2, "one two three") for i in range(800)], "doc_id long, text string")
    assert {r.form for r in fim.transform(table, rate=100, spm=0).collect()} == {"psm"}
    assert {r.form for r in fim.transform(table, rate=0).collect()} == {"plain"}
    got = fim.transform(table).collect()
    assert len(got) == 800 and len({(r.doc_id, r.output) for r in got}) == 400
    assert 100 < sum(r.form != "plain" for r in got) // 2 < 300
    assert fim.transform(table.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fim.transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
