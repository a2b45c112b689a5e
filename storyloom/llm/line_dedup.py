"""Boilerplate lines across sites. Catalyst only.

A line is known by the 64-bit hash of its text without surrounding white space. Per hash a HyperLogLog sketch of the
sites that show it is built by partial aggregation and merged. Estimates far from the threshold decide; a line whose
estimate lies within ``margin`` times the sketch's standard error of the threshold gets an exact distinct count of its
sites. Lines on at least ``sites`` sites are boilerplate, and are taken out of every document.

Skew. Lines are aggregated to sketches before anything is shuffled: a row per line and task. Pairs of line and site are
made for lines near the threshold alone, and are made distinct before they meet. Texts are not shuffled: up to
``small`` boilerplate lines (counted) are a table of hashes in the plan, and each document is stripped where it is read. A
larger set of them is joined with the lines of the distinct texts, a row per text that has some.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Sketches have 2**LG_K registers.
LG_K = 10
#: Boilerplate lines that the plan holds at most: 4 MB.
SMALL = 500_000
#: White space around a line. (A line ends at its line feed.)
SPACE = " \t\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _hash(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def _lines(text: Column) -> Column:
    """The hashes of a text's lines that aren't blank, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: _bare(x) != ""), _hash))


def spread(docs: DataFrame, sites: int, margin: float = 3.0, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``line, docs, estimate, exact, sites`` of the lines on at least ``sites`` sites.

    ``exact`` is null where the estimate was far enough from the threshold; ``sites`` is the exact count or else the
    rounded estimate. A null site is no site.
    """
    error = margin * 1.04 / math.sqrt(1 << LG_K)
    low, high = sites * (1 - error) - 0.5, sites * (1 + error) + 0.5
    lines = docs.filter(F.col(text_col).isNotNull()).select(F.col(site_col).alias("site"), F.explode(_lines(F.col(text_col))).alias("line"))
    merged = lines.groupBy("line").agg(F.count("*").alias("docs"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    many = cut(merged.filter(F.col("docs") >= sites).select("line", "docs", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= low), "spread")
    near = many.filter(F.col("estimate") < high).select("line")
    known = lines.filter(F.col("site").isNotNull())
    if near.count() <= SMALL:
        pairs = known.join(F.broadcast(near), "line", "left_semi").distinct()
    else:  # pairs of line and site are few for any line, however many documents show it
        pairs = known.distinct().join(near, "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count("*").alias("exact"))
    return many.join(exact, "line", "left").withColumn("sites", F.coalesce("exact", F.round("estimate").cast("long"))).filter(F.col("sites") >= sites)


def _table(common: DataFrame, slots: int) -> Column:
    """The hashes by their low bits, as an array of arrays that the plan holds."""
    rows: list[list[int]] = [[] for _ in range(slots)]
    for r in common.select("line").orderBy("line").collect():
        rows[r["line"] % slots].append(r["line"])
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), "array<array<bigint>>")


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many lines below it as make it none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def strip(docs: DataFrame, sites: int = 10, margin: float = 3.0, text_col: str = "text", site_col: str = "source", small: int = SMALL, counts: str | None = None) -> DataFrame:
    """The documents, with all their columns, without boilerplate lines.

    ``counts`` names a further column, none of the documents' own, with a struct of the number of ``lines`` and of those
    ``removed``. All rows stay; a text of which nothing is left becomes empty. Null texts stay null and have no lines; empty
    and blank lines stay as they are, and so do the ends of the lines that stay (a carriage return, say). Ids are not read, so
    rows that share one or have none are treated like others. Equal rows get equal results; an empty table gives no rows.
    Columns of any other name are carried along as they are.
    """
    if counts is not None and counts != free_name(counts, docs.columns):
        raise ValueError(f"{counts} is a column of the documents")
    common = cut(spread(docs, sites, margin, text_col, site_col).select("line"), "boilerplate")
    n = common.count()
    columns = docs.columns
    held = docs.select(F.struct(*[_named(c) for c in columns]).alias("_row"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    if n <= small:
        slots = 1 << n.bit_length()
        table = _table(common, slots)
        bad = lambda x: F.array_contains(F.get(table, F.pmod(_hash(x), F.lit(slots)).cast("int")), _hash(x))
    else:
        lines = held.filter("_text is not null").select("_hash", F.explode(_lines(F.col("_text"))).alias("line")).distinct()
        some = cut(lines.join(common, "line", "left_semi").groupBy("_hash").agg(F.collect_set("line").alias("_bad")), "texts")
        held = held.join(some, "_hash", "left")
        bad = lambda x: F.coalesce(F.array_contains("_bad", _hash(x)), F.lit(False))
    parts = F.split("_text", "\n")
    kept = held.select("_row", parts.alias("_parts"), F.filter(parts, lambda x: (_bare(x) == "") | ~bad(x)).alias("_left"))
    out = [F.array_join("_left", "\n").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns]
    lines, left = F.coalesce(F.size("_parts"), F.lit(0)), F.coalesce(F.size("_left"), F.lit(0))
    told = [] if counts is None else [F.struct(lines.cast("long").alias("lines"), (lines - left).cast("long").alias("removed")).alias(counts)]
    return kept.select(*out, *told)
