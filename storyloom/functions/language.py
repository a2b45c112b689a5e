"""The language of a short text by profiles of letter trigrams, learned from texts with a language, and told natively.

A text is its lower-case letters, any run of others being one space. Its trigrams fall into BUCKETS by a fixed sum of their
code points; a language's profile is the logarithm of each bucket's smoothed share. The language with the largest sum over
a text's trigrams wins, the first by name among equals. Profiles are arrays that the plan holds, so that a trigram's
weight is one access.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets (a prime), factors of a trigram's first two letters, and what every bucket counts beforehand.
BUCKETS, FIRST, SECOND, SMOOTH = 4099, 7919, 131, 0.5


def letters(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def buckets(text: Column) -> Column:
    """The bucket of every trigram of a text's letters."""
    codes = F.transform(F.filter(F.split(letters(text), ""), lambda c: c != ""), lambda c: F.ascii(c))
    told = lambda x: F.transform(F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - 2)), lambda a, i: ((a * FIRST + F.get(x, i + 1) * SECOND + F.get(x, i + 2)) % BUCKETS).cast("int"))
    return F.get(F.transform(F.array(codes), told), F.lit(0))


@dataclass
class Profiles:
    langs: list[str]
    weights: list[list[float]]

    def scores(self, text: Column) -> Column:
        """``array<struct<score, lang>>`` of all languages."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<array<double>>")
        names = F.array(*map(F.lit, self.langs))
        let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
        one = lambda b: F.transform(table, lambda w, i: F.struct(F.aggregate(b, F.lit(0.0), lambda s, k: s + F.get(w, k)).alias("score"), F.get(names, i).alias("lang")))
        return let(buckets(text), one)

    def guess(self, text: Column, fallback: Column, least: int = 3) -> Column:
        """The best language; the fallback for texts of fewer than ``least`` letters."""
        if not self.langs:
            return fallback
        by = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["lang"] < b["lang"], -1).when(a["lang"] > b["lang"], 1).otherwise(0)
        best = F.get(F.array_sort(self.scores(text), by), F.lit(0))["lang"]
        return F.when(F.length(F.replace(letters(text), F.lit(" "), F.lit(""))) < least, fallback).otherwise(best)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all rows with a language: counts of (language, bucket), which are few whatever the number of rows."""
    counted = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.explode(buckets(F.col(text))).alias("b")).groupBy("l", "b").agg(F.count("*").alias("n"))
    found: dict[str, list[float]] = {}
    for r in counted.collect():  # BUCKETS rows a language
        found.setdefault(r["l"], [SMOOTH] * BUCKETS)[r["b"]] += r["n"]
    langs = sorted(found)
    return Profiles(langs, [[math.log(x / sum(found[k])) for x in found[k]] for k in langs])
