"""Validators of entries, claims and articles: native, as lists of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.text import squeeze
from storyloom.sources.shared import cut

# Words of clickbait, of calls to act, and of section headings.
CLICKBAIT = ["increíble", "shocking", "no creerás", "secreto", "truco", "jamás imaginarías", "te sorprenderá", "nadie esperaba"]
CALLS = ["conoce", "descubre", "aprende", "lee", "explora", "consulta"]
INTRO, ANALYSIS = ["contexto", "antecedentes", "introducción"], ["análisis", "impacto", "consecuencias"]


def valid_entry() -> Column:
    """Title, URL, hash and both times are there, and the URL is of the web."""
    filled = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in ("title", "url", "url_sha1")])
    return filled & F.col("published_at").isNotNull() & F.col("fetched_at").isNotNull() & F.col("url").rlike("^https?://")


def words(text: Column) -> Column:
    """Distinct words between spaces, lower case."""
    return F.array_distinct(F.array_remove(F.split(squeeze(F.lower(text)), " "), ""))


def support(claims: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """``claim_id, supported, best, n_sources``: sources that have at least ``limit`` of a claim's words, and the best share.

    A source with that share has one of the claim's rarest words, as many as it may lack and one more. So candidates come
    from those words alone, by equality, and common words never pair all claims with all sources; each candidate is then
    checked on all words.
    """
    hashed = lambda text: F.transform(words(text), lambda w: F.xxhash64(w))
    asked = claims.select("claim_id", hashed(F.col("text")).alias("cw")).withColumn("n", F.size("cw"))
    each = cut(asked.select("claim_id", "n", F.explode("cw").alias("w")), "words")
    held = sources.select("source_id", F.explode(hashed(F.col("text"))).alias("w"))
    hits = cut(held.join(each.select("w").distinct(), "w", "left_semi"), "hits")
    common = hits.groupBy("w").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.coalesce("df", F.lit(0)), "w"))
    rare = cut(each.join(common, "w", "left").withColumn("k", place).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * limit) + 1).select("claim_id", "w"), "rare")
    # both sides are written tables: adaptive skew joins deal out a word that most sources have
    pairs = cut(hits.join(rare, "w").select("claim_id", "source_id").distinct(), "pairs")
    own = hits.groupBy("source_id").agg(F.collect_set("w").alias("sw"))  # of a source's words those of the claims
    share = F.size(F.array_intersect("cw", "sw")) / F.col("n")
    good = pairs.join(asked, "claim_id").join(own, "source_id").withColumn("share", share).filter(F.col("share") >= limit)
    best = good.groupBy("claim_id").agg(F.max("share").alias("best"), F.count_distinct("source_id").alias("n_sources"))
    return asked.join(best, "claim_id", "left").select("claim_id", F.col("best").isNotNull().alias("supported"), "best", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def numbers(text: Column) -> Column:
    """Numbers of a text, with their decimals and percent signs."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d+(?:[.,]\d+)*%?)"), F.lit(1)))


def checked_numbers(text: Column) -> Column:
    """Numbers between word boundaries, with decimals after a point: those that are looked up in sources."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\d+(?:\.\d+)?%?\b"), F.lit(0)))


def quotes(text: Column) -> Column:
    """Quotations of over 20 characters."""
    return F.filter(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.length(q) > 20)


def dates(text: Column) -> Column:
    """Dates written like '3 de mayo de 2024'."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\d{1,2}\s+de\s+\w+\s+de\s+\d{4}\b"), F.lit(0))


def _findings(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))


def _any(text: Column, found: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in found])


def seo(title: Column, meta: Column, slug: Column, sections: Column, sources: Column, domains: Column, alt: Column, length: Column) -> tuple[Column, Column]:
    """Errors and warnings of an article's parts: counts of sections, sources and domains, lengths, and texts."""
    errors = {
        "title_short": F.length(title) < 30,
        "title_long": F.length(title) > 70,
        "meta_short": F.length(meta) < 120,
        "meta_long": F.length(meta) > 160,
        "slug_format": ~slug.rlike("^[a-z0-9-]+$"),
        "slug_long": F.length(slug) > 100,
        "slug_edge": slug.startswith("-") | slug.endswith("-"),
        "slug_double": F.contains(slug, F.lit("--")),
        "few_sections": sections < 2,
        "few_sources": sources < 2,
        "alt_short": F.length(alt) < 20,
        "alt_credit": ~F.contains(F.lower(alt), F.lit("cortesía")),
    }
    warnings = {
        "title_caps": (F.upper(title) == title) & title.rlike(r"\p{L}"),
        "title_separator": F.contains(title, F.lit(" | ")) | F.contains(title, F.lit(": ")),
        "meta_no_call": ~_any(meta, CALLS),
        "slug_short": F.length(slug) < 10,
        "content_short": length < 300,
        "content_long": length > 3000,
        "one_domain": domains < 2,
    }
    return _findings(errors), _findings(warnings)


def sentence_length(text: Column) -> Column:
    """Words per sentence; null without a sentence."""
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(squeeze(s)) != "")
    total = F.aggregate(F.transform(sentences, lambda s: F.size(F.split(squeeze(s), " "))), F.lit(0), lambda a, n: a + n)
    return F.when(F.size(sentences) > 0, total / F.size(sentences))


def readability(text: Column) -> tuple[Column, Column]:
    mean = sentence_length(text)
    return _findings({"no_sentences": mean.isNull()}), _findings({"sentences_long": mean > 25, "sentences_short": mean < 8})


def score(errors: Column, warnings: Column) -> Column:
    """0 to 50 with errors, 60 to 100 with warnings alone."""
    return F.when(F.size(errors) > 0, F.greatest(F.lit(0), 50 - 10 * F.size(errors))).otherwise(F.greatest(F.lit(60), 100 - 5 * F.size(warnings)))


def overall(claims: Column, seo_score: Column, quality: Column) -> Column:
    return 0.4 * claims + 0.35 * seo_score + 0.25 * quality
