"""Rules of finished articles: claims against sources, search rules, quality, structure. Native columns.

An article is a row of ``title, lead, meta, slug, image_alt`` (texts), ``key_points`` (texts), ``sections``
(heading, content), ``faqs`` (question, answer), ``sources`` (url, title, text, domain; its own, a few) and the JSON-LD
fields ``headline, description, published, modified``. Findings are lists of short names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import STOPWORDS, keyword_tokens, shorten, squeeze, strip_tags, top_words
from storyloom.functions.url import authority
from storyloom.operators.validate import ANALYSIS, CLICKBAIT, INTRO, checked_numbers, dates, quotes, seo, sentence_length, words

# Words that no title may hold.
BANNED = ["increíble", "shocking", "no creerás", "secreto", "truco"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _findings(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))


def _numbered(items: Column, bad: Callable[[Column], Column], name: str) -> Column:
    """``name_1``, ``name_2`` ... of the bad ones."""
    marked = F.transform(items, lambda x, i: F.when(F.coalesce(bad(x), F.lit(False)), F.concat(F.lit(f"{name}_"), (i + 1).cast("string"))))
    return F.array_compact(F.coalesce(marked, F.array().cast("array<string>")))


def _shouted(text: Column) -> Column:
    return (F.upper(text) == text) & text.rlike(r"\p{L}")


def section_text() -> Column:
    """The sections' contents without tags, a space after each."""
    return F.array_join(F.transform("sections", lambda s: strip_tags(s["content"])), " ")


# ---- claims


def with_source_words(articles: DataFrame) -> DataFrame:
    """The articles with ``source_words``: of each source those distinct words that the article's claims have.

    So a source's own words are gone through once, and not for every claim.
    """
    answers = F.array_join(F.transform("faqs", lambda q: q["answer"]), " ")
    asked = words(F.concat_ws(" ", "title", "lead", F.array_join("key_points", " "), section_text(), answers))
    told = articles.withColumn("_asked", asked)
    return told.withColumn("source_words", F.transform("sources", lambda s: F.array_intersect(F.col("_asked"), words(s["text"])))).drop("_asked")


def supported(claim: Column, source_words: Column, limit: float) -> Column:
    """Whether a source has at least this share of a claim's words. A claim without words is supported by none."""
    share = lambda mine, w: F.size(F.array_intersect(mine, w)) / F.size(mine)
    return _let(words(claim), lambda mine: (F.size(mine) > 0) & F.exists(source_words, lambda w: share(mine, w) >= limit))


def missing_in_sources(found: Column, sources: Column, name: str, any_case: bool = False) -> Column:
    """The values that no source's text contains, as ``name:value``."""
    low = F.lower if any_case else (lambda x: x)
    gone = F.filter(F.array_distinct(found), lambda v: ~F.exists(sources, lambda s: F.contains(low(s["text"]), low(v))))
    return F.transform(gone, lambda v: F.concat(F.lit(f"{name}:"), F.substring(v, 1, 50)))


def claim_findings() -> tuple[Column, Column]:
    """Errors and warnings: parts without support, quotations, numbers and dates that no source has, clickbait.

    Of articles with their sources' words.
    """
    sources, held = F.col("sources"), F.col("source_words")
    whole = F.concat_ws(" ", "title", "lead", section_text(), F.array_join(F.transform("faqs", lambda q: F.concat_ws(" ", q["question"], q["answer"])), " "))
    errors = F.concat(
        _findings({"title_unsupported": ~supported(F.col("title"), held, 0.3), "lead_unsupported": ~supported(F.col("lead"), held, 0.4)}),
        _numbered(F.col("key_points"), lambda p: ~supported(p, held, 0.3), "point"),
        _numbered(F.col("sections"), lambda s: ~supported(strip_tags(s["content"]), held, 0.4), "section"),
        _numbered(F.col("faqs"), lambda q: ~supported(q["answer"], held, 0.4), "faq"),
        missing_in_sources(quotes(whole), sources, "quote", any_case=True),
    )
    bait = _findings({f"clickbait:{w}": F.contains(F.lower("title"), F.lit(w)) for w in CLICKBAIT})
    warnings = F.concat(bait, missing_in_sources(checked_numbers(whole), sources, "number"), missing_in_sources(dates(whole), sources, "date"))
    return errors, warnings


# ---- words by frequency


def with_keywords(articles: DataFrame, key: str) -> DataFrame:
    """The articles with ``keywords`` (ten of the whole text) and ``repeated`` (of the five most frequent words of title,
    lead and description those that come more than three times and aren't stop words)."""
    headed = F.array_join(F.transform("sections", lambda s: F.concat_ws(" ", s["heading"], strip_tags(s["content"]))), " ")
    whole = F.concat_ws(" ", "title", "lead", "meta", headed)
    told = squeeze(F.lower(F.concat_ws(" ", "title", "lead", "meta")))
    often = F.filter(top_words(F.array_remove(F.split(told, " "), ""), 5), lambda x: (x["n"] > 3) & ~x["word"].isin(STOPWORDS))
    none = F.array().cast("array<string>")
    names = lambda top: F.coalesce(F.transform(top, lambda x: x["word"]), none)
    return articles.withColumns({"keywords": names(top_words(keyword_tokens(whole), 10)), "repeated": names(often)})


# ---- search rules and quality, of articles with keywords


def seo_findings() -> tuple[Column, Column]:
    """All search rules: those of :func:`validate.seo` on real counts, headings, keywords and JSON-LD."""
    domains = F.array_distinct(F.transform("sources", lambda s: s["domain"]))
    errors, warnings = seo(F.col("title"), F.col("meta"), F.col("slug"), F.size("sections"), F.size("sources"), F.size(domains), F.col("image_alt"), F.length(section_text()) - F.greatest(F.size("sections") - 1, F.lit(0)))
    main = F.slice("keywords", 1, 3)
    fields = {f: F.coalesce(F.col(f), F.lit("")) == "" for f in ("headline", "description", "published", "modified")}
    more = F.concat(
        _numbered(F.col("sections"), lambda s: F.length(s["heading"]) < 5, "heading_short"),
        _numbered(F.col("sections"), lambda s: F.length(s["heading"]) > 120, "heading_long"),
        _numbered(F.col("sections"), lambda s: _shouted(s["heading"]), "heading_caps"),
        _findings(
            {
                "few_keywords": F.size("keywords") < 3,
                "keywords_not_in_title": ~F.arrays_overlap(words(F.col("title")), main),
                "keywords_not_in_meta": ~F.arrays_overlap(words(F.col("meta")), main),
                "headline_differs": F.coalesce("headline", F.lit("")) != F.col("title"),
            }
        ),
    )
    return F.concat(errors, _findings({f"json_ld_{f}": c for f, c in fields.items()})), F.concat(warnings, more)


def quality_findings() -> tuple[Column, Column]:
    """Sentence lengths, headings of context and of analysis, key points that the sections cover, repeated words."""
    mean = sentence_length(F.concat_ws(" ", "lead", section_text()))
    headings = F.transform("sections", lambda s: F.lower(s["heading"]))
    some = lambda text, found: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in found])
    asked, told = words(F.array_join("key_points", " ")), words(section_text())
    covered = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, told)) / F.size(asked)).otherwise(0.0)
    warnings = _findings(
        {
            "sentences_long": mean > 25,
            "sentences_short": mean < 8,
            "no_context": ~some(F.coalesce(F.get(headings, F.lit(0)), F.lit("")), INTRO),
            "no_analysis": ~some(F.array_join(headings, " "), ANALYSIS),
            "points_not_covered": covered < 0.5,
        }
    )
    repeated = F.when(F.size("repeated") > 0, F.array(F.concat(F.lit("repeated:"), F.array_join(F.slice("repeated", 1, 3), ",")))).otherwise(F.array().cast("array<string>"))
    return _findings({"no_sentences": mean.isNull()}), F.concat(warnings, repeated)


def suggestions(results: dict[str, tuple[Column, Column]], most: int = 5) -> Column:
    """Of each category its errors and its first two warnings; the first five of all."""

    def marked(found: Column, mark: str) -> Column:
        return F.transform(found, lambda x: F.concat(F.lit(f"[{mark}] "), x))

    parts = [p for name, (errors, warnings) in results.items() for p in (marked(errors, name.upper()), marked(F.slice(warnings, 1, 2), f"{name.upper()} WARNING"))]
    return F.slice(F.concat(*parts), 1, most)


# ---- rules of the article's parts


def model_findings() -> Column:
    """What makes an article invalid as such: lengths and counts of its parts, banned words, repeats, sources."""
    size = lambda c, lo, hi: ~F.length(c).between(lo, hi)
    points = F.transform("key_points", lambda p: F.lower(F.trim(p)))
    hosts = F.transform("sources", lambda s: F.lower(authority(s["url"])))
    return F.concat(
        _findings(
            {
                "title_length": size("title", 30, 70),
                "title_clickbait": reduce(lambda a, b: a | b, [F.contains(F.lower("title"), F.lit(w)) for w in BANNED]),
                "lead_length": size("lead", 120, 300),
                "points_count": ~F.size("key_points").between(3, 8),
                "points_repeated": F.size(F.array_distinct(points)) != F.size(points),
                "points_short": F.exists("key_points", lambda p: F.length(F.trim(p)) < 20),
                "sections_count": ~F.size("sections").between(2, 8),
                "section_heading": F.exists("sections", lambda s: size(s["heading"], 5, 120)),
                "section_content": F.exists("sections", lambda s: size(s["content"], 50, 2000)),
                "faqs_count": F.size("faqs") > 6,
                "faq_question": F.exists("faqs", lambda q: size(q["question"], 10, 200)),
                "faq_answer": F.exists("faqs", lambda q: size(q["answer"], 20, 1000)),
                "meta_length": size("meta", 120, 160),
                "slug_length": size("slug", 10, 100),
                "slug_format": ~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"),
                "headline_long": F.length("headline") > 110,
                "description_long": F.length("description") > 160,
                "alt_length": size("image_alt", 20, 150),
                "alt_credit": ~F.lower("image_alt").rlike("cortesía|courtesy"),
                "sources_count": ~F.size("sources").between(2, 15),
                "one_domain": F.size(F.array_distinct(hosts)) < 2,
                "domain_share": largest_share(hosts) > F.floor(F.size("sources") / 2),
            }
        )
    )


def largest_share(hosts: Column) -> Column:
    """How often the most frequent of a few values comes."""
    return F.coalesce(F.array_max(F.transform(hosts, lambda h: F.size(F.filter(hosts, lambda x: x == h)))), F.lit(0))


def compliance() -> Column:
    """A map of seven checks."""
    domains = F.size(F.array_distinct(F.transform("sources", lambda s: s["domain"])))
    content = F.aggregate("sections", F.lit(0), lambda n, s: n + F.length(s["content"]))
    checks = {
        "title_length": F.length("title").between(30, 70),
        "meta_description_length": F.length("meta").between(120, 160),
        "has_h2_sections": F.size("sections") >= 2,
        "source_diversity": domains >= 2,
        "minimum_content": content >= 300,
        "has_key_points": F.size("key_points") >= 3,
        "proper_attribution": F.contains(F.lower("image_alt"), F.lit("cortesía")),
    }
    return F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))])


def word_count() -> Column:
    """Words of title, lead, sections without tags, questions and answers."""
    told = F.concat_ws(" ", "title", "lead", section_text(), F.array_join(F.transform("faqs", lambda q: F.concat_ws(" ", q["question"], q["answer"])), " "))
    return F.size(F.array_remove(F.split(squeeze(told), " "), ""))


def reading_minutes(count: Column) -> Column:
    """250 words a minute, halves to the even minute, one at least."""
    return F.greatest(F.lit(1), F.bround(count / 250).cast("int"))


def cleaned_heading(heading: Column) -> Column:
    return F.regexp_replace(F.trim(heading), "[.!?]+$", "")


def as_question(question: Column) -> Column:
    return F.when(F.endswith(F.trim(question), F.lit("?")), question).otherwise(F.concat(F.trim(question), F.lit("?")))


def to_html() -> Column:
    """A plain page of the article, a line for each element."""
    line = lambda head, body, tail: F.concat(F.lit(head), body, F.lit(tail))
    listed = lambda head, items, tail: F.when(F.size(items) > 0, F.concat(F.array(*map(F.lit, head)), items, F.array(*map(F.lit, tail)))).otherwise(F.array().cast("array<string>"))
    points = F.transform("key_points", lambda p: line("<li>", p, "</li>"))
    sections = F.flatten(F.transform("sections", lambda s: F.array(F.lit("<section>"), line("<h2>", s["heading"], "</h2>"), line("<div>", s["content"], "</div>"), F.lit("</section>"))))
    faqs = F.flatten(F.transform("faqs", lambda q: F.array(F.lit("<div class='faq'>"), line("<h3>", q["question"], "</h3>"), line("<p>", q["answer"], "</p>"), F.lit("</div>"))))
    return F.array_join(
        F.concat(
            F.array(F.lit("<article>"), line("<h1>", F.col("title"), "</h1>"), line("<p class='lead'>", F.col("lead"), "</p>")),
            listed(["<div class='key-points'>", "<h2>Puntos Clave</h2>", "<ul>"], points, ["</ul>", "</div>"]),
            sections,
            listed(["<div class='faqs'>", "<h2>Preguntas Frecuentes</h2>"], faqs, ["</div>"]),
            F.array(F.lit("</article>")),
        ),
        "\n",
    )


def prepared_sources(sources: Column) -> Column:
    """The sources that have a URL, their texts cleaned of runs of white space, with the URL's host as domain."""
    plain = lambda x: squeeze(F.coalesce(x, F.lit("")))
    kept = F.filter(sources, lambda s: F.coalesce(s["url"], F.lit("")) != "")
    return F.transform(kept, lambda s: F.struct(s["url"].alias("url"), plain(s["title"]).alias("title"), plain(s["text"]).alias("text"), authority(s["url"]).alias("domain")))


DRAFT = "title string, lead string, key_points array<string>"


def draft(answer: Column, topic: Column, summary: Column) -> Column:
    """The article that a model's answer holds as JSON; where there is none with a title, one of topic and summary alone."""
    found = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1), DRAFT)
    plain = F.struct(topic.alias("title"), shorten(F.coalesce(summary, F.lit(""))).alias("lead"), F.array().cast("array<string>").alias("key_points"))
    return F.when(F.coalesce(found["title"], F.lit("")) != "", found).otherwise(plain)
