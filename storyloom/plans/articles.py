"""Queries on finished articles. A document stands for an article, and the two documents after it for its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import STOPWORDS
from storyloom.operators import articles, validate
from storyloom.plans.items import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def article_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an article. Its sources are found by number, so that both joins are plain equalities."""
    docs = table(spark, d, "documents")
    first = F.get(F.split("text", "\n"), F.lit(0))
    host = F.concat("source", F.lit(".org"))
    source = F.struct(F.concat(F.lit("http://"), host, F.lit("/"), "doc_id").alias("url"), first.alias("title"), F.col("text").alias("text"), host.alias("domain"))
    a = docs.select((F.col("doc_id") - 1).alias("doc_id"), source.alias("_a"))
    b = docs.select((F.col("doc_id") - 2).alias("doc_id"), source.alias("_b"))
    lines = F.split("text", "\n")
    joined = docs.join(a, "doc_id", "left").join(b, "doc_id", "left")
    return joined.select(
        "doc_id",
        first.alias("title"),
        F.substring("text", 1, 200).alias("lead"),
        F.substring("text", 1, 150).alias("meta"),
        F.concat(F.lit("doc-"), "doc_id").alias("slug"),
        F.concat(F.lit("Foto. Cortesía de "), "source").alias("image_alt"),
        F.transform(F.slice(lines, 1, 4), lambda x: F.substring(x, 1, 60)).alias("key_points"),
        F.transform(F.slice(lines, 1, 5), lambda x: F.struct(F.substring(x, 1, 30).alias("heading"), x.alias("content"))).alias("sections"),
        F.array(F.struct(F.substring("text", 3, 40).alias("question"), F.substring("text", 40, 100).alias("answer"))).alias("faqs"),
        F.array_compact(F.array("_a", "_b")).alias("sources"),
        F.when(F.col("doc_id") % 2 == 0, first).otherwise("").alias("headline"),
        F.substring("text", 1, 150).alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise("2024-01-30").alias("published"),
        F.lit("2024-01-31").alias("modified"),
    )


_HOST = "source || '.org'"
ART = f"""s0 AS (SELECT doc_id, {{'url': 'http://' || {_HOST} || '/' || doc_id, 'title': string_split(text, chr(10))[1], 'text': text, 'domain': {_HOST}, 'w': WORDS(text)}} AS s FROM documents),
    art AS (SELECT d.doc_id, string_split(text, chr(10))[1] AS title, left(text, 200) AS lead, left(text, 150) AS meta, 'doc-' || d.doc_id AS slug, 'Foto. Cortesía de ' || source AS image_alt,
        list_transform(string_split(text, chr(10))[1:4], lambda x: left(x, 60)) AS key_points, list_transform(string_split(text, chr(10))[1:5], lambda x: {{'heading': left(x, 30), 'content': x}}) AS sections,
        substr(text, 3, 40) AS question, substr(text, 40, 100) AS answer, list_filter([a.s, b.s], lambda x: x IS NOT NULL) AS sources,
        CASE WHEN d.doc_id % 2 = 0 THEN string_split(text, chr(10))[1] ELSE '' END AS headline, left(text, 150) AS description, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE '2024-01-30' END AS published
        FROM documents d LEFT JOIN s0 a ON a.doc_id = d.doc_id + 1 LEFT JOIN s0 b ON b.doc_id = d.doc_id + 2),
    parts AS (SELECT *, array_to_string(list_transform(sections, lambda s: regexp_replace(s.content, '<[^>]+>', '', 'g')), ' ') AS body FROM art),
    told AS (SELECT *, title || ' ' || lead || ' ' || body || ' ' || question || ' ' || answer AS whole FROM parts)"""


def _words(t: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({t}), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


ART = ART.replace("WORDS(text)", _words("text"))


def _supported(t: str, limit: float) -> str:
    w = _words(t)
    return f"(len({w}) > 0 AND len(list_filter(sources, lambda s: len(list_intersect({w}, s.w)) / len({w})::DOUBLE >= {limit})) > 0)"


def _numbered(items: str, bad: str, name: str) -> str:
    """``bad`` names the item x."""
    return f"list_filter(list_transform({items}, lambda x, i: CASE WHEN {bad} THEN '{name}_' || i END), lambda y: y IS NOT NULL)"


def _rules(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda y: y IS NOT NULL)"


def _missing(found: str, name: str, hit: str) -> str:
    return f"list_transform(list_filter(list_distinct({found}), lambda v: len(list_filter(sources, lambda s: {hit})) = 0), lambda v: '{name}:' || left(v, 50))"


def _concat(*lists: str) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


_CLAIM_ERRORS = _concat(
    _rules({"title_unsupported": f"NOT {_supported('title', 0.3)}", "lead_unsupported": f"NOT {_supported('lead', 0.4)}"}),
    _numbered("key_points", f"NOT {_supported('x', 0.3)}", "point"),
    _numbered("sections", "NOT " + _supported("regexp_replace(x.content, '<[^>]+>', '', 'g')", 0.4), "section"),
    f"CASE WHEN NOT {_supported('answer', 0.4)} THEN ['faq_1'] ELSE [] END",
    _missing("list_filter(regexp_extract_all(whole, '\"([^\"]+)\"', 1), lambda q: length(q) > 20)", "quote", "contains(lower(s.text), lower(v))"),
)
_CLAIM_WARNINGS = _concat(
    _rules({f"clickbait:{w}": f"contains(lower(title), '{w}')" for w in validate.CLICKBAIT}),
    _missing(r"regexp_extract_all(whole, '\b\d+(?:\.\d+)?%?\b')", "number", "contains(s.text, v)"),
    _missing(r"regexp_extract_all(whole, '\b\d{1,2}\s+de\s+\w+\s+de\s+\d{4}\b')", "date", "contains(s.text, v)"),
)


def _told(df: DataFrame, found: tuple) -> DataFrame:  # noqa: ANN001
    return df.select("doc_id", *[F.array_join(F.array_sort(c), ",").alias(n) for n, c in zip(("errors", "warnings"), found, strict=True)])


_SORTED = "array_to_string(list_sort(errors), ',') AS errors, array_to_string(list_sort(warnings), ',') AS warnings"
CLAIMS = f"claims AS (SELECT doc_id, {_CLAIM_ERRORS} AS errors, {_CLAIM_WARNINGS} AS warnings FROM told)"


@query(f"WITH {ART}, {CLAIMS} SELECT doc_id, {_SORTED} FROM claims")
def article_claims(spark: SparkSession, d: str) -> DataFrame:
    """Parts without support, and quotations, numbers and dates that no source has."""
    return _told(articles.with_source_words(article_rows(spark, d)), articles.claim_findings())


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_RUNS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-záéíóúñü]+') AND length(w) >= 3 AND w NOT IN ({}))"


def _top(name: str, words: str, k: int) -> str:
    return f"""{name}_w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, {words} AS l FROM parts)),
    {name}_c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM {name}_w GROUP BY ALL),
    {name} AS (SELECT doc_id, list({{'w': w, 'n': n}} ORDER BY n DESC, p)[1:{k}] AS top FROM {name}_c GROUP BY doc_id)"""


_HEADED = "array_to_string(list_transform(sections, lambda s: s.heading || ' ' || regexp_replace(s.content, '<[^>]+>', '', 'g')), ' ')"
KEYED = f"""{_top('kw', _RUNS.format("title || ' ' || lead || ' ' || meta || ' ' || " + _HEADED, _STOP), 10)},
    {_top('rp', "list_filter(string_split(trim(regexp_replace(lower(title || ' ' || lead || ' ' || meta), '" + chr(92) + "s+', ' ', 'g')), ' '), lambda w: w <> '')", 5)},
    keyed AS (SELECT t.*, coalesce(list_transform(kw.top, lambda x: x.w), []) AS keywords, coalesce(list_transform(list_filter(rp.top, lambda x: x.n > 3 AND x.w NOT IN ({_STOP})), lambda x: x.w), []) AS repeated
        FROM told t LEFT JOIN kw USING (doc_id) LEFT JOIN rp USING (doc_id))"""
_CAPS = "upper({0}) = {0} AND regexp_matches({0}, '\\p{{L}}')"
_CALL = " OR ".join(f"contains(lower(meta), '{w}')" for w in validate.CALLS)
_LENGTH = "list_sum(list_transform(sections, lambda s: length(regexp_replace(s.content, '<[^>]+>', '', 'g'))))"
_DOMAINS = "len(list_distinct(list_transform(sources, lambda s: s.domain)))"
_SEO_ERRORS = _rules(
    {
        "title_short": "length(title) < 30",
        "title_long": "length(title) > 70",
        "meta_short": "length(meta) < 120",
        "meta_long": "length(meta) > 160",
        "few_sections": "len(sections) < 2",
        "few_sources": "len(sources) < 2",
        "alt_short": "length(image_alt) < 20",
        "json_ld_headline": "headline = ''",
        "json_ld_description": "description = ''",
        "json_ld_published": "published = ''",
    }
)
_SEO_WARNINGS = _concat(
    _rules(
        {
            "title_caps": _CAPS.format("title"),
            "title_separator": "contains(title, ' | ') OR contains(title, ': ')",
            "meta_no_call": f"NOT ({_CALL})",
            "slug_short": "length(slug) < 10",
            "content_short": f"{_LENGTH} < 300",
            "content_long": f"{_LENGTH} > 3000",
            "one_domain": f"{_DOMAINS} < 2",
            "few_keywords": "len(keywords) < 3",
            "keywords_not_in_title": f"NOT list_has_any({_words('title')}, keywords[1:3])",
            "keywords_not_in_meta": f"NOT list_has_any({_words('meta')}, keywords[1:3])",
            "headline_differs": "headline <> title",
        }
    ),
    _numbered("sections", "length(x.heading) < 5", "heading_short"),
    _numbered("sections", "length(x.heading) > 120", "heading_long"),
    _numbered("sections", _CAPS.format("x.heading"), "heading_caps"),
)
SEO = f"seo AS (SELECT doc_id, {_SEO_ERRORS} AS errors, {_SEO_WARNINGS} AS warnings FROM keyed)"


@query(f"WITH {ART}, {KEYED}, {SEO} SELECT doc_id, {_SORTED} FROM seo")
def article_seo(spark: SparkSession, d: str) -> DataFrame:
    """All search rules, headings, keywords and JSON-LD among them, on the article's own counts."""
    return _told(articles.with_keywords(article_rows(spark, d), "doc_id"), articles.seo_findings())


_HEADINGS = "lower(array_to_string(list_transform(sections, lambda s: s.heading), ' '))"
_SENTENCES = r"list_filter(list_transform(string_split_regex(lead || ' ' || body, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
_MEAN = f"(list_sum(list_transform({_SENTENCES}, lambda x: len(string_split(x, ' ')))) / len({_SENTENCES})::DOUBLE)"
_POINTS = _words("array_to_string(key_points, ' ')")
_QUALITY_WARNINGS = _concat(
    _rules(
        {
            "sentences_long": f"{_MEAN} > 25",
            "sentences_short": f"{_MEAN} < 8",
            "no_context": "NOT (" + " OR ".join(f"contains(lower(sections[1].heading), '{w}')" for w in validate.INTRO) + ")",
            "no_analysis": "NOT (" + " OR ".join(f"contains({_HEADINGS}, '{w}')" for w in validate.ANALYSIS) + ")",
            "points_not_covered": f"coalesce(len(list_intersect({_POINTS}, {_words('body')})) / nullif(len({_POINTS}), 0)::DOUBLE, 0.0) < 0.5",
        }
    ),
    "CASE WHEN len(repeated) > 0 THEN ['repeated:' || array_to_string(repeated[1:3], ',')] ELSE [] END",
)
QUALITY = f"quality AS (SELECT doc_id, CASE WHEN len({_SENTENCES}) = 0 THEN ['no_sentences'] ELSE []::VARCHAR[] END AS errors, {_QUALITY_WARNINGS} AS warnings FROM keyed)"


@query(f"WITH {ART}, {KEYED}, {QUALITY} SELECT doc_id, {_SORTED} FROM quality")
def article_quality(spark: SparkSession, d: str) -> DataFrame:
    """Sentence lengths, headings, key points that are covered, words that come too often."""
    return _told(articles.with_keywords(article_rows(spark, d), "doc_id"), articles.quality_findings())


_SCORE = "CASE WHEN len({0}.errors) > 0 THEN greatest(0, 50 - 10 * len({0}.errors)) ELSE greatest(60, 100 - 5 * len({0}.warnings)) END::INT"
_SUGGEST = _concat(*[x for n in ("claims", "seo", "quality") for x in (f"list_transform({n}.errors, lambda e: '[{n.upper()}] ' || e)", f"list_transform({n}.warnings[1:2], lambda w: '[{n.upper()} WARNING] ' || w)")])


@query(f"""WITH {ART}, {KEYED}, {CLAIMS}, {SEO}, {QUALITY}, v AS (SELECT claims.doc_id, {_SCORE.format('claims')} AS claims_score, {_SCORE.format('seo')} AS seo_score, {_SCORE.format('quality')} AS quality_score,
        len(claims.errors) + len(seo.errors) + len(quality.errors) AS n_errors, len({_SUGGEST}[1:5]) AS n_suggestions, ({_SUGGEST})[1] AS first_suggestion FROM claims JOIN seo USING (doc_id) JOIN quality USING (doc_id))
    SELECT *, round(0.4 * claims_score + 0.35 * seo_score + 0.25 * quality_score, 6)::DOUBLE AS overall FROM v""")
def article_validation(spark: SparkSession, d: str) -> DataFrame:
    """The three validators at once: scores, their weighted sum, and suggestions."""
    rows = articles.with_keywords(articles.with_source_words(article_rows(spark, d)), "doc_id")
    claims, seo, quality = articles.claim_findings(), articles.seo_findings(), articles.quality_findings()
    names = ("claims", "seo", "quality")
    held = rows.select("doc_id", *[c.alias(f"{n}_{k}") for n, f in zip(names, (claims, seo, quality), strict=True) for k, c in zip(("errors", "warnings"), f, strict=True)])
    scores = {n: validate.score(F.col(f"{n}_errors"), F.col(f"{n}_warnings")) for n in names}
    told = articles.suggestions({n: (F.col(f"{n}_errors"), F.col(f"{n}_warnings")) for n in names})
    out = held.select("doc_id", *[c.alias(f"{n}_score") for n, c in scores.items()], sum((F.size(f"{n}_errors") for n in names), F.lit(0)).alias("n_errors"), F.size(told).alias("n_suggestions"), F.get(told, F.lit(0)).alias("first_suggestion"))
    return out.withColumn("overall", F.round(validate.overall(F.col("claims_score"), F.col("seo_score"), F.col("quality_score")), 6))


_POINT = "list_transform(key_points, lambda p: lower(trim(p)))"
_HOSTS = "list_transform(sources, lambda s: s.domain)"
_MODEL = _rules(
    {
        "title_length": "NOT length(title) BETWEEN 30 AND 70",
        "title_clickbait": " OR ".join(f"contains(lower(title), '{w}')" for w in articles.BANNED),
        "lead_length": "NOT length(lead) BETWEEN 120 AND 300",
        "points_count": "NOT len(key_points) BETWEEN 3 AND 8",
        "points_repeated": f"len(list_distinct({_POINT})) <> len(key_points)",
        "points_short": "len(list_filter(key_points, lambda p: length(trim(p)) < 20)) > 0",
        "sections_count": "NOT len(sections) BETWEEN 2 AND 8",
        "section_heading": "len(list_filter(sections, lambda s: NOT length(s.heading) BETWEEN 5 AND 120)) > 0",
        "section_content": "len(list_filter(sections, lambda s: NOT length(s.content) BETWEEN 50 AND 2000)) > 0",
        "faq_question": "NOT length(question) BETWEEN 10 AND 200",
        "faq_answer": "NOT length(answer) BETWEEN 20 AND 1000",
        "meta_length": "NOT length(meta) BETWEEN 120 AND 160",
        "slug_length": "NOT length(slug) BETWEEN 10 AND 100",
        "headline_long": "length(headline) > 110",
        "alt_length": "NOT length(image_alt) BETWEEN 20 AND 150",
        "sources_count": "NOT len(sources) BETWEEN 2 AND 15",
        "one_domain": f"{_DOMAINS} < 2",
        "domain_share": f"coalesce(list_max(list_transform({_HOSTS}, lambda h: len(list_filter({_HOSTS}, lambda y: y = h)))), 0) > len(sources) // 2",
    }
)


@query(f"WITH {ART} SELECT doc_id, array_to_string(list_sort({_MODEL}), ',') AS findings, length(replace(title, ' ', '')) AS letters FROM parts")
def article_model(spark: SparkSession, d: str) -> DataFrame:
    """What makes an article invalid as such."""
    return article_rows(spark, d).select("doc_id", F.array_join(F.array_sort(articles.model_findings()), ",").alias("findings"), F.length(F.replace("title", F.lit(" "), F.lit(""))).alias("letters"))


@query(rf"""WITH {ART}, c AS (SELECT *, len(list_filter(string_split(trim(regexp_replace(whole, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n FROM told)
    SELECT doc_id, n AS words, greatest(1, round_even(n / 250.0, 0))::INT AS minutes, length(title) BETWEEN 30 AND 70 AS title_length, length(meta) BETWEEN 120 AND 160 AS meta_description_length, len(sections) >= 2 AS has_h2_sections, {_DOMAINS} >= 2 AS source_diversity,
        list_sum(list_transform(sections, lambda s: length(s.content))) >= 300 AS minimum_content, len(key_points) >= 3 AS has_key_points, true AS proper_attribution FROM c""")
def article_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Seven checks, words and minutes of reading."""
    rows = article_rows(spark, d).select("doc_id", articles.word_count().alias("words"), articles.compliance().alias("m"))
    names = ["title_length", "meta_description_length", "has_h2_sections", "source_diversity", "minimum_content", "has_key_points", "proper_attribution"]
    return rows.select("doc_id", "words", articles.reading_minutes(F.col("words")).alias("minutes"), *[F.col("m")[n].alias(n) for n in names])


_LI = "list_transform(key_points, lambda p: '<li>' || p || '</li>')"
_PAGE = _concat(
    "['<article>', '<h1>' || title || '</h1>', '<p class=''lead''>' || lead || '</p>', '<div class=''key-points''>', '<h2>Puntos Clave</h2>', '<ul>']",
    _LI,
    "['</ul>', '</div>']",
    "flatten(list_transform(sections, lambda s: ['<section>', '<h2>' || s.heading || '</h2>', '<div>' || s.content || '</div>', '</section>']))",
    "['<div class=''faqs''>', '<h2>Preguntas Frecuentes</h2>', '<div class=''faq''>', '<h3>' || question || '</h3>', '<p>' || answer || '</p>', '</div>', '</div>', '</article>']",
)


@query(f"WITH {ART} SELECT doc_id, array_to_string({_PAGE}, chr(10)) AS page FROM parts")
def article_html(spark: SparkSession, d: str) -> DataFrame:
    """A plain page of every article."""
    return article_rows(spark, d).select("doc_id", articles.to_html().alias("page"))


@query(rf"""WITH {ART}, e AS (SELECT doc_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS place FROM art)
    SELECT doc_id, place - 1 AS place, s.url AS url, trim(regexp_replace(s.title, '\s+', ' ', 'g')) AS title, s.domain AS domain, length(trim(regexp_replace(s.text, '\s+', ' ', 'g'))) AS n FROM e""")
def article_sources(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned sources of every article."""
    rows = article_rows(spark, d).select("doc_id", F.posexplode(articles.prepared_sources(F.col("sources"))).alias("place", "s"))
    return rows.select("doc_id", "place", "s.url", "s.title", "s.domain", F.length("s.text").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 3 <> 0 THEN 'x' WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS lead, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS points FROM documents""")
def article_draft(spark: SparkSession, d: str) -> DataFrame:
    """Drafts from answers that hold JSON amid other words; every third holds none."""
    docs = table(spark, d, "documents")
    said = F.concat(F.lit('Sure. {"title": "Title '), "doc_id", F.lit('", "lead": "x", "key_points": ["a", "b"]} Done.'))
    answer = F.when(F.col("doc_id") % 3 != 0, said).otherwise("I cannot {write} that.")
    found = docs.select("doc_id", articles.draft(answer, F.col("source"), F.col("text")).alias("a"))
    return found.select("doc_id", "a.title", "a.lead", F.size("a.key_points").alias("points"))
