"""Article rules, one by one, on a made-up article."""

import pytest
from pyspark.sql import functions as F

from storyloom.operators import articles as A

SCHEMA = (
    "id long, title string, lead string, meta string, slug string, image_alt string, key_points array<string>, sections array<struct<heading:string,content:string>>, "
    "faqs array<struct<question:string,answer:string>>, sources array<struct<url:string,title:string,text:string,domain:string>>, headline string, description string, published string, modified string"
)
TEXT = "El puerto abrió el 3 de mayo de 2024 con 250 barcos y el alcalde dijo \"esto cambia la vida de toda la ciudad\" ante la prensa local reunida"


def article(**changes):
    row = {
        "id": 1,
        "title": "El puerto abrió con barcos y prensa local",
        "lead": "El puerto abrió el 3 de mayo de 2024 con 250 barcos y el alcalde dijo ante la prensa local reunida " + "que el puerto abrió con barcos.",
        "meta": "Descubre el puerto que abrió con barcos: " + "el puerto abrió con barcos ante la prensa local reunida, " * 2,
        "slug": "el-puerto-abrio",
        "image_alt": "Vista del puerto. Cortesía de la ciudad",
        "key_points": ["El puerto abrió con 250 barcos", "El alcalde dijo ante la prensa local", "La prensa local reunida con barcos"],
        "sections": [("Contexto del puerto", "<p>" + TEXT + ".</p>"), ("Impacto local", "<p>" + TEXT + ".</p>")],
        "faqs": [("¿Cuándo abrió el puerto?", "El puerto abrió el 3 de mayo de 2024")],
        "sources": [("http://a.org/1", "Puerto", TEXT, "a.org"), ("http://b.org/2", "Barcos", TEXT, "b.org")],
        "headline": "El puerto abrió con barcos y prensa local",
        "description": "El puerto",
        "published": "2024-05-03",
        "modified": "2024-05-03",
    }
    return tuple((row | changes).values())


@pytest.fixture(scope="module")
def findings(spark):
    def run(column, **changes):
        rows = A.with_keywords(A.with_source_words(spark.createDataFrame([article(**changes)], SCHEMA)), "id")
        return rows.select(column().alias("c") if not isinstance(column(), tuple) else F.concat(*column()).alias("c")).first().c

    return run


def test_a_sound_article_has_no_claim_findings(findings):
    assert findings(A.claim_findings) == []


@pytest.mark.parametrize(
    ("changes", "finding"),
    [
        ({"title": "Una luna verde cayó sobre montes nevados ayer"}, "title_unsupported"),
        ({"lead": "Nada de aquello sucedió nunca jamás según otros testigos presentes allá"}, "lead_unsupported"),
        ({"key_points": ["El puerto abrió con 250 barcos", "Luna verde sobre montes nevados"]}, "point_2"),
        ({"sections": [("Contexto", "<b>Luna verde sobre montes nevados</b>")]}, "section_1"),
        ({"faqs": [("¿Qué pasó?", "Luna verde sobre montes nevados")]}, "faq_1"),
        ({"faqs": [("¿Qué?", 'El puerto abrió el 3 de mayo "nunca dijo nadie estas palabras aquí" de 2024 con barcos')]}, "quote:nunca dijo nadie estas palabras aquí"),
        ({"faqs": [("¿Cuántos?", "El puerto abrió con 999.5 barcos el 3")]}, "number:999.5"),
        ({"faqs": [("¿Cuándo?", "El puerto abrió el 4 de mayo de 2023")]}, "date:4 de mayo de 2023"),
        ({"title": "El increíble puerto abrió con barcos y prensa"}, "clickbait:increíble"),
    ],
)
def test_claims(findings, changes, finding):
    assert finding in findings(A.claim_findings, **changes)


@pytest.mark.parametrize(
    ("changes", "finding"),
    [
        ({"headline": ""}, "json_ld_headline"),
        ({"headline": "Otro"}, "headline_differs"),
        ({"published": None}, "json_ld_published"),
        ({"sections": [("Uno", "x"), ("Contexto", "y")]}, "heading_short_1"),
        ({"sections": [("Contexto", "x"), ("IMPACTO LOCAL", "y")]}, "heading_caps_2"),
        ({"sections": [("Contexto", "x"), ("z" * 121, "y")]}, "heading_long_2"),
        ({"title": "Nada de lo dicho arriba figura ahora aquí"}, "keywords_not_in_title"),
        ({"sources": [("http://a.org/1", "P", TEXT, "a.org")]}, "few_sources"),
        ({"sources": [("http://a.org/1", "P", TEXT, "a.org")] * 2}, "one_domain"),
    ],
)
def test_search_rules(findings, changes, finding):
    found = findings(A.seo_findings, **changes)
    assert finding in found
    assert not {"few_sources", "one_domain", "json_ld_headline"} & set(findings(A.seo_findings))


def test_quality_rules(findings):
    assert findings(A.quality_findings, sections=[("Contexto", "Puerto barcos."), ("Fin", "Prensa.")])
    base = findings(A.quality_findings)
    assert "no_context" not in base and "no_analysis" not in base and "points_not_covered" not in base
    assert "no_context" in findings(A.quality_findings, sections=[("Nada", TEXT), ("Impacto", TEXT)])
    assert "points_not_covered" in findings(A.quality_findings, key_points=["luna verde sobre montes nevados"])
    repeated = [x for x in findings(A.quality_findings, lead="barcos " * 9) if x.startswith("repeated:")]
    assert repeated and "barcos" in repeated[0]


def test_model_rules(findings):
    # the two sources are of two hosts, one each: the share of one is not over half
    assert findings(A.model_findings, meta="m" * 130) == []
    assert set(findings(A.model_findings, meta="m" * 130, slug="-bad--slug-", key_points=["Same point of some length"] * 2)) == {"slug_format", "points_count", "points_repeated"}
    three = [("http://a.org/1", "P", TEXT, "a.org"), ("http://a.org/2", "P", TEXT, "a.org"), ("http://b.org/2", "P", TEXT, "b.org")]
    assert findings(A.model_findings, meta="m" * 130, sources=three) == ["domain_share"]


def test_page_words_and_suggestions(spark):
    df = A.with_keywords(spark.createDataFrame([article(key_points=[], faqs=[], sections=[("H", "<i>a b</i>")])], SCHEMA), "id")
    r = df.select(A.to_html().alias("page"), A.word_count().alias("n"), A.reading_minutes(F.lit(625)).alias("even"), A.reading_minutes(F.lit(10)).alias("least"), A.as_question(F.lit(" Why ")).alias("q"), A.cleaned_heading(F.lit(" Title?! ")).alias("h")).first()
    lead, title = article()[2], article()[1]
    assert r.page == "\n".join(["<article>", f"<h1>{title}</h1>", f"<p class='lead'>{lead}</p>", "<section>", "<h2>H</h2>", "<div><i>a b</i></div>", "</section>", "</article>"])
    assert r.n == len(f"{title} {lead} a b".split()) and (r.even, r.least, r.q, r.h) == (2, 1, "Why?", "Title")
    arr = lambda *x: F.array(*map(F.lit, x))
    got = spark.range(1).select(A.suggestions({"seo": (arr("e1", "e2"), arr("w1", "w2", "w3")), "quality": (arr("e3"), arr("w4"))}).alias("s")).first().s
    assert got == ["[SEO] e1", "[SEO] e2", "[SEO WARNING] w1", "[SEO WARNING] w2", "[QUALITY] e3"]
