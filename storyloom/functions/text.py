"""Text functions: columns in, columns out."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from storyloom.functions.language import Profiles

# Spanish words that are no keywords.
STOPWORDS = (
    "el la de que y a en un es se no te lo le da su por son con para al del los las una como "
    "pero sus les me mi nos ni ya yo si muy más este esta esto ese esa eso aquel aquella aquello"
).split()


def missing(text: Column) -> Column:
    """Null for the empty string, which counts as missing everywhere."""
    return F.nullif(text, F.lit(""))


def tokens(text: Column) -> Column:
    """ASCII words and numbers in lower case; every other character parts them."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", " "), " +"), "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkd_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def clean(text: Column) -> Column:
    """NFKC, then white space squeezed. Only texts beyond ASCII go to Python."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return squeeze(F.when(ascii_only, text).otherwise(nfkc(F.when(~ascii_only, text))))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if not self.hidden:
            self.parts.append(data)


def text_of_html(source: str | None) -> str:
    """Visible text: scripts and styles dropped, entities decoded, blocks joined as they stand, white space squeezed."""
    if not source:
        return ""
    try:
        parser = _Text()
        parser.feed(source)
        parser.close()
        found = "".join(parser.parts)
    except Exception:  # a broken page is cleaned by pattern
        found = html.unescape(re.sub(r"<[^>]+>", "", source))
    return re.sub(r"\s+", " ", found).strip()


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of_html)


def slugify(ascii_text: Column, most: int = 80) -> Column:
    """A slug of text that has been through nfkd_ascii (or is ASCII); cut at the last hyphen if that is near the end."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(ascii_text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(joined, 1, most)
    at = most - F.instr(F.reverse(head), "-")  # place of the last hyphen, from 0; most if there is none
    short = F.when((F.instr(head, "-") > 0) & (at > most * 0.7), F.substring(head, F.lit(1), at)).otherwise(head)
    slug = F.when(F.length(joined) > most, short).otherwise(joined)
    return F.when(F.coalesce(ascii_text, F.lit("")) == "", "").otherwise(F.coalesce(missing(slug), F.lit("articulo")))


def _words_before(text: Column, length: int) -> Column:
    """The words of the first characters but the last, which may be cut."""
    words = F.array_remove(F.split(F.substring(text, 1, length), r"\s+"), "")
    return F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))


def clamp_length(text: Column, least: int, most: int, suffix: str = "...") -> Column:
    """Cut at the end of a first sentence, of a word, or hard; short texts stay."""
    text = F.coalesce(text, F.lit(""))
    target = most - len(suffix)
    first = F.get(F.split(F.substring(text, 1, target + 50), "[.!?]"), F.lit(0))
    sentence = F.when(F.substring(text, 1, target + 50).rlike("[.!?]") & (F.length(first) >= target * 0.7), F.concat(F.trim(first), F.lit(suffix)))
    words = _words_before(text, target + 20)
    word = F.when(F.length(words) <= target, F.concat(words, F.lit(suffix)))
    hard = F.concat(F.trim(F.substring(text, 1, target)), F.lit(suffix))
    return F.when((F.length(text) < least) | (F.length(text) <= most), text).otherwise(F.coalesce(sentence, word, hard))


def excerpt(text: Column, most: int = 160) -> Column:
    """Up to a sentence's end if that is past 60 %, else whole words, else a hard cut. The text is clean already."""
    text = F.coalesce(text, F.lit(""))
    head = F.substring(text, 1, most)
    end = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1))  # length up to the last end mark
    sentence = F.when(end - 1 > most * 0.6, F.trim(F.substring(text, F.lit(1), end)))
    words = _words_before(text, most + 20)
    word = F.when(F.length(words) <= most, F.concat(words, F.lit("...")))
    hard = F.concat(F.trim(F.substring(text, 1, most - 3)), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(sentence, word, hard))


def shorten(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_tokens(text: Column, least: int = 3) -> Column:
    """Words of at least ``least`` letters that aren't stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-záéíóúñü]+\b"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(STOPWORDS))


def top_words(found: Column, most: int) -> Column:
    """``array<struct<word, n>>``: the most frequent of a row's words, the first to come first among equals.

    The words are sorted with their places, and a word's number is the length of its run: nothing leaves the row."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    placed = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda r, k: F.when((k == 0) | (r["w"] != F.get(rows, k - 1)["w"]), k).otherwise(-1)), lambda k: k >= 0)
        return let(starts, lambda at: F.transform(at, lambda k, j: F.struct((k - F.coalesce(F.get(at, j + 1), F.size(rows))).alias("m"), F.get(rows, k)["i"].alias("i"), F.get(rows, k)["w"].alias("w"))))

    best = F.slice(F.sort_array(let(placed, runs)), 1, most)
    return F.transform(best, lambda x: F.struct(x["w"].alias("word"), (-x["m"]).cast("long").alias("n")))


# Frequent words of four languages, for guessing a short text's.
GUESS = {
    "de": "der die und das nicht ist mit von ein eine zu den für auf im".split(),
    "en": "the of and to in is that for it was with on as are this".split(),
    "es": "el la de que y en los del las por con una para es al".split(),
    "fr": "le la les des et est une du que pour dans qui au sur pas".split(),
}


def guess_language(text: Column, fallback: Column) -> Column:
    """The language with most of its frequent words in the text; the fallback for short texts and where none occurs."""
    words = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\s]", " ")), r"\s+")
    scores = F.array(*[F.struct(_hits(words, GUESS[k]).alias("n"), F.lit(k).alias("lang")) for k in sorted(GUESS, reverse=True)])
    best = F.array_max(scores)
    return F.when(F.length(squeeze(text)) < 20, fallback).when(best["n"] > 0, best["lang"]).otherwise(fallback)


def _hits(words: Column, mine: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(mine)))


def detect_language(title: Column, summary: Column, fallback: Column, profiles: Profiles | None = None) -> Column:
    """The language of title and summary, by profiles where some were learned, else by frequent words; the fallback where
    they are under 10 characters, or 20 when cleaned."""
    whole = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    if profiles is None:
        return F.when(F.length(whole) < 10, fallback).otherwise(guess_language(whole, fallback))
    return F.when((F.length(whole) < 10) | (F.length(squeeze(whole)) < 20), fallback).otherwise(profiles.guess(whole, fallback))


def hard_slug(ascii_text: Column, most: int = 80) -> Column:
    """A slug cut at ``most`` characters, wherever that is; the empty string where nothing is left."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(ascii_text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def embedding_text(title: Column, summary: Column) -> Column:
    """Title and summary for an embedding: joined by a space where there is a summary, then trimmed."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    return F.trim(F.when(s != "", F.concat(t, F.lit(" "), s)).otherwise(t))


def simhash_text(title: Column, summary: Column) -> Column:
    """Title and summary for a fingerprint: with a space between, whatever they are."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


# Tags that stay in sanitised HTML, and their attributes.
ALLOWED = {
    "p": [], "br": [], "strong": [], "b": [], "em": [], "i": [], "u": [], "ul": [], "ol": [], "li": [], "h2": [], "h3": [], "h4": [],
    "blockquote": ["cite"], "a": ["href", "title", "rel"], "span": ["class"], "div": ["class"],
}


class _Allowed(HTMLParser):
    def __init__(self, allowed: dict[str, list[str]]) -> None:
        super().__init__(convert_charrefs=True)
        self.allowed, self.parts = allowed, []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in self.allowed:
            kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs if k in self.allowed[tag] and not re.match(r"\s*(javascript|data|vbscript):", v or "", re.IGNORECASE))
            self.parts.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if tag in self.allowed and tag != "br":
            self.parts.append(f"</{tag}>")

    def handle_data(self, data):  # noqa: ANN001, ANN201
        self.parts.append(html.escape(data, quote=False))


def sanitised_html(source: str | None, allowed: dict[str, list[str]] | None = None) -> str:
    """HTML with the allowed tags and attributes alone; the text of other tags stays."""
    parser = _Allowed(ALLOWED if allowed is None else allowed)
    parser.feed(source or "")
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(StringType())
def sanitise(pages: pd.Series) -> pd.Series:
    return pages.map(sanitised_html)
