"""Quality rules: repetition and symbol counts, and divergence from a language's usual text. Catalyst only.

Two histograms describe a document: the shares of six character classes, and the shares of its language's common words
among its words (with one bin for all others). A language's reference is the mean histogram of all its documents that
pass the base rules. A document fails if the Jensen-Shannon distance (base 2, so from 0 to 1) of a histogram from the
reference exceeds the histogram's limit, and it has enough words for that histogram to be judged. The means are over the documents at hand: what most of them are
like is usual, so a table of bad documents alone has no good reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

# Common words of the languages that have references.
COMMON = {
    "de": "als am auch auf aus bei das dem den der des die ein eine einer für im in ist mit nach nicht sich sie und von war wird zu zur".split(),
    "en": "a an and are as at be but by for from he his in is it not of on or that the this to was were which with you".split(),
    "es": "a al como con de del el en es esta ha la las lo los más no o para pero por que se sin su sus un una y".split(),
    "fr": "a au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour qui que se son sur un une".split(),
}
CLASSES = ("lower", "space", "upper", "digit", "punctuation", "other")
#: Limits of the distances, and the words that a text must have to be judged by each.
CHAR_LIMIT, WORD_LIMIT, CHAR_LEAST, WORD_LEAST = 0.27, 0.33, 50, 100
#: Languages whose references are broadcast: some MB.
LANGUAGES = 10_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_words(found: Column) -> Column:
    """Words that lie in a 3-word window which the text has at least twice."""

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(spans, F.lit(0), lambda a, n: a + n)

    def places(rows: Column) -> Column:
        twin = lambda x, j: F.coalesce(x["h"] == F.get(rows, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"]))

    def count(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(rows, lambda r: _let(places(r), covered)))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return _let(found, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows(w), count))).cast("long")


def _classes(text: Column) -> Column:
    """Counts of CLASSES among the code points: each class is taken out of what the earlier ones left."""
    rest, out = text, []
    for pattern in ("[\\p{Ll}]+", "[\\s]+", "[\\p{L}]+", "[\\p{N}]+", "[.,;:!?'\"()\\-]+"):
        out.append(rest)
        rest = F.regexp_replace(rest, pattern, "")
    out.append(rest)
    return F.array(*[F.length(a) - F.length(b) for a, b in zip(out, out[1:], strict=False)], F.length(rest))


def _common(found: Column, lang: Column) -> Column:
    """Counts of the language's common words among the words without their punctuation, and of the others; else null."""
    bare = lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))

    def of(language: str) -> Column:
        mine = COMMON[language]
        k = len(mine)
        # the words' places in the list (0: not in it), and every place once more, in order: a place's number is how far its
        # first one stands from that of the next place, less the one that was added
        places = F.transform(found, lambda w: F.array_position(F.array(*map(F.lit, mine)), bare(w)).cast("int"))
        ordered = F.sort_array(F.concat(places, F.sequence(F.lit(0), F.lit(k + 1))))
        at = lambda line, i: F.array_position(line, i).cast("int")
        count = lambda line, i: at(line, i + 1) - at(line, i) - 1
        return _let(ordered, lambda line: F.concat(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: count(line, i)), F.array(count(line, F.lit(0)))))

    return reduce(lambda out, k: out.when(lang == k, of(k)), list(COMMON)[1:], F.when(lang == next(iter(COMMON)), of(next(iter(COMMON)))))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang``, the base counts, ``base_failed`` and the two histograms (counts) of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"), words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = base.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        _classes(F.col("text")).alias("chars"),
        _common(F.col("words"), F.col("lang")).alias("common"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    return F.transform(counts, lambda n: n / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    each = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.when(total < 0, 0.0).otherwise(total))


def references(found: DataFrame) -> DataFrame:
    """Mean shares of the documents of each language that pass the base rules; of common words for the languages of COMMON."""
    some = found.filter(~F.col("base_failed") & F.col("lang").isNotNull()).select("lang", _shares(F.col("chars")).alias("p"), _shares(F.col("common")).alias("w"))
    longest = max(map(len, COMMON.values())) + 1
    means = some.groupBy("lang").agg(*[F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(len(CLASSES))], *[F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(longest)])
    listed = F.array_compact(F.array(*[f"w{i}" for i in range(longest)]))
    return means.select("lang", F.array(*[f"p{i}" for i in range(len(CLASSES))]).alias("ref_chars"), F.when(F.size(listed) > 0, listed).alias("ref_common"))


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, n_words``, the base counts, ``base_failed, char_distance, word_distance, kept``.

    Null and empty texts have no words and fail the base rules. A document whose language is null, or which is
    too short, has null distances and is kept if it passes the base rules; in a language without a list of common words it
    is judged by its character classes alone. Equal rows get equal results, a
    null doc_id stays null, an empty table gives no rows, columns other than the three named ones are not read.
    """
    found = cut(features(docs, id_col, text_col, lang_col), "features")
    usual = cut(references(found), "references")
    joined = found.join(F.broadcast(usual) if usual.count() <= LANGUAGES else usual, "lang", "left")
    chars = F.when(F.col("n_words") >= CHAR_LEAST, js_distance(_shares(F.col("chars")), F.col("ref_chars")))
    common = F.when(F.col("n_words") >= WORD_LEAST, js_distance(_shares(F.col("common")), F.col("ref_common")))
    out = joined.withColumn("char_distance", chars).withColumn("word_distance", common)
    far = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
