"""Fill-in-middle transformation by escaped marker injection, in Catalyst's string functions alone.

A delimiter is escaped in the text, a replacement by pattern appends it after every unit, its count is the number of units,
and the parts between two ranks are cut out by it; then the delimiters go and the escapes are taken back. Where a text
is cut and in which form it is written follows from a hash of seed and document number, so that a repeated run or a lost
executor's task gives the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a word with the blanks before it, or the blanks at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Neither is a blank, and an escaped one is a sign and a letter, so that escapes change no unit.
MARK, SIGN = "\x01", "\x02"
#: Of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SIGN), F.lit(SIGN + "b")), F.lit(MARK), F.lit(SIGN + "a"))


def _plain(marked: Column) -> Column:
    bare = F.replace(marked, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(SIGN + "a"), F.lit(MARK)), F.lit(SIGN + "b"), F.lit(SIGN))


def _parts(text: Column, mark: Column | str, count: Column | int) -> Column:
    """What stands before that many marks; of a negative count, what stands after so many from the end."""
    return F.call_function("substring_index", text, F.lit(mark), F.lit(count) if isinstance(count, int) else count)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n, form, prefix, middle, suffix, output`` of every whole text.

    ``n`` units; ``form`` is ``spm`` or ``psm`` for ``rate`` texts in a hundred, of which ``spm`` in a hundred are the first,
    and ``plain`` for the others, for empty texts and for those that hold one of the three strings; a plain text's output is
    the text, and its parts are null. Parts may be empty. A null text is an empty one; a null doc_id hashes as an empty
    string and stays null; equal rows give equal rows; an empty table gives no rows; other columns are not read; a text of
    any length is cut whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = rows.select("*", F.regexp_replace(_escaped(F.col("text")), F.lit(UNIT), F.lit("$0" + MARK)).alias("_marked"), digest.alias("_digest"))
    n = F.length("_marked") - F.length(F.replace(F.col("_marked"), F.lit(MARK), F.lit("")))
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    counted = marked.select("doc_id", "text", "_marked", n.cast("long").alias("n"), *[x.alias(f"_h{i}") for i, x in enumerate(h, 1)])
    held = reduce(lambda a, b: a | b, [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    form = F.when((F.col("text") == "") | held | (F.col("_h3") % 100 >= rate), "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    low, high = F.least(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)), F.greatest(F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1))
    ranked = counted.select("doc_id", "text", "_marked", F.col("n"), form.alias("form"), low.cast("int").alias("_low"), high.cast("int").alias("_high"))
    cut = F.col("form") != "plain"
    parts = ranked.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(cut, _plain(_parts(F.col("_marked"), MARK, F.col("_low")))).alias("prefix"),
        F.when(cut, _plain(_parts(_parts(F.col("_marked"), MARK, F.col("_high")), MARK, F.col("_low") - F.col("_high")))).alias("middle"),
        F.when(cut, _plain(_parts(F.col("_marked"), MARK, F.col("_high") - F.col("n").cast("int") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return parts.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        head = _parts(output, MIDDLE, 1)
        return F.substr(_parts(head, second, 1), F.lit(len(first) + 1)), _parts(head, second, -1), _parts(output, MIDDLE, -1)

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
