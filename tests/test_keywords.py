"""Keywords of all documents against the reference's pattern."""

import re
import unicodedata
from collections import Counter

import __spark_entry__ as entry
from storyloom.functions.text import STOPWORDS

DIR = "/root/testdata/sf0.001"


def top(text):
    words = re.findall(r"\b[a-záéíóúñü]+\b", unicodedata.normalize("NFC", text.lower()))
    return Counter(w for w in words if len(w) >= 3 and w not in STOPWORDS).most_common(10)


def against(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {(r.doc_id, r["rank"]): (r.keyword, r.n) for r in entry.queries()["keywords_topn"](spark, d).collect()}
    assert got == {(r.doc_id, k): x for r in rows if r.text for k, x in enumerate(top(r.text), 1)}
    return got


def test_every_document_has_its_keywords(spark):
    assert against(spark, DIR)


def test_accents_digits_tabs_and_nulls(spark, tmp_path):
    rows = [(1, "Él año canción canción\tniño día2 foo_bar élève abc9def straße plain"), (2, None), (3, ""), (4, "café café bar — “bar” été")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = against(spark, str(tmp_path))
    assert got[1, 1] == ("canción", 2) and got[4, 1] == ("café", 2)
