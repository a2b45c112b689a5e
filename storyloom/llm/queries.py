"""The queries opN_<name>: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, language_id, license_scan, line_dedup, media, packing, quality, quality_rules, sharding, simhash_dedup, token_counts, whitening
from .store import small_batches


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles and at most four differing bits, as the query's contract fixes them."""
    found = simhash_dedup.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again; both results as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_docs(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of up to 2048 tokens; each piece's ids as a checksum."""
    found = packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def _remainder(by: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows whose remainder by 4 is not 2; predicted for all. A null doc_id is not held out."""
    docs = _docs(spark, sf_dir)
    model = language_id.fit(docs.filter(_remainder(4) != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels of ids whose remainder by 5 is not 0; all texts are scored."""
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_remainder(5) != 0)
    found = quality.score(docs, quality.fit(docs, labels))
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and its verdict by divergence from its language."""
    return quality_rules.judge(_docs(spark, sf_dir))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text, alone or within a paragraph, with its family."""
    docs = _docs(spark, sf_dir)
    found = license_scan.scan(docs, license_scan.fit(docs))
    return found.select("doc_id", "paragraph", "lines", "family", "probability", "similarity", F.sha2("text", 256).alias("text_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored in an ISO media file and read back by its sample tables."""
    return media.read_back(media.store_texts(_docs(spark, sf_dir)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards whose row counts differ by at most one."""
    found = sharding.assign(_docs(spark, sf_dir), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "links", "kept_links")


#: Sites on which a line is boilerplate.
SITES = 10


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least SITES sources share."""
    docs = _docs(spark, sf_dir)
    counts = line_dedup.free_name("counts", docs.columns)
    found = line_dedup.strip(docs, SITES, counts=counts)
    return found.select("doc_id", F.col(counts)["lines"].alias("n_lines"), F.col(counts)["removed"].alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


#: Tokens that a text may have.
LIMIT = 1024


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every whole text, and how much of it LIMIT tokens hold, both from the counts of its prefixes."""
    stored = token_counts.prefix_steps(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_counts.within(stored, LIMIT)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in its form, and what is restored from that; both as digests."""
    found = fill_in_middle.transform(_docs(spark, sf_dir))
    return found.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 first components of their covariance."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 16)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_media": op2_media,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op5_language_id": op5_language_id,
    "op7_quality": op7_quality,
    "op9_packing": op9_packing,
    "op6_bpe": op6_bpe,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
        b AS (SELECT bare FROM t WHERE bare <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}),
        j AS (SELECT t.doc_id, t.line, t.k, b.bare IS NOT NULL AS bad FROM t LEFT JOIN b USING (bare)),
        g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT bad), '') AS text FROM j GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(g.text) AS text_sha256 FROM documents d LEFT JOIN g USING (doc_id)""",
    "op12_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS x FROM documents),
        h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || x[17:24])::BIGINT AS c, ('0x' || x[25:32])::BIGINT AS d FROM t),
        f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c % 100 >= 50 THEN 'plain' WHEN d % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
