"""URL functions, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid twclid _ga _gl ref referrer source campaign_id ad_id cmpid cid eid ncid mc_cid mc_eid"
).split()
BLOCKED = ["localhost", "127.0.0.1", "0.0.0.0"]


def authority(url: Column) -> Column:
    """Host with port and user, as written; the empty string if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    return F.lower(authority(url))


def normalize(url: Column) -> Column:
    """No fragment, no tracking parameters, no blank values; parameters sorted by name, their values in order.

    Values are decoded and encoded again, so that equal ones are spelt alike. Scheme in lower case; all else as it was.
    """
    text = F.trim(F.coalesce(url, F.lit("")))
    whole = F.regexp_replace(text, "(?s)#.*$", "")
    base = F.regexp_extract(whole, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(whole, r"(?s)\?(.*)$", 1)
    parts = F.transform(F.split(query, "&"), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))
    kept = F.filter(parts, lambda p: F.coalesce((p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING), F.lit(False)))
    indexed = F.array_sort(F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    joined = F.array_join(F.transform(indexed, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    lowered = F.concat(F.lower(scheme), F.substring(base, F.length(scheme) + 1, F.length(base)))
    return F.when(joined == "", lowered).otherwise(F.concat(lowered, F.lit("?"), joined))


def sha1(url: Column) -> Column:
    """Hex SHA-1 of the normalised URL; the empty string for a missing one."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.sha1(normalize(url)))


def safe(url: Column) -> Column:
    host = domain(url)
    blocked = F.lit(False)
    for b in BLOCKED:
        blocked = blocked | F.contains(host, F.lit(b))
    return F.coalesce(url, F.lit("")).rlike("^https?://") & (host != "") & ~blocked
