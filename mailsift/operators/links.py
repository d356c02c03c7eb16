"""Links of messages: extraction, features of each link, and roll-ups to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import urls
from mailsift.functions.refdata import BRAND_DOMAINS
from mailsift.functions.text import brand_distance, edit_distance, fold_leet

NEAR = 3
ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a\s*>"""
BARE = r"""(?i)\b(?:https?://|www\.)[^\s<>"'`\]\)]+"""


def _found(h: Column) -> Column:
    anchors = F.arrays_zip(F.regexp_extract_all(h, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(h, F.lit(ANCHOR), 2).alias("label"))
    plain = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    bare = F.transform(F.regexp_extract_all(plain, F.lit(BARE), 0), lambda u: F.struct(F.rtrim(u, F.lit(".,;:!?)]}>'\"")).alias("href"), F.lit("").alias("label")))
    named = F.transform(anchors, lambda x: F.struct(x["href"].alias("href"), F.trim(F.regexp_replace(x["label"], "<[^>]*>", "")).alias("label")))
    return F.array_distinct(F.filter(F.concat(named, bare), lambda x: ~x["href"].rlike(r"(?i)^(mailto:|tel:|javascript:|#)")))


def hrefs(text: Column) -> Column:
    """Targets of a text's anchors and its bare URLs, first seen first."""
    return F.array_distinct(F.transform(_found(text), lambda x: x["href"]))


def extract(pages: DataFrame, id: str = "page_id", html: str = "html", base: str | None = "url") -> DataFrame:
    """(id, pos, href, label): anchors, then bare URLs of the text, first seen first, without duplicates.

    Mail, phone, script and fragment anchors are passed over; relative ones stand below the page's URL.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    out = pages.select(F.col(id), *([F.col(base).alias("_base")] if base else []), F.posexplode(_found(h)).alias("pos", "x"))
    href = F.col("x.href")
    if base:
        root = F.regexp_extract("_base", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
        href = F.when(F.startswith(href, F.lit("/")) & ~F.startswith(href, F.lit("//")), F.concat(root, href)).otherwise(href)
    return out.select(id, "pos", href.alias("href"), F.col("x.label").alias("label"))


def nearest_brands(domains: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, brand, distance): each distinct domain's nearest brand domain within three edits, else '' and 99.

    Plain edit distance, at most twice the one with swaps, thins out the brands first; ties go by name.
    """
    d = domains.select(F.col(domain).alias("domain")).filter("domain is not null and domain <> ''").distinct()
    near = F.filter(F.array(*(F.lit(b) for b in BRAND_DOMAINS)), lambda b: F.abs(F.char_length(b) - F.char_length("domain")) <= NEAR)
    pairs = d.select("domain", F.explode(near).alias("brand")).filter(F.levenshtein("domain", "brand", 2 * NEAR) >= 0)
    pairs = pairs.withColumn("distance", edit_distance("domain", "brand")).filter(F.col("distance") <= NEAR)
    best = pairs.groupBy("domain").agg(F.min(F.struct("distance", "brand")).alias("b"))
    return d.join(best, "domain", "left").select("domain", F.coalesce("b.brand", F.lit("")).alias("brand"), F.coalesce("b.distance", F.lit(99)).alias("distance"))


def link_features(links: DataFrame, id: str = "message_id", canonical: bool = True) -> DataFrame:
    """Each link with its signs."""
    x = links.select(id, "pos", F.col("href").alias("raw"), "label")
    x = urls.with_canonical(x, "raw", "url") if canonical else x.withColumn("url", urls.with_scheme(F.col("raw")))
    x = urls.with_parts(urls.with_parts(urls.settled(x), "url", "_c_"), "raw", "_r_")
    x = x.withColumn("domain", F.col("_c_registered_domain")).withColumn("_folded", fold_leet(F.col("domain")))
    x = x.withColumns({"_d1": brand_distance("domain"), "_d2": brand_distance("_folded")}).withColumn("_distance", F.least("_d1", "_d2"))
    signs, original = urls.shape(F.col("url"), "_c_"), urls.shape(F.col("raw"), "_r_")
    for k in ("has_userinfo", "is_shortener", "has_at_symbol", "is_punycode", "pct_encoding_ratio", "has_redirect_param"):
        signs[k] = original[k]
    signs["unwrap_changed_host"] = (F.col("_r_registered_domain") != F.col("domain")).cast("double")
    x = urls.with_deception(x.withColumns(signs), "_c_", "_distance")
    label = F.coalesce("label", F.lit(""))
    x = urls.with_brand_hits(x, {"_cl": label, "_ow": F.col("domain")}).withColumn("_sh", urls.host_of(label)).withColumn("_ss", urls.suffix_of(F.col("_sh")))
    looks = label.rlike(r"(?i)^\s*(https?://|www\.)")
    x = x.withColumn("text_shows_url_mismatch", (looks & (urls.registered_domain(F.col("_sh"), F.col("_ss")) != F.col("domain"))).cast("double"))
    x = x.withColumn("text_href_mismatch", ((F.size("_cl") > 0) & (F.size(F.array_intersect("_cl", "_ow")) == 0)).cast("double"))
    return x.select(id, "pos", "raw", "url", "label", "domain", *signs, *DECEPTION, "text_shows_url_mismatch", "text_href_mismatch")


DECEPTION = ("brand_in_subdomain", "brand_in_path", "brand_mismatch", "brand_lookalike", "lookalike_distance", "brand_squat", "brand_impersonation")
ANY = ("ip_host", "shortener", "punycode", "brand_mismatch", "free_hosting", "redirect_param", "at_symbol", "brand_lookalike", "brand_squat", "brand_impersonation")
_SIGN = {"ip_host": "is_ip_host", "shortener": "is_shortener", "punycode": "is_punycode", "redirect_param": "has_redirect_param", "at_symbol": "has_at_symbol"}


def _rolled() -> dict[str, Column]:
    """The roll-ups of a message's links, as aggregates."""
    n = F.count(F.lit(1)).cast("double")
    domains = F.countDistinct(F.when(F.col("domain") != "", F.col("domain")))
    return {
        "link_count": n,
        "link_unique_domains": domains.cast("double"),
        "link_max_risk_tld": F.max("high_risk_tld"),
        **{f"link_any_{k}": F.max(_SIGN.get(k, k)) for k in ANY},
        "link_min_lookalike_distance": F.min("lookalike_distance"),
        "link_official_brand_ratio": F.round(F.avg("official_brand_domain"), 6),
        "link_text_href_mismatch": F.sum("text_href_mismatch"),
        "link_text_shows_url_mismatch": F.sum("text_shows_url_mismatch"),
        "link_display_domain_mismatch": F.sum(F.col("text_href_mismatch") + F.col("text_shows_url_mismatch")),
        "link_max_suspicious_tokens": F.max("suspicious_token_count"),
        "link_mean_length": F.round(F.avg("length"), 6),
        "link_max_length": F.max("length"),
        "link_max_subdomains": F.max("num_subdomains"),
        "link_max_host_entropy": F.max("host_entropy"),
        "link_https_ratio": F.round(F.avg("is_https"), 6),
        "link_domain_diversity": F.round(domains / n, 6),
    }


def signs(features: DataFrame, id: str = "message_id") -> list[str]:
    """The names of the signs of each link."""
    return [c for c in features.columns if c not in (id, "pos", "raw", "url", "label", "domain")][:41]


def _extremes(names: list[str]) -> dict[str, Column]:
    return {f"url_{c}__{n}": F.round(f(c), 6) for f, n in ((F.max, "max"), (F.avg, "mean")) for c in names}


def rollup(features: DataFrame, id: str = "message_id") -> DataFrame:
    """One row of roll-ups for each message with links."""
    return features.groupBy(id).agg(*(v.alias(k) for k, v in _rolled().items()))


def neutral(x: DataFrame, names: list[str]) -> DataFrame:
    """What a message without links has: zeros, and 9 for the distances to brands."""
    return x.na.fill({c: 9.0 if "lookalike_distance" in c else 0.0 for c in names})


def message_links(messages: DataFrame, features: DataFrame, id: str = "message_id") -> DataFrame:
    """Roll-ups of every message."""
    x = messages.select(id).join(rollup(features, id), id, "left")
    return neutral(x, [c for c in x.columns if c != id])


def link_family(features: DataFrame, id: str = "message_id", only: set[str] | None = None) -> DataFrame:
    """The 107 link columns of each message with links (or those in ``only``): roll-ups, largest and mean values of all signs, in one aggregate."""
    found = {k: v for k, v in (_rolled() | _extremes(signs(features, id))).items() if only is None or k in only}
    return features.groupBy(id).agg(*(v.alias(k) for k, v in found.items())) if found else features.select(id).distinct()


def max_and_mean(features: DataFrame, id: str = "message_id") -> DataFrame:
    """The largest and the mean value of every sign of a message's links."""
    return features.groupBy(id).agg(*(v.alias(k) for k, v in _extremes(signs(features, id)).items()))
