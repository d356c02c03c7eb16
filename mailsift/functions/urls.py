"""URL functions on columns: a permissive parse, canonical form, 41 signs and the click-time score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .refdata import BRAND_DOMAINS, BRANDS, CLICK_WEIGHTS, FREE_HOSTING, OFFICIAL, PATH_TOKENS, PATH_WEIGHT, PLAIN, REDIRECT_PARAMS, RISKY_TLDS, SHORTENERS, SUFFIXES
from .text import among, entropy, fold_confusables, fold_leet, kept, listed, mixed_script_words, strings

URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def with_scheme(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u == "", "").when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), u).otherwise(F.concat(F.lit("http://"), u))


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port or closing dot."""
    return _host(F.regexp_extract(with_scheme(url), URL, 2))


def _host(authority: Column) -> Column:
    server = F.substring_index(authority, "@", -1)
    host = F.when(F.startswith(server, F.lit("[")), F.regexp_extract(server, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(server, ":", 1))
    return F.btrim(F.lower(host), F.lit("."))


def suffix_of(host: Column) -> Column:
    """The public suffix: three labels before two before one; addresses and single labels have none."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    three, two = (F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".") for k in (3, 2))
    last = F.element_at(labels, -1)
    plain = host.rlike(IPV4) | F.contains(host, F.lit(":")) | (n < 2)
    return F.when(plain, "").when((n > 3) & among(three, SUFFIXES), three).when((n > 2) & among(two, SUFFIXES), two).otherwise(last)


def registered_domain(host: Column, suffix: Column) -> Column:
    """The suffix with one more label; the host itself where it has no suffix."""
    labels = F.split(host, r"\.")
    k = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), "."))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which later filters and join conditions don't reach through.

    Else each condition on a derived column is rewritten in terms of the first ones, and long chains of
    derived columns grow beyond what the optimizer can hold.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _plain_host(host: str) -> str:
    try:
        return host.encode("ascii", "ignore").decode("idna")
    except (UnicodeError, IndexError, ValueError):
        return host  # broken labels stay as they are


@F.pandas_udf(StringType())
def _from_punycode(hosts: pd.Series) -> pd.Series:
    """Hosts in the letters that their xn-- labels stand for; each distinct host of a batch is decoded once."""
    plain = {h: _plain_host(h) for h in hosts.dropna().unique()}
    return pd.Series([plain.get(h) for h in hosts], dtype=object)


def decoded_host(host: Column) -> Column:
    """The host without punycode; only hosts with an xn-- label leave the JVM."""
    coded = host.rlike(r"(^|\.)xn--")
    return F.when(coded, _from_punycode(F.when(coded, host))).otherwise(host)


PARTS = ("scheme", "userinfo", "host", "port", "path", "query", "suffix", "registered_domain", "subdomain", "is_ip")


def with_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Adds the parts of a URL column. Never fails: what isn't there is empty, or null for the port.

    Parts are added step by step, each from the ones before, so no expression is worked out twice.
    """
    c = lambda k: F.col(f"{prefix}{k}")
    x = df.withColumn(f"{prefix}full", with_scheme(F.col(url)))
    x = x.withColumns({f"{prefix}authority": F.regexp_extract(c("full"), URL, 2), f"{prefix}scheme": F.lower(F.regexp_extract(c("full"), URL, 1)), f"{prefix}path": F.regexp_extract(c("full"), URL, 3), f"{prefix}query": F.substring(F.regexp_extract(c("full"), URL, 4), 2, 1_000_000)})
    port = F.regexp_extract(F.substring_index(c("authority"), "@", -1), r":([0-9]{1,5})$", 1)
    x = x.withColumns({f"{prefix}host": _host(c("authority")), f"{prefix}userinfo": F.regexp_extract(c("authority"), r"^(.*)@", 1), f"{prefix}port": F.when(port != "", port.cast("int"))})
    x = x.withColumns({f"{prefix}suffix": suffix_of(c("host")), f"{prefix}is_ip": c("host").rlike(IPV4) | F.contains(c("host"), F.lit(":"))})
    x = x.withColumn(f"{prefix}registered_domain", registered_domain(c("host"), c("suffix")))
    sub = F.when(F.char_length(c("host")) > F.char_length(c("registered_domain")), F.substr(c("host"), F.lit(1), F.char_length(c("host")) - F.char_length(c("registered_domain")) - 1)).otherwise("")
    return x.withColumn(f"{prefix}subdomain", sub)


def parts(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in PARTS}


def _decoded(text: Column) -> Column:
    """Percent-decoded; plus signs stay, and a text with broken escapes is kept as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def with_canonical(df: DataFrame, url: str, into: str, unwrap: int = 3) -> DataFrame:
    """Adds the canonical form of a URL column.

    Targets of redirect parameters that lead to another registered domain are unwrapped up to
    ``unwrap`` times; lookalike hosts are folded, default ports dropped, an empty path is /.
    """
    keep = df.columns
    x = df.withColumn("_u", with_scheme(F.col(url)))
    rank = F.map_from_arrays(strings(REDIRECT_PARAMS), F.expr(f"array({', '.join(map(str, range(len(REDIRECT_PARAMS))))})"))
    for _ in range(unwrap):
        x = with_parts(x, "_u", "_p_")
        pairs = F.transform(F.split("_p_query", "&"), lambda y: F.struct(rank[F.lower(F.substring_index(y, "=", 1))].alias("i"), _decoded(F.regexp_replace(y, "^[^=]*=?", "")).alias("v")))
        found = F.array_min(F.filter(pairs, lambda y: y["i"].isNotNull() & y["v"].rlike(r"(?i)^(?:https?:)?//|^www\.")))
        x = x.withColumn("_t", found["v"]).withColumn("_t", F.when(F.startswith("_t", F.lit("//")), F.concat(F.lit("http:"), "_t")).otherwise(F.col("_t")))
        x = x.withColumn("_h", host_of(F.col("_t"))).withColumn("_s", suffix_of(F.col("_h"))).withColumn("_r", registered_domain(F.col("_h"), F.col("_s")))
        x = x.withColumn("_u", F.when(F.col("_t").isNotNull() & (F.col("_r") != F.col("_p_registered_domain")), with_scheme(F.col("_t"))).otherwise(F.col("_u"))).select(*keep, "_u")
    x = with_parts(settled(x), "_u", "_p_")
    p = parts("_p_")
    port = F.when(p["port"].isNotNull() & ~p["port"].isin(80, 443), F.concat(F.lit(":"), p["port"].cast("string"))).otherwise("")
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
    whole = F.when(F.col("_u") == "", "").otherwise(F.concat(p["scheme"], F.lit("://"), fold_confusables(p["host"]), port, path, query))
    return x.withColumn("_whole", whole).select(*(c for c in keep if c != into), F.col("_whole").alias(into))


def with_brand_hits(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds the brands in texts, literally or leet-folded: as whole tokens, or inside when of five letters or more."""
    df = df.withColumns({f"{k}_low": F.lower(v) for k, v in columns.items()})
    df = df.withColumns({f"{k}_leet": fold_leet(F.col(f"{k}_low")) for k in columns})
    long = [b for b in BRANDS if len(b) >= 5]
    either = "|".join(sorted(long))

    def hits(k: str) -> Column:
        out = []
        for v in (f"{k}_low", f"{k}_leet"):
            out.append(kept(f"split({v}, '[^a-z0-9]+')", BRANDS))
            # Few texts hold a brand, and only those are searched for each.
            out.append(F.expr(f"if({v} rlike '{either}', filter(array({listed(long)}), b -> contains({v}, b)), cast(array() as array<string>))"))
        return F.array_distinct(F.concat(*out))

    return df.withColumns({k: hits(k) for k in columns}).drop(*(f"{k}_{x}" for k in columns for x in ("low", "leet")))


def shape(url: Column, prefix: str) -> dict[str, Column]:
    """Signs of form: lengths, counts, authority, evasion and reputation, of a URL whose parts are there. Doubles."""
    p = parts(prefix)
    host, path, query, suffix, reg = (p[k] for k in ("host", "path", "query", "suffix", "registered_domain"))
    full = F.col(f"{prefix}full")
    subs = F.greatest(F.size(F.split(host, r"\.")) - F.size(F.split(reg, r"\.")), F.lit(0))
    tld = F.substring_index(suffix, ".", -1)
    digits = F.regexp_count(full, F.lit("[0-9]"))
    params = F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1)))
    blob = F.lower(F.concat(path, F.lit(" "), query))
    out = {
        "length": F.char_length(full),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "query_length": F.char_length(query),
        "num_dots": F.regexp_count(host, F.lit(r"\.")),
        "num_hyphens": F.regexp_count(full, F.lit("-")),
        "num_digits": digits,
        "digit_ratio": digits / F.greatest(F.char_length(full), F.lit(1)),
        "num_subdomains": subs,
        "num_path_segments": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "num_query_params": F.size(params),
        "host_entropy": F.round(entropy(host), 6),
        "longest_token": F.coalesce(F.array_max(F.transform(F.split(full, "[^A-Za-z0-9]+"), lambda t: F.char_length(t))), F.lit(0)),
        "tld_length": F.char_length(tld),
        "deep_subdomain": subs >= 3,
        "is_https": p["scheme"] == "https",
        "is_ip_host": p["is_ip"],
        "has_port": p["port"].isNotNull(),
        "nonstandard_port": p["port"].isNotNull() & ~p["port"].isin(80, 443),
        "has_userinfo": p["userinfo"] != "",
        "has_at_symbol": F.contains(F.substring_index(url, "?", 1), F.lit("@")),
        "has_hex_host": host.rlike("^0x[0-9a-f]+$"),
        "double_slash_in_path": F.contains(path, F.lit("//")),
        "is_punycode": F.contains(F.lower(url), F.lit("xn--")),
        "pct_encoding_ratio": F.regexp_count(url, F.lit("%")) / F.greatest(F.char_length(url), F.lit(1)),
        "is_shortener": among(reg, SHORTENERS),
        "has_redirect_param": F.exists(params, lambda k: among(F.lower(k), REDIRECT_PARAMS)),
        "free_hosting": among(suffix, FREE_HOSTING),
        "high_risk_tld": among(tld, RISKY_TLDS),
        "suspicious_token_count": sum(F.contains(blob, F.lit(t)).cast("int") for t in PATH_TOKENS),
        "mixed_script_host": mixed_script_words(host),
        "hyphen_in_registered_domain": F.regexp_count(reg, F.lit("-")),
        "official_brand_domain": among(reg, BRAND_DOMAINS),
    }
    return {k: v.cast("double") for k, v in out.items()}


def with_deception(df: DataFrame, prefix: str, distance: str) -> DataFrame:
    """Adds signs of a borrowed brand to a table with a URL's parts and its distance to the nearest brand domain."""
    p = parts(prefix)
    x = with_brand_hits(df, {"_bs": p["subdomain"], "_bp": F.concat(p["path"], F.lit(" "), p["query"]), "_bo": F.substring_index(p["registered_domain"], ".", 1)}).withColumn("_bo", F.size("_bo") > 0)
    near = (F.col(distance) > 0) & (F.col(distance) <= 2)
    x = x.withColumns({"_mm": ((F.size("_bs") > 0) | (F.size("_bp") > 0)) & ~F.col("_bo"), "_sq": F.col("_bo") & ~among(p["registered_domain"], BRAND_DOMAINS), "_nr": near})
    out = {"brand_in_subdomain": F.size("_bs"), "brand_in_path": F.size("_bp"), "brand_mismatch": F.col("_mm"), "brand_lookalike": F.col("_nr"), "lookalike_distance": F.least(distance, F.lit(9)), "brand_squat": F.col("_sq"), "brand_impersonation": F.col("_sq") | F.col("_mm") | F.col("_nr")}
    return x.withColumns({k: v.cast("double") for k, v in out.items()}).drop("_bs", "_bp", "_bo", "_mm", "_sq", "_nr")


def click_score(row: dict[str, Column] | None = None) -> Column:
    """Click-time score of the signs in columns of these names (or in ``row``), before rounding."""
    c = (lambda k: row[k]) if row else F.col
    total = sum(F.when(c(k) > 0, w).otherwise(0.0) for k, w in CLICK_WEIGHTS.items())
    total = total + F.when(c("suspicious_token_count") >= 2, PATH_WEIGHT).otherwise(0.0)
    total = F.when(c("official_brand_domain") > 0, F.greatest(total - OFFICIAL, F.lit(0.0))).otherwise(total)
    total = total + F.when(c("is_https") == 0, PLAIN).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(0.99))


def click_reasons() -> Column:
    """The names of the signs that raise the click-time score, in order of weight."""
    ordered = sorted(CLICK_WEIGHTS, key=lambda k: (-CLICK_WEIGHTS[k], k))
    return F.array_compact(F.array(*(F.when(F.col(k) > 0, k) for k in ordered), F.when(F.col("suspicious_token_count") >= 2, "suspicious_token_count"), F.when(F.col("is_https") == 0, "not_https")))
