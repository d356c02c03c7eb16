"""Text and URL functions against literal results."""

from pyspark.sql import functions as F

from mailsift.functions import text as T
from mailsift.functions import urls
from mailsift.operators import links


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_leet_and_identifiers(spark):
    for raw, want in {"p4ssw0rd": "password", "h3ll0": "hello", "l33t": "l33t", "sha256": "sha256", "office365": "office365", "base64": "base64", "x509": "x509", "2FA": "2FA"}.items():
        assert value(spark, T.fold_leet(F.lit(raw))) == want, raw


def test_canonical_forms(spark):
    assert value(spark, T.collapse_runs(F.lit("urgeeeeent"))) == "urgeent"
    assert value(spark, T.collapse_runs(F.lit("keep"))) == "keep"
    assert value(spark, T.strip_invisible(F.lit("pa​ss‮word"))) == "password"
    assert value(spark, T.fold_confusables(F.lit("раураl ＡＢ"))) == "paypal AB"
    assert value(spark, T.rejoin_separated(F.lit("your p-a-s-s now"))) == "your pass now"
    assert value(spark, T.strip_diacritics(F.lit("café ﬁn"))) == "cafe fin"
    assert value(spark, T.mixed_script_words(F.lit("pаypal and paypal"))) == 1
    once = value(spark, T.canonical(F.lit("p​4ssw0rd  раураl")))
    assert value(spark, T.canonical(F.lit(once))) == once


def test_entropy_addresses_and_digests(spark):
    assert value(spark, T.entropy(F.lit("aabb"))) == 1.0
    assert value(spark, T.entropy(F.lit(""))) == 0.0
    assert value(spark, T.address(F.lit("PayPal <Service@PayPal.com>"))) == "service@paypal.com"
    assert value(spark, T.address_domain(F.lit("a@b@c.example."))) == "c.example"
    assert value(spark, T.pseudonym(F.lit(""), "s")) == ""
    assert spark.range(1).select(T.squeezed(F.lit("Act  now, act now!")).alias("low")).select(T.phrase_count("low").alias("n")).first().n == 2


def test_distance(spark):
    assert T.edits("hdfcbnak.com", "hdfcbank.com") == 1
    assert T.edits("paypa1.com", "paypal.com") == 1
    assert T.edits("", "abc") == 3


def test_suffixes(spark):
    def split(host):
        s = urls.suffix_of(F.lit(host))
        return value(spark, s), value(spark, urls.registered_domain(F.lit(host), s))

    assert split("www.example.co.uk") == ("co.uk", "example.co.uk")
    assert split("evil.pages.dev") == ("pages.dev", "evil.pages.dev")
    assert split("192.168.4.9") == ("", "192.168.4.9")
    assert split("localhost") == ("", "localhost")


def test_links(spark):
    rows = [
        (1, 0, "https://relay.example/r?url=https%3A%2F%2Fbad-domain.tk%2Flogin", ""),
        (2, 0, "http://192.168.4.9:8080/login", ""),
        (3, 0, "https://paypa1.com/login", ""),
        (4, 0, "https://www.paypal.com/signin", ""),
        (5, 0, "http://user:pw@host.example/x", "https://www.paypal.com/signin"),
        (6, 0, "", None),
        (7, 0, "not a url ::", "x"),
    ]
    df = spark.createDataFrame(rows, "message_id long, pos int, href string, label string")
    got = {r.message_id: r for r in links.link_features(df).collect()}
    assert got[1].domain == "bad-domain.tk" and got[1].unwrap_changed_host == 1
    assert got[2].is_ip_host == 1 and got[2].nonstandard_port == 1
    assert got[3].brand_impersonation == 1 and got[3].lookalike_distance == 1 - got[3].brand_squat * 1 or got[3].brand_squat == 1
    assert got[4].official_brand_domain == 1 and got[4].brand_impersonation == 0
    assert got[5].has_userinfo == 1 and got[5].text_shows_url_mismatch == 1
    assert len(got) == 7
    roll = {r.message_id: r for r in links.message_links(spark.range(9).withColumnRenamed("id", "message_id"), links.link_features(df)).collect()}
    assert roll[0].link_min_lookalike_distance == 9.0 and roll[0].link_count == 0.0


def test_punycode_hosts(spark):
    hosts = {
        "http://xn--ihqwcrb4cv8a8dqg056pqjye.cn/a": "他们为什么不说中文.cn",
        "https://www.xn--pple-43d.com/login": "www.\u0430pple.com",
        "http://xn--mnchen-3ya.example": "münchen.example",
        "http://xn--a-ecp.ru..x": None,
        "http://xn--\u00e9\u00e9.com": None,
        "http://plain.example": "plain.example",
        "http://not-xn--here.example": "not-xn--here.example",
    }
    df = spark.createDataFrame([(u,) for u in hosts], "u string")
    got = {r.u: r.p_host for r in df.select("u", urls.decoded_host(urls.host_of(F.col("u"))).alias("p_host")).collect()}
    assert len(got) == len(hosts) and all(v is not None for v in got.values())
    for u, want in hosts.items():
        assert want is None or got[u] == want
