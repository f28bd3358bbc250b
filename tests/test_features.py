"""Golden values of URL features and the URL split."""

import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from baitline.functions import fixed, urls as U
from baitline.operators import features as feat, rules, suffix


def core(spark, *urls):
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    return {r["url"]: r for r in feat.feat_core(df).collect()}


def test_length_and_depth(spark):
    r = core(spark, "https://example.com/path/to/page", "https://google.com", "https://example.com", "https://example.com/a/b/c", "https://e.com/a/;p")
    assert r["https://example.com/path/to/page"].url_length == 32
    assert r["https://google.com"].url_length == 18
    assert r["https://example.com"].path_depth == 0
    assert r["https://example.com/a/b/c"].path_depth == 3
    assert r["https://e.com/a/;p"].path_depth == 1


def test_ip_addresses(spark):
    r = core(spark, "http://192.168.1.1/login", "http://10.0.0.1/admin", "http://256.1.1.1/", "http://01.1.1.1/", "http://[::1]/")
    flags = {u: x.has_ip_address for u, x in r.items()}
    assert flags == {
        "http://192.168.1.1/login": True, "http://10.0.0.1/admin": True, "http://256.1.1.1/": False,
        "http://01.1.1.1/": False, "http://[::1]/": False,
    }
    assert r["http://192.168.1.1/login"].subdomain_count == 0


def test_keywords_brands_and_trust(spark):
    r = core(
        spark, "https://example.com/verify-account", "https://example.com/secure-login", "https://example.com/normal-page",
        "https://www.google.com/login", "https://paypal.com/x", "https://paypal.evil.com/x", "https://walmart.com/x")
    assert [x.has_suspicious_keywords for x in (
        r["https://example.com/verify-account"], r["https://example.com/secure-login"], r["https://example.com/normal-page"],
        r["https://www.google.com/login"], r["https://paypal.com/x"], r["https://paypal.evil.com/x"], r["https://walmart.com/x"])
    ] == [True, True, False, False, False, True, False]


def test_subdomains_and_tlds(spark):
    r = core(spark, "https://a.b.c.example.com", "https://a.b.example.co.uk", "https://example.tk", "https://example.ml", "https://example.com")
    assert r["https://a.b.c.example.com"].subdomain_count == 3
    assert r["https://a.b.example.co.uk"].subdomain_count == 2
    assert [r[f"https://example.{t}"].suspicious_tld for t in ("tk", "ml", "com")] == [True, True, False]


def test_typosquat(spark):
    r = core(spark, "https://g00gle.com", "https://google.com", "https://paypa1.com", "https://unrelated-name.com", "https://Gooogle.com")
    found = {u: (x.typosquat_target, x.typosquat_distance) for u, x in r.items()}
    assert found == {
        "https://g00gle.com": ("google.com", 2), "https://google.com": (None, 0), "https://paypa1.com": ("paypal.com", 1),
        "https://unrelated-name.com": (None, 0), "https://Gooogle.com": ("google.com", 1),
    }


def test_split_equals_standard_library(spark):
    rng = random.Random(7)
    pieces = ["http", "https", "://", "//", ":", "/", "?", "#", "@", "a.com", "b", "%41", ";x", ".", "-", "é", "8080", "user"]
    urls = {"".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(400)}
    urls = sorted(u for u in urls if "[" not in u and "]" not in u)
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    u = F.col("url")
    for row in df.select("url", U.scheme(u).alias("s"), U.netloc(u).alias("n"), U.path(u).alias("p"), U.query(u).alias("q")).collect():
        want = urlsplit(row.url)
        assert (row.s, row.n, row.p, row.q) == (want.scheme, want.netloc, want.path, want.query), row.url


def brute_distance(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line = [i]
        for j, y in enumerate(b, 1):
            line.append(min(previous[j] + 1, line[-1] + 1, previous[j - 1] + (x != y)))
        previous = line
    return previous[-1]


def test_nearest_name_against_brute_force(spark):
    rng = random.Random(3)
    names = fixed.SQUAT_NAMES_CORE
    labels = set(names) | {"", "x"}
    for name in names:
        for _ in range(6):
            chars = list(name)
            for _ in range(rng.randint(1, 3)):
                chars[rng.randrange(len(chars))] = rng.choice("abcxyz01")
            labels.add("".join(chars))
    df = spark.createDataFrame([(x,) for x in sorted(labels)], "label STRING")
    near = U.nearest_name(F.col("label"), names, 2)
    for row in df.select("label", U.name_distance(near).alias("d"), U.name_at(near, names).alias("t")).collect():
        best = min((brute_distance(row.label, n), i) for i, n in enumerate(names))
        if row.label in names or best[0] > 2:
            assert (row.d, row.t) == (0, None), row.label
        else:
            assert (row.d, row.t) == (best[0], names[best[1]] + ".com"), row.label


def test_string_features(spark):
    df = spark.createDataFrame([("http://ex-a.com/a?x=1&y=2?z",), ("https://bit.ly/1//2",), ("ftp:/päth٣",)], "url STRING")
    wide = {r["url"]: r for r in feat.feat_lexical32(df).collect()}
    r = wide["http://ex-a.com/a?x=1&y=2?z"]
    assert (r.domain_length, r.path_length, r.query_length, r.num_query_params, r.num_question_marks) == (8, 12, 7, 2, 2)
    assert r.domain_has_hyphen == 1 and r.has_https == 0
    assert wide["https://bit.ly/1//2"].uses_shortener == 1 and wide["https://bit.ly/1//2"].has_double_slash == 1
    odd = wide["ftp:/päth٣"]
    assert odd.num_digits == 1 and odd.special_char_ratio == pytest.approx(2 / 10)


RULES = [
    "// a comment with dots.in.it", "", "uk", "co.uk   what follows is ignored", "*.ck", "!www.ck", "*.kawasaki.jp", "jp", "!city.kawasaki.jp", "公司.cn", "cn",
    "CO.UK", "com.",
]


def test_public_suffix_rules(spark):
    table = suffix.suffix_rules(spark.createDataFrame([(x,) for x in RULES], "value STRING"))
    assert table.count() == 11  # co.uk once, one rule in two spellings
    hosts = {
        "a.b.shop.co.uk": ("a.b", "shop", "co.uk"), "10.1.2.3": ("", "10.1.2.3", ""), "x.unknown": ("", "x", "unknown"),
        "localhost": ("", "localhost", ""), "co.uk": ("", "", "co.uk"), "b.c.ck": ("", "b", "c.ck"), "c.ck": ("", "", "c.ck"), "ck": ("", "ck", ""),
        "www.ck": ("", "www", "ck"), "a.www.ck": ("a", "www", "ck"), "a.city.kawasaki.jp": ("a", "city", "kawasaki.jp"),
        "a.b.c.kawasaki.jp": ("a", "b", "c.kawasaki.jp"), "kawasaki.jp": ("", "kawasaki", "jp"), "x.公司.cn": ("", "x", "公司.cn"),
        "X.Xn--55qx5d.CN": ("", "X", "Xn--55qx5d.CN"), "y.公司.com": ("y", "公司", "com"),
    }
    urls = spark.createDataFrame([(f"https://{h}/x",) for h in hosts] * 2 + [(None,), ("",)], "url STRING").repartition(3)
    got = suffix.join_public_suffix(urls, table).collect()
    assert len(got) == 2 * len(hosts) + 2
    assert {r.host: (r.subdomain, r.domain, r.suffix) for r in got if r.host} == hosts
    bare = suffix.join_public_suffix(urls, table, unlisted=0).filter("host = 'x.unknown'").first()
    assert (bare.subdomain, bare.domain, bare.suffix) == ("x", "unknown", "")


def test_public_suffix_rules_by_walking_the_labels(spark):
    """Every host of up to four labels against a walk over the rules one by one."""
    import itertools

    labels = ["a", "www", "city", "kawasaki", "ck", "jp", "uk", "co"]
    hosts = [".".join(p) for n in (2, 3, 4) for p in itertools.product(labels, repeat=n)]
    rules = [(r.split()[0].lower().rstrip(".").lstrip("!").split("."), r.startswith("!")) for r in RULES if r and not r.startswith("//")]

    def walk(host):
        parts, best = host.split("."), 1
        for rule, exception in rules:
            if len(rule) <= len(parts) and all(x in ("*", y) for x, y in zip(rule[::-1], parts[::-1])):
                if exception:
                    return len(rule) - 1
                best = max(best, len(rule))
        return best

    table = suffix.suffix_rules(spark.createDataFrame([(x,) for x in RULES], "value STRING"))
    df = spark.createDataFrame([(h,) for h in hosts], "host STRING")
    assert {r.host: r.n for r in suffix.with_suffix_labels(df, "host", table, "n").collect()} == {h: walk(h) for h in hosts}


def test_inner_wildcards_are_refused(spark):
    with pytest.raises(Exception, match="leftmost"):
        suffix.suffix_rules(spark.createDataFrame([("a.*.b",)], "value STRING")).collect()


def test_variants_and_key(spark):
    df = spark.createDataFrame([("https://a.com/",), ("http://a.com",), ("a.com//",)], "url STRING")
    got = {r.url: r.v for r in df.select("url", U.variants(F.col("url")).alias("v")).collect()}
    assert got["https://a.com/"] == ["https://a.com/", "http://a.com/", "https://a.com", "http://a.com"]
    assert got["http://a.com"] == ["http://a.com", "https://a.com", "http://a.com/", "https://a.com/"]
    assert got["a.com//"] == ["a.com//", "a.com"]
    exploded = df.select("url", F.explode(U.variants(F.col("url"))).alias("v"))
    assert exploded.filter(U.match_key(F.col("url")) != U.match_key(F.col("v"))).count() == 0


def test_filter_after_verdict_stays_small(spark):
    """A filter on the verdict must not copy the rule expressions into the condition."""
    df = spark.createDataFrame([("https://example.tk/login",), ("https://example.com",)], "url STRING")
    judged = rules.rule_verdict(feat.feat_core(df)).filter("verdict = 'suspicious'")
    assert len(judged._jdf.queryExecution().executedPlan().toString()) < 60_000
    assert [r.url for r in judged.collect()] == ["https://example.tk/login"]


def test_custom_rules_and_thresholds(spark):
    df = spark.createDataFrame([("https://example.com/" + "a" * 50,)], "url STRING")
    own = [r for r in rules.default_rules(max_length=40) if r.name == "url_length"]
    row = rules.rule_eval(feat.feat_core(df), own).collect()
    assert [(r.rule_name, r.triggered, r.severity, r.score) for r in row] == [("url_length", True, "medium", 1.0)]
