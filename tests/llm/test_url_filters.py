import random
import re

from brindle.llm.url_filters import match_rules


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(raw) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    return match_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en/77", "block"), ("example.com", "/en/777/x", "allow"), ("net", "", "block"), ("a.b.net", "/", "allow"), ("é.org", "/ü", "block")]
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/en/", "HTTP://WWW.Example.COM/en/7?x#y", "http://x.a.b.net", "http://a.b.net/", "http://evilexample.com/en/7", "http://é.org/üx", "http://..com/en/1"]
    urls += [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example.com', 'com', 'net', 'b.net', 'a.b.net'])}/en/{rng.choice([7, 77, 777, '777/x', 8])}" for _ in range(200)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, urls, rules).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_repeated_rows_and_no_rules(spark):
    rows = [(1, "http://a.com/x")] * 3 + [(None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert match_rules(pages, none).count() == 5
    one = spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = match_rules(pages, one).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": 3, "allow": 2}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert match_rules(pages, spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")).count() == 0


def test_hosts_of_rules_differ_in_case(spark):
    for rules in ([("Example.com", "/", "block"), ("example.com", "/", "allow")], [("example.com", "/", "allow"), ("Example.com", "/", "block")]):
        got = judged(spark, ["http://example.com/x"], rules).first()
        assert (got.verdict, got.rule, got.rule_depth) == ("block", "example.com/", 1)
