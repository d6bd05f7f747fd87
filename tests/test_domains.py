"""Registrable domains by suffix rules."""

import random

import pytest

from adtrail.operators.domains import third_party, with_domains
from adtrail.sources.files import read_suffix_rules

RULES = ["com", "net", "org", "uk", "co.uk", "gov.pl", "pl", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp"]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(r,) for r in RULES], "rule string")


def brute(host, rules, unlisted):
    """The published algorithm, label by label."""
    labels = host.split(".")
    if not host or all(x.isdigit() for x in labels) and len(labels) == 4:
        return ""
    best = 1 if unlisted else None
    for i in range(1, len(labels) + 1):
        tail = ".".join(labels[-i:])
        if "!" + tail in rules:
            best = i - 1
            break
        if tail in rules:
            best = max(best or 0, i)
        if "*." + tail in rules:
            best = max(best or 0, i + 1)
    return ".".join(labels[-best - 1:]) if best is not None and len(labels) > best else ""


def domains(spark, rules, urls, **more):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return {r.u: r.d for r in with_domains(df, {"d": "u"}, rules, **more).collect()}


def test_known_cases(spark, rules):
    want = {"http://u:p@WWW.Example.co.uk:80/a/b.js;p=1?x=1#f": "example.co.uk", "//x.org/y": "x.org", "": "", None: "",
            "http://10.0.0.1/x.png": "", "http://com/": "", "http://x.com?q=/a": "x.com", "http://a.foo.gov.pl/": "foo.gov.pl",
            "http://gov.pl": "", "http://foo.pl": "foo.pl", "http://a.b.ck/": "a.b.ck", "http://www.ck/": "www.ck",
            "http://x.www.ck": "www.ck", "http://b.ck": "", "http://x.foo.science/": "foo.science",
            "http://foo.agency/": "foo.agency", "http://science/": "", "http://a.city.kobe.jp": "city.kobe.jp",
            "http://a.b.kobe.jp./": "a.b.kobe.jp", "x.y.co.uk": "y.co.uk"}
    assert domains(spark, rules, want) == want
    assert domains(spark, rules, ["http://a.nowhere", "http://b.a.com"], unlisted=False) == {
        "http://a.nowhere": "", "http://b.a.com": "a.com"}


@pytest.mark.parametrize("unlisted", [True, False])
def test_matches_the_published_algorithm(spark, rules, unlisted):
    rng = random.Random(8)
    labels = ["com", "uk", "co", "ck", "www", "jp", "kobe", "city", "a", "b", "gov", "pl"]
    hosts = {".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) for _ in range(600)}
    got = domains(spark, rules, [f"http://{h}/x" for h in hosts], unlisted=unlisted)
    assert got == {f"http://{h}/x": brute(h, set(RULES), unlisted) for h in hosts}


def test_many_copies_and_third_parties(spark, rules):
    df = spark.createDataFrame([("http://a.b.co.uk/", "http://c.b.co.uk", 1)] * 50
                               + [("http://a.co.uk/", "http://b.co.uk", 2), (None, "http://a.com", 3), ("", None, 4)],
                               "url string, home string, n int")
    got = {(r.n, r.x) for r in third_party(df, "url", "home", rules, out="x").collect()}
    assert got == {(1, False), (2, True), (3, True), (4, False)}
    assert third_party(df, "url", "home", rules).count() == 53


def test_rule_file(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text("// ===BEGIN ICANN DOMAINS===\n// com : x\ncom\n\n *.ck extra\n!www.ck\n中国\n"
                    "// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nblogspot.com\n", encoding="utf-8")
    own = {r.rule for r in read_suffix_rules(spark, str(path)).collect()}
    assert own == {"com", "*.ck", "!www.ck", "中国", "xn--fiqs8s"}
    both = read_suffix_rules(spark, str(path), private=True)
    assert {r.rule for r in both.collect()} == own | {"blogspot.com"}
    assert domains(spark, both, ["http://x.me.blogspot.com"]) == {"http://x.me.blogspot.com": "me.blogspot.com"}
