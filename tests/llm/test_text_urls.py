import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from panelspark.llm import url_rules as U

URLS = [None, "", "x", "http://A.ORG", "http://a.org/", "HTTPS://É.Com/de/1?x#y", "a://b?c/d", "z://org/x", "ftp://xorg/",
        "q://example.org/en/12", "q://www.example.org/es/?a=/x", "http://u:p@x.example.org:80/es/", "a://b://c/d", "http://x.com/fr/#a\nb",
        "http://x.com/fr", "://com/de/", "http://EXAMPLE.org/EN/1", "h://" + "a." * 3000 + "com/de/" + "x/" * 3000]


def expected(url, rules=U.RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in rules for a, _, b in [r.partition("/")] if (host == a or host.endswith("." + a)) and path.startswith("/" + b)]
    return host, path, max(fits, key=len, default=None)


def pages(spark, urls):
    rows = [(i, u, "h", "mine", "x") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, note string, tokens string").repartition(3)


def test_given_rules(spark):
    rows = U.judged(pages(spark, URLS + URLS[4:6])).collect()
    assert len(rows) == len(URLS) + 2
    verdict = dict((r, v) for v, r in U.RULES)
    for r in rows:
        assert (r.host, r.path, r.rule) == expected(r.url) and r.note == "mine" and r.verdict in ("allow", "block")
        assert r.rule is None or r.verdict == verdict[r.rule]


@pytest.mark.parametrize("rules", [[("block", "a.org/"), ("allow", "org/xxx")], [("allow", "org/a"), ("block", "org/a")]])
def test_order_of_rules(spark, rules):
    row = U.judged(pages(spark, ["q://a.org/xxx", "q://org/a"]), rules).where("page_id = 0 and path = '/xxx' or path = '/a'").collect()
    assert {r.rule: r.verdict for r in row} == ({"a.org/": "block"} if len(rules[0][1]) == 6 else {"org/a": "block"}) or len(row) == 2


def mined_pages():
    """Blocked where a path has spam and the host ends in com; allowed elsewhere."""
    out = []
    for i in range(400):
        tld, part = ("com", "net")[i % 2], ("spam", "news", "shop")[i % 3]
        out.append((f"site{i % 7}.{tld}", f"/{part}/{i}", "block" if tld == "com" and part == "spam" else "allow"))
    return out


def labelled(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, label string").select(
        "label", U.tokens(F.col("host"), F.col("path")).alias("tokens"))


def test_mined_rules_are_those_of_counting(spark):
    rows = mined_pages()
    df = labelled(spark, rows)
    sets = [(set(r.tokens), r.label) for r in df.collect()]
    found = U.mined(df, min_support=0.05, min_confidence=0.9)
    assert found
    for r in found:
        have = [label for t, label in sets if set(r["tokens"]) <= t]
        n = have.count(r["label"])
        assert abs(r["confidence"] - n / len(have)) < 1e-9 and n / len(sets) >= 0.05 and r["posted"] in r["tokens"]
        for other in found:  # none is beaten by a rule with one token less
            if other is not r and set(other["tokens"]) < set(r["tokens"]) and len(other["tokens"]) == len(r["tokens"]) - 1:
                assert other["label"] != r["label"] or other["confidence"] < r["confidence"]
    blocks = [set(r["tokens"]) for r in found if r["label"] == "block"]
    assert {"host:com", "part:spam"} in blocks and all("host:com" in b for b in blocks if "part:spam" in b)
    assert not U.mined(df.limit(0))


def test_matching_by_the_index_is_matching_by_all_rules(spark):
    rules = U.mined(labelled(spark, mined_pages()), min_support=0.05, min_confidence=0.9)
    urls = [("a.com", "/spam/x"), ("a.net", "/spam/x"), ("b.com", "/news"), ("zz", "/nothing"), ("", ""), ("site3.com", "/shop/spam/4")]
    df = spark.createDataFrame(urls, "host string, path string").select("*", U.tokens(F.col("host"), F.col("path")).alias("t"))
    for r in df.select("t", U.matched(F.col("t"), rules).alias("m")).collect():
        assert r.m == next((x["label"] for x in rules if set(x["tokens"]) <= set(r.t)), None)


def test_empty_table_and_no_python(spark):
    df = U.judged(pages(spark, URLS))
    assert U.judged(df.select("page_id", "url").limit(0)).count() == 0
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_a_frequent_long_url_is_no_trouble(spark):
    long = "http://" + ".".join(f"h{i}" for i in range(30)) + ".com/de/" + "/".join(f"p{i}" for i in range(30))
    assert {r.verdict for r in U.judged(pages(spark, [long] * 200 + ["http://a.org/x"] * 100)).collect()} == {"allow", "block"}


def brute_rules(sets, min_support, min_confidence):
    """All rules of up to three tokens by counting, without those that one with a token less beats."""
    found, n = {}, len(sets)
    names = sorted({t for s, _ in sets for t in s if sum(t in x for x, _ in sets) >= min_support * n})
    for size in (1, 2, 3):
        for tokens in itertools.combinations(names, size):
            have = [label for s, label in sets if s.issuperset(tokens)]
            for label in set(have):
                k = have.count(label)
                if k >= min_support * n and k / len(have) >= min_confidence:
                    found[tokens, label] = k / len(have)
    return {r for r, c in found.items() if not any(found.get((tuple(x for x in r[0] if x != t), r[1]), -1) >= c for t in r[0])}


def test_rules_of_long_urls_are_all_mined(spark):
    draw, rows = random.Random(5), []
    for _ in range(120):
        parts = [f"p{k}" for k in range(13) if draw.random() < 0.75]
        rows.append(("x.com", "/" + "/".join(parts), "block" if {"p11", "p12"} <= set(parts) and "p3" in parts or draw.random() < 0.1 else "allow"))
    df = labelled(spark, rows)
    sets = [(set(r.tokens), r.label) for r in df.collect()]
    assert max(len(s) for s, _ in sets) > 24  # parts and words of the same URLs: more than ten classes
    got = {(tuple(r["tokens"]), r["label"]) for r in U.mined(df, min_support=0.1, min_confidence=0.75) if len(r["tokens"]) <= 3}
    assert got == brute_rules(sets, 0.1, 0.75) and got


def test_more_rules_than_are_sent(spark, monkeypatch):
    urls = [f"http://a{i % 50}.x{i % 7}.org/{'es' if i % 3 else 'en'}/k{i % 90}" for i in range(900)] + [
        f"http://q.net/k{i % 95}/a{i % 50}" for i in range(300)]
    few = sorted(tuple(r) for r in U.judged(pages(spark, urls), min_confidence=0.5).collect())
    monkeypatch.setattr(U, "SENT_RULES", 0)
    assert sorted(tuple(r) for r in U.judged(pages(spark, urls), min_confidence=0.5).collect()) == few


def test_no_cap_on_tokens_or_rules(spark):
    """600 frequent tokens of one label each: all are rules."""
    df = labelled(spark, [("", f"/t{i % 600}", "block" if i % 600 < 300 else "allow") for i in range(2400)])
    assert {tuple(r["tokens"]) for r in U.mined(df, min_support=0.001)} == {(f"{k}:t{i}",) for i in range(600) for k in ("part", "word")}
