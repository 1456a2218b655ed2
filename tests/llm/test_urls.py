from __future__ import annotations

import random
import re

from dossier.llm import urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("b.org/fr/x", "block"), ("c.org/", "allow"), ("c.org/", "block")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        if rule is None:
            continue
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), verdict == "block", rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def _judged(spark, rows, rules):
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, _short string")
    found = urls.judged(pages, spark.createDataFrame(rules, "rule string, verdict string"))
    return [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()]


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["a.example.net", "EXAMPLE.net", "xexample.net", "example.com", "É.example.com", "b.org", "a.b.org", "c.org", "net", "", "a..net", "net:80", "u@net"]
    paths = ["", "/", "/en/", "/en/1", "/en", "/de/x/y", "/fr/xy", "/fr/y", "//en/", "/fr/x"]
    tails = ["", "?q=/en/", "#/de/", "?a://b"]
    rows = [(i, rnd.choice(["http://", "HTTPS://", "://", ""]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(tails)) for i in range(600)]
    rows += [(None, None), (7, "http://net/"), (7, "http://net/"), (8, ""), (9, "http://net/a\nb"), (10, "http://" + "a." * 5000 + "net/" + "b/" * 5000)]
    got = _judged(spark, [(*r, "kept", "x") for r in rows], [*RULES, (None, "block")])
    assert sorted(got, key=str) == sorted([(i, *brute(u, RULES)) for i, u in rows], key=str)


def test_empty_tables(spark):
    assert _judged(spark, [], RULES) == []
    assert _judged(spark, [(1, "http://net/", "", "")], []) == [(1, "net", "/", None, "allow")]


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string").cache()
    rules = spark.sql("SELECT * FROM VALUES ('net/', 'block') AS t(rule, verdict)")
    plan = urls.judged(pages, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
