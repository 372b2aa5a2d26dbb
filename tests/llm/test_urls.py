import random
import re

from tidemark.llm import urls as U

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else U.DEFAULT


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in urls], SCHEMA).repartition(3)
    table = spark.createDataFrame([(*r, "extra") for r in rules], "host string, path string, verdict string, key string")
    return sorted((tuple(r) for r in U.judge(pages, table).collect()), key=str)


def test_random_rules_and_urls(spark):
    rng = random.Random(8)
    labels = ["com", "net", "a", "b", "ab", "www", "x-y", "a.b"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/b/", "/é", "/a%20b"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({r[:2]: r for r in rules}.values())
    pairs = [(i, f"http{rng.choice(['', 's'])}://{host()}{rng.choice(paths)}{rng.choice(['', 'c', '/d'])}{rng.choice(['', '?q=/a', '#/b'])}") for i in range(600)]
    assert run(spark, pairs, rules) == sorted(((i, *brute(u, rules)) for i, u in pairs), key=str)


def test_odd_urls_ties_and_hot_host(spark):
    rules = [("Example.com", "/en/", "block"), ("example.com", "/", "allow"), ("com", "/", "block"), ("com", "/", "allow"),
             (None, "/", "block"), ("net", None, "block"), ("org", "/", "maybe"), ("", "/", "block")]
    odd = [None, "", "no scheme.com/", "http://", "://x.com/", "http://EXAMPLE.com/en/x", "http://www.example.com?x", "HTTP://example.com./en/",
           "http://a..com/", "http://com/", "http://xcom/", "http://example.com:80/en/", "http://host/" + "p" * 100_000, "http://a://b.com/"]
    pairs = list(enumerate(odd)) + [(None, "http://example.com/"), (7, "http://example.com/")] + [(100 + i, "http://hot.example.com/same") for i in range(900)]
    good = [("example.com", "/en/", "block"), ("example.com", "/", "allow"), ("com", "/", "block"), ("com", "/", "allow")]
    assert run(spark, pairs, rules) == sorted(((i, *brute(u, good)) for i, u in pairs), key=str)


def test_empty_tables(spark):
    assert run(spark, [], [("com", "/", "block")]) == []
    assert run(spark, [(1, "http://a.com/")], []) == [(1, "a.com", "/", None, "allow")]
