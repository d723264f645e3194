import math
import random
from collections import Counter

from pyspark.sql import functions as F

from gridweave.llm.urlfilter import RULES, judge, lexical, parsed

SCHEMA = "page_id long, url string, html string, host int"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_rules_and_model(spark):
    rng = random.Random(8)
    urls = [None, "", "no scheme/x", "http://", "https://EXAMPLE.org/es/a?b#c", "http://a.example.org/en/12", "http://example.org/en/2", "http://xcom/de/", "http://x.com/de/1", "http://org", "http://org/", "a://b://c.com/fr/", "http://x.com?/de/", "http://h.com/" + "z" * 100_000]
    for i in range(400):
        t, lang = rng.choice(["com", "org", "net"]), rng.choice(["en", "de", "fr", "es"])
        urls.append(f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', ''])}site{i}.example.{t}/{lang}/{rng.randrange(999)}{rng.choice(['', '?page=1&q=2', '#top'])}")
    rows = {r.page_id: r for r in judge(spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], SCHEMA).repartition(3)).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = brute(u)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), u
        assert r.verdict == best[0] if best else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_entropy(spark):
    url = "http://aab.c/"
    got = lexical(parsed(spark.createDataFrame([(1, url, "", 0)], SCHEMA))).select("entropy", "depth", "parameters").first()
    assert abs(got.entropy + sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())) < 1e-9 and got.depth == 1


def test_few_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "", 0), (2, "http://a.org/", "", 0)], SCHEMA)
    assert {r.page_id: r.verdict for r in judge(df).collect()} == {1: "allow", 2: "allow"}
    assert judge(df.where(F.lit(False))).count() == 0
