"""The index over many rules against trying each rule."""

import random
import re

from pyspark.sql import functions as F

from heronry.operators import dispatch
from heronry.plans.rules import RULES


def test_required_text_is_in_every_match():
    assert dispatch.required(r"example\.org/a+b") == ["example.org/a", "b"] and dispatch.required("ab?c(d|e)f{2}gh*") == ["a", "c", "g"]
    for none in ("a|b", "(?i)abc", r"\Qabc", r"\p{L}abc", "[a[b]]c", "(a", "a{2"):
        assert dispatch.required(none) == [], none
    rng, parts = random.Random(2), ["ab", r"\.", "[xy]", "(?:cd|e)", "z?", "q+", ".", r"\d", "/w", "k{1,2}", "^", "(f(g))?"]
    text = [("".join(rng.choice("abcdefgxyzqkw./1") for _ in range(30))) for _ in range(300)]
    for _ in range(300):
        pattern = "".join(rng.choice(parts) for _ in range(4))
        for t in text:
            for m in re.finditer(pattern, t):
                assert all(r in m[0] for r in dispatch.required(pattern)), (pattern, m[0])


def test_many_rules(spark):
    rng = random.Random(7)
    rules = [(r.name, r.url) for r in RULES] + [(f"host{k}", rf"host{k}\.org") for k in range(300)] + [("short", "/q$"), ("choice", "abc|zzz"), ("any", r"host1\d*\.org/x"), ("flag", "(?i)UPPER")]
    rng.shuffle(rules)
    urls = [f"http://host{rng.randrange(400)}.org/{rng.choice(['x', 'q', 'abc', 'upper', ''])}" for _ in range(300)] + ["https://ieeexplore.ieee.org/document/1", "https://www.aclweb.org/anthology/1", None, "", "abc", "x"] + ["http://host1.org/x"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("piece", F.lit(1)).withColumn("address", F.lit(2))
    got = dispatch.dispatch_many(pages, rules, "general")
    assert got.columns == ["page_id", "url", "piece", "address", "rule"]
    want = {k: next((n for n, p in rules if u is not None and re.search(p, u)), "general") for k, u in enumerate(urls)}
    assert {r.page_id: r.rule for r in got.collect()} == want and len(set(want.values())) > 100


def test_ten_thousand_rules(spark):
    rules = [(f"n{k}", rf"site{k:05d}\.org/p") for k in range(10_000)]
    pages = spark.range(5000).select("id", F.format_string("http://site%05d.org/p/%d", F.col("id") * 7 % 12_000, F.col("id")).alias("url"))
    got = dispatch.dispatch_many(pages, rules, "general").groupBy("rule").count().collect()
    assert sum(r["count"] for r in got) == 5000 and {r.rule for r in got} == {f"n{k * 7 % 12_000}" if k * 7 % 12_000 < 10_000 else "general" for k in range(5000)}
