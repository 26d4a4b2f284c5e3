"""Mined URL rules: what a match may mean, and rules of every length."""

from itertools import combinations

from pyspark.sql import functions as F

from chatloom.llm import url_filters


def judged(spark, urls):
    """urls: (url, blocked or None) -> verdicts in order."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls) if b is not None], "id long, blocked boolean")
    return [r.verdict for r in url_filters.judge_urls(pages, labels, ()).orderBy("page_id").collect()]


def test_mostly_clean_rules_do_not_block(spark):
    """Twice the base rate, yet two of three such urls are clean."""
    urls = [("http://a.mixed.com/x", i % 3 == 0) for i in range(60)] + [("http://a.good.com/y", i % 20 == 0) for i in range(140)]
    urls += [("http://a.bad.com/z", i % 3 > 0) for i in range(60)]
    assert judged(spark, urls) == ["allow"] * 200 + ["block"] * 60


def test_rules_of_three_tokens(spark):
    """Only the three segments together mean block; any two are mostly clean."""
    parts = ("p", "q", "r")
    urls = [("http://com/p/q/r", True)] * 20 + [(f"http://com/{a}/{b}/{c}", False) for a, b in combinations(parts, 2) for c in "stuvw" for _ in range(8)]
    assert judged(spark, [*urls, ("http://com/r/q/p/new", None)]) == ["block"] * 20 + ["allow"] * 120 + ["block"]


def test_dominated_rules_change_no_best_match(spark):
    rules = [(["a"], 0.6), (["a", "b"], 0.5), (["a", "c"], 0.7), (["a", "b", "c"], 0.7), (["b", "c"], 0.9), (["b", "d"], 0.6), (["a", "b", "c", "d"], 0.95)]
    rules = spark.createDataFrame(rules, "tokens array<string>, confidence double")
    kept = url_filters.drop_dominated(rules)
    assert sorted(r.tokens for r in kept.collect()) == [["a"], ["a", "b", "c", "d"], ["a", "c"], ["b", "c"], ["b", "d"]]
    sets = [list(c) for n in range(5) for c in combinations("abcd", n)]
    urls = spark.createDataFrame([("".join(c), c) for c in sets], "set_key string, tokens array<string>")
    best = lambda r: sorted(map(tuple, url_filters.match_rules(urls, r).select("set_key", F.col("confidence")).collect()))
    assert best(kept) == best(rules)


def test_many_segments_that_come_together(spark):
    """Twenty-five segments that always come together are one item; any one of them means what all mean."""
    path = "/".join(f"seg{chr(97 + i)}" for i in range(25))
    urls = [(f"http://com/{path}", True)] * 30 + [(f"http://com/clean/{i}x", False) for i in range(60)] + [("http://com/segb/other", None), ("http://com/new/segz", None)]
    assert judged(spark, urls) == ["block"] * 30 + ["allow"] * 60 + ["block", "allow"]


def test_items_are_tokens_of_the_same_sets(spark):
    sets = [["a", "b", "c"], ["a", "b"], ["c", "d", "e"], ["d", "e"], ["f"], ["f"]]
    got = {r.token: r["item"] for r in url_filters.token_items(spark.createDataFrame([(s,) for s in sets], "tokens array<string>")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f"}


def test_rules_are_those_of_plain_counting(spark, sf):
    """Verdicts of mined rules over pages against all combinations of up to four tokens."""
    rng = __import__("random").Random(6)
    urls = [("http://" + rng.choice(["a.x.com", "b.x.com", "y.com"]) + "/" + "/".join(rng.choices("pqrst", k=rng.randint(0, 3))), rng.random()) for _ in range(400)]
    urls = [(u, (("p" in u.split("com")[1]) == (x < 0.8)) if i % 5 else None) for i, (u, x) in enumerate(urls)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_filters.url_tokens(url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))).alias("t")).collect()}
    seen = {}
    for i, (_, b) in enumerate(urls):
        for n in range(1, len(tokens[i]) + 1) if b is not None else ():
            for c in combinations(sorted(tokens[i]), n):
                m = seen.setdefault(c, [0, 0])
                m[0] += 1
                m[1] += b
    known = [b for _, b in urls if b is not None]
    base = sum(known) / len(known)
    rules = [frozenset(c) for c, (n, b) in seen.items() if b >= 0.005 * len(known) and b / n >= 0.5 and b / n >= 1.2 * base]
    expected = ["block" if any(r <= tokens[i] for r in rules) else "allow" for i in range(len(urls))]
    assert judged(spark, urls) == expected and len(set(expected)) == 2
