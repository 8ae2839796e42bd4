import random
import re

from gleanset.llm import url_filter as url_filter_module
from gleanset.llm.url_filter import url_filter


def brute(url, rules, otherwise="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])
    fit = {}
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), h + p)
            fit[key] = max(v, fit.get(key, ""))
    if not fit:
        return host, path, None, "block" if not host else otherwise
    return host, path, max(fit)[2], fit[max(fit)]


def run(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "<p>", "r", "v") for i, u in urls], "page_id long, url string, html string, rule string, verdict string")
    return url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **more)


def test_url_filter_against_brute_force(spark):
    rnd = random.Random(11)
    label = lambda: rnd.choice(["a", "b", "ab", "A", "", "é", "a-b", "a!"])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda n: "".join(rnd.choice("/ab!é.") for _ in range(n))
    rules = [(host(rnd.randrange(1, 4)), rnd.choice(["", "/", None]) if rnd.random() < 0.3 else "/" + path(rnd.randrange(4)), rnd.choice(["allow", "block"])) for _ in range(120)]
    rules += [(None, "/", "block"), ("", "/", "block"), ("b", "/", None), ("b", "/", "maybe"), ("a", "/x", "block"), ("A", "/x", "allow")]
    rules += [("a", "/" + "b" * k, "allow") for k in range(1, 40)] + [("b" + ".a" * k, "/", "block") for k in range(1, 12)]
    urls = [f"http{rnd.choice(['', 's'])}://{host(rnd.randrange(0, 6))}{rnd.choice(['', '/' + path(rnd.randrange(6))])}{rnd.choice(['', '?x=/a', '#/b', '?'])}" for _ in range(1500)]
    urls += ["http://b.a/" + "b" * k for k in range(60)] + ["https://b" + ".a" * k + "/x" for k in range(20)]
    urls += [None, "", "://", "no scheme", "http:/a/x", "http://", "x://a://b/c", "http://A.B/É\n/x?://", "http://u@a:8/x", "http://a./x", "http://b.a/" + "b" * 100_000, "http://" + "a." * 3_000 + "a/x"]
    rows = list(enumerate(urls)) + [(5, urls[5]), (5, "http://a/x"), (None, "http://a/x"), (None, None)] + [(9999, "http://b.a/bb")] * 700
    got = sorted(map(repr, map(tuple, run(spark, rows, rules, otherwise="block").collect())))
    assert got == sorted(repr((i, *brute(u, rules, "block"))) for i, u in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")  # many ranges without a rule of their own
        assert sorted(map(repr, map(tuple, run(spark, rows, rules, otherwise="block").collect()))) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_tables_and_no_python(spark):
    assert run(spark, [], [("a", "/", "block")]).count() == 0
    assert [tuple(r) for r in run(spark, [(1, "http://a/b")], []).collect()] == [(1, "a", "/b", None, "allow")]
    pages = spark.range(3).selectExpr("id AS page_id", "'http://x.a/b' AS url")
    out = url_filter(pages, spark.sql("SELECT 'a' AS host, '/' AS path, 'block' AS verdict"))
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    assert {r.rule for r in out.collect()} == {"a/"}


def test_rules_and_verdicts_of_the_contract(spark, tmp_path):
    listed = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {h + p: v for h, p, v in url_filter_module.RULES} == listed
    assert len(url_filter_module.RULES) == len(listed)
    urls = [u for r in listed for u in (f"http://{r}", f"https://sub.{r}x?y")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter_module.query(spark, str(tmp_path)).collect()}
    assert got == {i: (r, listed[r]) for i, r in enumerate(r for r in listed for _ in range(2))}
