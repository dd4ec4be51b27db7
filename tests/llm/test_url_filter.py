import pytest
from pyspark.sql import functions as F

from seqtally.llm.url_filter import Settings, filter_urls


def pages_of(spark, urls):
    return spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'c' as host", "'c' as path", "'c' as shape", "'c' as n")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "page_id long, bad boolean")


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://Shop.Example.COM/en/1?q=/x", "shop.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/x#f", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/1", "badexample.com", "/en/1", "com/", "allow"),
        ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://a.net/ES/x", "a.net", "/ES/x", None, "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?x=/", "a.com", "", None, "allow"),
        ("a.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://y://z/es/", "y:", "//z/es/", None, "allow"),
        ("http://a.net/es/" + "x/" * 3000, "a.net", "/es/" + "x/" * 3000, "net/es/", "block"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = filter_urls(pages_of(spark, [(1, url)]), labels_of(spark)).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_templates_merge_and_reject(spark):
    urls = [(i, f"http://a.org/news/{i}/story.html") for i in range(100)]
    urls += [(200 + i, f"http://a.org/blog/{i}/story.html") for i in range(100)]
    urls += [(400 + i, f"http://a.org/spam/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}z/story.html") for i in range(100)]
    bad = [(i, i % 10 == 0) for i in range(0, 100, 2)] + [(200 + i, i % 10 == 0) for i in range(0, 100, 2)] + [(400 + i, True) for i in range(0, 100, 2)]
    got = {r.page_id: r for r in filter_urls(pages_of(spark, urls), labels_of(spark, [*bad, (None, True), (7, None), (999, True)])).collect()}
    assert {got[i].template for i in range(100)} == {got[200].template} == {"/*/{n}/story.html"}
    assert {got[400 + i].template for i in range(100)} == {got[400].template} and got[400].template != got[0].template
    assert {got[i].verdict for i in range(100)} == {"allow"} and {got[400 + i].verdict for i in range(100)} == {"block"}


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (None, "http://a.org/x/2"), (2, None)]
    got = filter_urls(pages_of(spark, rows), labels_of(spark, [(1, True), (1, False)]))
    assert got.count() == 4 and got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert "Python" not in got._jdf.queryExecution().toString()
    assert filter_urls(pages_of(spark, rows).where("false"), labels_of(spark)).count() == 0
    strict = filter_urls(pages_of(spark, rows), labels_of(spark, [(1, True)]), settings=Settings(prior=0.1)).where("verdict = 'block'")
    assert strict.where(F.col("host") == "a.org").count() == 3


def test_a_small_section_of_a_large_host_is_judged_by_its_own_labels(spark):
    names = ["casino"] + [f"s{'abcdefghij'[k % 10]}{'klmnopq'[k // 10]}" for k in range(70)]
    urls = [(100 * k + i, f"http://big.org/{name}/{i}.html") for k, name in enumerate(names) for i in range(15 if k == 0 else 14)]
    urls += [(100_000 + i, f"http://small.org/casino/{i}.html") for i in range(15)] + [(200_000 + i, f"http://small.org/clean/{i}.html") for i in range(30)]
    bad = [(i, "/casino/" in url) for i, url in urls]
    got = filter_urls(pages_of(spark, urls), labels_of(spark, bad)).collect()
    assert {r.verdict for r in got if r.path.startswith("/casino/")} == {"block"}
    assert {r.verdict for r in got if not r.path.startswith("/casino/")} == {"allow"}
    assert {r.template for r in got if r.host == "big.org"} == {"/casino/{n}.html", "/*/{n}.html"}
