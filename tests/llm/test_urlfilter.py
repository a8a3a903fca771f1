import re

from lakeval.llm import urlfilter
from lakeval.llm.queries import op9_url_filters
from lakeval.llm.queries.op9_url_filters import RULES

URLS = [
    "http://a.example.net/en/1",
    "https://EXAMPLE.net/de/1?x=/en/",
    "http://example.net",
    "http://example.com/de/",
    "http://m.example.com/de/x#y",
    "http://notexample.com/de/x",
    "ftp://x.org/fr/z",
    "http://org/fr/",
    "nothing",
    None,
    "",
    "http://",
    "http://Höst.ORG/Fr/",
    "http://casino.example.com/en/win",
    "http://news.example.com/en/1",
    "x://y://z.net/a",
    "http://h.net?q=/en/",
    "http://long.org/" + "a" * 50_000,
    "http://h.org/a\nb",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[2], best[1]


def test_rules_equal_brute_force(spark, tmp_path):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in op9_url_filters.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("block", "allow")
    assert got[13]["verdict"] == "block" and got[14]["verdict"] == "allow"


def test_model_separates_held_out_urls(spark):
    rows = op9_url_filters.labelled_urls(spark).withColumn("k", __import__("pyspark").sql.functions.xxhash64("host", "path") % 4)
    model = urlfilter.train(rows.filter("k <> 0"))
    scored = urlfilter.judge(rows.filter("k = 0"), model).collect()
    assert sum((r["model_verdict"] == "block") == (r["label"] == 1) for r in scored) / len(scored) > 0.9


def test_labels_of_one_kind_or_none(spark):
    one = spark.createDataFrame([("a", "/", 1), (None, "/", 0)], "host string, path string, label int")
    assert urlfilter.train(one) == "block" and urlfilter.train(one.limit(0)) == "allow"
    assert urlfilter.judge(one, "block").filter("model_verdict = 'block'").count() == 2


def test_columns_that_clash(spark):
    """Columns named like the model's own, and nulls, stay as they are."""
    rows = [("a.net", "/x", 1, "g", 2.0), (None, None, 2, "h", 3.0)]
    df = spark.createDataFrame(rows, "host string, path string, features int, grams string, prediction double")
    got = urlfilter.judge(urlfilter.apply_rules(df, RULES), urlfilter.train(op9_url_filters.labelled_urls(spark))).orderBy("features").collect()
    assert [(r["features"], r["grams"], r["prediction"], r["host"]) for r in got] == [(1, "g", 2.0, "a.net"), (2, "h", 3.0, None)]
    assert all(r["model_verdict"] in ("block", "allow") for r in got) and urlfilter.judge(df.limit(0), "block").count() == 0


def test_held_out_accuracy_on_pages(spark):
    """Held out by host and path, pages with a bad word are blocked and the others allowed."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = urlfilter.split_url(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path")).distinct().withColumn("k", F.pmod(F.xxhash64("host", "path"), F.lit(4)))
    model = urlfilter.train(op9_url_filters.labelled_urls(spark).unionByName(urlfilter.worded_sample(rows.filter("k <> 0"), op9_url_filters.BAD, 2000)))
    held = urlfilter.worded_sample(rows.filter("k = 0"), op9_url_filters.BAD, 2000)
    scored = urlfilter.judge(held, model).collect()
    bad, good = ([r for r in scored if r["label"] == x] for x in (1, 0))
    assert bad and sum(r["model_verdict"] == "block" for r in bad) / len(bad) >= 0.9
    assert sum(r["model_verdict"] == "allow" for r in good) / len(good) >= 0.95
