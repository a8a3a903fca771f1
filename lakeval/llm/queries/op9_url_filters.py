"""Every page's url by rules, else by a model that learned from a small labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import urlfilter

#: Verdict, host, path of each rule.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


#: Words of addresses that advertise, bet, sell on the sly or spread downloads, and words of reading matter.
BAD = "casino bet win-cash free-download warez pills xxx ads click crack spam cheap porn viagra loan replica phishing malware jackpot adult".split()
GOOD = "news blog docs wiki library school museum science forum recipes university health weather garden history music travel archive learn city".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small table of labelled hosts and paths: 800 rows made by rule from words in the address.

    Hosts and paths with one of the bad words are labelled 1, and reading matter 0."""
    bad, good = (F.array(*map(F.lit, words)) for words in (BAD, GOOD))
    rows = spark.range(800).withColumn("label", (F.col("id") % 2).cast("int"))
    word = F.when(F.col("label") == 1, F.get(bad, (F.col("id") / 2).cast("int") % 20)).otherwise(F.get(good, (F.col("id") / 2).cast("int") % 20))
    tld = F.get(F.array(*map(F.lit, ("com", "org", "net", "info"))), (F.col("id") / 40).cast("int") % 4)
    lang = F.get(F.array(*map(F.lit, ("/en/", "/de/", "/fr/", "/es/"))), (F.col("id") / 160).cast("int") % 4)
    first = F.concat(word, F.lit("."), F.lit("example."), tld)
    second = F.concat(F.lit("www.site"), (F.col("id") % 37).cast("string"), F.lit("."), tld)
    in_host = (F.col("id") / 400).cast("int") == 0
    host = F.when(in_host, first).otherwise(second)
    path = F.when(in_host, F.concat(lang, F.col("id").cast("string"))).otherwise(F.concat(lang, word, F.lit("/"), F.col("id").cast("string")))
    return rows.select(host.alias("host"), path.alias("path"), "label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of pages. The model learns from the labelled
    table and from at most ``urlfilter.MOST_LABELLED`` urls of pages, labelled by the bad words, so that it
    knows what harmless urls look like here."""
    host, path = urlfilter.split_url(F.col("url"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    ruled = urlfilter.apply_rules(pages, RULES)
    labelled = labelled_urls(spark).unionByName(urlfilter.worded_sample(pages, BAD))
    ruled = urlfilter.judge(ruled, urlfilter.train(labelled))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "model_verdict").alias("verdict"))
