"""URL filters: rules by host and path, and a logistic regression where no rule fits.

All of it is DataFrame operations: hosts and paths by string functions, rules by a join on the host's
suffixes, and the model as hashed character n-grams under Spark's own logistic regression.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4)
#: So many urls of the corpus may become examples of the model.
MOST_LABELLED = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or where there is no ``://``. Urls of any
    length are taken whole."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), r"(?s)[?#].*$", "")
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a DataFrame; the path starts with a slash."""
    return spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``; else nulls. Input
    columns of these two names are replaced, all others stay; a null host or path fits no rule.

    A rule fits its host and all subdomains where the path starts with the rule's. The rule list is a
    parameter of the call, so its fits are written out as conditions, longest rule first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked by the part it is from."""
    out = []
    for mark, part in (("h:", host), ("p:", path)):
        padded = F.concat(F.lit("^"), part, F.lit("$"))
        for n in GRAMS:
            out.append(F.transform(F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g, m=mark: F.concat(F.lit(m), g)))
    return F.concat(*out)


def worded_sample(pages: DataFrame, words: list[str], most: int = MOST_LABELLED) -> DataFrame:
    """(host, path, label) of at most ``most`` distinct urls, the first by hash of host and path: 1 where one of
    the words stands by itself in host or path, else 0. Examples of what urls of the corpus look like; the
    bound is this parameter's. Rows without a host teach nothing."""
    named = F.lower(F.concat("host", F.coalesce("path", F.lit("")))).rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])")
    rows = pages.filter("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), named.cast("int").alias("label")).distinct()
    return rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)


def train(labelled: DataFrame, buckets: int = BUCKETS, reg: float = 1e-3) -> PipelineModel | str:
    """Model from rows (host, path, label 1 for block and 0 for allow); other columns are ignored.

    Nulls in any of the three teach nothing. With labels of one kind only the model is that verdict, and
    without any label it is ``allow``."""
    rows = labelled.filter("host is not null and path is not null and label is not null").select(_grams(F.col("host"), F.col("path")).alias("grams"), F.col("label").cast("double").alias("label"))
    kinds = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).head()
    if kinds["low"] == kinds["high"]:
        return "block" if kinds["low"] == 1.0 else "allow"
    stages = [HashingTF(numFeatures=buckets, inputCol="grams", outputCol="features", binary=True), LogisticRegression(regParam=reg, maxIter=60, featuresCol="features", labelCol="label")]
    return Pipeline(stages=stages).fit(rows)


def judge(pages: DataFrame, model: PipelineModel | str) -> DataFrame:
    """Add ``model_verdict`` by ``host`` and ``path``, nulls as empty text. All other columns stay, whatever
    their names; one of this name is replaced. An empty table gives an empty one."""
    if isinstance(model, str):
        return pages.withColumn("model_verdict", F.lit(model))
    none = F.lit("")
    held = pages.drop("model_verdict").select(F.struct("*").alias("row_"), _grams(F.coalesce("host", none), F.coalesce("path", none)).alias("grams"))
    return model.transform(held).select("row_.*", F.when(F.col("prediction") > 0.5, "block").otherwise("allow").alias("model_verdict"))
