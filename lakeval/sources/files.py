"""Files of example rows and prompts: CSV with a reject table, JSON lines of three shapes, manifests."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of CSV, TSV or TXT files with a header.

    Records are (file, row, values): row is the 1-based data row, values a map by column. Quotes may hold
    delimiters and line ends. Blank rows are skipped. Issues are (file, row, problem): a row with another
    number of fields, a repeated column, no header, bytes that aren't UTF-8. (Spark does not list files of
    no bytes at all.) A file is parsed by one
    task, as row numbers need; many files are parsed in parallel."""

    def run(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf.path, pdf.content, strict=True):
                try:
                    text = bytes(data).decode("utf-8-sig")
                except UnicodeDecodeError as e:
                    out.append((name, 0, None, f"not UTF-8 at byte {e.start}"))
                    continue
                lines = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if name.endswith(".tsv") else ",")
                header = [c.strip() for c in next(lines, [])]
                if not any(header):
                    out.append((name, 0, None, "empty file"))
                    continue
                if len(set(header)) < len(header):
                    out.append((name, 0, None, "a column stands twice in the header"))
                    continue
                for n, row in enumerate((r for r in lines if any(c.strip() for c in r)), 1):
                    good = len(row) == len(header)
                    out.append((name, n, dict(zip(header, row, strict=True)) if good else None, None if good else f"{len(row)} fields, the header has {len(header)}"))
            yield pd.DataFrame(out, columns=["file", "row", "values", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parsed = files.mapInPandas(run, "file string, row long, values map<string,string>, problem string")
    return parsed.filter("problem is null").drop("problem"), parsed.filter("problem is not null").drop("values")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of text files; a byte order mark at the start of a file is dropped."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))


def line_issue(value: Column) -> Column:
    """What is wrong with a JSON line; null for a good one."""
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNull(), "invalid JSON").when(~F.startswith(F.ltrim(value), F.lit("{")), "not an object")


def line_shape(value: Column) -> Column:
    """chat, batch or plain; null for a line of no shape."""
    has = lambda key: F.get_json_object(value, f"$.{key}").isNotNull()
    return F.when(line_issue(value).isNotNull(), None).when(has("body"), "batch").when(has("messages"), "chat").when(has("prompt"), "plain")


MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("weight", T.IntegerType())]))


def line_messages(value: Column) -> Column:
    """Messages of a line of any shape; a plain line's prompt is a user's, after its system text."""
    own = F.from_json(F.get_json_object(value, "$.messages"), MESSAGES)
    body = F.from_json(F.get_json_object(value, "$.body.messages"), MESSAGES)
    one = lambda role, key: F.when(F.get_json_object(value, f"$.{key}").isNotNull(), F.struct(F.lit(role).alias("role"), F.get_json_object(value, f"$.{key}").alias("content"), F.lit(None).cast("int").alias("weight")))
    plain = F.array_compact(F.array(one("system", "system"), one("user", "prompt"), one("assistant", "answer")))
    shape = line_shape(value)
    return F.when(shape == "batch", body).when(shape == "chat", own).when(shape == "plain", plain)


def check_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows, issues, shapes, and whether expected outputs are on all, some or none of the rows."""
    v = F.col(value)
    shaped = lines.select(line_issue(v).alias("issue"), line_shape(v).alias("shape"), F.get_json_object(v, "$.expected").isNotNull().alias("has"))
    part = F.when(F.count_if("has") == 0, "none").when(F.count_if("has") == F.count("*"), "all").otherwise("some")
    return shaped.agg(F.count("*").alias("n_rows"), F.count("issue").alias("issues"), F.array_join(F.array_sort(F.collect_set("shape")), ",").alias("shapes"), part.alias("expected"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed."""
    a, b = wanted.alias("a"), found.alias("b")
    both = a.join(b, F.expr("a.path = b.path"), "full_outer")
    problem = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "extra").when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")) | ~F.col("a.bytes").eqNullSafe(F.col("b.bytes")), "changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), problem.alias("problem")).filter("problem is not null")


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with their keys in order, nulls left out; Spark's committer makes the files appear
    whole or not at all. What is there is not overwritten."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def newest_training_file(spark: SparkSession, folder: str) -> str | None:
    """The newest ``*.distill.jsonl`` or ``train.jsonl`` of a folder, the larger name of two of one time; none
    if there is none."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    named = F.element_at(F.split("path", "/"), -1)
    best = files.filter((named == "train.jsonl") | F.endswith(named, F.lit(".distill.jsonl"))).agg(F.max(F.struct("modificationTime", "path")).alias("b")).head()
    return best["b"]["path"] if best["b"] else None


def make_bundle(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy all files below ``source`` as one table with their digests, and return its manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    root = source.rstrip("/").removeprefix("file:") + "/"
    name = F.regexp_replace(F.substring_index("path", root, -1), "^/+", "")
    files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content").write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target).select("path", "bytes", "sha256")


def bundle_problems(spark: SparkSession, bundle: str) -> DataFrame:
    """Files of a bundle whose content is not what its manifest says."""
    rows = spark.read.parquet(bundle)
    return rows.filter((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("bytes"))).select("path", F.lit("changed").alias("problem"))


def install_bundle(spark: SparkSession, bundle: str, target: str) -> int:
    """Write the files of a verified bundle below a folder through Hadoop's file systems; returns how many.
    A changed file stops it before anything is written, and a file that is there is not overwritten."""
    if not bundle_problems(spark, bundle).isEmpty():
        raise OSError(f"{bundle} is not what its manifest says")
    jvm, conf, done = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for r in spark.read.parquet(bundle).select("path", "content").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{target}/{r['path']}")
        out = path.getFileSystem(conf).create(path, False)
        out.write(bytearray(r["content"]))
        out.close()
        done += 1
    return done


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of files of JSON lines: records are (file, line, value), issues (file, line, problem).

    Lines are numbered from 1, blank ones count and are left out. A byte order mark is dropped; a file that
    is not UTF-8 is an issue at line 0 that says at which byte. A file is read by one task, as line numbers
    need; many files are read in parallel."""

    def run(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf.path, pdf.content, strict=True):
                try:
                    text = bytes(data).decode("utf-8-sig")
                except UnicodeDecodeError as e:
                    out.append((name, 0, None, f"not UTF-8 at byte {e.start}"))
                    continue
                out += [(name, n, line, None) for n, line in enumerate(text.splitlines(), 1) if line.strip()]
            yield pd.DataFrame(out, columns=["file", "line", "value", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = files.mapInPandas(run, "file string, line long, value string, problem string").withColumn("problem", F.coalesce("problem", line_issue(F.col("value"))))
    return read.filter("problem is null").drop("problem"), read.filter("problem is not null").drop("value")
