"""Canonical exact digests of texts.

The canonical form is Unicode NFKC, full case folding, and each run of white space as one space with none
at the ends. Its fingerprint is 128 bits of xxhash. Where two rows share one, their canonical bytes are
compared, and different forms of one hash are told apart by a number; so two fingerprints are equal
exactly when the canonical forms are. DataFrame functions only; normalisation and folding are ICU's, which
Spark ships, called by the ``reflect`` function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

_WHITE = r"[\s\p{Z}\x85\x1C-\x1F]+"


def canonical(text: Column) -> Column:
    """Canonical form; a null is an empty text."""
    some = F.coalesce(text, F.lit(""))
    plain = some.rlike(r"^[\x00-\x7F]*$")
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), some, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(F.when(plain, F.lower(some)).otherwise(again), _WHITE, " "))


def wide_hash(form: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(form), F.xxhash64(F.lit(0x5BD1E995), form))))


def fingerprints(df: DataFrame, key: str, texts: Sequence[str], ws: Workspace, keep: Sequence[Column] = ()) -> DataFrame:
    """For each row: ``key``, the ``keep`` columns, and for each text column c its ``c_fp``.

    Fingerprints of all the columns share one space. Nulls count as empty texts, so they are equal to
    them; repeated rows stay repeated; an empty table gives an empty one. Hashes are written first; texts
    are gathered again only for rows whose hash is not the only one, by ``key`` (which may repeat or be
    null), and only their least and greatest form of each hash are kept, summed up before the shuffle, so
    no group of copies meets in one task.
    """
    names = [f"{c}_h" for c in texts]
    forms = df.select(F.col(key), *keep, *(canonical(F.col(c)).alias(n) for c, n in zip(texts, names, strict=True)))  # a step of its own, so each is made once
    hashed = ws.save(forms.withColumns({n: wide_hash(F.col(n)) for n in names}), "hashes", release=True)
    each = hashed.select(key, F.explode(F.array(*names)).alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    members = each.join(shared, "h", "left_semi").select(key).filter(F.col(key).isNotNull()).distinct()
    some = df.join(members, key, "left_semi").unionByName(df.filter(F.col(key).isNull()))
    forms = some.select(F.explode(F.array(*(canonical(F.col(c)) for c in texts))).alias("form"))
    forms = forms.withColumn("h", wide_hash(F.col("form")))
    odd = ws.save(forms.groupBy("h").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low != high").select("h"), "odd", release=True)
    if odd.isEmpty():
        numbered = None
    else:
        several = df.select(F.explode(F.array(*(canonical(F.col(c)) for c in texts))).alias("form")).withColumn("h", wide_hash(F.col("form")))
        several = several.join(odd, "h", "left_semi").distinct()
        numbered = ws.save(several.groupBy("h").agg(F.array_sort(F.collect_set("form")).alias("forms")), "numbered")
    if numbered is None:
        return hashed.select(key, *(c for c in hashed.columns if c != key and c not in names), *(F.col(n).alias(f"{c}_fp") for c, n in zip(texts, names, strict=True)))
    out = df.select(F.col(key), *keep, *(canonical(F.col(c)).alias(f"{c}_form") for c in texts))
    kept = [c for c in hashed.columns if c != key and c not in names]
    for c in texts:
        out = out.withColumn("h", wide_hash(F.col(f"{c}_form"))).join(numbered, "h", "left")
        place = F.array_position("forms", F.col(f"{c}_form"))
        out = out.withColumn(f"{c}_fp", F.when(place > 1, F.concat("h", F.lit("-"), place.cast("string"))).otherwise(F.col("h"))).drop("h", "forms", f"{c}_form")
    return out.select(key, *kept, *(f"{c}_fp" for c in texts))


def next_keys(keys: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """Each distinct non-null key and the next larger one (after the last: the first), as (key, next).

    Keys are dealt by range; only the first key of each range, one row a partition, meets in one task."""
    ranged = keys.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key)
    held = ws.save(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    from pyspark.sql import Window

    firsts = held.groupBy("part").agg(F.min(key).alias("first"))
    lowest = firsts.agg(F.min("first").alias("lowest"))
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    here = held.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(key)))
    return here.join(F.broadcast(after), "part").crossJoin(F.broadcast(lowest)).select(key, F.coalesce("next", "after", "lowest").alias("next"))
