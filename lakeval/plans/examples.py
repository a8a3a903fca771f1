"""Intake, duplicates, groups, splits and samples over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import baselines, rows, splits
from ..workspace import Workspace
from .registry import register

#: The normal form in SQL, for text that is NFKC already.
NORM = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def norm(c: str) -> str:
    return NORM.format(c)


def _labelled(t):
    docs = t("documents").select("doc_id", "text", "lang", "source")
    return docs.join(t("labels").select("doc_id", "quality", "toxic"), "doc_id")


@register(f"SELECT sha256({norm('text')}) AS digest, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def norm_dup_groups(spark, t):
    """Texts that are equal in normal form."""
    return rows.duplicate_groups(t("documents").filter("text is not null"), "text", "doc_id")


@register("""WITH k AS (SELECT doc_id, 'r-' || left(sha256(text || chr(0) || CAST(quality AS VARCHAR)), 12) AS b FROM documents JOIN labels USING (doc_id)),
r AS (SELECT doc_id, b, row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 AS n FROM k)
SELECT doc_id, CASE WHEN n = 0 THEN b ELSE b || '-' || CAST(n AS VARCHAR) END AS id FROM r""")
def row_ids(spark, t):
    """Stable ids of labelled rows."""
    df = _labelled(t).withColumn("out", F.col("quality").cast("string"))
    return rows.with_row_ids(df, "text", "out", ["doc_id"]).select("doc_id", "id")


def _components(spark, t):
    docs = t("documents").select("doc_id", "text")
    keys = [F.sha2(normalized(F.col("text")), 256), F.floor(F.col("doc_id") / 3).cast("string")]
    return splits.row_components(docs, "doc_id", keys, Workspace(spark, "components"))


@register(f"""WITH RECURSIVE n AS (SELECT doc_id, {norm('text')} AS k, doc_id // 3 AS g FROM documents),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN (SELECT k, min(doc_id) AS doc_id FROM n GROUP BY k) b USING (k)
      UNION SELECT a.doc_id, b.doc_id FROM n a JOIN (SELECT g, min(doc_id) AS doc_id FROM n GROUP BY g) b USING (g)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.a)
SELECT a AS doc_id, min(c) AS component FROM r GROUP BY a""")
def components(spark, t):
    """Documents linked by equal normal form or by group, however far."""
    return _components(spark, t)


_SPLIT_SQL = f"""WITH RECURSIVE n AS (SELECT doc_id, {norm('text')} AS k, doc_id // 3 AS g FROM documents),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN (SELECT k, min(doc_id) AS doc_id FROM n GROUP BY k) b USING (k)
      UNION SELECT a.doc_id, b.doc_id FROM n a JOIN (SELECT g, min(doc_id) AS doc_id FROM n GROUP BY g) b USING (g)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.a),
comp AS (SELECT a AS doc_id, min(c) AS component FROM r GROUP BY a),
z AS (SELECT component, count(*) AS size, sha256('seed-7' || CAST(component AS VARCHAR)) AS h FROM comp GROUP BY component),
o AS (SELECT *, sum(size) OVER (ORDER BY h, component ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM z),
q AS (SELECT sum(size) FILTER (WHERE before < round_even(total * 0.1, 0)) AS t FROM o),
sp AS (SELECT component, size, CASE WHEN before < round_even(total * 0.1, 0) THEN 'test' WHEN before - t < round_even(total * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM o, q)"""


def _split(spark, t):
    comp = _components(spark, t)
    return comp, splits.deal(comp, "seed-7", 0.1, 0.15)


@register(_SPLIT_SQL + " SELECT component, size, split FROM sp")
def split_generated(spark, t):
    """Components dealt to test, val and train."""
    return _split(spark, t)[1]


@register(_SPLIT_SQL + """ SELECT quality, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
concat_ws(',', CASE WHEN count(*) FILTER (WHERE split = 'train') = 0 THEN 'train' END, CASE WHEN count(*) FILTER (WHERE split = 'val') = 0 THEN 'val' END, CASE WHEN count(*) FILTER (WHERE split = 'test') = 0 THEN 'test' END) AS missing_in
FROM labels JOIN comp USING (doc_id) JOIN sp USING (component) GROUP BY quality""")
def split_class_coverage(spark, t):
    """Classes in each generated split, and the splits that lack one."""
    comp, split = _split(spark, t)
    df = t("labels").select("doc_id", "quality").join(comp, "doc_id").join(split.drop("size"), "component")
    return splits.class_coverage(df, "quality", "split")


@register(f"""WITH s AS (SELECT {norm('text')} AS k, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS split, min(doc_id) AS first FROM documents GROUP BY 1, 2)
SELECT sha256(a.k) AS digest, a.split AS split_a, b.split AS split_b, a.first AS first_a, b.first AS first_b FROM s a JOIN s b ON a.k = b.k AND a.split < b.split""")
def split_overlap(spark, t):
    """Texts that two supplied splits share."""
    split = F.expr("case when doc_id % 5 = 0 then 'test' when doc_id % 5 = 1 then 'val' else 'train' end")
    return rows.overlaps(t("documents").select("doc_id", "text", split.alias("split")), "text", "split", "doc_id")


@register(f"""WITH d AS (SELECT doc_id, text, {norm("CASE WHEN doc_id % 2 = 0 THEN ' ' || upper(source) ELSE source END")} AS out FROM documents)
SELECT sha256({norm('text')}) AS digest, string_agg(DISTINCT out, '|' ORDER BY out) AS outputs, count(DISTINCT out) AS n_outputs, min(doc_id) AS first FROM d GROUP BY 1 HAVING count(DISTINCT out) > 1""")
def conflicting_labels(spark, t):
    """Inputs with two labels or more in normal form, the source standing for the label."""
    label = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("source"))).otherwise(F.col("source"))
    return rows.conflicting(t("documents"), normalized(F.col("text")), normalized(label), "doc_id")


@register("""WITH s AS (SELECT CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type || '  ' ELSE event_type END AS spelling FROM events),
c AS (SELECT replace(lower(trim(regexp_replace(spelling, '\\s+', ' ', 'g'))), 'ß', 'ss') AS norm, spelling, count(*) AS n FROM s GROUP BY 1, 2)
SELECT norm, spelling, n FROM c QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n DESC, spelling DESC) = 1""")
def label_vocabulary(spark, t):
    """One spelling for each label."""
    spelled = t("events").select(F.expr("case event_id % 3 when 0 then upper(event_type) when 1 then event_type || '  ' else event_type end").alias("label"))
    return rows.label_vocabulary(spelled, "label")


@register(f"""WITH p AS (SELECT conv_id, turn, text, {norm('text')} AS k FROM conversations WHERE role = 'user'
  UNION ALL SELECT 1000000 + item_id, 0, '  ' || text || ' ', {norm('text')} FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT 2000000 + item_id, 0, '   ', '' FROM benchmark WHERE item_id % 10 = 0),
h AS (SELECT DISTINCT {norm('text')} AS k FROM benchmark),
f AS (SELECT CASE WHEN p.k = '' THEN 'empty' WHEN h.k IS NOT NULL THEN 'held' WHEN row_number() OVER (PARTITION BY p.k ORDER BY conv_id, turn) > 1 THEN 'repeat' ELSE 'kept' END AS fate FROM p LEFT JOIN h USING (k))
SELECT fate, count(*) AS n FROM f GROUP BY fate""")
def leakage_filter(spark, t):
    """Prompts kept and dropped: empty, held out, repeated."""
    own = t("conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    held = t("benchmark").select("item_id", "text")
    known = held.filter("item_id % 2 = 0").select((F.col("item_id") + 1000000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    blank = held.filter("item_id % 10 = 0").select((F.col("item_id") + 2000000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("   ").alias("text"))
    fates = rows.leakage_filter(own.unionByName(known).unionByName(blank), held, "text", ["conv_id", "turn"])
    return fates.groupBy("fate").agg(F.count("*").alias("n"))


@register(f"""WITH d AS (SELECT doc_id, lang, {norm('text')} AS k FROM documents QUALIFY row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) = 1)
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1' || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM d QUALIFY rank <= 20""")
def stratified_sample(spark, t):
    """Twenty distinct texts of each language in a seeded order."""
    pool = rows.distinct_pool(t("documents").select("doc_id", "lang", "text"), "text", "doc_id")
    return rows.stratified(pool, "lang", "doc_id", "s1", 20).select("doc_id", "lang", "rank")


@register("""WITH r AS (SELECT doc_id, CASE WHEN length(text) <= 800 THEN 'short' ELSE 'long' END AS tier FROM documents)
SELECT doc_id, tier FROM r QUALIFY row_number() OVER (PARTITION BY tier ORDER BY sha256('q' || CAST(doc_id AS VARCHAR)), doc_id) <= CASE tier WHEN 'short' THEN 30 ELSE 10 END""")
def quota_sample(spark, t):
    """A seeded sample with a quota of short and long texts."""
    df = t("documents").select("doc_id", F.when(F.length("text") <= 800, "short").otherwise("long").alias("tier"))
    return rows.stratified(df, "tier", "doc_id", "q", 30).filter("rank <= case tier when 'short' then 30 else 10 end").select("doc_id", "tier")


@register("""WITH o AS (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0), te AS (SELECT doc_id, toxic AS quality FROM labels WHERE doc_id % 2 = 1)
SELECT doc_id, quality, 'own' AS origin FROM o, range(2) UNION ALL SELECT doc_id, quality, 'teacher' FROM te""")
def training_union(spark, t):
    """Own rows twice, the teacher's once."""
    labels = t("labels")
    return rows.training_union(labels.filter("doc_id % 2 = 0").select("doc_id", "quality"), 2.4, ("teacher", labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("quality"))))


@register("""WITH f AS (SELECT 'event_type' AS field, event_type AS o FROM events UNION ALL SELECT 'props', props FROM events UNION ALL SELECT 'text', text FROM documents),
p AS (SELECT field, o, json_valid(o) AND left(ltrim(o), 1) = '{' AS obj, length(o) <= 40 AND len(string_split(trim(regexp_replace(o, '\\s+', ' ', 'g')), ' ')) <= 4 AND NOT regexp_matches(o, '[.!?]\\s') AS brief FROM f),
c AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE obj) AS objects, count(*) FILTER (WHERE brief) AS briefs, count(DISTINCT lower(trim(o))) AS kinds FROM p GROUP BY field),
v AS (SELECT field, sum(n) FILTER (WHERE n > 1) AS repeated FROM (SELECT field, lower(trim(o)) AS k, count(*) AS n FROM p GROUP BY ALL) GROUP BY field)
SELECT field, n, CASE WHEN objects = n THEN 'json' WHEN objects > 0 THEN 'open' WHEN briefs = n AND kinds BETWEEN 2 AND 200 AND coalesce(repeated, 0) >= 0.8 * n THEN 'classification' ELSE 'open' END AS task FROM c JOIN v USING (field)""")
def suggest_task(spark, t):
    """How each output column would best be scored."""
    fields = t("events").select(F.lit("event_type").alias("field"), F.col("event_type").alias("o"))
    fields = fields.unionByName(t("events").select(F.lit("props").alias("field"), F.col("props").alias("o"))).unionByName(t("documents").select(F.lit("text").alias("field"), F.col("text").alias("o")))
    return baselines.suggest_task(fields, "field", "o")


_TFIDF = """WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all({nd}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
df AS (SELECT w, count(DISTINCT id) AS df FROM d GROUP BY w),
idf AS (SELECT w, ln((1 + n.n) / (1 + df.df)) + 1 AS idf FROM df, n),
tw AS (SELECT id, w, count(*) * any_value(idf) AS x FROM d JOIN idf USING (w) GROUP BY id, w),
tn AS (SELECT id, sqrt(sum(x * x)) AS l FROM tw GROUP BY id),
q AS (SELECT item_id, unnest(regexp_extract_all({nq}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark),
qw AS (SELECT item_id, w, count(*) * any_value(idf) AS x FROM q JOIN idf USING (w) GROUP BY item_id, w),
qn AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM qw GROUP BY item_id),
s AS (SELECT qw.item_id, tw.id, round(sum(qw.x * tw.x) / any_value(qn.l * tn.l), 9) AS sim FROM qw JOIN tw USING (w) JOIN qn USING (item_id) JOIN tn ON tn.id = tw.id GROUP BY 1, 2),
b AS (SELECT item_id, id, sim FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, id) = 1)
SELECT benchmark.item_id, coalesce(b.id, (SELECT min(doc_id) FROM documents)) AS doc_id, coalesce(round(b.sim, 6), 0.0) AS similarity FROM benchmark LEFT JOIN b USING (item_id)"""


@register(_TFIDF.format(nd=norm("text"), nq=norm("text")))
def tfidf_nearest(spark, t):
    """The document nearest to each benchmark item by TF-IDF cosine."""
    train = t("documents").select(F.col("doc_id").alias("id"), "text")
    return baselines.tfidf_nearest(train, t("benchmark").select("item_id", "text"), "item_id").select("item_id", F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


@register()
def logreg_baseline(spark, t):
    """Accuracy of a multinomial logistic regression over stored vectors, on every fifth row."""
    return baselines.logreg(t("embeddings"), "embedding", "label", F.col("vec_id") % 5 == 0)
