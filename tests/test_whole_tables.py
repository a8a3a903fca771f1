"""Queries over all rows of their tables, against SQL of this file that has no bounds on ids or lengths."""

import pytest

from .test_queries import QUERIES, SF_DIR, canon, duck  # noqa: F401

WHOLE = {
    "distill_records": """WITH m AS (SELECT max(item_id) + 1 AS items FROM benchmark), r AS (SELECT event_id, event_id % items AS item_id, props AS answer FROM events, m WHERE event_id % 9 <> 0)
SELECT row_number() OVER (ORDER BY item_id, event_id) AS place, item_id, sha256(text) AS prompt, answer FROM benchmark JOIN r USING (item_id) WHERE answer IS NOT NULL""",
    "judge_requests": """WITH c(model) AS (VALUES ('base'), ('tuned'), ('teacher')), o(turn) AS (VALUES ('ab'), ('ba'))
SELECT 'point' AS kind, model AS who, item_id, '-' AS turn, model || '/' || item_id AS id FROM benchmark, c
UNION ALL SELECT 'pair', a.model || ':' || b.model, item_id, turn, a.model || ':' || b.model || '/' || item_id || '/' || turn FROM benchmark, c a, c b, o WHERE a.model < b.model""",
    "row_audit": """WITH m AS (SELECT max(event_id) + 1 AS ids FROM events), w AS (SELECT event_id AS id FROM events, m WHERE event_id < ids * 4 // 5),
c AS (SELECT event_id % (ids * 9 // 10) AS id, count(*) AS n FROM events, m WHERE event_id % 10 <> 3 GROUP BY 1)
SELECT id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'extra' ELSE 'duplicated' END AS problem FROM w FULL OUTER JOIN c USING (id) WHERE n IS NULL OR w.id IS NULL OR n > 1""",
}


def compared(spark, duck, name, sql):  # noqa: F811
    df = QUERIES[name](spark, SF_DIR)
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.collect(), df.columns) == canon(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_rows_take_part(spark, duck, name):  # noqa: F811
    compared(spark, duck, name, WHOLE[name])


def test_loss_curves_reach_the_last_event(spark, tmp_path):
    rows = [(n, 1.0) for n in range(3000)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["loss_curves"](spark, str(tmp_path)).collect()[0]["n"] == 3000


def test_segments_are_whole_turns(spark, duck):  # noqa: F811
    compared(spark, duck, "flattened_segments", """WITH s AS (SELECT conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') AS seg FROM conversations), f AS (SELECT conv_id, string_agg(seg, ' ' ORDER BY turn) AS text FROM s GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, sha256(lower(text)) AS digest FROM f GROUP BY lower(text)""")
