"""Ad-hoc statements read the view and nothing else."""

import pytest

from tracklore.operators.adhoc import other_relations, query_session, run_structured_query, structured_query

VIEW = "v_listening_history"
READS = [
    (f"SELECT * FROM {VIEW}", []),
    (f"SELECT * FROM V_Listening_History v JOIN {VIEW} w ON v.n = w.n", []),
    (f"WITH a AS (SELECT n FROM {VIEW}), b AS (SELECT n FROM a) SELECT * FROM a JOIN b USING (n)", []),
    (f"SELECT n FROM {VIEW} WHERE n IN (SELECT max(n) FROM {VIEW}) AND EXISTS (SELECT 1 FROM (VALUES (1)) AS t(x))", []),
    (f"SELECT id FROM {VIEW}, range(3)", []),
    (f"SELECT s.x FROM {VIEW} v, default.secret s", ["default.secret"]),
    (f"SELECT (SELECT max(x) FROM default.secret) FROM {VIEW}", ["default.secret"]),
    (f"WITH {VIEW} AS (SELECT * FROM secret) SELECT * FROM {VIEW}", ["secret", VIEW]),
    (f"SELECT * FROM {VIEW} UNION ALL SELECT x FROM secret", ["secret"]),
    (f"SELECT (WITH secret AS (SELECT 1 AS x) SELECT max(x) FROM secret), s.x FROM {VIEW}, secret s", ["secret"]),
    (f"WITH a AS (SELECT * FROM b), b AS (SELECT * FROM {VIEW}) SELECT * FROM a", ["b"]),
    (f"SELECT n FROM {VIEW} WHERE EXISTS (SELECT 1 FROM secret WHERE x = n)", ["secret"]),
    (f"SELECT n FROM {VIEW} ORDER BY (SELECT max(x) FROM secret)", ["secret"]),
    (f"SELECT * FROM {VIEW} v JOIN LATERAL (SELECT x FROM secret WHERE x = v.n) l ON true", ["secret"]),
    (f"SELECT * FROM {VIEW}, IDENTIFIER('sec' || 'ret')", ["IDENTIFIER"]),
    (f"SELECT * FROM {VIEW}, parquet.`/tmp/x`", ["parquet./tmp/x"]),
    (f"SELECT * FROM default.{VIEW}", [f"default.{VIEW}"]),
    (f"SELECT n, count(*) FROM {VIEW} GROUP BY n HAVING count(*) > (SELECT max(x) FROM secret)", ["secret"]),
]


@pytest.fixture(scope="module")
def session(spark):
    spark.createDataFrame([(7,)], "x int").createOrReplaceGlobalTempView("secret")
    return query_session(spark, lambda s: s.range(3).selectExpr("id AS n").createOrReplaceTempView(VIEW))


@pytest.mark.parametrize(("sql", "others"), READS)
def test_relations_of_a_statement(session, sql, others):
    assert other_relations(session, sql) == sorted(others)


def test_other_relations_are_refused(session):
    for sql in (
        f"SELECT s.x FROM {VIEW} v, global_temp.secret s",
        f"SELECT (SELECT max(x) FROM global_temp.secret) AS x FROM {VIEW}",
        f"WITH {VIEW} AS (SELECT x FROM global_temp.secret) SELECT * FROM {VIEW}",
    ):
        with pytest.raises(ValueError):
            structured_query(session, sql)
    rows = run_structured_query(session, f"WITH a AS (SELECT max(n) AS m FROM {VIEW}) SELECT m FROM a, (SELECT 1 FROM {VIEW} LIMIT 1)")
    assert rows == [{"m": 2}]
