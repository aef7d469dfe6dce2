"""Every registered query of the tables against its DuckDB SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    kind = type(v).__name__
    return bool(v) if kind == "bool_" else int(v) if kind.startswith(("int", "uint")) else round(float(v), 9) if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, DATA).columns


def test_dangling_references_of_all_customers(spark, duck):
    want = duck.execute("select 'c' || c_custkey, 'n' || (c_custkey % 30) from customer where c_custkey % 30 not in (select n_nationkey from nation)").fetchall()
    assert sorted((r["id"], r["ref"]) for r in queries.queries()["j3_dangling_references"](spark, DATA).collect()) == sorted(want) and max(int(c[1:]) for c, _ in want) > 100


def test_token_weakness_of_texts_that_begin_with_a_known_token(spark, tmp_path):
    """Known tokens are short ones to the SQL; spaces of any kind are trimmed as there, line breaks aren't."""
    texts = [(6, "token of trust"), (4, "Test this"), (30, "\u00a0\u3000" + "x" * 40), (24, "\n" + "y" * 40), (25, "z" * 24 + " z"), (7, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    name = "r22_api_token_weakness"
    assert rows(queries.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_chunks_of_long_documents_are_dealt_over_all_partitions(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a line\n"), 50).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.queries()["q23_ordered_chunks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [file_index" in plan and ", 7" not in plan.split("RepartitionByExpression")[1].split("\n")[0]


def test_overlapping_boxes_are_pairs(spark, duck):
    boxes = duck.execute("select p_partkey, p_brand, p_partkey * 37 % 4000, p_partkey * 91 % 4000, p_size * 4, p_size * 3 from part").fetchall()
    meets = lambda a, b: a[1] == b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    found = queries.queries()["v19_overlapping_boxes"](spark, DATA)
    assert found.columns == ["a", "b"] and sorted(map(tuple, found.collect())) == sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and meets(a, b))


def through_python(plan) -> int:
    """Rows that the Python steps of a plan that has run had back."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
        return through_python(plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan())
    own = plan.metrics().get("pythonNumRowsReceived").get().value() if name == "BatchEvalPython" else 0
    return own + sum(through_python(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize(("name", "cases", "composed"), [("r2_inspection_text", 4, (0, 1, 2)), ("r4_inspect_text", 7, (3,)), ("r6_classify_send", 8, ())])
def test_texts_that_composition_cannot_change_wait_for_no_python(spark, duck, name, cases, composed):
    out = queries.queries()[name](spark, DATA)
    assert dict(out.collect()) == dict(duck.execute(queries.oracle_sql()[name]).fetchall())
    got = through_python(out._jdf.queryExecution().executedPlan())
    assert got == duck.execute(f"select count(*) from events where event_id % {cases} in {(*composed, -1)}").fetchone()[0]
