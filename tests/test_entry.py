"""Driver contract, plan checks and oracle agreement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from marquee.plans import registry
from tests.conftest import SF001

HEAVY = {"svd_topn_unseen", "svd_score_moments", "train_hybrid", "evaluate_modes", "dataset_run", "stream_ingest"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["title", "year", "clean_title", "appearance_count"]


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    assert set(registry.QUERIES) <= set(q)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def test_plans_and_oracle_types(spark, con):
    """No cross products or row-at-a-time UDFs in any plan; oracle column types equal Spark's."""
    bad, types = [], []
    E.queries()
    oracle = registry.oracles()
    for name, fn in registry.QUERIES.items():
        if name in HEAVY:
            continue
        df = fn(spark, SF001)
        plan = _plan(df)
        for marker in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            if marker in plan:
                bad.append((name, marker))
        if name in oracle:
            ot = {r[0]: r[1] for r in con.execute(f"DESCRIBE {oracle[name]}").fetchall()}
            for f in df.schema.fields:
                t = f.dataType.simpleString()
                if not (ot.get(f.name) == DUCK.get(t, t) or (t.startswith("array") and str(ot.get(f.name)).endswith("[]"))):
                    types.append((name, f.name, t, ot.get(f.name)))
    assert bad == []
    assert types == []


def test_scan_is_pruned(spark):
    plan = _plan(E.queries()["unique_items"](spark, SF001))
    line = [ln for ln in plan.splitlines() if "orders.parquet" in ln and "ReadSchema" in ln][0]
    assert "o_custkey" in line
    assert "o_totalprice" not in line and "o_orderstatus" not in line and "o_orderpriority" not in line


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["unique_items", "final_reviews", "match_cascade", "list_top", "tfidf",
                                  "item_features", "topn_unseen", "auc", "content_score", "json_details",
                                  "ingest_ratings", "percentiles"])
def test_oracle_agreement_sf0001(spark, con, name):
    from tools.compare import digest
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
