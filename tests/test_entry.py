"""Driver contract: entry runs, every oracle has a query, queries run at sf0.001."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["run_id", "cluster_id", "keyphrases", "medoid", "samples"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


# Queries of the optional subpackage have their own tests.
OWN = [k for k in E.queries() if k.startswith("q_")]


@pytest.mark.parametrize("name", OWN)
def test_query_runs_at_smoke_scale(spark, name):
    """Every query runs, from a plan of few scans without a join that lacks a key."""
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("FileScan") < 60
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("missing", ["public_tokenizers", "revwise.llm", "corpus_pipeline"])
def test_other_queries_stay_without_the_optional_part(monkeypatch, missing):
    """A dependency of the optional part that can't be imported costs that part alone."""
    import sys
    for name in [m for m in sys.modules if m == missing or m.startswith(missing + ".") or m == "revwise.llm.queries"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    found = E.queries()
    assert sorted(k for k in found if k.startswith("q_")) == sorted(OWN) and "pipeline" not in found
    assert set(E.oracle_sql()) <= set(found)
