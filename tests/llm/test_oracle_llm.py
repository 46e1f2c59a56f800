"""Training-data queries against their SQL counterparts, and what is registered."""

import pytest

import __spark_entry__ as driver
from compare import differences, oracle
from conftest import SF_SMALL
from docquarry.llm.queries import LLM_QUERIES, LLM_SQL


def test_all_operators_are_registered():
    names = driver.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14))
    assert "pipeline" in names and set(LLM_SQL) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_same_rows(spark, name):
    assert differences(LLM_QUERIES[name](spark, SF_SMALL), oracle(SF_SMALL).sql(LLM_SQL[name])) == ""


@pytest.mark.parametrize("name", ["op5_sharding", "op6_decontamination"])
def test_native_plans_hold_no_python(spark, name):
    plan = LLM_QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
