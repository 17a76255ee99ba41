"""Plans that must hold at scale."""

import re

import pytest

from tapeline.operators import indicators, maintain, rules
from tapeline.plans import derive
from tapeline.plans.queries import QUERIES
from tapeline.session import configure


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)


def test_fact_needs_one_shuffle_after_the_join(spark, sf_dir):
    joined = derive.stored(spark, sf_dir, "plan_joined", lambda: derive.joined_bars(spark, sf_dir))
    text = plan(indicators.build_fact(joined))
    assert text.count("Exchange hashpartitioning(symbol_key") == 1
    assert text.count("Exchange") == 1 and len(re.findall(r"- Sort \[", text)) == 1
    assert len(re.findall(r"- Window \[", text)) == 2


def test_small_dimensions_are_broadcast(spark, sf_dir):
    text = plan(derive.joined_bars(spark, sf_dir))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_bars_read_only_what_they_need_and_combine_before_the_shuffle(spark, sf_dir):
    text = plan(derive.bars_raw(spark, sf_dir))
    assert "l_tax" not in text and "l_returnflag" not in text
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_time_filter_reaches_the_scan(spark, sf_dir):
    text = QUERIES["read_incremental"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in text


def test_first_per_key_is_cut_before_the_shuffle(spark, sf_dir):
    text = plan(rules.once_rules(derive.custom_matches(spark, sf_dir)))
    assert re.search(r"Exchange hashpartitioning\(rule_id.*\n.*WindowGroupLimit", text)


@pytest.mark.parametrize("name", [q for q in QUERIES if not q.startswith("stream")])
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["match_rules", "bars_1min", "load_watermarks"])
def test_totals_combine_in_hash_tables(spark, sf_dir, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, sf_dir))


def test_upsert_is_an_anti_join(spark, sf_dir):
    silver = derive.silver_bars(spark, sf_dir)
    assert "LeftAnti" in plan(maintain.upsert(silver, silver, ["symbol", "trade_date"]))
