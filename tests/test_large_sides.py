"""What has a row for every record is dealt, not sent to every task, however few bytes its files have."""

import re

import pytest


@pytest.mark.parametrize("name", ["ranking_findings", "ranking_reasons", "recommendations"])
def test_records_are_not_broadcast(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [consultation" in plan and not re.search(r"Broadcast(HashJoin|NestedLoopJoin) \[(consultation|o_orderkey)", plan)


def test_grams_and_texts_are_not_broadcast(spark):
    from __spark_entry__ import queries

    plan = queries()["containment_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_text" in plan and not re.search(r"Broadcast(HashJoin|NestedLoopJoin)", plan)


@pytest.mark.parametrize("name", ["recommendation_input_hash", "assessment_explanations", "snapshots"])
def test_names_are_looked_up_in_place(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[(ask|proposed|generic|drug|knowledge_id)#", plan)


def test_consultations_meet_their_indications_drugs_in_place(spark):
    """However few bytes their file has against the drugs' plan, consultations aren't the side that is sent."""
    from evidara.bindings import composed
    from evidara.plans import ranking

    d = "/root/testdata/sf0.001"
    found = ranking.candidates(composed.case(spark, d)["consultations"], composed.indications(spark, d))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[indication#\d+\], \[indication#\d+\], Inner, BuildRight", plan) and "BuildLeft" not in plan


def test_parts_and_customers_are_sent_if_they_are_few(spark, monkeypatch):
    from evidara.bindings import composed
    from evidara.sources import files

    held = {}
    monkeypatch.setattr(files, "written", lambda df, what: (held.setdefault(what, df), what))
    for most, join in ((10, "SortMergeJoin"), (50_000, "BroadcastHashJoin")):
        held.clear()
        monkeypatch.setattr(files, "MOST_SENT", most)
        composed.case(spark, "/root/testdata/sf0.001")
        lines, conditions = (held[k]._jdf.queryExecution().executedPlan().toString() for k in ("lines", "conditions"))
        assert f"{join} [l_partkey" in lines and f"{join} [o_custkey" in conditions
        assert ("Broadcast" in lines + conditions) == (most > 10)


@pytest.mark.parametrize("name", ["ranking_findings", "ranking_reasons", "recommendations"])
def test_candidates_are_not_dealt(spark, name):
    """A consultation's candidates are many times its records: only these are dealt, once, and nothing by consultation and drug."""
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "consultation" in x]
    assert len(dealt) == 2 and not any("drug" in x for x in dealt)


def test_lines_are_dealt_before_their_sets_are_made(spark, monkeypatch):
    from evidara.bindings import composed
    from evidara.sources import files

    held = {}
    monkeypatch.setattr(files, "written", lambda df, what: (held.setdefault(what, df), what))
    composed.case(spark, "/root/testdata/sf0.001")
    made, _, dealt = held["lines"]._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(o_orderkey")
    assert "collect_set" in made and dealt and "collect_set" not in dealt
