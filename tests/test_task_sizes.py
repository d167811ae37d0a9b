"""What one task holds does not grow with the tables."""

from pyspark.sql import functions as F

from tracewright.operators import detectors, rankings
from tracewright.operators import tails as measures
from tracewright.operators.facts import facts
from tracewright.operators.graph import kept, settings
from tracewright.plans import findings, tails
from tracewright.sources import driver_tables


def test_facts_of_a_few_events_a_task(spark, sf_dir, monkeypatch):
    """The number of tasks follows the number of events, and no stage puts them together again."""
    monkeypatch.setattr(driver_tables, "EVENTS_A_TASK", 20)
    for adapter in (driver_tables.work_events, driver_tables.trace_events):
        rows = facts(adapter(spark, sf_dir))
        assert rows.rdd.getNumPartitions() == 50
        assert "Exchange hashpartitioning(session_id" not in rows._jdf.queryExecution().executedPlan().toString()


def test_run_brief_makes_its_facts_once(spark, sf_dir, monkeypatch):
    """rules and tails read one checkpoint of the facts."""
    made = []
    monkeypatch.setattr(tails, "facts", lambda events: made.append(1) or facts(events))
    assert tails.run_brief(spark, sf_dir).columns == ["section", "place", "name", "label", "n", "sessions", "score"]
    assert len(made) == 1


def test_digests_stay_where_events_were_dealt(spark, sf_dir, monkeypatch):
    """episodes and their digests are made in the tasks of their events; nothing is dealt anew over few partitions."""
    from tracewright.plans.diagnoses import episode_digests

    monkeypatch.setattr(driver_tables, "EVENTS_A_TASK", 20)
    found = episode_digests(spark, sf_dir)
    assert found.rdd.getNumPartitions() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange hashpartitioning(session_id" not in plan


def test_tails_keep_as_many_tasks_as_the_facts(spark, sf_dir, monkeypatch):
    """behind the checkpoint of the facts, what gathers a session's rows is in as many tasks as the events ask for."""
    monkeypatch.setattr(driver_tables, "EVENTS_A_TASK", 20)
    for query in (tails.theme_scores, tails.priority_rank):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(", 50), REPARTITION_BY_NUM") >= 4
        assert "Exchange hashpartitioning(session_id" in plan and "Window" in plan


def test_run_brief_deals_its_sessions_once(spark, sf_dir, monkeypatch):
    """measures and rules are counted in the tasks that the facts were made in, and what is counted is what sets of
    sessions give."""
    monkeypatch.setattr(driver_tables, "EVENTS_A_TASK", 100)
    persisted = spark.sparkContext._jsc.getPersistentRDDs
    before, rows = persisted().size(), lambda df: sorted(map(tuple, df.collect()))
    dealt_again = lambda df: "Exchange hashpartitioning(session_id" in df._jdf.queryExecution().executedPlan().toString()
    # Tables so small would be broadcast.
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}), kept(facts(driver_tables.work_events(spark, sf_dir))) as made:
        assert made.count() > 1000
        found = measures.incidents(made, measures=(measures.model_usage, measures.retry_attempts, measures.cache_rebuilds))
        counted = measures.tallies(found, 0.02)
        assert found.rdd.getNumPartitions() == 10 and not dealt_again(counted)
        assert not dealt_again(measures.tallies(measures.incidents(made, measures=(measures.delegations,))))
        assert rows(rankings.scored(counted)) == rows(rankings.themes(found))
        want = measures.observations(found, 0.02).groupBy("detector", "severity").agg(F.count("*"), F.countDistinct("session_id"))
        assert rows(counted.filter("observed > 0").select("detector", "severity", "observed", "observed_sessions")) == rows(want)
        assert not dealt_again(detectors.tallies(detectors.run(made, findings.KNOBS, known=True, enabled={"EDIT_WITHOUT_READ", "STYLE_IMPOSITION", "RETRY_STORM"})))
    assert persisted().size() == before
