"""Goals meet names without carrying their texts along, and words that no term can match are dropped where they are read."""

from factloom.functions.words import starts
from factloom.operators.ranking import best_by_word
from factloom.plans import questions
from factloom.session import cut_lineage
from helpers import pairs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_goal_texts_are_shuffled_once(spark, monkeypatch):
    """One exchange by goal for texts and names alike; no sort of every word of every goal."""
    monkeypatch.setattr(questions, "GOAL_ROWS", 2, raising=False)
    goals = [("r", "g1", "Show the Order Line of big_order, then Order again"), ("r", "g2", "order lines\nnothing"), ("r", "g2", "zebra lines order line"), ("r", "g3", None), ("r", "g4", "a-b"), ("s", "g1", "order line")]
    names = [("r", "order line"), ("r", "Order"), ("r", "big_order"), ("r", "order line"), ("r", "lines of"), ("r", "--")]
    out = questions.goal_terms(spark.createDataFrame(goals, "repo string, goal_id string, text string"), spark.createDataFrame(names, "repo string, name string"))
    assert pairs(out, "repo", "goal_id", "position", "term") == [
        ("r", "g1", 1, "order line"), ("r", "g1", 2, "big_order"), ("r", "g1", 3, "order"), ("r", "g1", 4, "again"),
        ("r", "g2", 1, "order line"), ("r", "g2", 2, "order"), ("r", "g2", 3, "zebra"), ("r", "g2", 4, "lines"), ("r", "g2", 5, "nothing"),
        ("s", "g1", 1, "order"), ("s", "g1", 2, "line"),
    ]
    plan = _plan(out)
    assert "Window" not in plan and plan.count("hashpartitioning(repo#") == 1 and "REPARTITION_BY_NUM" in plan


def test_unmatched_names_are_not_shuffled(spark):
    rows = [("r", f"src/f{k}", f"Red{k}Client") for k in range(50)] + [("r", "a", "BlueThing"), ("r", "b", "Clients"), ("r", "c", "client"), ("r", "a0", "client"), ("s", "z", "RedClient")]
    symbols = spark.createDataFrame(rows, "repo string, path string, name string")
    wanted = cut_lineage(starts(spark.createDataFrame([("r", "Client")], "repo string, term string"), "term"))
    got = best_by_word(symbols, wanted=wanted)
    keep = [r for r in pairs(best_by_word(symbols), "repo", "word", "inexact", "at", "hit") if r[0] == "r" and r[1].startswith("clie")]
    assert pairs(got, "repo", "word", "inexact", "at", "hit") == keep == [("r", "client", 0, "a0", "client"), ("r", "clients", 0, "b", "Clients")]
    assert _plan(got).count("Exchange hashpartitioning") == 1


def test_what_is_known_of_a_concept_meets_the_goals_once(spark):
    intent = spark.createDataFrame([("r", f"g{k}", 1, "order", "ACTIVE", "Order", "extend") for k in range(3)] + [("r", "g0", 2, "new", "ABSENT", None, "create")], "repo string, goal_id string, position int, term string, verdict string, canonical string, bucket string")
    concepts = spark.createDataFrame([("r", "Order", ["Line", "Item"])], "repo string, name string, relations array<string>")
    owners = spark.createDataFrame([("r", "Order", 1, "src/a"), ("r", "Order", 2, "src/b")], "repo string, target string, rank int, owner string")
    governing = spark.createDataFrame([("r", "Order", "d1"), ("r", "Order", "d2")], "repo string, target string, id string")
    impact = spark.createDataFrame([("r", "Order", "HIGH", 9)], "repo string, target string, severity string, files long")
    out = questions.goal_plan(intent, concepts, owners, governing, impact)
    assert pairs(out, "goal_id", "position", "canonical", "owner", "related", "decisions", "severity", "files") == [(f"g{k}", 1, "Order", "src/a", "Line,Item", 2, "HIGH", 9) for k in range(3)]
    assert sum("Join" in line for line in _plan(out).splitlines()) == 1
