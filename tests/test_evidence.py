"""Support of evidence by hits of its group against plain loops."""

import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from lecturelake.operators import evidence
from lecturelake.plans import evidence_queries
from lecturelake.plans.tables import Tables
from tests.oracle import SF

SCHEMA = "g string, uid long, kind string, ids array<string>, linked string, slide int, start_sec double, end_sec double, similarity double, flag string"


def some_items():
    rng = random.Random(4)
    kinds = [*evidence.SUPPORT, "lance_soft", "other", None]
    pick = lambda *xs: rng.choice([*xs, None])
    rows = []
    for g, n in (("a", 40), ("b", 12), ("c", 1), (None, 9)):
        for i in range(n):
            start = pick(*(rng.uniform(0, 900) for _ in range(6)))
            end = pick(start and start + rng.choice([0.0, 5.0, 300.0]), start and start - 3.0)
            ids = pick([], ["1", "2", "1"], ["3", None])
            rows.append((g, i, rng.choice(kinds), ids, pick("1", "2", "3"), pick(1, 2, 3, 4), start, end, pick(0.0, 0.5, 1.0), pick("R", "R", "A")))
    return rows


def plain(rows):
    out = {}
    for g, uid, kind, ids, _, slide, start, end, _, _ in rows:
        total, n = 0.0, 0
        for g2, _, _, _, linked, slide2, start2, end2, score, flag in rows:
            if g is None or g != g2 or flag != "R" or kind is None or kind.startswith("lance"):
                continue
            score = 0.5 if score is None else score
            reasons = [evidence.BY_ID] if linked is not None and linked in (ids or []) else []
            reasons += [evidence.BY_SLIDE] if slide is not None and slide == slide2 else []
            if start is not None and start2 is not None:
                stop, stop2 = (s if e is None else e for s, e in ((start, end), (start2, end2)))
                reasons += [evidence.BY_TIME] if max(start, start2) <= min(stop, stop2) + 1 else []
            if reasons:
                total, n = total + evidence.SUPPORT.get(kind, evidence.OTHER_SUPPORT) * max(reasons) * score, n + 1
        out[g, uid] = (round(min(total, evidence.SUPPORT_CAP), 9), n)
    return out


@pytest.mark.parametrize("at_once", [0, 8, 300])
def test_support_equals_plain_loops(spark, at_once):
    """Groups whose hits are given to each item, and (at_once 8: the largest, 0: all) those that go by equi-joins."""
    rows = some_items()
    df = spark.createDataFrame(rows, SCHEMA)
    with mock.patch.object(evidence, "AT_ONCE", at_once):
        got = evidence.with_support(df, "g", F.col("flag") == "R")
        assert got.columns == [*df.columns, "support", "n_hits"]
        got = got.select("g", "uid", "support", "n_hits").collect()
    want = plain(rows)
    assert len(got) == len(rows) and {(r.g, r.uid): (round(r.support, 9), r.n_hits) for r in got} == want
    assert any(0 < s < evidence.SUPPORT_CAP for s, _ in want.values()) and any(n > 1 for _, n in want.values())


def test_a_group_is_brought_together_once(spark):
    """Before, each reason of support shuffled items and hits by keys of its own, and their pairs twice more."""
    for df in (evidence_queries.scored(Tables(spark, SF)), evidence.with_support(evidence_queries.items(Tables(spark, SF)), "g", F.col("flag") == "R")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_groups_of_many_hits_are_stored_for_their_joins(spark):
    """The lines of other orders do not reach the joins on ids, slides and time."""
    with mock.patch.object(evidence, "AT_ONCE", 3):
        df = evidence_queries.scored(Tables(spark, SF)).select("g", "uid", F.round("score", 6))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, df.collect()))
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("/lecturelake/rest") > 1
    assert got == sorted(map(tuple, evidence_queries.scored(Tables(spark, SF)).select("g", "uid", F.round("score", 6)).collect()))
