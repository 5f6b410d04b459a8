"""Sequential operators and text rules against plain loops and known cases."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lecturelake.functions import texts
from lecturelake.operators import build, folds, timeline
from lecturelake.plans import registry
from tests.oracle import SF


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def absorbed(runs, least):
    moved = True
    while moved:
        moved, out, i = False, [], 0
        while i < len(runs):
            r = runs[i]
            if 0 < i < len(runs) - 1 and r[2] - r[1] < least and runs[i - 1][0] == runs[i + 1][0]:
                p = out.pop()
                out.append((p[0], min(p[1], r[1], runs[i + 1][1]), max(p[2], r[2], runs[i + 1][2])))
                i, moved = i + 2, True
                continue
            out.append(r)
            i += 1
        runs = out
    return runs


def test_absorbed_runs_equal_a_plain_loop(spark):
    import random

    rng, rows, want = random.Random(2), [], {}
    for key in range(12):
        at, runs, before = 0.0, [], None
        for i in range(rng.randint(0, 25)):
            kind = rng.choice([k for k in "abc" if k != before])
            length = rng.choice([1.0, 2.0, 20.0])
            runs.append((kind, at, at + length))
            at, before = at + length, kind
        rows += [(key, i, *r) for i, r in enumerate(runs)]
        want[key] = absorbed(runs, 12.0)
    df = spark.createDataFrame(rows, "key int, i long, kind string, start double, stop double")
    got = {key: [] for key in want}
    for r in timeline.absorb_short(df, "key", 12.0).orderBy("key", "i").collect():
        got[r.key].append((r.kind, r.start, r.stop))
    assert got == want
    assert timeline.absorb_short(df.limit(0), "key", 12.0).count() == 0


def test_greedy_groups_equal_a_plain_loop(spark):
    rows = [("g", i, i) for i in range(6)] + [("h", 0, 9)]
    links = [("g", 0, 1), ("g", 1, 2), ("g", 3, 4), ("g", 0, 5)]
    items = spark.createDataFrame(rows, "g string, place int, item int")
    near = spark.createDataFrame(links, "g string, a int, b int")
    some = {(r.g, r.item): r.cluster for r in build.greedy_groups(items, near, "g", complete=False).collect()}
    every = {(r.g, r.item): r.cluster for r in build.greedy_groups(items, near, "g", complete=True).collect()}
    assert some == {("g", 0): 0, ("g", 1): 0, ("g", 2): 0, ("g", 3): 1, ("g", 4): 1, ("g", 5): 0, ("h", 9): 0}
    assert every == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 2, ("g", 5): 3, ("h", 9): 0}


def test_tracks_and_claims(spark):
    step, state, tracks = timeline.track_step(), None, []
    for row in [(1, 0.1, 0.1, 0.2, 0.2), (1, 0.7, 0.7, 0.1, 0.1), (2, 0.15, 0.1, 0.2, 0.2), (2, 0.7, 0.71, 0.1, 0.1), (4, 0.1, 0.1, 0.2, 0.2), (5, 0.31, 0.1, 0.2, 0.2)]:
        state, sent = step(state, row)
        tracks += [t for _, t in sent]
    assert tracks == [1, 2, 1, 2, 3, 3]
    claims = [(1, "heapgrows", ["heap", "grows"]), (2, "theheapgrowsup", ["the", "heap", "grows", "up"]), (3, "stack", ["stack"]), (4, "", []), (5, "stack", ["stack"])]
    state = None
    for row in claims:
        state, _ = timeline.claim_step(state, row)
    assert [c for c, _, _ in state[0]] == [2, 3, 4]


def test_scene_changes_stream_and_table_agree(spark):
    table = sorted((r.user_id, r.event_id, r.reason) for r in registry.QUERIES["win_slide_change"](spark, SF).collect() if r.reason != "end_flush")
    assert table == sorted((r.user_id, r.event_id, r.reason) for r in registry.QUERIES["stream_slide_change"](spark, SF).collect())
    step, state, sent = timeline.scene_step(2, 4, 3), None, []
    still = (10, 0, 10, 0, 0.0, 0, 0)
    for frame in [(1, *still), (2, 900, 12, 900, 12, 0.5, 0, 0), (3, 10, 1, 900, 12, 0.5, 0, 0), (4, *still), (5, 900, 12, 900, 12, 0.5, 0, 0)]:
        state, out = step(state, frame)
        sent += out
    assert sent == [(1, "first_frame"), (2, "stabilized")] and timeline.scene_flush(state) == [(5, "end_flush")]


def test_folds_keep_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 400.0), ("a", 1, 3.0)], "k string, i int, v double")
    step, last = folds.pack_speech(10.0)
    got = sorted(((r.k or ""), r.pieces) for r in folds.fold(df, "k", ["i"], ["i", "v"], step, last, "k string, start int, seconds double, pieces long").collect())
    assert got == [("", 1), ("", 1), ("a", 1)]
    assert folds.fold(df.limit(0), "k", ["i"], ["i", "v"], step, last, "k string, start int, seconds double, pieces long").count() == 0


def test_text_rules(spark):
    lit = F.lit
    assert value(spark, texts.sentences(lit("페이지를 교체한다 프레임이 필요하죠. 끝"))) == ["페이지를 교체한다", "프레임이 필요하죠.", "끝"]
    assert value(spark, texts.excerpt(lit("One. Two is longer than thirty-five characters here. Three."))) == "One. Two is longer than thirty-five characters here."
    assert value(spark, texts.trimmed(lit("alpha beta gamma"), 12)) == "alpha beta..."
    assert value(spark, texts.canonical_key(lit("스케줄링의 개념 (Scheduling)"))) == "스케줄링"
    assert value(spark, texts.question_keywords(lit("‘가상 메모리’의 장점은 무엇인가요?"), ("무엇인가요",))) == ["가상 메모리", "가상", "메모리", "장점"]
    marks = F.array(F.struct(lit("bb").alias("text"), lit(4).alias("count")), F.struct(lit("b").alias("text"), lit(1).alias("count")))
    assert value(spark, texts.marked(lit("aa bb cc b"), marks)) in ("aa ***bb*** cc b", "aa ***bb*** cc *b*", "aa ***bb*** cc b")
    assert value(spark, texts.one_letter_apart(lit("paging"), lit("paxing")), texts.one_letter_apart(lit("abc"), lit("abd"))) == (True, False)
    assert abs(value(spark, texts.sequence_similarity(lit("abcd"), lit("bcde"))) - SequenceMatcher(None, "abcd", "bcde").ratio()) < 1e-12
    assert value(spark, texts.is_concept(lit(None).cast("string")), texts.code_like(lit(None).cast("string")), texts.domain(lit(None).cast("string"))) == (False, 0.0, "etc")
    assert value(spark, texts.keyword(lit(None).cast("string")), texts.without_ending(lit("")), texts.sentences(lit(""))) == (None, "", [])
