"""Speech groups, chunks and scene rules against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lecturelake.operators import speech
from lecturelake.operators.intervals import best_scene, scene_at


def plain_groups(segments, longest=30.0):
    """segments: (start, tie, end, text) of one key."""
    rows = sorted((s for s in segments if s[0] is not None and s[2] is not None), key=lambda s: (s[0], s[1]))
    groups = []
    for i, (start, tie, end, text) in enumerate(rows):
        reason = None
        if i:
            pause = start - rows[i - 1][2]
            ends = bool(re.match(r".*[.!?。！？]\s*$", (rows[i - 1][3] or "").strip(), re.S))
            if pause >= 1.2:
                reason = "paragraph"
            elif end - groups[-1][1][0][0] > longest:
                reason = "length"
            elif ends and pause >= 0.4:
                reason = "sentence"
            elif pause >= 0.6:
                reason = "pause"
        if not i or reason:
            groups.append((reason, []))
        groups[-1][1].append((start, end, (text or "").strip(), tie))
    return [(i, reason, g[0][0], g[-1][1], " ".join(x[2] for x in g if x[2]), len(g), g[0][3]) for i, (reason, g) in enumerate(groups)]


def made(rng, n, scale=1.0):
    out, at = [], 0.0
    for i in range(n):
        at = round(at + scale * rng.choice([0, 0, 0.1, 0.4, 0.5, 0.6, 0.7, 1.2, 2]), 1)
        end = round(at + rng.choice([0, 0.5, 3, 8, 35]), 1)
        out.append((at, i, end, rng.choice(["so", "and.", "what? ", " ", None, "x。", "y.z"])))
        at = rng.choice([at, end, end])
    return out


def test_groups_equal_a_plain_loop(spark):
    rng = random.Random(5)
    keys = {k: made(rng, rng.choice([1, 2, 60]), rng.choice([0.2, 1])) for k in ["a", "b", "c", "d", None]}
    keys["b"] += [(None, 1000, 3.0, "x"), (4.0, 1001, None, "y")]
    rows = [(k, *s, "more") for k, x in keys.items() for s in x]
    df = spark.createDataFrame(rows, "k string, start double, seg int, end double, text string, n string")
    for width in (7.0, 3600.0):
        got = sorted((r.k or "", tuple(r)[1:]) for r in speech.speech_groups(df, "k", "seg", width).collect())
        assert got == sorted((k or "", g) for k, x in keys.items() for g in plain_groups(x))
    assert speech.speech_groups(df.limit(0), "k", "seg").count() == 0


def test_a_long_speech_without_a_pause(spark):
    # one user's 200,000 segments without a break by pauses, beside another's few
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 2.0).alias("start"), F.col("id").alias("seg"), (F.col("id") * 2.0 + 2.0).alias("end"), F.lit("on").alias("text"))
    df = df.union(spark.createDataFrame([("u", 0.0, 1, 1.0, "a."), ("u", 1.5, 2, 2.0, "b")], df.schema))
    x = speech.group_segments(df, "k", "seg")
    sizes = x.groupBy("k", "opened", "part").count().groupBy("k", "count").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.k, r["count"], r.n) for r in sizes) == [("hot", 5, 1), ("hot", 15, 13333), ("u", 1, 2)]


def test_merged_groups(spark):
    g = spark.createDataFrame([("a", i, float(i), i + 0.5, t, 1, i) for i, t in enumerate(["x", "", "y", "z"])] + [("b", 0, 0.0, 1.0, "w", 2, 0)], "k string, grp long, start double, end double, text string, n long, first_tie int")
    joins = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 3), ("b", 0), ("c", 5)], "k string, grp long")
    got = sorted(tuple(r) for r in speech.merge_groups(g, "k", joins).collect())
    assert got == [("a", 0, 0.0, 2.5, "x  y", 3), ("a", 1, 3.0, 3.5, "z", 1), ("b", 0, 0.0, 1.0, "w", 2)]


def plain_chunks(total, silences, silence=1.5, longest=180.0, shortest=30.0, pad=0.1):
    cuts = sorted((s, e) for s, e in silences if s is not None and e is not None and e - s >= silence)
    raw, cursor = [], 0.0
    for s, e in cuts:
        s, e = max(0.0, s), min(total, e)
        if s > cursor:
            raw.append((cursor, s))
        cursor = e
    if cursor < total:
        raw.append((cursor, total))
    padded = []
    for s, e in raw:
        padded.append((max(0.0, s - pad, padded[-1][1] if padded else 0.0), min(total, e + pad)))
    pieces = [(s + i * longest, min(e, s + (i + 1) * longest)) for s, e in padded for i in range(max(1, math.ceil((e - s) / longest)))]
    groups = []
    for s, e in pieces:
        if e <= s:
            continue
        if groups and sum(b - a for a, b in groups[-1]) + e - s <= longest:
            groups[-1].append((s, e))
        else:
            groups.append([(s, e)])
    size = lambda g: sum(b - a for a, b in g)
    if len(groups) > 1 and size(groups[-1]) < shortest and size(groups[-2]) + size(groups[-1]) <= longest:
        groups[-2] += groups.pop()
    return [(g[0][0], g[-1][1], size(g), len(g)) for g in groups]


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(6)
    keys = {"silent": (10.0, [(0.0, 10.0)]), "none": (0.0, []), "whole": (400.0, []), "short": (3.0, [(1.0, 1.2)]), "tail": (200.0, [(120.0, 122.0), (175.0, 177.0)])}
    for i in range(30):
        total = rng.choice([50.0, 700.0, 2500.0])
        starts = [rng.uniform(-5, total) for _ in range(rng.randint(0, 12))]
        keys[f"r{i}"] = (total, [(s, s + rng.choice([0.5, 1.6, 4, 60])) for s in starts])
    totals = spark.createDataFrame([(k, t) for k, (t, _) in keys.items()] + [("null", None)], "k string, total double")
    silences = spark.createDataFrame([(k, s, e, 1) for k, (_, x) in keys.items() for s, e in x] + [("whole", None, 5.0, 1), ("nobody", 1.0, 9.0, 1)], "k string, start double, end double, total int")
    got = {}
    for r in speech.speech_chunks(totals, silences, "k").collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.seconds, r.pieces))
    for k, (total, x) in keys.items():
        want = plain_chunks(total, x)
        assert [g[3] for g in sorted(got.get(k, []))] == [w[3] for w in want], k
        assert all(a == pytest.approx(b, abs=1e-6) for g, w in zip(sorted(got.get(k, [])), want, strict=True) for a, b in zip(g, w, strict=True))
    assert "null" not in got and "nobody" not in got


def plain_best(start, end, scenes):
    """scenes: (ls, le, scene), sorted."""
    start = start or 0.0
    end = max(start, end or start)
    over = [(min(end, le) - max(start, ls), ls, le, i) for ls, le, i in scenes]
    over = sorted(((o, ls, le, i) for o, ls, le, i in over if o > 0), key=lambda x: (-x[0], -x[1], x[2], x[3]))
    if over:
        later = [x for x in over if start < x[1] <= end]
        if later:
            o, ls, _, i = min(later, key=lambda x: (x[1], -x[0], x[2], x[3]))
            if start >= ls - 1.0 or o >= over[0][0] * 0.75 or end - ls >= 0.2:
                return i
        return over[0][3]
    at = start + (end - start) * 0.65
    for ls, le, i in scenes:
        if ls <= at <= le:
            return i
    near = min(((min(abs(at - ls), abs(at - le)), ls, le, i) for ls, le, i in scenes), default=None)
    return near[3] if near and near[0] <= 3.0 else None


def test_scene_rules_equal_a_plain_loop(spark):
    rng = random.Random(7)
    scenes, rows = {}, []
    for u in range(12):
        scenes[u] = sorted((s, s + float(rng.choice([0.0, 0.1, 1, 4, 20])), 100 * u + j) for j, s in enumerate(float(rng.choice([0, 1, 2, 5, 5.5, 10, 30, 31]) + rng.choice([0, 0.25])) for _ in range(rng.randint(0, 7))))
        rows += [(u, 1000 * u + j, rng.choice([None, 0.0, 1.0, 4.0, 4.8, 5.0, 9.5, 24.0, 33.0, 60.0]), None) for j in range(40)]
    rows = [(u, i, s, rng.choice([None, 0.0, (s or 0.0) - 1, (s or 0.0) + 0.2, (s or 0.0) + 1.25, (s or 0.0) + 7])) for u, i, s, _ in rows]
    s = spark.createDataFrame([(u, i, ls, le) for u, x in scenes.items() for ls, le, i in x], "u int, scene int, ls double, le double")
    r = spark.createDataFrame(rows, "u int, row int, rs double, re double")
    got = {x.row: x.scene for x in best_scene(r, s, ["u"], "row", "scene", 2.0).collect()}
    assert got == {i: plain_best(a, b, scenes[u]) for u, i, a, b in rows}
    at = {x.row: x.scene for x in scene_at(r.withColumnRenamed("rs", "at").drop("re"), s, ["u"], "row", "at", "scene", 2.0).collect()}
    for u, i, a, _ in rows:
        inside = [n for ls, le, n in sorted(scenes[u], key=lambda x: (x[0], x[2])) if a is not None and ls <= a < le]
        ends = sorted((ls, n) for ls, _, n in scenes[u])
        assert at[i] == (inside[0] if inside else None if a is None or not ends else ends[0][1] if a < ends[0][0] else ends[-1][1])


def test_query_chunks_equal_a_plain_loop(spark):
    from lecturelake.plans import registry
    from tests.oracle import SF

    at = F.pmod(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6, F.lit(3600.0))
    users = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", at.alias("at"), "value").collect():
        users.setdefault(r.user_id, []).append((r.at, r.at + r.value / 10))
    got = sorted((r.user_id, r.pieces) for r in registry.QUERIES["win_chunk_pack_speech"](spark, SF).collect())
    assert got == sorted((u, c[3]) for u, x in users.items() for c in plain_chunks(3600.0, x))


def test_contexts_equal_a_plain_loop(spark):
    rng = random.Random(8)
    rows, named, want = [], [], []
    for k in ("a", "b", None):
        own = sorted((round(rng.uniform(0, 50), 1), i, rng.choice(["x", " ", None, "thank you", "thank you " * 20, "y  z"])) for i in range(40))
        marks = set(rng.sample(range(40), 6))
        groups = []
        short = lambda t: len(" ".join((t or "").split())) <= 90 and "thank" in (t or "")
        for j, (at, i, text) in enumerate(own):
            if not j or own[j - 1][1] in marks or short(own[j - 1][2]) or short(text):
                groups.append([])
            groups[-1].append((at, i, (text or "").strip()))
        rows += [(k, at, i, at + 1, text) for at, i, text in own]
        named += [(k, i) for i in marks]
        want += [(k or "", n, g[0][0], g[-1][0] + 1, " ".join(t for _, _, t in g if t), len(g)) for n, g in enumerate(groups)]
    df = spark.createDataFrame([*rows, ("a", None, 99, 1.0, "thank you")], "k string, start double, seg int, end double, text string")
    breaks = spark.createDataFrame([*named, *named, ("a", 1000)], "k string, seg int")
    for width in (5.0, 3600.0):
        got = speech.contexts(df, "k", "seg", breaks, "thank", width=width).collect()
        assert sorted((r.k or "", *tuple(r)[1:]) for r in got) == sorted(want)
    assert speech.contexts(df.limit(0), "k", "seg", breaks, "thank").count() == 0


def test_remarks_are_told_by_their_words(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 1.0, "본문"), ("a", 1.0, 1, 2.0, "질문 있나요"), ("a", 2.0, 2, 3.0, "본문 둘"), ("a", 3.0, 3, 4.0, "설명 " * 40 + "감사합니다")], "k string, start double, seg int, end double, text string")
    none = spark.createDataFrame([], "k string, seg int")
    assert sorted((r.context, r.n) for r in speech.contexts(df, "k", "seg", none).collect()) == [(0, 1), (1, 1), (2, 2)]
