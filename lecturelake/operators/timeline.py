"""Timelines: runs, regions, roles of visits, tracks and claims in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored
from .folds import Step

# Weights of a visit's score, and when a visit only passes.
SPEECH, DWELL, ORDER, ELABORATED = 0.4, 0.3, 0.3, 0.3


def first_truthy(*columns: Column) -> Column:
    """The first that is not null, empty or blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def absorb_short(runs: DataFrame, key: str, least: float) -> DataFrame:
    """key, i, kind, start, stop: a run shorter than least between two of one kind joins them, until no such run is left.

    Each pass goes from left to right: of candidates next to each other every second is absorbed, since the run after an
    absorbed one is spent. runs: key, i, kind, start, stop. A pass is three windows by key and a table.
    """
    w = Window.partitionBy(key).orderBy("i")
    now = stored(runs.select(key, "i", "kind", "start", "stop"), "runs")
    while True:
        x = now.withColumn("can", F.coalesce((F.col("stop") - F.col("start") < least) & (F.lag("kind").over(w) == F.lead("kind").over(w)), F.lit(False)))
        x = x.withColumn("island", F.sum(F.when(F.col("can"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        place = F.sum(F.col("can").cast("int")).over(Window.partitionBy(key, "island").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        x = x.withColumn("gone", F.col("can") & (place % 2 == 1))
        opens = ~F.col("gone") & ~F.coalesce(F.lag("gone").over(w), F.lit(False))
        x = x.withColumn("g", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        new = x.groupBy(key, "g").agg(F.min_by("kind", "i").alias("kind"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("gone").alias("moved"))
        new = stored(new.select(key, F.col("g").alias("i"), "kind", "start", "stop", "moved"), "runs")
        discard(now)
        now = new.select(key, "i", "kind", "start", "stop")
        now.stored_path = new.stored_path
        if new.filter("moved").limit(1).count() == 0:
            return now


def visit_roles(visits: DataFrame, group: str) -> DataFrame:
    """visits (group, visit, start, stop, silence) with score, role, revisited and continuous.

    A visit that is short, or mostly silent, passes. Of the others the best by speech (.4), dwell and order (.3 each,
    relative to the group) is core, the rest elaborated from .3 on. What comes after the group's first visit that does
    not pass is revisited, and continuous if the pause since the one before is under a second and a half.
    """
    w = Window.partitionBy(group)
    dwell = F.col("stop") - F.col("start")
    share = F.when(dwell > 0, F.least(F.lit(1.0), F.col("silence") / dwell)).otherwise(0.0)
    x = visits.withColumns({"dwell": dwell, "quiet": share, "speech": F.greatest(F.lit(0.0), 1 - share)})
    spread = F.max("start").over(w) - F.min("start").over(w)
    score = F.col("speech") * SPEECH + F.col("dwell") / F.coalesce(F.nullif(F.max("dwell").over(w), F.lit(0.0)), F.lit(1.0)) * DWELL + (F.col("start") - F.min("start").over(w)) / F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0)) * ORDER
    x = x.withColumn("score", F.round(F.round(score, 10), 4))
    x = x.withColumn("passes", (F.col("dwell") < 3) | ((F.col("dwell") <= 10) & (F.col("quiet") > 0.5)) | ((F.col("dwell") > 10) & (F.col("quiet") > 0.8)))
    best = F.row_number().over(w.orderBy(F.col("passes").cast("int"), F.desc("score"), "visit"))
    x = x.withColumn("role", F.when(F.col("passes"), "transitional").when(best == 1, "core").when(F.col("score") >= ELABORATED, "elaborated").otherwise("transitional"))
    before = w.orderBy("start", "visit").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") != "transitional", F.col("stop")), ignorenulls=True).over(before)
    x = x.withColumn("last_stop", last).withColumn("revisited", (F.col("role") != "transitional") & F.col("last_stop").isNotNull())
    return x.withColumn("continuous", F.col("revisited") & (F.col("start") - F.col("last_stop") < 1.5)).drop("dwell", "quiet", "speech", "passes", "last_stop")


def regions(segments: DataFrame, key: str, guard: int, kind: str) -> DataFrame:
    """key, segment, lo, hi: samples of the segments (key, i, kind, lo, hi) of a kind, without guard samples at borders to
    other kinds; segments that are gone then are left out."""
    w = Window.partitionBy(key).orderBy("i")
    other = lambda c: (c.isNotNull() & (c != kind)).cast("int") * guard
    x = segments.withColumn("a", F.col("lo") + other(F.lag("kind").over(w))).withColumn("b", F.col("hi") - other(F.lead("kind").over(w)))
    return x.filter((F.col("kind") == kind) & (F.col("a") <= F.col("b"))).select(key, F.col("i").alias("segment"), F.col("a").alias("lo"), F.col("b").alias("hi"))


def window_kind(motion: Column, strong: Column, changed: Column, active: Column) -> Column:
    """video, slide or unknown for a window of samples."""
    return F.when((motion >= 0.45) | (strong >= 0.25) | (changed >= 0.08), "video").when((motion <= 0.20) & (changed <= 0.03), "slide").when((motion >= 0.30) | (active >= 0.25), "video").otherwise("unknown")


def track_step(row_gap: int = 1) -> Step:
    """Boxes over time, rows (step, x, y, w, h), as tracks: each joins the best track whose last box is near and at most
    row_gap steps back, else opens one. Sends (step, track)."""

    def near(a, b):
        ix, iy = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        inter = max(0.0, ix) * max(0.0, iy)
        sa, sb = a[2] * a[3], b[2] * b[3]
        gap = (max(0.0, -ix) ** 2 + max(0.0, -iy) ** 2) ** 0.5
        reach = min((a[2] ** 2 + a[3] ** 2) ** 0.5, (b[2] ** 2 + b[3] ** 2) ** 0.5)
        return inter / (sa + sb - inter or 1.0), inter / (min(sa, sb) or 1.0), gap, reach

    def step(state, row):
        now, box = row[0], row[1:5]
        opened, tracks = state or (0, ())
        best, best_score = None, float("-inf")
        for t in tracks:  # (number, last step, last box)
            if now - t[1] > row_gap:
                continue
            iou, share, gap, reach = near(box, t[2])
            far = iou <= 0 and (share < 0.6 if now == t[1] else share < 0.2 and gap > max(0.008, 0.18 * reach))
            if not far and max(iou, share) - gap > best_score:
                best, best_score = t[0], max(iou, share) - gap
        if best is None:
            opened += 1
            best = opened
        live = tuple(t for t in tracks if t[0] != best and now - t[1] <= row_gap)
        return (opened, (*live, (best, now, box))), [(now, best)]

    return step


def claim_step(state, row):
    """Claims of one kind and context in order, rows (claim, tight, tokens): those that hold each other's text, or share
    .65 of the shorter one's tokens, are one; the longest stays in the place of the first."""
    claim, tight, words = row[0], row[1], set(row[2])
    kept = list(state[0]) if state else []
    for i, (_, other, theirs) in enumerate(kept):
        if tight and other and (tight in other or other in tight or (words and theirs and len(words & theirs) >= 0.65 * min(len(words), len(theirs)))):
            if len(tight) > len(other):
                kept[i] = (claim, tight, words)
            return (kept,), []
    return ([*kept, (claim, tight, words)],), []


def scene_step(stable: int, longest: int, fade: int) -> Step:
    """Scene changes from rows (frame, mse, hash, base_mse, base_hash, changed, fade_mse, fade_hash): distances to the frame
    before, to the scene's base, and to the frame `fade` frames before. Sends (frame, reason).

    A cut, a change of structure, a distance from the base or a fade opens a pending scene; it is confirmed after
    `stable` frames without change or `longest` frames in all, unless the frame is like the base again.
    """

    def step(state, row):
        frame, mse, dist, base_mse, base_dist, changed, fade_mse, fade_dist = row
        if state is None:
            return (-1, 0, 0, 0), [(frame, "first_frame")]
        first, steady, total, seen = state  # first: the pending scene's first frame, or -1
        same = changed < 0.02
        if first < 0:
            hit = not same and ((mse >= 500 and dist >= 10) or (base_mse >= 250 and changed >= 0.12) or (base_dist >= 8 and mse >= 250) or (seen >= fade and fade_mse >= 400 and fade_dist >= 8))
            return ((frame, 1, 1, 0) if hit else (-1, 0, 0, seen + 1)), []
        steady, total = (steady + 1 if mse <= 60 and dist <= 4 else 1), total + 1
        if steady >= stable or total >= longest:
            return (-1, 0, 0, 0), ([] if same else [(first, "stabilized" if steady >= stable else "timeout")])
        return (first, steady, total, 0), []

    return step


def scene_flush(state) -> list[tuple]:
    """A pending scene at the end of input counts."""
    return [(state[0], "end_flush")] if state[0] >= 0 else []
