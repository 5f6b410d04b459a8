"""Evidence for an answer: candidates scored by meaning, intent, keywords and bonuses, and what is chosen of them.

Candidates are rows with group (the question), uid, kind, text, slide, start_sec, end_sec, ids array<string>, similarity,
emphasis, weight, edge_weight, core and structured; a question asks for some of ASKS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored
from .intervals import buckets
from .windows import latest

# Weights of the parts of a score, priors of kinds by intent, and bonuses.
SEMANTIC, INTENT, KEYWORD = 0.52, 0.33, 0.15
PRIORS = {
    "definition": {"slide_text": 1.0, "slide_concept": 0.9, "segment": 0.55, "sub_concept": 0.88, "lance": 0.82},
    "example": {"slide_text": 0.45, "slide_concept": 0.5, "segment": 0.95, "sub_concept": 0.42, "lance": 0.88},
    "explanation": {"slide_text": 0.75, "slide_concept": 0.7, "segment": 0.85, "sub_concept": 0.65, "lance": 0.8},
    "comparison": {"slide_text": 0.8, "slide_concept": 0.85, "segment": 0.7, "sub_concept": 0.75, "lance": 0.78},
    "temporal": {"slide_text": 0.5, "slide_concept": 0.45, "segment": 0.95, "sub_concept": 0.4, "lance": 0.65},
    "location": {"slide_text": 0.9, "slide_concept": 0.85, "segment": 0.55, "sub_concept": 0.5, "lance": 0.6},
    "general": {"slide_text": 0.75, "slide_concept": 0.72, "segment": 0.78, "sub_concept": 0.7, "lance": 0.85},
}
OTHER_PRIOR, SOFT = 0.7, 0.72
SUPPORT = {"visual_asset": 0.10, "slide_text": 0.08, "slide_concept": 0.08, "segment": 0.05, "graphrag_entity": 0.05, "graphrag_relationship": 0.03, "sub_concept": 0.03}
OTHER_SUPPORT, SUPPORT_CAP = 0.03, 0.12
BY_ID, BY_SLIDE, BY_TIME = 1.00, 0.75, 0.60
SLIDES = ("slide_text", "slide_concept")
#: What a question may ask for.
ASKS = ("slide_importance", "visual", "current_visual", "emphasis", "core", "example")
#: Width of the time buckets in which hits and candidates meet, in seconds; longer spans fill several.
BUCKET = 60.0
#: Hits of a group that each of its items is given at once; those of groups with more meet items by equi-joins.
AT_ONCE = 300


def intent_prior(kind: Column, intents: Column, priors: dict[str, dict[str, float]] = PRIORS) -> Column:
    """Sum of an intent's weight (a map) times its prior for the kind; unknown intents count as general, other kinds .7,
    vector hits as "lance" with .72 of it for soft ones."""
    table = F.create_map(*[x for name, row in priors.items() for x in (F.lit(name), F.create_map(*[F.lit(v) for kv in row.items() for v in kv]))])
    known = F.when(kind.startswith("lance"), "lance").otherwise(kind)
    row = lambda name: F.coalesce(F.element_at(table, name), F.element_at(table, F.lit("general")))
    total = F.aggregate(F.map_entries(intents), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.element_at(row(e["key"]), known), F.lit(OTHER_PRIOR)))
    return F.when(kind == "lance_soft", total * SOFT).otherwise(total)


def example_directness(text: Column, subjects: Column) -> Column:
    """1 for a text that names one of the subjects and says that it gives an example, .75 for a list that goes on, .6 for
    one in parentheses, else 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tight = F.translate(low, " \t\n\x0b\f\r", "")
    named = F.exists(subjects, lambda s: F.contains(low, F.lower(s)) | F.contains(tight, F.replace(F.lower(s), F.lit(" "), F.lit(""))))
    return F.when(~F.coalesce(named, F.lit(False)) | (tight == ""), 0.0).when(tight.rlike("예시|사례|예를들|예로|대표적예"), 1.0).when(F.contains(tight, F.lit("등")), 0.75).when(low.rlike(r"\([^)]*,[^)]*\)"), 0.6).otherwise(0.0)


def support_bonus(items: DataFrame, hits: DataFrame, group: str) -> DataFrame:
    """group, uid, support, n_hits: what vector hits (group, hit, linked, slide, start_sec, end_sec, score) add to items.

    A hit supports an item whose ids hold its linked id, whose slide is its own, or whose time overlaps its own with a
    second's slack; the strongest reason counts. Each reason is an equi-join, the last on time buckets.
    """
    own = items.filter(~F.col("kind").startswith("lance")).select(group, "uid", "kind", "ids", "slide", "start_sec", F.coalesce("end_sec", "start_sec").alias("stop"))
    near = hits.select(group, "hit", "linked", F.col("slide").alias("hit_slide"), F.col("start_sec").alias("hit_start"), F.coalesce("end_sec", "start_sec").alias("hit_stop"), F.coalesce("score", F.lit(0.5)).alias("score"))
    pick = lambda df, w: df.select(group, "uid", "kind", "hit", "score", F.lit(w).alias("w"))
    by_id = own.withColumn("linked", F.explode(F.array_distinct("ids"))).join(near, [group, "linked"])
    by_slide = own.withColumn("hit_slide", F.col("slide")).join(near, [group, "hit_slide"])
    a = own.filter("start_sec is not null").withColumn("bucket", F.explode(buckets(F.col("start_sec"), F.col("stop") + 1, BUCKET)))
    b = near.filter("hit_start is not null").withColumn("bucket", F.explode(buckets(F.col("hit_start"), F.col("hit_stop") + 1, BUCKET)))
    by_time = a.join(b, [group, "bucket"]).filter("greatest(start_sec, hit_start) <= least(stop, hit_stop) + 1")
    met = pick(by_id, BY_ID).union(pick(by_slide, BY_SLIDE)).union(pick(by_time, BY_TIME))
    best = met.groupBy(group, "uid", "kind", "hit").agg(F.max(F.col("w") * F.col("score")).alias("gain"))
    return best.groupBy(group, "uid").agg(F.least(F.lit(SUPPORT_CAP), F.sum(_support_share(F.col("kind")) * F.col("gain"))).alias("support"), F.count(F.lit(1)).alias("n_hits"))


def _support_share(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUPPORT.items() for x in kv]), kind), F.lit(OTHER_SUPPORT))


def with_support(items: DataFrame, group: str, hit: Column) -> DataFrame:
    """items (uid unique in a group) with support and n_hits as support_bonus has them, 0 where nothing supports them; hits are the
    items that pass the test, with linked, slide, start_sec, end_sec and their similarity as score.

    Items stay where their group is: each is given its group's hits, as long as these are AT_ONCE or fewer, so nothing is
    shuffled beyond what brings a group together. Groups with more hits are told beforehand, stored, and go by support_bonus.
    """
    many = stored(items.filter(hit & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > AT_ONCE).select(group), "many_hits")
    hot = not many.isEmpty()
    if not hot:
        discard(many)
    few = items.join(F.broadcast(many), group, "left_anti") if hot else items
    near = F.struct("linked", "slide", "start_sec", F.coalesce("end_sec", "start_sec").alias("stop"), F.coalesce("similarity", F.lit(0.5)).alias("score"))
    x = few.withColumn("hits", F.collect_list(F.when(hit & F.col(group).isNotNull(), near)).over(Window.partitionBy(group)))

    def gain(h: Column) -> Column:
        timed = F.col("start_sec").isNotNull() & h["start_sec"].isNotNull()
        meets = F.greatest(F.col("start_sec"), h["start_sec"]) <= F.least(F.coalesce("end_sec", "start_sec"), h["stop"]) + 1
        reasons = ((F.array_contains("ids", h["linked"]), BY_ID), (F.col("slide") == h["slide"], BY_SLIDE), (timed & meets, BY_TIME))
        return F.greatest(*[F.when(test, h["score"] * w) for test, w in reasons])

    x = x.withColumn("gains", F.when(~F.col("kind").startswith("lance"), F.array_compact(F.transform("hits", gain)))).drop("hits")
    total = F.aggregate("gains", F.lit(0.0), lambda s, g: s + F.col("share") * g)
    x = x.withColumn("share", _support_share(F.col("kind"))).withColumn("support", F.least(F.lit(SUPPORT_CAP), F.coalesce(total, F.lit(0.0))))
    x = x.withColumn("n_hits", F.coalesce(F.size("gains"), F.lit(0)).cast("long")).drop("gains", "share")
    if not hot:
        return x
    # read by each of the joins, which would otherwise bring all groups together once more
    rest = stored(items.join(F.broadcast(many), group, "left_semi").select(items.columns), "rest")
    hits = rest.filter(hit).select(group, F.col("uid").alias("hit"), "linked", "slide", "start_sec", "end_sec", F.col("similarity").alias("score"))
    rest = rest.join(support_bonus(rest, hits, group), [group, "uid"], "left")
    return x.unionByName(rest.withColumns({"support": F.coalesce("support", F.lit(0.0)), "n_hits": F.coalesce("n_hits", F.lit(0)).cast("long")}))


def scored(items: DataFrame, group: str, intents: Column, keyword: Column, asks: frozenset[str], subjects: Column | None = None, support: DataFrame | None = None, current_slide: int | None = None, hit: Column | None = None) -> DataFrame:
    """items with breakdown struct<semantic, intent_prior, keyword, bonus, support> and score, their sum.

    keyword: share of the question's keywords found. support: that of support_bonus, or hit: the items that are hits, for
    with_support. Emphasis and weights are relative to the largest of their kind
    among the group's items. Null numbers count 0.
    """
    w = Window.partitionBy(group)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kind = F.col("kind")
    is_slide, is_entity, is_edge = kind.isin(*SLIDES), kind == "graphrag_entity", kind == "graphrag_relationship"
    most = lambda test, c: F.coalesce(F.max(F.when(test, num(c))).over(w), F.lit(0.0))
    x = items.withColumns({"most_emphasis": most(is_slide, "emphasis"), "most_weight": most(is_entity, "weight"), "most_edge": most(is_edge, "edge_weight"), "most_core": most(is_entity, "core")})
    part = lambda test, c, top, share: F.when(test & (F.col(top) > 0), num(c) / F.col(top) * share).otherwise(0.0)
    slide = lambda share: part(is_slide, "emphasis", "most_emphasis", share)
    edge = lambda share: part(is_edge, "edge_weight", "most_edge", share)
    bonus = F.lit(0.0)
    if "slide_importance" in asks:
        bonus += slide(0.45)
    if "visual" in asks:
        bonus += F.when(kind == "visual_asset", 0.55).when(is_slide & F.coalesce("structured", F.lit(False)), 0.25).otherwise(0.0)
        if "current_visual" in asks and current_slide is not None:
            bonus += F.when(F.col("slide") == current_slide, 0.60).otherwise(0.0)
    if "emphasis" in asks:
        bonus += slide(0.30) + part(is_entity, "weight", "most_weight", 0.35) + edge(0.25)
    if "core" in asks:
        bonus += part(is_entity, "core", "most_core", 0.55) + edge(0.20) + slide(0.15)
    if "example" in asks:
        direct = example_directness(F.col("text"), F.array().cast("array<string>") if subjects is None else subjects)
        bonus += direct * F.when((kind == "visual_asset") | is_slide, 0.45).when(is_entity | is_edge, 0.35).otherwise(0.18)
    if hit is not None:
        x = with_support(x, group, hit)
    elif support is not None:
        x = x.join(support.select(group, "uid", "support"), [group, "uid"], "left")
    else:
        x = x.withColumn("support", F.lit(0.0))
    breakdown = F.struct((num("similarity") * SEMANTIC).alias("semantic"), (intent_prior(kind, intents) * INTENT).alias("intent_prior"), (keyword * KEYWORD).alias("keyword"), bonus.alias("bonus"), num("support").alias("support"))
    x = x.withColumn("breakdown", breakdown)
    score = sum((F.col("breakdown")[k] for k in ("intent_prior", "keyword", "bonus", "support")), F.col("breakdown")["semantic"])
    return x.withColumn("score", score).select(*items.columns, "breakdown", "score")


def ensure_one(chosen: DataFrame, items: DataFrame, group: str, test: Column, first: bool = False) -> DataFrame:
    """chosen (group, uid, place) and, for groups without an item that passes the test, the best such item of theirs by
    score (then uid): at the end, or at the front, of their list. items: group, uid, score and what the test reads."""
    good = items.filter(F.coalesce(test, F.lit(False)))
    has = chosen.join(good.select(group, "uid"), [group, "uid"], "left_semi").select(group).distinct()
    best = latest(good.join(has, group, "left_anti"), [group], [F.desc("score"), F.col("uid")]).select(group, "uid")
    ends = chosen.groupBy(group).agg(F.max("place").alias("last"))
    place = F.lit(0).cast("long") if first else (F.col("last") + 1).cast("long")
    return chosen.select(group, "uid", F.col("place").cast("long").alias("place")).unionByName(best.join(ends, group).select(group, "uid", place.alias("place")))


def overview(parts: list[tuple[DataFrame, list[Column], int, int]], group: str) -> DataFrame:
    """group, uid, part, place: of each part (rows, order, fetched, shown) the first of each group that are fetched, of
    which the first are shown; a uid that an earlier part shows is not shown again."""
    out = None
    for i, (rows, order, fetched, shown) in enumerate(parts):
        best = latest(rows, [group], order, min(fetched, shown)).select(group, "uid", F.lit(i).alias("part"), "place")
        out = best if out is None else out.unionByName(best)
    return out.groupBy(group, "uid").agg(F.min(F.struct("part", "place")).alias("p")).select(group, "uid", "p.part", "p.place")
