"""Keywords and concepts of lectures: weighted scores, roles, complexity, candidates from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts

# Weights of a keyword's score and the bounds of roles.
FREQUENCY, EMPHASIS, CENTRALITY = 0.4, 0.2, 0.4
CORE_CENTRALITY, CORE_EMPHASIS, CORE_FREQUENCY = 0.5, 0.35, 0.25
MOST_INTRODUCED = 40
GRAPH, COMMUNITY, GRAPH_EMPHASIS, BRIDGE, GROUNDING = 0.45, 0.25, 0.15, 0.10, 0.05


def by_max(c: Column | str, lecture: str) -> Column:
    """Relative to the lecture's largest; all 0 where that is 0."""
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("double")
    return x / F.coalesce(F.nullif(F.max(x).over(Window.partitionBy(lecture)), F.lit(0.0)), F.lit(1.0))


def scored(terms: DataFrame, lecture: str) -> DataFrame:
    """terms (lecture, term, slide_freq, transcript_freq, emphasis, degree) with n_slide, n_transcript, n_emphasis, n_degree
    (relative to the lecture's largest) and score."""
    n = {"n_slide": "slide_freq", "n_transcript": "transcript_freq", "n_emphasis": "emphasis", "n_degree": "degree"}
    x = terms.withColumns({k: by_max(v, lecture) for k, v in n.items()})
    freq = by_max(F.coalesce("slide_freq", F.lit(0.0)) + 0.5 * F.coalesce("transcript_freq", F.lit(0.0)), lecture)
    return x.withColumn("score", FREQUENCY * freq + EMPHASIS * F.col("n_emphasis") + CENTRALITY * F.col("n_degree"))


def kept(scored: DataFrame, lecture: str, minutes: Column) -> DataFrame:
    """A lecture's keywords by score: concepts that are no background noise, of at least 1.2 times the mean score; a number
    of them that goes with the minutes, without the bound on scores where they are too few. Ties go to the alphabet."""
    low = F.greatest(F.lit(7), F.floor(minutes / 8)).cast("int")
    high = F.greatest(low, F.least(F.lit(30), F.floor(minutes / 3))).cast("int")
    mean = F.avg("score").over(Window.partitionBy(lecture))
    noise = (F.col("n_slide") >= 0.25) & (F.col("n_transcript") <= 0.05) & (F.col("n_degree") <= 0.10)
    x = scored.withColumn("enough", F.col("score") >= mean * 1.2).filter(texts.is_concept(F.col("term")) & ~noise)
    w = Window.partitionBy(lecture)
    x = x.withColumn("n_enough", F.sum(F.col("enough").cast("int")).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "term")))
    most = F.when(F.col("n_enough") < low, low).otherwise(F.least(F.col("n_enough"), high))
    return x.filter(F.col("place") <= most).drop("enough", "n_enough")


def roles(scored: DataFrame, lecture: str) -> DataFrame:
    """lecture, term, role, place: core for central or frequent terms that are emphasized, else introduced, the first
    MOST_INTRODUCED by centrality (ties to the alphabet)."""
    strong = F.col("n_emphasis") >= CORE_EMPHASIS
    core = strong & ((F.col("n_degree") >= CORE_CENTRALITY) | (F.col("n_slide") >= CORE_FREQUENCY))
    x = scored.withColumn("role", F.when(core, "core").otherwise("introduced"))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(lecture, "role").orderBy(F.desc("n_degree"), "term")))
    return x.filter((F.col("role") == "core") | (F.col("place") <= MOST_INTRODUCED)).select(lecture, "term", "role", "place", "n_degree")


def complexity(roles: DataFrame, lecture: str) -> DataFrame:
    """lecture, level: high, medium or low, by the mean centrality of its core terms (none: low)."""
    mean = F.coalesce(F.avg(F.when(F.col("role") == "core", F.col("n_degree"))), F.lit(0.0))
    return roles.groupBy(lecture).agg(F.when(mean >= 0.65, "high").when(mean >= 0.35, "medium").otherwise("low").alias("level"))


def endpoint_signal(relations: DataFrame, *keys: str) -> DataFrame:
    """keys, title, signal: weight + ln(1 + combined degree) of the relations (src, dst, weight, degree) at each end."""
    signal = F.col("weight") + F.log1p(F.greatest("degree", F.lit(0.0)))
    return relations.select(*keys, F.explode(F.array("src", "dst")).alias("title"), signal.alias("signal")).groupBy(*keys, "title").agg(F.sum("signal").alias("signal"))


def graph_candidates(entities: DataFrame, relations: DataFrame, members: DataFrame, lecture: str) -> DataFrame:
    """lecture, title, base, score from five signals of the graph, with penalties and caps.

    entities: lecture, title, type, degree, frequency, emphasis, grounding. relations: lecture, src, dst, weight, degree,
    example (whether dst is an example of src or the other way round). members: lecture, community, title, rank, size,
    mention (how the community's report names the title). Importance is degree + ln(1 + frequency); the less important
    end of an example relation is the example.
    """
    e = entities.filter(texts.is_concept(F.col("title"))).withColumn("importance", F.col("degree") + F.log1p(F.greatest("frequency", F.lit(0.0))))
    # communities: quality of those it is in, its part in their relations and reports, and how many there are
    per = members.withColumn("quality", F.col("rank") / F.sqrt(F.greatest("size", F.lit(1.0))))
    both = relations.join(per.select(lecture, "community", F.col("title").alias("src")), [lecture, "src"]).join(per.select(lecture, "community", F.col("title").alias("dst")), [lecture, "community", "dst"])
    inner = endpoint_signal(both, lecture, "community").groupBy(lecture, "title").agg(F.sum("signal").alias("inner"))
    com = per.groupBy(lecture, "title").agg(F.sum("quality").alias("quality"), F.sum("mention").alias("mention"), F.count_distinct("community").alias("n"))
    ends = endpoint_signal(relations, lecture).withColumnRenamed("signal", "bridge")
    weigh = e.select(lecture, "title", "importance")
    a = weigh.select(lecture, F.col("title").alias("src"), F.col("importance").alias("ia"))
    b = weigh.select(lecture, F.col("title").alias("dst"), F.col("importance").alias("ib"))
    child = relations.filter("example").join(a, [lecture, "src"], "left").join(b, [lecture, "dst"], "left")
    child = child.withColumn("title", F.when(F.coalesce("ib", F.lit(0.0)) <= F.coalesce("ia", F.lit(0.0)), F.col("dst")).otherwise(F.col("src")))
    child = child.groupBy(lecture, "title").agg(F.sum(F.col("weight") + F.log1p(F.greatest("degree", F.lit(0.0)))).alias("example_signal"))
    x = e
    for more in (com, inner, ends, child):
        x = x.join(more, [lecture, "title"], "left")
    x = x.fillna(0.0, ["quality", "mention", "inner", "bridge", "example_signal"]).fillna(0, ["n"])
    n = lambda c: by_max(c, lecture)
    x = x.withColumns({"n_graph": n("importance"), "n_quality": n("quality"), "n_mention": n("mention"), "n_inner": n("inner"), "n_cross": n(F.greatest(F.col("n") - 1, F.lit(0))), "n_emphasis": n("emphasis"), "n_grounding": n("grounding"), "n_example": n("example_signal")})
    x = x.withColumn("n_bridge", n(F.col("bridge") * (1 + 0.25 * F.greatest(F.col("n") - 1, F.lit(0)))))
    x = x.withColumn("n_community", n(0.4 * F.col("n_quality") + 0.4 * (0.6 * F.col("n_mention") + 0.4 * F.col("n_inner")) + 0.2 * F.col("n_cross")))
    x = x.withColumn("base", GRAPH * F.col("n_graph") + COMMUNITY * F.col("n_community") + GRAPH_EMPHASIS * F.col("n_emphasis") + BRIDGE * F.col("n_bridge") + GROUNDING * F.col("n_grounding"))
    code, kind, seen = texts.code_like(F.col("title")), F.lower("type"), F.greatest("n_emphasis", "n_grounding")
    outside = F.when(kind.isin("person", "organization", "geo"), 0.45).otherwise(0.0)
    penalty = (0.55 * F.col("n_example") + 0.35 * outside + 0.65 * code) * (1 - 0.5 * F.greatest("n_graph", "n_grounding"))
    score = F.col("base") * (1 - F.least(F.greatest(penalty, F.lit(0.0)), F.lit(0.65)))
    score = F.when((code >= 0.75) & (F.col("n_graph") < 0.60), F.least(score, F.lit(0.18))).when((code >= 0.55) & (F.col("n_graph") < 0.35), F.least(score, F.lit(0.20))).otherwise(score)
    place = kind.isin("organization", "geo")
    cap = F.when((kind == "person") & (F.col("n_graph") < 0.65) & (seen < 0.25), 0.22).when(place & ((seen < 0.20) | (F.col("n_graph") < 0.35)), 0.24).otherwise(1e9)
    return x.select(lecture, "title", F.round(F.round("base", 10), 4).alias("base"), F.round(F.round(F.least(score, cap), 10), 4).alias("score"))


def emphasis_of(scenes: DataFrame, slide: str) -> DataFrame:
    """slide, scene_total, slide_total: a slide's scenes (contexts, annotation, visual, repeats) summed, and its strongest
    visual emphasis by half with what is said again (.6 and more)."""
    repeat = F.when(F.col("repeats") >= 0.6, F.col("repeats")).otherwise(0.0)
    return scenes.groupBy(slide).agg(F.sum(F.col("contexts") + F.col("annotation")).alias("scene_total"), (F.max("visual") * 0.5 + F.sum(repeat)).alias("slide_total"))
