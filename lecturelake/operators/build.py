"""How the graph comes about: triples of structure and concepts, entities resolved, aliases, roles, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..storage import stored
from .folds import fold
from .graph import components
from .text import normalize_term

# Labels of the structure layer with the edge from the node above, and what concepts may be.
LAYERS = {"Slide": "HAS_SLIDE", "VisualAsset": "HAS_VISUAL_ASSET", "Scene": "HAS_SCENE", "Context": "HAS_CONTEXT", "Segment": "HAS_SEGMENT", "AnnotationEmphasis": "HAS_ANNOTATION"}
ENTITY_TYPES = ("concept", "technology", "process", "person", "organization", "metric")
MOST_CORE, MOST_INTRODUCED = 12, 40
SAME_DESCRIPTION = 0.96


def structure_triples(roots: DataFrame, layers: dict[str, DataFrame], uses: DataFrame | None = None) -> DataFrame:
    """s, p, o, props (JSON, nulls left out) of a structure layer.

    roots: id and properties of videos. layers: by label of LAYERS, rows with parent, id and properties. uses: scene,
    slide. A node has a row with p = "type", an edge one with the name of its label's edge.
    """
    props = lambda df: F.to_json(F.struct(*[c for c in df.columns if c not in ("id", "parent")]))
    node = lambda df, label: df.select(F.col("id").alias("s"), F.lit("type").alias("p"), F.lit(label).alias("o"), props(df).alias("props"))
    edge = lambda df, a, rel, b: df.select(F.col(a).alias("s"), F.lit(rel).alias("p"), F.col(b).alias("o"), F.lit(None).cast("string").alias("props"))
    out = node(roots, "Video")
    for label, df in layers.items():
        out = out.union(node(df, label)).union(edge(df, "parent", LAYERS[label], "id"))
    return out if uses is None else out.union(edge(uses, "scene", "USES_SLIDE", "slide"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_term(name), r"[^0-9a-z가-힣]+", "-"), "^-+|-+$", "")


def concept_triples(entities: DataFrame, mentions: DataFrame, relations: DataFrame, sources: DataFrame, relation_types: tuple[str, ...]) -> DataFrame:
    """s, p, o of concepts from what an extraction gave: entities (name, type), mentions (name, source), relations (src,
    dst, type), checked against the sources (source) that exist and each other.

    Types not known become concept; names without a letter or digit go, as do mentions by or of what is not there,
    relations of another type, self-loops and those with an end that is no entity. Each triple comes once.
    """
    kind = F.when(F.col("type").isin(*ENTITY_TYPES), F.col("type")).otherwise("concept")
    known = entities.select(slug(F.col("name")).alias("slug"), kind.alias("kind")).filter("slug <> ''").groupBy("slug").agg(F.min("kind").alias("kind"))
    id_of = lambda c: F.concat(F.lit("concept/"), c)
    nodes = known.select(id_of(F.col("slug")).alias("s"), F.lit("type").alias("p"), F.lit("Concept").alias("o"))
    by = mentions.select(slug(F.col("name")).alias("slug"), "source").join(known.select("slug"), "slug", "left_semi").join(sources.select("source").distinct(), "source", "left_semi")
    rel = F.when(F.col("source").startswith("segment/"), "MENTIONS").when(F.col("source").startswith("slide_"), "APPEARS_IN")
    by = by.select(F.col("source").alias("s"), rel.alias("p"), id_of(F.col("slug")).alias("o")).filter("p is not null")
    ends = relations.filter(F.col("type").isin(*relation_types)).select(slug(F.col("src")).alias("a"), "type", slug(F.col("dst")).alias("b")).filter("a <> b")
    ends = ends.join(known.select(F.col("slug").alias("a")), "a", "left_semi").join(known.select(F.col("slug").alias("b")), "b", "left_semi")
    return nodes.union(by).union(ends.select(id_of(F.col("a")).alias("s"), F.col("type").alias("p"), id_of(F.col("b")).alias("o"))).distinct()


# --- entities -------------------------------------------------------------------------------------------------------


def alias_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^0-9a-z가-힣]+", "")


def gram_cosine(pairs: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """pairs (a, b) with cosine of the character n-gram counts of their whole texts (id, text); only the letters and
    digits of alias_key count, and a text shorter than n is one gram. Pairs that share nothing have 0.

    Pairs are cut to pairs of different texts, whose grams alone are made and joined. The optimizer takes a table of grams for
    as small as the texts, so the joins are told to merge: nothing is gathered on the driver for its estimate.
    """
    key = texts.select("id", alias_key(F.col("text")).alias("k"))
    side = lambda x: key.select(F.col("id").alias(x), F.col("k").alias(f"k{x}")).hint("merge")
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").fillna("", ["ka", "kb"])
    met = stored(met.select(*pairs.columns, F.least("ka", "kb").alias("x"), F.greatest("ka", "kb").alias("y")), "text-pairs")
    kinds = met.select("x", "y").filter("x <> '' and y <> ''").distinct()
    asked = kinds.select(F.col("x").alias("k")).union(kinds.select("y")).distinct()
    places = F.when(F.length("k") >= n, F.sequence(F.lit(1), F.length("k") - n + 1)).otherwise(F.array(F.lit(1)))
    grams = asked.select("k", F.explode(F.transform(places, lambda i: F.substring(F.col("k"), i, F.lit(n)))).alias("g")).groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"))
    norms = grams.groupBy("k").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    of = lambda x: grams.select(F.col("k").alias(x), "g", F.col("n").alias(f"n{x}")).hint("merge")
    dots = kinds.join(of("x"), "x").join(of("y"), ["y", "g"]).groupBy("x", "y").agg(F.sum(F.col("nx") * F.col("ny")).alias("dot"))
    norm = lambda x: norms.select(F.col("k").alias(x), F.col("norm").alias(f"m{x}")).hint("merge")
    cosines = dots.join(norm("x"), "x").join(norm("y"), "y").select("x", "y", (F.col("dot") / (F.col("mx") * F.col("my"))).alias("cosine"))
    return met.join(cosines, ["x", "y"], "left").select(*pairs.columns, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def unit_pairs(entities: DataFrame) -> DataFrame:
    """a < b: entities that share a text unit (units array<string>), each pair once. A unit's entities are few by nature
    (what one passage of text names)."""
    units = entities.select("id", F.explode(F.array_distinct("units")).alias("unit"))
    x, y = units.alias("x"), units.alias("y")
    return x.join(y, (F.col("x.unit") == F.col("y.unit")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def resolve_entities(entities: DataFrame) -> DataFrame:
    """id, group, canonical: entities (id, title, description, frequency, units) that are one.

    Titles `head (alias)` stand for the side in Hangul. Titles of one key are one, and a title that is another's alias,
    if only one has it, joins that one; then what shares a text unit and has nearly the same text; and so on along
    chains. group is the least id; canonical the title with the largest sum of frequencies, ties to the alphabet.
    """
    x = entities.withColumn("canon", terms.without_alias(F.col("title")))
    parts = r"^(.*\S)\s*[(\[]([^()\[\]]+)[)\]]$"
    head, alias = F.trim(F.regexp_extract("title", parts, 1)), F.trim(F.regexp_extract("title", parts, 2))
    x = x.withColumn("key", alias_key(F.col("canon"))).withColumn("head_key", alias_key(F.when(head == "", F.col("title")).otherwise(head))).withColumn("alias_key", alias_key(alias))
    # an alias that stands for one canonical title alone
    sole = x.filter("alias_key <> ''").groupBy(F.col("alias_key").alias("k")).agg(F.min("key").alias("to"), F.max("key").alias("other")).filter("to = other and k <> to").select("k", "to")
    names = x.select("id", F.explode(F.array_distinct(F.array("key", "head_key"))).alias("k"))
    linked = names.join(sole, "k", "left").select("id", F.explode(F.array_distinct(F.array("k", F.coalesce("to", "k")))).alias("k")).filter("k <> ''")
    least = linked.groupBy("k").agg(F.min("id").alias("least"))
    same_key = linked.join(least, "k").select(F.col("least").alias("src"), F.col("id").alias("dst"))
    near = gram_cosine(unit_pairs(entities), entities.select("id", F.concat_ws(" ", "title", "description").alias("text"))).filter(F.col("cosine") >= SAME_DESCRIPTION)
    groups = components(entities.select(F.col("id").alias("node")), same_key.union(near.select("a", "b"))).select(F.col("node").alias("id"), F.col("component").alias("group"))
    votes = x.join(groups, "id").groupBy("group", "canon").agg(F.sum(F.coalesce("frequency", F.lit(1))).alias("votes"))
    best = votes.groupBy("group").agg(F.min(F.struct((-F.col("votes")).alias("v"), "canon")).alias("b")).select("group", F.col("b.canon").alias("canonical"))
    return groups.join(best, "group").select("id", "group", "canonical")


def alias_map(candidates: DataFrame) -> DataFrame:
    """alias, representative from candidates (keyword, variants, place): variants that are not the keyword itself; of
    several keywords that have a variant, the last by place."""
    rows = candidates.select("keyword", "place", F.explode("variants").alias("v")).select(F.trim("keyword").alias("representative"), "place", F.trim("v").alias("alias"))
    rows = rows.filter((F.col("alias") != "") & (F.col("representative") != "") & (normalize_term(F.col("alias")) != normalize_term(F.col("representative"))))
    return rows.groupBy("alias").agg(F.max_by("representative", "place").alias("representative"))


def canonical_lists(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, names: each key's list (key, place, name) with variants replaced by representatives, in order, once each."""
    index = aliases.groupBy(normalize_term(F.col("alias")).alias("n")).agg(F.min("representative").alias("representative"))
    x = names.withColumn("n", normalize_term(F.col("name"))).join(index, "n", "left").withColumn("name", F.coalesce("representative", F.trim("name"))).filter("name <> ''")
    once = x.groupBy("key", normalize_term(F.col("name")).alias("k")).agg(F.min(F.struct("place", "name")).alias("first"))
    return once.groupBy("key").agg(F.array_sort(F.collect_list("first")).alias("l")).select("key", F.col("l.name").alias("names"))


def roles(candidates: DataFrame, group: str) -> DataFrame:
    """group, keyword, role (core or introduced), place from ranked candidates (place, keyword, score, importance, inner,
    example_penalty, code_penalty, capped).

    Operational, code-like and example-only keywords have no role. The first MOST_CORE that are core-like are core, the
    next MOST_INTRODUCED others introduced.
    """
    w = Window.partitionBy(group).orderBy("place")
    once = Window.partitionBy(group, "k").orderBy("place")
    x = candidates.withColumn("k", normalize_term(F.col("keyword"))).filter("k <> ''").withColumn("seen", F.row_number().over(once)).filter("seen = 1")
    fits = F.col("capped").isNull() & (F.col("code_penalty") < 0.75) & ~((F.col("example_penalty") >= 0.65) & (F.col("importance") < 0.30))
    like = fits & (F.col("score") >= 0.30) & (F.col("importance") >= 0.20) & (F.col("inner") >= 0.20) & (F.col("example_penalty") < 0.35)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("like", F.coalesce(like, F.lit(False))).withColumn("fits", F.coalesce(fits, F.lit(False)))
    x = x.withColumn("core", F.col("like") & (F.sum(F.col("like").cast("int")).over(so_far) <= MOST_CORE))
    x = x.withColumn("introduced", F.col("fits") & ~F.col("core"))
    x = x.withColumn("introduced", F.col("introduced") & (F.sum(F.col("introduced").cast("int")).over(so_far) <= MOST_INTRODUCED))
    role = F.when(F.col("core"), "core").when(F.col("introduced"), "introduced")
    return x.withColumn("role", role).filter("role is not null").select(group, "keyword", "role", "place")


# --- greedy groups --------------------------------------------------------------------------------------------------


def greedy_groups(items: DataFrame, links: DataFrame, group: str, complete: bool) -> DataFrame:
    """group, item, cluster: items (item, place) in order each join the first cluster with any linked member (or, if
    complete, whose members are all linked to it), else found one. links: group, a, b.

    Order decides, so each group is one sequence; its rows stream and the clusters so far are the state.
    """
    near = links.select(group, F.col("a").alias("item"), F.col("b").alias("other")).union(links.select(group, F.col("b"), F.col("a")))
    near = near.groupBy(group, "item").agg(F.collect_set("other").alias("near"))
    rows = items.join(near, [group, "item"], "left").withColumn("near", F.coalesce("near", F.array().cast(f"array<{items.schema['item'].dataType.simpleString()}>")))

    def step(state, row):
        item, linked = row[0], set(row[1])
        clusters = state[0] if state else []
        for i, members in enumerate(clusters):
            if (members <= linked) if complete else (members & linked):
                members.add(item)
                return (clusters,), [(item, i)]
        return ([*clusters, {item}],), [(item, len(clusters))]

    g, i = (items.schema[c].dataType.simpleString() for c in (group, "item"))
    return fold(rows.select(group, "place", "item", "near"), group, ["place"], ["item", "near", "place"], step, lambda state: [], f"{group} {g}, item {i}, cluster int")
