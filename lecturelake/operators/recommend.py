"""Lectures ranked for a query: term weights, matches, graph and topic signals, and the adjustments in their order.

Everything is columns over one row per candidate (a lecture beside the query it is a candidate for), so scoring is a
narrow stage however many candidates there are. A lecture has

    video_id, title, summary, domain, subdomain, duration_sec, uploaded_at,
    keywords array<struct<keyword string, score double>>, core array<string>, introduced array<string>,
    relations array<struct<src string, dst string, type string>>,
    communities array<struct<title string, summary string, nodes array<string>, importance double>>,
    mentioned array<string>, visual_terms array<string>, visual_ratio, structure_ratio, application, listenability, spm

and a query is a Query, the same for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from . import scores
from .ranking import clamp01
from .text import normalize_term, tokens

# Weights and penalties of the ranking.
FIELDS = {"title": 0.20, "keyword": 0.55, "summary": 0.25}
VECTOR_SHARE, CONTENT_CAP, INFERRED = 0.70, 0.85, 0.5
WEIGHTS = {"content": 0.70, "graph": 0.20, "visual": 0.03, "boost": 0.07}
VISUAL_WEIGHTS = {"content": 0.62, "graph": 0.18, "visual": 0.15, "boost": 0.05}
CORE, INTRODUCED, GENERIC = 1.0, 0.35, 0.30
GENERIC_TYPES = ("related_to", "relates_to")
CONTRAST_TYPES = ("contrasts", "contrasts_with", "lacks", "differs", "vs", "versus", "compared_to", "unlike", "opposes", "excludes")
FRAGMENTATION, CONTRAST_BONUS = 0.10, 0.10
DOMAIN_MISMATCH, SUBJECT_MISMATCH, LEXICAL_MISS, WEAK_TOPIC = 0.60, 0.60, 0.30, 0.45
BOOSTS = {"domain": 0.20, "depth": 0.30, "duration": 0.08, "application": 0.10, "listenability": 0.08, "slow_speech": 0.07}
GRACE_SEC, HALF_LIFE_DAYS, IRF_FLOOR = 300, 180.0, 0.05
LEAST_SCORE, LEAST_RELATED = 0.22, 0.13


@dataclass(frozen=True)
class Query:
    """What is asked for. prefers: of visual, application, listenability, slow_speech and recency."""

    keywords: tuple[str, ...]
    inferred: tuple[str, ...] = ()
    domain: str | None = None
    subdomain: str | None = None
    focus: str | None = None
    duration_max_sec: int | None = None
    query_type: str = "topic_browse"
    specific: bool = False
    comparison: bool = False
    prefers: frozenset[str] = frozenset()


def rounded(c: Column) -> Column:
    """To four places; by way of ten, so that the last bit of a sum doesn't decide a tie."""
    return F.round(F.round(c, 10), 4)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def _some(values: Column, form: Column) -> Column:
    """Whether any of the forms is like form."""
    return F.exists(values, lambda x: terms.alike(x, form))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("double")


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# --- query terms ----------------------------------------------------------------------------------------------------


def lexical_variants(phrases: DataFrame, key: str, phrase: str, weight: str) -> DataFrame:
    """key, term, weight: each phrase w, its lookup keys .8 w, its tokens .5 w and their keys .4 w, summed by term."""
    w, p = F.col(weight).cast("double"), normalize_term(F.col(phrase))
    rows = phrases.select(F.col(key), p.alias("p"), w.alias("w")).filter(F.length("p") > 0)
    rows = rows.withColumn("keys", terms.lookup_keys(F.col("p"))).withColumn("tokens", F.filter(tokens(F.col("p")), lambda x: x != F.col("p")))
    w = F.col("w")
    entry = lambda share: lambda x: F.struct(x.alias("term"), (w * share).alias("weight"))
    keys_of = lambda x: F.transform(F.filter(terms.lookup_keys(x), lambda k: k != x), entry(0.4))
    every = F.concat(F.array(entry(1.0)(F.col("p"))), F.transform(F.filter("keys", lambda k: k != F.col("p")), entry(0.8)), F.transform("tokens", entry(0.5)), F.flatten(F.transform("tokens", keys_of)))
    return rows.select(key, F.inline(every)).groupBy(key, "term").agg(F.sum("weight").alias("weight"))


def canonicalize(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (term) with canonical, null where no alias shares a lookup key with it.

    aliases: alias, canonical, weight. A key stands for the canonical term of its heaviest alias (then the shorter
    term, then the alphabet); of a term's keys the one whose canonical term weighs most in all wins. Keys are cut to
    one row each before anything meets the terms asked for.
    """
    heavy = aliases.groupBy("canonical").agg(F.sum("weight").alias("total"))
    index = aliases.select(F.explode(terms.lookup_keys(F.col("alias"))).alias("k"), "canonical", "weight")
    index = index.groupBy("k").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.length("canonical").alias("n"), "canonical")).alias("b")).select("k", "b.canonical")
    index = index.join(heavy, "canonical").select("k", F.struct((-F.col("total")).alias("w"), "canonical").alias("best"))
    keys = asked.select("term").distinct().select("term", F.explode(terms.lookup_keys(F.col("term"))).alias("k"))
    found = keys.join(index, "k").groupBy("term").agg(F.min("best").alias("best"))
    return asked.join(found.select("term", F.col("best.canonical").alias("canonical")), "term", "left")


# --- matches --------------------------------------------------------------------------------------------------------


def prepared(lectures: DataFrame, q: Query, need: tuple[str, ...] = ()) -> DataFrame:
    """lectures with the forms of their terms, worked out once: f_title, f_summary, f_keywords, f_core, f_introduced,
    f_relations, f_nodes, f_mentioned; and the query's, once for all rows: f_q, f_i (terms and keys), f_all (concepts),
    f_required. need: the lecture's that are used, if not all.

    They come out of a generator, since the optimizer would put a column that is named once into the function that goes over
    the query's terms, and make its forms again for each of them.
    """
    keyword = F.transform("keywords", lambda k: F.struct(F.get(terms.forms(F.array(k["keyword"])), F.lit(0)).alias("f"), F.greatest(F.lit(0.0), F.coalesce(k["score"], F.lit(0.0))).alias("score")))
    relation = F.transform("relations", lambda r: F.struct(F.get(terms.forms(F.array(r["src"])), F.lit(0)).alias("a"), F.get(terms.forms(F.array(r["dst"])), F.lit(0)).alias("b"), F.when(F.lower(r["type"]).isin(*GENERIC_TYPES), GENERIC).otherwise(1.0).alias("w")))
    nodes = F.flatten(F.transform("communities", lambda c: F.concat(F.array(c["title"]), F.coalesce(c["nodes"], F.array().cast("array<string>")))))
    asked = {"f_q": terms.forms(terms.expanded(_strings(q.keywords))), "f_i": terms.forms(terms.expanded(_strings(q.inferred))),
             "f_all": terms.forms(F.array_distinct(_strings([*q.keywords, *q.inferred]))), "f_required": terms.forms(F.array_distinct(F.transform(_strings(q.keywords), normalize_term)))}
    asked = lectures.sparkSession.range(1).select(F.struct(*[c.alias(k) for k, c in asked.items()]).alias("asked")).scalar()
    own = {
        "f_title": terms.forms(F.array_distinct(tokens(F.col("title")))), "f_summary": terms.forms(tokens(F.col("summary"))),
        "f_whole": terms.forms(F.array("title", "summary")),
        "f_keywords": F.filter(keyword, lambda k: k["f"].isNotNull()), "f_core": terms.forms(F.col("core")), "f_introduced": terms.forms(F.col("introduced")),
        "f_relations": F.filter(relation, lambda r: r["a"].isNotNull() & r["b"].isNotNull()), "f_nodes": terms.forms(nodes), "f_mentioned": terms.forms(F.col("mentioned")),
    }
    x = lectures.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in own.items() if k in need or not need]))))
    return x.withColumns({k: asked[k] for k in ("f_q", "f_i", "f_all", "f_required")})


def direct_match(weight=None) -> Column:
    """struct<title, keyword, summary, matched>: shares of the query's terms found in title and summary, and of the
    keywords' weight that they match; inferred terms count half. weight: what a keyword weighs (its score)."""
    weight = weight or (lambda k: k["score"])
    q, i = F.col("f_q"), F.col("f_i")
    share = lambda asked, there: F.when(F.size(asked) > 0, _count(asked, lambda t: _some(there, t)) / F.size(asked)).otherwise(0.0)
    both = lambda there: (share(q, there) + share(i, there) * INFERRED) / (1 + INFERRED)
    longer = lambda asked: F.filter(asked, lambda t: F.length(t["term"]) > 1)
    matched = lambda asked: _bound(longer(asked), lambda a: _sum(F.filter("f_keywords", lambda k: _some(a, k["f"])), weight))
    sums = F.struct(matched(q).alias("q"), matched(i).alias("i"), _sum(F.col("f_keywords"), weight).alias("all"))
    title, summary = both(F.col("f_title")), both(F.col("f_summary"))
    share_of = lambda m: (m["q"] + m["i"] * INFERRED) / (F.when(m["all"] == 0, 1.0).otherwise(m["all"]) * (1 + INFERRED))
    return _bound(sums, lambda m: F.struct(title.alias("title"), share_of(m).alias("keyword"), summary.alias("summary"), ((F.size(q) == 0) | (m["q"] > 0)).alias("matched")))


def tfirf_match(irf: Column) -> Column:
    """direct_match with keywords weighed by score times max(irf, floor); irf is a map from keyword to its irf."""
    return direct_match(lambda k: k["score"] * F.greatest(F.coalesce(F.element_at(irf, k["f"]["term"]), F.lit(0.0)), F.lit(IRF_FLOOR)))


def role_strength(form: Column, core: float = CORE, introduced: float = INTRODUCED) -> Column:
    return F.when(_some(F.col("f_core"), form), core).when(_some(F.col("f_introduced"), form), introduced).otherwise(0.0)


def strengths(form: Column) -> Column:
    """struct<role, keyword, text, relation, community, mention>: how strongly a lecture matches one term, by kind."""
    keywords, relations, nodes = F.col("f_keywords"), F.col("f_relations"), F.col("f_nodes")
    most = F.coalesce(F.array_max(F.transform(keywords, lambda k: k["score"])), F.lit(0.0))
    best = F.coalesce(F.array_max(F.transform(F.filter(keywords, lambda k: terms.alike(k["f"], form)), lambda k: k["score"])), F.lit(0.0))
    weight = _sum(relations, lambda r: r["w"])
    hit = _sum(F.filter(relations, lambda r: terms.alike(r["a"], form) | terms.alike(r["b"], form)), lambda r: r["w"])
    whole = lambda i: F.coalesce(terms.alike(F.get(F.col("f_whole"), F.lit(i)), form), F.lit(False))
    text = F.when(whole(0) | _some(F.col("f_title"), form), 0.9).when(whole(1) | _some(F.col("f_summary"), form), 0.2).otherwise(0.0)
    return F.struct(
        role_strength(form).alias("role"), _bound(most, lambda m: F.when(m > 0, F.least(F.lit(1.0), best / m)).otherwise(0.0)).alias("keyword"), text.alias("text"),
        _bound(weight, lambda w: F.when(w > 0, F.least(F.lit(1.0), hit / w)).otherwise(0.0)).alias("relation"),
        F.when(F.size(nodes) > 0, _count(nodes, lambda x: terms.alike(x, form)) / F.size(nodes)).otherwise(0.0).alias("community"),
        F.when(_some(F.col("f_mentioned"), form), 1.0).otherwise(0.0).alias("mention"),
    )


def subject_match() -> Column:
    """not_required, canonical (a shared lookup key), partial (a lecture's term holds a required one) or none."""
    own = F.concat("f_whole", F.transform("f_keywords", lambda k: k["f"]), "f_core", "f_introduced", F.transform("f_relations", lambda r: r["a"]), F.transform("f_relations", lambda r: r["b"]), "f_nodes", F.col("f_mentioned"))
    required = F.col("f_required")
    shared = F.exists(own, lambda x: F.exists(required, lambda t: F.arrays_overlap(x["keys"], t["keys"])))
    partial = F.exists(own, lambda x: F.exists(required, lambda t: terms.names_subject(x, t)))
    return F.when(F.size(required) == 0, "not_required").when(shared, "canonical").when(partial, "partial").otherwise("none")


# --- graph signals --------------------------------------------------------------------------------------------------


def graph_score() -> Column:
    """.65 of the mean role of the query's concepts and .35 of the mean, over matched nodes, of the share of their
    relations' weight that leads to matched nodes."""
    concepts, relations = F.col("f_all"), F.col("f_relations")
    role = F.when(F.size(concepts) > 0, _sum(concepts, role_strength) / F.size(concepts)).otherwise(0.0)
    known = lambda f: F.exists(concepts, lambda c: terms.alike(f, c))
    # an undirected relation is one from each end; flagged once by whether the ends are matched
    end = lambda n, own, other, w: F.struct(n.alias("n"), own.alias("own"), other.alias("other"), w.alias("w"))
    told = lambda r: F.struct(r["a"]["term"].alias("a"), r["b"]["term"].alias("b"), known(r["a"]).alias("ka"), known(r["b"]).alias("kb"), r["w"].alias("w"))
    ends = F.flatten(F.transform(F.transform(relations, told), lambda r: F.array(end(r["a"], r["ka"], r["kb"], r["w"]), end(r["b"], r["kb"], r["ka"], r["w"]))))
    ratio = lambda hits, n: _sum(F.filter(hits, lambda e: (e["n"] == n) & e["other"]), lambda e: e["w"]) / _sum(F.filter(hits, lambda e: e["n"] == n), lambda e: e["w"])
    mean = lambda hits, names: F.when(F.size(names) > 0, _sum(names, lambda n: ratio(hits, n)) / F.size(names)).otherwise(0.0)
    relation = _bound(F.filter(ends, lambda e: e["own"]), lambda hits: _bound(F.array_distinct(F.transform(hits, lambda e: e["n"])), lambda names: mean(hits, names)))
    return F.when(F.size(concepts) > 0, rounded(F.least(role * 0.65 + relation * 0.35, F.lit(1.0)))).otherwise(0.0)


def with_depth(prepared: DataFrame, focus: str | None) -> DataFrame:
    """Add depth, how deeply a lecture treats the focus: .5 role (core 1, introduced .1) and .5 of the sum of 1 / (d + 1)
    over nodes within three hops of it, over 5, clipped; without such a node, a third for each keyword beyond it."""
    if not focus:
        return prepared.withColumn("depth", F.lit(0.0))
    names = F.array_distinct(F.flatten(F.transform("relations", lambda r: F.array(r["src"], r["dst"]))))
    start = F.get(F.filter(names, lambda n: terms.concept_match(n, F.lit(focus))), F.lit(0))
    x = prepared.withColumn("ring0", F.array_compact(F.array(start)))
    for d in (1, 2, 3):  # what is reached within d hops, a projection each, since each is used more than once
        near = F.col(f"ring{d - 1}")
        ends = F.flatten(F.transform(F.filter("relations", lambda r: F.array_contains(near, r["src"]) | F.array_contains(near, r["dst"])), lambda r: F.array(r["src"], r["dst"])))  # noqa: B023
        x = x.withColumn(f"ring{d}", F.array_union(near, ends))
    size = lambda d: F.size(f"ring{d}")
    hops = sum(((size(d) - size(d - 1)) / (d + 1) for d in (1, 2, 3)), F.lit(0.0))
    beyond = _count(F.col("keywords"), lambda k: F.contains(k["keyword"], F.lit(focus)) & (k["keyword"] != focus)) / 3
    reach = F.least(F.lit(1.0), F.when(size(0) > 0, hops / 5).otherwise(beyond))
    x = x.withColumn("f_focus", F.get(terms.forms(F.array(F.lit(focus))), F.lit(0)))
    x = x.withColumn("depth", rounded(role_strength(F.col("f_focus"), 1.0, 0.1) * 0.5 + reach * 0.5))
    return x.drop("ring0", "ring1", "ring2", "ring3", "f_focus")


def contrast_ratio() -> Column:
    some = F.size("relations") > 0
    return F.when(some, rounded(_count(F.col("relations"), lambda r: F.lower(r["type"]).isin(*CONTRAST_TYPES)) / F.size("relations"))).otherwise(0.0)


def fragmentation() -> Column:
    core, introduced = (F.coalesce(F.size(c), F.lit(0)) for c in ("core", "introduced"))
    n = core + introduced
    return F.when(n > 0, introduced / n * (1 - core / n)).otherwise(0.0)


def importance(rank: Column, level: Column) -> Column:
    """Of a community report, from its rank (0 to 10) and level (0: the widest)."""
    return clamp01(rank / 10) * 0.7 + F.greatest(1 - level * 0.25, F.lit(0.25)) * 0.3


def community_score(communities: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """key, score: the best of a lecture's community reports, (.6 title + .4 summary coverage) (.85 + .15 importance).

    communities: key, title, summary, importance (0 to 1). query: term, weight. A field's coverage is the weight of the
    query's terms among its tokens (1 each) and their lookup keys (.75 each), over the query's weight, at most 1. Only
    terms that the query has leave the scan, and its terms are few: they are broadcast.
    """
    spread = lambda field: F.flatten(F.transform(tokens(F.col(field)), lambda t: F.concat(F.array(t), F.filter(terms.lookup_keys(t), lambda k: k != t))))
    asked = query.groupBy("term").agg(F.sum("weight").alias("weight"))
    total = asked.agg(F.sum("weight")).scalar()
    rows = communities.withColumn("report", F.monotonically_increasing_id())
    parts = [rows.select(key, "report", "importance", F.lit(share).alias("share"), F.explode(F.array_distinct(spread(field))).alias("term")) for field, share in (("title", 0.6), ("summary", 0.4))]
    met = parts[0].union(parts[1]).join(F.broadcast(asked), "term")
    sums = met.groupBy(key, "report", "importance", "share").agg(F.sum("weight").alias("hit"))
    cover = sums.groupBy(key, "report", "importance").agg(F.sum(F.col("share") * F.least(F.lit(1.0), F.col("hit") / total)).alias("cover"))
    return cover.groupBy(key).agg(F.max(rounded(F.col("cover") * (0.85 + 0.15 * F.col("importance")))).alias("score"))


# --- ranking --------------------------------------------------------------------------------------------------------


def visual_concepts(weights: Column) -> Column:
    """The share of the query's term weight (a map) that a lecture's visual terms and their tokens cover."""
    own = F.array_distinct(F.flatten(F.transform(F.filter(F.transform("visual_terms", normalize_term), lambda x: F.length(x) > 0), lambda x: F.concat(F.array(x), tokens(x)))))
    total = _sum(F.map_values(weights), lambda w: F.greatest(w, F.lit(0.0)))
    hit = _sum(F.map_values(F.map_filter(weights, lambda k, w: F.array_contains(own, k))), lambda w: F.greatest(w, F.lit(0.0)))
    return F.when(total > 0, rounded(F.least(F.lit(1.0), hit / total))).otherwise(0.0)


def rank(candidates: DataFrame, q: Query, now: str, term_weights: dict[str, float] | None = None, vector: Column | None = None, in_lexical: Column | None = None) -> DataFrame:
    """candidates with content_score, graph_score, visual_score, boost, level, central, subject and score.

    vector: the blended vector similarity, null where a lecture has no vector. in_lexical: whether the lexical search
    found the lecture. The adjustments follow each other in a fixed order: contrast bonus up to 1, mismatch of domain
    (not when browsing), mismatch of subject, cap by topic level, lexical miss of a specific query, weak topic of a
    depth query.
    """
    vector = F.lit(None).cast("double") if vector is None else vector
    in_lexical = F.lit(True) if in_lexical is None else in_lexical
    # each step in a projection of its own, as what it makes is used more than once
    x = prepared(candidates, q).withColumn("dm", direct_match()).withColumn("vec", vector)
    dm = sum((F.col("dm")[k] * w for k, w in FIELDS.items()), F.lit(0.0))
    x = x.withColumn("content_score", F.least(F.lit(CONTENT_CAP), F.when(F.col("vec").isNull(), dm).otherwise(VECTOR_SHARE * F.col("vec") + (1 - VECTOR_SHARE) * dm)))
    x = with_depth(x.withColumn("graph_score", graph_score()), q.focus).withColumn("subject", subject_match())
    weights = F.create_map(*[F.lit(v) for kv in (term_weights or {}).items() for v in kv]).cast("map<string,double>")
    density = rounded(clamp01(F.coalesce("visual_ratio", F.lit(0.0)) * 0.5 + F.coalesce("structure_ratio", F.lit(0.0)) * 0.5))
    x = x.withColumn("visual_score", rounded(scores.visual_score(density, visual_concepts(weights), F.lit("visual" in q.prefers))))
    spm = F.col("spm")
    pace = F.when(spm.isNull() | (spm <= 0) | (spm >= 330), 0.0).when(spm <= 240, 1.0).otherwise(rounded(1 - (spm - 240) / 90))
    age = F.greatest(F.lit(0.0), F.unix_micros(F.to_timestamp(F.lit(now))) / 86400e6 - F.unix_micros(F.col("uploaded_at").cast("timestamp")) / 86400e6)
    recency = F.coalesce(rounded(F.exp(-age * F.log(F.lit(2.0)) / HALF_LIFE_DAYS)), F.lit(0.0))
    same = F.when(F.lit(q.subdomain) == F.col("subdomain"), 1.0).when(F.lit(q.domain) == F.col("domain"), 1.0).otherwise(0.0)
    recent = F.when(F.col("uploaded_at").isNotNull(), scores.recency_weight(F.col("domain"))).otherwise(0.0) if "recency" in q.prefers else F.lit(0.0)
    signals = {
        "domain": (q.domain or q.subdomain, same), "depth": (q.focus, F.col("depth")),
        "duration": (q.duration_max_sec, F.when(F.col("duration_sec") <= (q.duration_max_sec or 0) + GRACE_SEC, 1.0).otherwise(0.0)),
        "application": ("application" in q.prefers, clamp01(F.col("application"))), "listenability": ("listenability" in q.prefers, clamp01(F.col("listenability"))), "slow_speech": ("slow_speech" in q.prefers, pace),
    }
    live = {k: signal for k, (on, signal) in signals.items() if on}
    most = sum((F.lit(BOOSTS[k]) for k in live), F.lit(0.0)) + recent
    gained = sum((BOOSTS[k] * signal for k, signal in live.items()), F.lit(0.0)) + recent * recency
    x = x.withColumn("boost", F.when(most > 0, gained / most).otherwise(0.0))
    w = VISUAL_WEIGHTS if "visual" in q.prefers else WEIGHTS
    total = w["content"] * F.col("content_score") + w["graph"] * F.col("graph_score") + w["visual"] * F.col("visual_score") + w["boost"] * F.col("boost") - FRAGMENTATION * fragmentation()
    x = x.withColumn("raw", rounded(F.greatest(total, F.lit(0.0))))
    asked = F.when(F.size("f_required") > 0, F.col("f_required")).otherwise(F.col("f_all"))
    x = x.withColumn("by_term", F.transform(asked, strengths))
    args = lambda s: [s[k] for k in ("role", "keyword", "text", "relation", "community", "mention")]
    x = x.withColumn("by_term", F.transform("by_term", lambda s: F.struct(rounded(scores.centrality(*args(s))).alias("central"), scores.match_level(*args(s)).alias("level"))))
    n = F.size("by_term")
    x = x.withColumn("central", F.when(n > 0, rounded(_sum(F.col("by_term"), lambda s: s["central"]) / n)).otherwise(0.0)).withColumn("level", F.coalesce(F.array_max("by_term.level"), F.lit(0)))
    matched = (n > 0) & F.forall("by_term", lambda s: s["central"] > 0)
    steps = [
        lambda s: F.least(F.lit(1.0), s + CONTRAST_BONUS * contrast_ratio()) if q.comparison else F.least(F.lit(1.0), s),
        lambda s: s if q.query_type == "topic_browse" else F.when((F.lit(q.subdomain).isNotNull() & ~F.col("subdomain").eqNullSafe(F.lit(q.subdomain))) | (F.lit(q.domain).isNotNull() & ~F.col("domain").eqNullSafe(F.lit(q.domain))), s * DOMAIN_MISMATCH).otherwise(s),
        lambda s: F.when(F.col("subject") == "none", s * SUBJECT_MISMATCH).otherwise(s),
        lambda s: F.when(F.size("f_required") > 0, F.least(s, scores.topic_cap(F.col("level"), F.col("central"), matched))).otherwise(s),
        lambda s: F.when(in_lexical, s).otherwise(s * LEXICAL_MISS) if q.specific else s,
        lambda s: F.when(F.col("level") >= scores.LEVELS.index("keyword_high"), s).otherwise(s * WEAK_TOPIC) if q.query_type == "concept_depth" else s,
    ]
    score = reduce(lambda s, step: step(s), steps, F.col("raw"))
    kept = [*candidates.columns, "content_score", "graph_score", "visual_score", "boost", "raw", "level", "central", "subject"]
    return x.withColumn("score", rounded(score)).select(*kept, "score")


def tiers(ranked: DataFrame, key: str, k: int, least: float = LEAST_SCORE) -> DataFrame:
    """The k best of ranked with score >= least, ties to the key, as tier direct (core or strong keyword) or related."""
    best = ranked.filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)
    direct = F.col("level") >= scores.LEVELS.index("keyword_high")
    return best.withColumn("tier", F.when(direct, "direct").otherwise("related")).withColumn("reason", F.concat(F.lit("topic_"), F.get(F.array(*map(F.lit, scores.LEVELS)), F.col("level"))))
