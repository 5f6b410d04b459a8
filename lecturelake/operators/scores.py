"""Scores of lectures, issues and scenes as columns: topic centrality, caps, display shares, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranking import clamp01

# Match levels from weakest to strongest, each with its cap where all terms match and where some do.
TOPIC_CAPS = {
    "none": (0.30, 0.30),
    "summary": (0.42, 0.35),
    "mention": (0.45, 0.40),
    "community": (0.48, 0.40),
    "relation": (0.52, 0.42),
    "keyword_low": (0.62, 0.52),
    "introduced": (0.68, 0.58),
    "keyword_high": (1.00, 1.00),
    "core": (1.00, 1.00),
}
LEVELS = tuple(TOPIC_CAPS)
#: A summary alone earns its full cap from this centrality on.
SUMMARY_FLOOR = 0.20
#: A component counts in full from this ratio on; conditions take this share of the displayed score.
FULL_RATIO, CONDITION_SHARE = 0.8, 20


def ladder(steps: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first test that holds; a null test doesn't."""
    (test, value), rest = steps[0], steps[1:]
    return reduce(lambda c, s: c.when(s[0], s[1]), rest, F.when(test, value)).otherwise(otherwise)


def centrality(role: Column, keyword: Column, text: Column, relation: Column, community: Column, mention: Column) -> Column:
    """How central a term is to a lecture, by its strongest kind of match."""
    return clamp01(F.greatest(role, keyword * 0.9, text, relation * 0.45, community * 0.35, mention * 0.3))


def match_level(role: Column, keyword: Column, text: Column, relation: Column, community: Column, mention: Column) -> Column:
    """Place in LEVELS of a term's strongest evidence."""
    tests = {"core": role >= 0.95, "keyword_high": keyword >= 0.65, "introduced": role >= 0.3, "keyword_low": keyword > 0, "relation": relation >= 0.2, "community": community > 0, "mention": mention > 0, "summary": text > 0}
    return ladder([(test, LEVELS.index(name)) for name, test in tests.items()], 0)


def topic_cap(level: Column, central: Column, all_matched: Column) -> Column:
    """The highest score a lecture may get; level is a place in LEVELS."""
    at = lambda which: F.get(F.array(*[F.lit(caps[which]) for caps in TOPIC_CAPS.values()]), level)
    full = all_matched & ((level != LEVELS.index("summary")) | (central >= SUMMARY_FLOOR))
    return F.when(full, at(0)).otherwise(at(1))


def visual_score(density: Column, concept: Column, preferred: Column) -> Column:
    return clamp01(F.when(preferred, density * 0.65 + concept * 0.35).otherwise(density * 0.5))


def display_score(content: Column, meaning: Column, condition: Column) -> Column:
    """0 to 100 as shown: content and meaning share what conditions leave, by their ratio; a null condition takes none."""
    share = F.when(condition.isNull(), 0).otherwise(CONDITION_SHARE)
    left = F.lit(100) - share
    mine = F.when(content + meaning > 0, F.bround(content / (content + meaning) * left)).otherwise(F.floor(left / 2)).cast("double")
    part = lambda c: clamp01(c / FULL_RATIO) * 100
    return F.bround(part(content) * (mine / 100) + part(meaning) * ((left - mine) / 100) + part(condition) * (share / 100)).cast("int")


def emphasis(topic: Column, importance: Column, signal: Column) -> tuple[Column, Column]:
    """Keyword and audio emphasis of a context, each part clipped to its maximum (60, 9, 10)."""
    clipped = lambda c, most: F.least(c, F.lit(float(most))) / most
    return clipped(topic, 60) + clipped(importance, 9), clipped(signal, 10) * 0.8


def keyword_coverage(hits: Column, n: int) -> Column:
    return F.least(F.lit(1.0), hits / max(3.0, n * 0.5))


def recency_weight(domain: Column) -> Column:
    return F.when(domain == "engineering", 0.10).when(domain.isin("social_science", "health_sciences"), 0.05).otherwise(0.02)


def iso_utc(c: Column) -> Column:
    """A timestamp of ISO text; text without an offset is UTC, text that is no time is null."""
    return F.try_to_timestamp(F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z"))))


def grounded(score: Column, refuted: Column, threshold: float) -> Column:
    """A refuted issue falls just below the threshold of rejection; null counts as not refuted."""
    return F.when(refuted, F.least(score, F.lit(max(0.0, threshold - 0.001)))).otherwise(score)
