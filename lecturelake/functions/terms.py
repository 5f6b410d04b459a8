"""Korean query terms as columns: particles, request phrases, lookup keys and concept matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.text import compact, normalize_term

# Particles that may end a term, and phrases of a request that name no topic.
PARTICLES = ("으로부터", "로부터", "에서", "에게", "한테", "으로", "까지", "부터", "처럼", "보다", "마다", "로", "와", "과", "의", "을", "를", "이", "가", "은", "는", "에", "도", "만")
REQUESTS = ("추천해줘", "추천해 주세요", "추천해주세요", "추천해", "추천", "알려줘", "알려 주세요", "알려주세요", "알려", "찾아줘", "찾아 주세요", "찾아주세요", "찾아", "보여줘", "보여 주세요", "보여주세요", "보여", "설명해줘", "설명해 주세요", "설명해주세요", "설명", "강의", "관련", "대해서", "대해", "관한", "다루는", "배우는", "학습", "수업")

#: The shortest stem of two characters or more that a particle follows, so the longest particle goes.
LAST_PARTICLE = f"^(.{{2,}}?)(?:{'|'.join(PARTICLES)})$"
#: The same for all particles that stand at the end; a request phrase, the longest that fits.
ALL_PARTICLES = f"^(.{{2,}}?)(?:\\s*(?:{'|'.join(PARTICLES)}))+$"
REQUEST = "|".join(sorted(REQUESTS, key=lambda x: -len(x)))


def strip_particles(c: Column) -> Column:
    """Take particles off the end while two characters remain; null stays null."""
    return F.trim(F.regexp_replace(normalize_term(c), ALL_PARTICLES, "$1"))


def strip_requests(c: Column) -> Column:
    """Take request phrases out; where several begin at one place, the longest goes."""
    return normalize_term(F.regexp_replace(normalize_term(c), REQUEST, " "))


def base(c: Column) -> Column:
    """What a term is about, without request phrases and particles (which only a term in Hangul can have)."""
    return F.when(c.rlike("[가-힣]"), normalize_term(strip_particles(strip_requests(c)))).otherwise(normalize_term(c))


def lookup_keys(c: Column) -> Column:
    """Keys of a term: it and its base, with and without blanks, of two characters or more."""
    term, stem = normalize_term(c), base(c)
    return F.array_distinct(F.filter(F.array(term, compact(term), stem, compact(stem)), lambda x: F.length(x) > 1))


def concept_match(a: Column, b: Column) -> Column:
    """Whether two concepts mean the same: they share a key or one holds the other. Empty or null ones match nothing."""
    x, y = normalize_term(a), normalize_term(b)
    full = (F.length(x) > 0) & (F.length(y) > 0)
    same = (compact(x) == compact(y)) | F.arrays_overlap(lookup_keys(a), lookup_keys(b)) | F.contains(x, y) | F.contains(y, x)
    return F.coalesce(full & same, F.lit(False))


def forms(terms: Column) -> Column:
    """An array's terms as array<struct<term, tight, keys>>, empty and null ones left out, so that each is worked out once.

    What is normalized has single blanks, which are all that compact and a second normalize_term can still take; only a term in
    Hangul has a base of its own.
    """
    some = F.filter(F.transform(terms, normalize_term), lambda x: F.length(x) > 0)
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    hangul = lambda x: (F.octet_length(x) > F.length(x)) & x.rlike("[가-힣]")
    plain = lambda x: F.array_distinct(F.filter(F.array(F.trim(x), tight(x)), lambda k: F.length(k) > 1))
    return F.transform(some, lambda x: F.struct(x.alias("term"), tight(x).alias("tight"), F.when(hangul(x), lookup_keys(x)).otherwise(plain(x)).alias("keys")))


def alike(a: Column, b: Column) -> Column:
    """concept_match of two forms; what costs most is asked last."""
    return (a["tight"] == b["tight"]) | F.contains(a["term"], b["term"]) | F.contains(b["term"], a["term"]) | F.arrays_overlap(a["keys"], b["keys"])


def names_subject(a: Column, b: Column) -> Column:
    """Whether form a names the subject b: as alike, except that a must not be a part of b only."""
    return (a["tight"] == b["tight"]) | F.contains(a["term"], b["term"]) | F.arrays_overlap(a["keys"], b["keys"])


def expanded(terms: Column) -> Column:
    """Distinct normalized terms of an array and their lookup keys."""
    some = F.filter(F.transform(terms, normalize_term), lambda x: F.length(x) > 0)
    return F.array_distinct(F.flatten(F.transform(some, lambda x: F.concat(F.array(x), lookup_keys(x)))))


def without_alias(c: Column) -> Column:
    """Of `head (alias)` or `head [alias]`, the side written in Hangul, the head first; otherwise the title as it is."""
    parts = re.compile(r"^(.*\S)\s*[(\[]([^()\[\]]+)[)\]]$").pattern
    title = F.trim(c)
    head, alias = F.trim(F.regexp_extract(title, parts, 1)), F.trim(F.regexp_extract(title, parts, 2))
    hangul = lambda x: x.rlike("[가-힣]")
    return F.when((alias != "") & hangul(head), head).when((alias != "") & hangul(alias), alias).otherwise(title)
