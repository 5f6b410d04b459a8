"""Rules on short texts as columns: endings, keys, validity, sentences, questions, marks and edits."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.text import compact, normalize_term

# Particles of a keyword, endings in the order in which they are tried, words and endings of what is no
# concept, generic endings of a title, words of questions.
KEYWORD_PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에서", "에게", "에", "로", "으로", "와", "과", "도", "만", "까지", "부터", "처럼", "이란", "란")
QUESTION_PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "에서", "에게", "로", "으로", "와", "과", "도", "만", "까지", "부터", "처럼", "이란", "란", "으로서", "로서")
ENDINGS = (
    "했습니다", "됐습니다", "였습니다", "습니다", "ㅂ니다", "입니다", "합니다", "됩니다", "이에요", "이예요", "예요", "에요", "네요", "군요", "어요", "아요", "해요", "되요",
    "되는", "하는", "있는", "라는", "이라는", "된", "할", "하게", "하지", "는데", "니까", "거나", "지만", "에서", "으로", "고", "면", "며", "죠", "네",
    "부터", "까지", "처럼", "대로", "마저", "조차", "랑", "들", "가", "를", "을", "의", "로", "에", "와", "과", "는", "은", "도", "만", "이",
)
ENGLISH_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "and", "or", "but", "if", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "about",
)
NOISE_ENDINGS = (
    "하고", "하며", "하여", "하는", "하면서", "하고자", "이라고", "이며", "이나", "이고", "대해", "에서", "으로", "에게", "으로써", "이다", "아니다", "있다", "없다", "한다", "하거나", "하지", "하면", "이지", "하니", "않고", "이후", "이전",
    "있도록", "있음", "없던", "만든", "만드", "된", "될", "할", "함", "함으로", "함께", "하다", "된다", "되다", "가능하다", "하", "않는다", "아님", "준다", "포함한", "보여주", "느끼", "제공받", "반영하", "전달하", "구현하", "쫓아가",
)
GENERIC_SUFFIXES = ("개념", "정의", "기능", "목적", "특징", "원리", "이해", "소개", "기초", "관련")
STRUCTURAL_WORDS = ("몇 번", "슬라이드", "시간", "타임", "언제", "어디서", "강조", "몇 초", "구간", "씬", "장면", "scene")
CONTENT_WORDS = ("설명", "내용", "기능", "역할", "정의", "차이", "이유", "의미", "개념")
PLACE_WORDS = ("구간", "어디", "어디서", "언제", "장면", "씬")
SLIDE_WORDS = ("뭐", "무엇", "어떤", "어느", "찾", "알려", "소개", "관련", "다루", "중요", "핵심", "강조", "비중", "순위", "랭킹")
VISUAL_WORDS = ("시각자료", "그림", "이미지", "도표", "다이어그램", "구조도")
STYLE_WORDS = ("더 적절", "더 자연", "자연스럽", "어색", "문법", "조사", "순화", "용어", "표현 선호", "더 좋은 표현", "문체", "선택의 의미", "나열", "병렬", "쉼표", "구분", "별개", "띄어쓰기", "공백", "줄바꿈", "글자 간격")
DOMAINS = {"eng": "engineering", "sci": "natural_science", "math": "natural_science", "hum": "humanities", "soc": "social_science", "med": "health_sciences", "art": "arts", "gen": "etc"}
DOMAIN_NAMES = ("engineering", "natural_science", "humanities", "social_science", "arts", "health_sciences", "sports", "education", "etc")


def any_of(words) -> str:
    """A pattern for any of the words."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def keyword(c: Column) -> Column:
    """Lower case, without punctuation and one particle."""
    bare = F.regexp_replace(F.trim(F.lower(c)), r"[^\p{L}\p{N}_]", "")
    return F.regexp_replace(bare, f"(?:{'|'.join(KEYWORD_PARTICLES)})$", "")


def without_ending(c: Column) -> Column:
    """The word without the first of ENDINGS that leaves two characters or more."""
    out = c
    for ending in reversed(ENDINGS):
        out = F.when(c.endswith(ending) & (F.length(c) >= len(ending) + 2), F.substring(c, F.lit(1), F.length(c) - len(ending))).otherwise(out)
    return out


def canonical_key(c: Column) -> Column:
    """What titles of one concept share: no parentheses, punctuation, 의 and generic ending."""
    x = F.regexp_replace(F.regexp_replace(normalize_term(c), r"\([^)]*\)", ""), r"[\s_./#+:;,\-·'\"`~!?\[\]{}<>]", "")
    x = F.replace(F.regexp_replace(x, "(?:에대한|에관한|관련된|관련)$", ""), F.lit("의"), F.lit(""))
    return F.regexp_replace(x, f"(?<=.{{3}})(?:{'|'.join(GENERIC_SUFFIXES)})$", "")


def is_concept(c: Column) -> Column:
    """Not too short, a number, an address, an English function word or a Korean verb."""
    x = F.trim(c)
    no = (F.length(x) < 2) | x.rlike(r"^\d+$") | x.rlike(r"\.(com|kr|org|net|io|tistory|brunch|github)")
    return F.coalesce(F.when(no, False).when(x.rlike("^[a-z]+$"), ~x.isin(*ENGLISH_STOPWORDS)).otherwise(~x.rlike(f"(?:{'|'.join(NOISE_ENDINGS)})$")), F.lit(False))


def code_like(c: Column) -> Column:
    """A penalty for what looks like a code or an abbreviation."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_\-./#+]", "")
    n, upper = F.length(x), (x == F.upper(x)) & (x != F.lower(x))
    return F.when(~x.rlike("[A-Za-z]"), 0.0).when(x.rlike("^[A-Za-z]+[0-9]+$") & (n <= 8), 1.0).when(upper & n.between(2, 3), 0.35).when(upper & n.between(2, 6), 0.75).when(x.rlike("^[A-Za-z]+[0-9]*$") & (n <= 6), 0.55).otherwise(0.0)


def sentences(c: Column) -> Column:
    """Sentences by end marks or Korean final endings; what is left at the end is one too."""
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    found = F.regexp_extract_all(x, F.lit(r".+?(?:[.!?。！？]+|(?:다|요|죠|니다|습니다|어요|예요|에요)(?=\s|$)|$)"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda s: s != "")


def trimmed(c: Column, most: int) -> Column:
    """At most so many characters, cut at a blank where there is one, then `...`."""
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.rtrim(F.substring(x, 1, most))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.regexp_replace(cut, r"(?s)^(.*) [^ ]*$", "$1")), F.lit("...")))


def excerpt(c: Column, least: int = 35, most: int = 120, n: int = 3) -> Column:
    """The first sentences, three at most, until least characters are reached, none that goes beyond most but the first."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    add = lambda a, s: F.trim(F.concat_ws(" ", F.nullif(a["text"], F.lit("")), s))

    def step(a, s):
        both = add(a, s)
        stop = a["done"] | ((a["text"] != "") & (F.length(both) > most))
        return F.struct(F.when(stop, a["text"]).otherwise(both).alias("text"), (stop | (F.length(both) >= least)).alias("done"))

    return trimmed(F.aggregate(F.slice(sentences(c), 1, n), start, step, lambda a: a["text"]), most)


def without_boilerplate(c: Column, words, most: int = 360) -> Column:
    """Sentences without any of the words, or the whole where none is left, cut to most characters."""
    parts = F.split(F.trim(c), r"(?<=[.!?。！？])\s+|(?<=다\.)\s*")
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: (s != "") & ~s.rlike(any_of(words)))
    return F.trim(F.substring(F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.trim(c)), 1, most))


def is_contents(c: Column) -> Column:
    """Whether a slide lists numbered chapters: five numbers or more, none twice, from 1 on, the first five rising by 2 at most."""
    numbers = F.transform(F.filter(F.transform(F.split(c, r"\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{1,9}\s*[.)]?\s+\S+")), lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int"))
    first = F.slice(numbers, 1, 5)
    steps = F.zip_with(F.slice(first, 2, 4), F.slice(first, 1, 4), lambda b, a: b - a <= 2)
    return F.coalesce((F.size(numbers) >= 5) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.get(numbers, F.lit(0)) == 1) & F.forall(steps, lambda x: x), F.lit(False))


def question_class(c: Column) -> Column:
    """content or structural (about where and when)."""
    content = c.rlike(any_of(VISUAL_WORDS)) | (c.rlike(any_of(CONTENT_WORDS)) & c.rlike(any_of(PLACE_WORDS))) | (F.contains(c, F.lit("슬라이드")) & c.rlike(any_of(SLIDE_WORDS)))
    return F.when(~content & c.rlike(any_of(STRUCTURAL_WORDS)), "structural").otherwise("content")


def question_keywords(c: Column, stopwords) -> Column:
    """Quoted phrases, then words without a particle and stop-words, each once; 표 and 그림 may be short."""
    quoted = F.transform(F.regexp_extract_all(c, F.lit("['‘’“”「」]([^'‘’“”「」]+)['‘’“”「」]"), F.lit(1)), lambda x: F.trim(x))
    words = F.split(F.trim(F.regexp_replace(c, r"['‘’“”「」?？!！.,，。·\s]+", " ")), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, f"(?:{'|'.join(QUESTION_PARTICLES)})$", ""))
    bare = F.transform(bare, lambda w: F.when(w.isin("중요한", "중요하게", "중요도"), "중요").when(w.isin("핵심적인", "핵심적"), "핵심").when(w.startswith("비교"), "비교").when(w.startswith("강조"), "강조").otherwise(w))
    return F.array_distinct(F.concat(quoted, F.filter(bare, lambda w: ((F.length(w) >= 2) | w.isin("표", "그림")) & ~w.isin(*stopwords))))


def without_modifiers(terms: Column, blocked) -> Column:
    """Terms without words of conditions, longest first; what is only such words goes; each once."""
    pattern = any_of(sorted(blocked, key=lambda w: -len(w)))
    bare = F.transform(terms, lambda t: F.trim(F.regexp_replace(F.regexp_replace(normalize_term(t), pattern, " "), r"\s+", " ")))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) > 0) & ~t.isin(*blocked)))


def is_reportable(problem: Column, fix: Column, reason: Column) -> Column:
    """Whether a slide's error is more than a matter of blanks or style."""
    p, q, r = (F.trim(F.coalesce(x, F.lit(""))) for x in (problem, fix, reason))
    blank = lambda x: F.regexp_replace(x, r"\S+", "")
    double = F.contains(r, F.lit("중복")) & p.rlike(r"(?:을|를|이|가|은|는)\s+\S+(?:을|를|이|가|은|는)")
    return (p != "") & (q != "") & (F.regexp_replace(p, r"\s+", "") != F.regexp_replace(q, r"\s+", "")) & (blank(p) == blank(q)) & ~F.lower(r).rlike(any_of(STYLE_WORDS)) & ~double


def is_asr_artifact(snippet: Column, original: Column, corrected: Column) -> Column:
    """Whether what an issue quotes is in the raw transcript only, and gone from the corrected one."""
    s, o, c = (compact(F.coalesce(x, F.lit(""))) for x in (snippet, original, corrected))
    return (F.length(s) >= 6) & (o != "") & (c != "") & (o != c) & ~F.contains(c, s) & F.contains(o, s)


def domain(c: Column) -> Column:
    """One of nine domains, from its name or the short form before a slash."""
    x = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_"))
    table = F.create_map(*[F.lit(v) for kv in DOMAINS.items() for v in kv])
    return F.when(x.isin(*DOMAIN_NAMES), x).otherwise(F.coalesce(F.element_at(table, F.get(F.split(x, "/"), F.lit(0))), F.lit("etc")))


def marked(c: Column, targets: Column) -> Column:
    """A text with the first occurrence of each target (text, count), in order, between one, two (from 2) or three (from
    4) stars; not inside stars that are there, and each target once."""

    def step(text, t):
        at = F.instr(F.lower(text), F.lower(t["text"]))
        before = F.substring(text, F.lit(1), at - 1)
        stars = F.repeat(F.lit("*"), F.when(t["count"] >= 4, 3).when(t["count"] >= 2, 2).otherwise(1))
        after = F.substring(text, at, F.length(text))
        odd = F.length(F.regexp_replace(before, r"[^*]", "")) % 2 == 1
        put = F.concat(before, stars, F.substring(after, F.lit(1), F.length(t["text"])), stars, F.substring(after, F.length(t["text"]) + 1, F.length(after)))
        return F.when((at == 0) | odd | (F.length(t["text"]) == 0), text).otherwise(put)

    return F.aggregate(targets, c, step)


def edited(c: Column, edits: Column) -> Column:
    """A text with edits (start from 0, stop, old, new) applied: those whose span holds the old text, taken from the left,
    none into the one before; from the right, so that places stay true."""
    good = F.filter(edits, lambda e: (e["start"] >= 0) & (e["stop"] > e["start"]) & (e["stop"] <= F.length(c)) & (F.substring(c, e["start"] + 1, e["stop"] - e["start"]) == e["old"]) & (e["old"] != e["new"]))
    kind = "array<struct<start: int, stop: int, old: string, new: string>>"
    clear = F.aggregate(F.array_sort(good.cast(kind)), F.array().cast(kind), lambda a, e: F.when((F.size(a) == 0) | (e["start"] >= F.element_at(a, -1)["stop"]), F.concat(a, F.array(e))).otherwise(a))
    return F.aggregate(F.reverse(clear), c, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new"], F.substring(t, e["stop"] + 1, F.length(t))))


@F.pandas_udf(T.DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (not an edit distance); 0 where one is null or empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def one_letter_apart(a: Column, b: Column) -> Column:
    """Equal lengths of four or more, and one place that differs."""
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    apart = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda x: x))
    return (F.length(a) == F.length(b)) & (F.length(a) >= 4) & (apart == 1)


def phrases(words: Column, shortest: int, longest: int, glue: str) -> Column:
    """Runs of neighbouring words as phrases, each once."""

    def of(n: int) -> Column:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), glue))

    return F.array_distinct(F.concat(*map(of, range(shortest, longest + 1))))
