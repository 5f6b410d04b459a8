"""Korean terms, boxes and JSON text, over values that Spark derives from the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes, terms
from .tables import Tables, query

_ENDS = ("의", "에서", "으로부터", "까지는", "를", "")
_ENDS_SQL = "[" + ", ".join(f"'{x}'" for x in _ENDS) + "]"
_NORMAL = r"lower(regexp_replace(trim({0}), '\s+', ' ', 'g'))"
_WORD_SQL = f"SELECT p_partkey, lower(string_split(p_name, ' ')[1]) || {_ENDS_SQL}[1 + p_partkey % {len(_ENDS)}] AS word FROM part"


def _words(t: Tables):
    """Part names with a particle, several or none at the end."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (1 + F.col("p_partkey") % len(_ENDS)).cast("int"))
    return t.part.select("p_partkey", F.concat(F.lower(F.get(F.split("p_name", " "), F.lit(0))), end).alias("word"))


def _rounds(x: str, n: int) -> str:
    for _ in range(n):
        x = rf"trim(regexp_replace({x}, '{terms.LAST_PARTICLE}', '\1'))"
    return x


@query("str_strip_particles", f"SELECT p_partkey, {_rounds('word', 4)} AS term FROM ({_WORD_SQL})")
def _(t: Tables):
    return _words(t).select("p_partkey", terms.strip_particles(F.col("word")).alias("term"))


@query("str_strip_meta", f"SELECT p_partkey, trim(p_type) AS topic FROM (SELECT p_partkey, {_NORMAL.format('p_type')} AS p_type FROM part)")
def _(t: Tables):
    """Requests about part types; taking the request phrases out leaves the type."""
    return t.part.select("p_partkey", terms.strip_requests(F.concat(F.col("p_type"), F.lit(" 강의 추천해줘"))).alias("topic"))


@query("str_lookup_keys", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([word, {_rounds('word', 4)}], lambda x: length(x) > 1))), '|') AS keys FROM ({_WORD_SQL})")
def _(t: Tables):
    return _words(t).select("p_partkey", F.array_join(F.sort_array(terms.lookup_keys(F.col("word"))), "|").alias("keys"))


@query("str_concept_match", "SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part")
def _(t: Tables):
    """A part's first word with a particle matches that word alone, and not another word."""
    other = F.when(F.col("p_partkey") % 2 == 0, F.get(F.split("p_name", " "), F.lit(0))).otherwise(F.col("unlike"))
    parts = t.part.select("p_partkey", "p_name", F.concat(F.lit("zq"), "p_brand").alias("unlike"))
    return _words(t).join(parts, "p_partkey").select("p_partkey", terms.concept_match(F.col("word"), other).alias("same"))


@query("str_alias_split", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '운영체제' WHEN 1 THEN '강의 ' || p_partkey ELSE p_brand END AS title FROM part")
def _(t: Tables):
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat("p_brand", F.lit(" (운영체제)"))).when(k % 3 == 1, F.concat(F.lit("강의 "), k, F.lit(" ["), "p_brand", F.lit("]"))).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", terms.without_alias(title).alias("title"))


_BOX_SQL = """
WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS x, l_tax * 5 AS y, l_quantity / 100 AS w, l_linenumber / 10 AS h FROM lineitem),
p AS (SELECT l_orderkey, a.l_linenumber AS mark, t.l_linenumber AS track, a.w AS aw, a.h AS ah, t.w AS tw, t.h AS th,
  greatest(least(a.x + a.w, t.x + t.w) - greatest(a.x, t.x), 0) * greatest(least(a.y + a.h, t.y + t.h) - greatest(a.y, t.y), 0) AS i,
  sqrt(greatest(a.x - t.x - t.w, t.x - a.x - a.w, 0) ** 2 + greatest(a.y - t.y - t.h, t.y - a.y - a.h, 0) ** 2) AS gap,
  sqrt((a.x + a.w / 2 - t.x - t.w / 2) ** 2 + (a.y + a.h / 2 - t.y - t.h / 2) ** 2) AS centre
  FROM b a JOIN b t USING (l_orderkey) WHERE a.l_linenumber % 2 = 1 AND t.l_linenumber % 2 = 0),
m AS (SELECT *, i / (aw * ah + tw * th - i) AS iou, i / least(aw * ah, tw * th) AS part FROM p)
"""


def _pairs(t: Tables):
    """Marks (odd lines) and tracks (even lines) of an order, which has a handful of lines, as boxes a and b."""
    b = boxes.box(F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity") / 100, F.col("l_linenumber") / 10)
    x = t.lineitem.select("l_orderkey", "l_linenumber", b.alias("box"))
    marks = x.filter("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("mark"), F.col("box").alias("a"))
    tracks = x.filter("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_linenumber").alias("track"), F.col("box").alias("b"))
    return marks.join(tracks, "l_orderkey")


@query("math_bbox", _BOX_SQL + "SELECT l_orderkey, mark, track, round(iou, 6) AS iou, round(part, 6) AS part, round(gap, 6) AS gap, round(centre, 6) AS centre FROM m")
def _(t: Tables):
    a, b = F.col("a"), F.col("b")
    shown = {"iou": boxes.iou, "part": boxes.share_of_smaller, "gap": boxes.gap, "centre": boxes.centre_distance}
    return _pairs(t).select("l_orderkey", "mark", "track", *[F.round(f(a, b), 6).alias(k) for k, f in shown.items()])


@query("join_bbox_match", _BOX_SQL + """SELECT l_orderkey, mark, track, CAST(row_number() OVER (PARTITION BY l_orderkey, mark ORDER BY round(greatest(iou, part) - gap, 9) DESC, track) AS BIGINT) AS place FROM m
WHERE iou > 0 OR part >= 0.2 OR gap <= greatest(0.01, 0.35 * sqrt(least(aw ** 2 + ah ** 2, tw ** 2 + th ** 2))) QUALIFY row_number() OVER (PARTITION BY l_orderkey, mark ORDER BY round(greatest(iou, part) - gap, 9) DESC, track) <= 3""")
def _(t: Tables):
    """The three tracks that fit each mark best."""
    a, b = F.col("a"), F.col("b")
    fit = F.round(F.greatest(boxes.iou(a, b), boxes.share_of_smaller(a, b)) - boxes.gap(a, b), 9)
    w = Window.partitionBy("l_orderkey", "mark").orderBy(F.desc("fit"), "track")
    x = _pairs(t).filter(boxes.near(a, b)).select("l_orderkey", "mark", "track", fit.alias("fit"))
    return x.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").drop("fit")


@query("json_strip_fence", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(t: Tables):
    """Replies in a code fence: fence and control characters go, the object is parsed."""
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\u0001\n```"))
    bare = F.regexp_replace(reply, r"```[A-Za-z]*|[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return t.events.select("event_id", F.get_json_object(bare, "$.k").cast("long").alias("k"))


@query("json_find_object", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(t: Tables):
    """The first object in free text."""
    text = F.concat(F.lit("Answer: "), "props", F.lit(" as asked."))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.k").cast("long").alias("k"))


@query("json_parse_object", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(props->>'k' AS BIGINT) END AS k, event_id % 3 = 2 AS failed FROM events")
def _(t: Tables):
    """Empty text and what is no object give nothing; what is no JSON is marked."""
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "").otherwise("{broken")
    parsed = F.try_parse_json(F.when(F.trim(text) == "", F.lit("{}")).otherwise(text))
    return t.events.select("event_id", F.try_variant_get(parsed, "$.k", "long").alias("k"), parsed.isNull().alias("failed"))
