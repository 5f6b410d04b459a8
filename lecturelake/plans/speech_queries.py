"""Speech queries: conversations are lectures whose turns are segments, their lengths taken as time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import speech
from .tables import Tables, query

#: 60 ms a character, and a pause before each turn that its length decides.
_SEGMENTS = """s AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) * 60 AS d, length(coalesce(text, '')) * 7 % 16 * 100 AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
m AS (SELECT *, CAST(sum(d + p) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS stop FROM s), t AS (SELECT conv_id, turn, i, trim(text) AS text, CAST(stop - d AS DOUBLE) / 1000 AS start, CAST(stop AS DOUBLE) / 1000 AS "end" FROM m)"""
_GROUPS = _SEGMENTS + r""", l AS (SELECT *, start - lag("end") OVER w AS pause, coalesce(regexp_matches(lag(text) OVER w, '[.!?。！？]\s*$'), false) AS ends FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT conv_id, i, start AS opened, 0 AS grp, CAST(NULL AS VARCHAR) AS reason FROM l WHERE i = 1 UNION ALL
SELECT l.conv_id, l.i, CASE WHEN x THEN l.start ELSE opened END, grp + x::INT, CASE WHEN pause >= 1.2 THEN 'paragraph' WHEN l."end" - opened > 30 THEN 'length' WHEN ends AND pause >= 0.4 THEN 'sentence' WHEN pause >= 0.6 THEN 'pause' END
FROM (SELECT l.*, g.opened, g.grp, pause >= 0.6 OR l."end" - opened > 30 OR (ends AND pause >= 0.4) AS x FROM g JOIN l ON l.conv_id = g.conv_id AND l.i = g.i + 1) l),
r AS (SELECT conv_id, CAST(grp AS BIGINT) AS grp, min_by(reason, i) AS reason, min(start) AS start, max_by("end", i) AS "end", string_agg(nullif(text, ''), ' ' ORDER BY i) AS text, count(*) AS n FROM g JOIN l USING (conv_id, i) GROUP BY 1, 2)"""


def _segments(t: Tables):
    size = F.length(F.coalesce("text", F.lit("")))
    stop = F.sum(size * 60 + size * 7 % 16 * 100).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", "text", ((stop - size * 60).cast("double") / 1000).alias("start"), (stop.cast("double") / 1000).alias("end"))


@query("win_gap_sessionize_speech", f"WITH RECURSIVE {_GROUPS} SELECT conv_id, grp, reason, start, \"end\", md5(coalesce(text, '')) AS text, n FROM r")
def _(t: Tables):
    """Segments grouped by pauses, sentence ends and a length of 30 seconds."""
    return speech.speech_groups(_segments(t), "conv_id", "turn").select("conv_id", "grp", "reason", "start", "end", F.md5("text").alias("text"), "n")


@query("win_gap_sessionize_merged", f"""WITH RECURSIVE {_GROUPS}, o AS (SELECT *, coalesce(lag(length(text) < 150) OVER (PARTITION BY conv_id ORDER BY grp), false) AS goes_on FROM r), k AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY conv_id ORDER BY grp) - 1 AS k FROM o)
SELECT conv_id, CAST(k AS BIGINT) AS grp, min(start) AS start, max_by("end", grp) AS "end", md5(trim(string_agg(coalesce(text, ''), ' ' ORDER BY grp))) AS text, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY conv_id, k""")
def _(t: Tables):
    """The second pass: a short group goes on in the next one."""
    g = speech.speech_groups(_segments(t), "conv_id", "turn")
    return speech.merge_groups(g, "conv_id", g.filter(F.length("text") < 150).select("conv_id", "grp")).withColumn("text", F.md5("text"))


_REMARKS = "tion|mente|und"


@query("win_break_points_contexts", "WITH " + _SEGMENTS + f""", r AS (SELECT *, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 90 AND regexp_matches(text, '{_REMARKS}') AS remark, turn % 4 = 3 AS named FROM t),
o AS (SELECT *, coalesce(lag(named OR remark) OVER w OR remark, false) AND i > 1 AS opens FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)), c AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY i) AS context FROM o)
SELECT conv_id, CAST(context AS BIGINT) AS context, min(start) AS start, max_by("end", i) AS "end", md5(coalesce(string_agg(nullif(text, ''), ' ' ORDER BY i), '')) AS text, count(*) AS n FROM c GROUP BY 1, 2""")
def _(t: Tables):
    """Contexts between the breaks that a model has named, short remarks on their own."""
    x = _segments(t)
    named = x.filter("turn % 4 = 3").select("conv_id", "turn")
    return speech.contexts(x, "conv_id", "turn", named, _REMARKS).withColumn("text", F.md5("text"))


@query("win_chunk_pack_speech")
def _(t: Tables):
    """A user's month as one recording, silent for as long as an event's value says; packing is sequential, so a plain loop tests it."""
    at = F.pmod(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6, F.lit(3600.0))
    totals = t.events.select("user_id").distinct().withColumn("total", F.lit(3600.0))
    silences = t.events.select("user_id", at.alias("start"), (at + F.col("value") / 10).alias("end"))
    return speech.speech_chunks(totals, silences, "user_id").select("user_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("seconds", 4).alias("seconds"), "pieces")
