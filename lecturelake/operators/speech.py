"""Speech: segments grouped by pauses, sentence ends and length, and pieces between silences packed into chunks.

Rows of one key are ordered in time. Where a row looks at the one before it, keys are cut into stretches of time and each
stretch takes the last row of the one before, so that a key with a great share of all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

# Seconds of a pause between paragraphs, between sentences, and behind a sentence's end; a group's length.
PARAGRAPH, PAUSE, SENTENCE, LONGEST = 1.2, 0.6, 0.4, 30.0
#: Seconds of silence that cut, of a chunk at most and at least, and of padding.
SILENCE, CHUNK_MAX, CHUNK_MIN, PAD = 1.5, 180.0, 30.0, 0.1
SENTENCE_END = r"[.!?。！？]\s*$"
# A remark's most characters, and what remarks on the running of a class hold.
REMARK_CHARS = 90
REMARKS = r"감사합니다|수고하셨|고생하셨|출석|쉬는\s*시간|잠깐\s*쉬|휴식|녹음|마이크|소리\s*들리|다음\s*영상|구독|좋아요|질문\s*있|마치겠습니다|끝내겠습니다|다음으로\s*(넘어|가|보)|이제\s*다음|넘어가겠습니다"


def _stretched(df: DataFrame, start: str, width: float) -> DataFrame:
    return df.withColumn("stretch", F.floor(F.col(start) / width))


def before(df: DataFrame, key: str, order: list[str], start: str, columns: list[str], width: float, name: str = "before") -> DataFrame:
    """Add name: a struct of the columns of the key's row before, null for its first. order begins with start."""
    x = _stretched(df, start, width)
    own = F.struct(*columns)
    inner = F.lag(own).over(Window.partitionBy(key, "stretch").orderBy(*order))
    lasts = x.groupBy(key, "stretch").agg(F.max_by(own, F.struct(*order)).alias("last"))
    carried = lasts.withColumn("carried", F.lag("last").over(Window.partitionBy(key).orderBy("stretch"))).drop("last")
    met = x.withColumn(name, inner).join(carried, (x[key].eqNullSafe(carried[key])) & (x.stretch == carried.stretch)).drop(carried[key]).drop("stretch")
    return met.withColumn(name, F.coalesce(name, "carried")).drop("carried")


def running_count(df: DataFrame, key: str, order: list[str], start: str, flag: Column, width: float, name: str) -> DataFrame:
    """Add name: how many rows of the key up to this one have the flag. order begins with start."""
    x = _stretched(df, start, width).withColumn("flag", F.coalesce(flag, F.lit(False)).cast("long"))
    inner = F.sum("flag").over(Window.partitionBy(key, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = x.groupBy(key, "stretch").agg(F.sum("flag").alias("all"))
    so_far = F.sum("all").over(Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("earlier", F.coalesce(so_far, F.lit(0))).drop("all")
    met = x.withColumn(name, inner).join(sums, (x[key].eqNullSafe(sums[key])) & (x.stretch == sums.stretch)).drop(sums[key])
    return met.withColumn(name, F.col(name) + F.col("earlier")).drop("earlier", "stretch", "flag")


def _limit_step(longest: float):
    def step(state, row):
        start, end = row[0], row[1]
        if state is None:
            return (start, 0), [(*row, 0)]
        opened, number = state
        if end - opened > longest:
            opened, number = start, number + 1
        return (opened, number), [(*row, number)]

    return step


def group_segments(segments: DataFrame, key: str, tie: str, width: float = 3600.0, longest: float = LONGEST) -> DataFrame:
    """Add opened and part to segments (key, start, end, text, tie): rows of equal key, opened and part are one group.

    A segment opens a group where the pause before it is that of a paragraph; or where with it the group would last more
    than longest from its start; or where the text before ends a sentence and the pause is that behind one; or where the
    pause is that between sentences. Segments follow each other by start, then tie (unique in a key). Those without a
    start or an end are left out; a null text is empty; pauses are from the end of the segment before, so overlaps
    are none. A null key is a key. opened counts breaks by pauses; only what lies between two of them and is longer than
    longest is read in sequence, in constant memory.
    """
    x = segments.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    x = before(x, key, ["start", tie], "start", ["end", "text"], width)
    pause = F.col("start") - F.col("before.end")
    ends = F.col("before.text").rlike(SENTENCE_END)
    x = x.withColumn("pause", pause).withColumn("ends", F.coalesce(ends, F.lit(False))).drop("before")
    x = running_count(x, key, ["start", tie], "start", (F.col("pause") >= PAUSE) | (F.col("ends") & (F.col("pause") >= SENTENCE)), width, "opened")
    spans = x.groupBy(key, "opened").agg((F.max("end") - F.min("start") > longest).alias("long"))
    met = x.join(spans, x[key].eqNullSafe(spans[key]) & (x.opened == spans.opened)).drop(spans[key]).drop(spans.opened)
    columns = ["start", "end", key, "text", tie, "pause", "ends", "opened", *[c for c in segments.columns if c not in ("start", "end", key, "text", tie)]]
    short = met.filter("NOT long").select(*columns, F.lit(0).cast("long").alias("part"))
    rows = met.filter("long").withColumn("span", F.to_json(F.struct(key, "opened")))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    cut = fold(rows, "span", ["start", tie], columns, _limit_step(longest), lambda state: [], f"span string, {schema}, part long")
    return short.unionByName(cut.drop("span"))


def speech_groups(segments: DataFrame, key: str, tie: str, width: float = 3600.0, longest: float = LONGEST) -> DataFrame:
    """key, grp (from 0), reason, start, end, text, n, first_tie: the groups of group_segments; the text has its segments' texts
    joined by blanks (empty ones left out), the end is the last segment's. reason is the first rule, in their order, that
    has opened the group: paragraph, length, sentence or pause; null for a key's first."""
    x = group_segments(segments, key, tie, width, longest)
    own = F.array_sort(F.collect_list(F.struct("start", tie, "text", "end", "pause", "ends")))
    g = x.groupBy(key, "opened", "part").agg(own.alias("s")).withColumn("one", F.get("s", F.lit(0))).withColumn("n", F.size("s").cast("long"))
    text = F.array_join(F.filter(F.col("s.text"), lambda c: c != ""), " ")
    g = g.select(key, F.col("one.start").alias("start"), F.element_at("s", -1).end.alias("end"), text.alias("text"), "n", F.col(f"one.{tie}").alias("first_tie"), "one")
    g = running_count(g, key, ["start", "first_tie"], "start", F.lit(True), width, "grp").withColumn("grp", F.col("grp") - 1)
    g = before(g, key, ["start", "first_tie"], "start", ["start"], width)
    pause = F.col("one.pause")
    reason = F.when(pause >= PARAGRAPH, "paragraph").when(F.col("one.end") - F.col("before.start") > longest, "length").when(F.col("one.ends") & (pause >= SENTENCE), "sentence")
    return g.select(key, "grp", F.when(F.col("before").isNotNull(), reason.otherwise("pause")).alias("reason"), "start", "end", "text", "n", "first_tie")


def merge_groups(groups: DataFrame, key: str, joins: DataFrame, width: float = 3600.0) -> DataFrame:
    """groups (speech_groups) of which those that joins (key, grp) names are one with the next: key, grp (renumbered),
    start, end, text, n. joins is what a model has found to go on; names of groups that aren't there, or the last, do nothing."""
    told = joins.select(F.col(key).alias("jk"), (F.col("grp") + 1).alias("jg")).distinct().withColumn("goes_on", F.lit(True))
    x = groups.join(told, groups[key].eqNullSafe(told.jk) & (groups.grp == told.jg), "left").drop("jk", "jg")
    x = running_count(x, key, ["start", "first_tie"], "start", F.col("goes_on").isNull() | (F.col("grp") == 0), width, "merged")
    own = F.array_sort(F.collect_list(F.struct("grp", "start", "end", "text", "n")))
    m = x.groupBy(key, F.col("merged").alias("grp")).agg(own.alias("s"))
    total = F.aggregate(F.col("s.n"), F.lit(0).cast("long"), lambda a, v: a + v)
    text = F.trim(F.array_join("s.text", " "))
    return m.select(key, (F.col("grp") - 1).alias("grp"), F.get("s", F.lit(0)).start.alias("start"), F.element_at("s", -1).end.alias("end"), text.alias("text"), total.alias("n"))


def contexts(segments: DataFrame, key: str, tie: str, breaks: DataFrame, remarks: str = REMARKS, most: int = REMARK_CHARS, width: float = 3600.0) -> DataFrame:
    """key, context (from 0), start, end, text, n: segments (key, start, end, text, tie) between breaks.

    A context ends behind a segment that breaks (key, tie) names, and on both sides of a remark: a text of `most` characters
    at most, runs of white space taken as one, in which the pattern remarks is found. Segments follow each other by
    start, then tie (unique in a key); those without a start are left out, breaks that name none do nothing. The text has
    the segments' trimmed texts joined by blanks, empty ones left out; the end is the last segment's.
    """
    told = breaks.select(F.col(key).alias("bk"), F.col(tie).alias("bt")).distinct().withColumn("named", F.lit(True))
    x = segments.filter(F.col("start").isNotNull()).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    x = x.join(told, x[key].eqNullSafe(told.bk) & (x[tie] == told.bt), "left").drop("bk", "bt")
    tight = F.trim(F.regexp_replace("text", r"\s+", " "))
    x = x.withColumn("named", F.coalesce("named", F.lit(False))).withColumn("remark", (F.length(tight) <= most) & tight.rlike(remarks))
    x = before(x, key, ["start", tie], "start", ["named", "remark"], width)
    opens = F.col("before").isNotNull() & (F.col("before.named") | F.col("before.remark") | F.col("remark"))
    x = running_count(x, key, ["start", tie], "start", opens, width, "context")
    own = F.array_sort(F.collect_list(F.struct("start", tie, "text", "end")))
    c = x.groupBy(key, "context").agg(own.alias("s"))
    text = F.array_join(F.filter(F.col("s.text"), lambda t: t != ""), " ")
    return c.select(key, "context", F.get("s", F.lit(0)).start.alias("start"), F.element_at("s", -1).end.alias("end"), text.alias("text"), F.size("s").cast("long").alias("n"))


# --- chunks ---------------------------------------------------------------------------------------------------------


def speech_pieces(totals: DataFrame, silences: DataFrame, key: str, silence: float = SILENCE, longest: float = CHUNK_MAX, pad: float = PAD) -> DataFrame:
    """key, start, end: what lies between silences (key, start, end) of at least `silence` seconds in recordings (key, total),
    padded on both sides but not into the piece before, in pieces of `longest` at most. Null or empty recordings have
    none, null silences cut nothing, and a silence that ends before an earlier one lets speech begin at its own end."""
    t = totals.filter("total > 0").select(key, "total")
    w = Window.partitionBy(key).orderBy("s", "e")
    cuts = silences.filter(F.col("end") - F.col("start") >= silence).select(key, F.col("start").alias("s"), F.col("end").alias("e"))
    cuts = cuts.join(t, key).select(key, "total", F.greatest("s", F.lit(0.0)).alias("s"), F.least("e", "total").alias("e"), F.lit(0).alias("last"))
    ends = t.select(key, "total", F.col("total").alias("s"), F.lit(None).cast("double").alias("e"), F.lit(1).alias("last"))
    w = Window.partitionBy(key).orderBy("last", "s", "e")
    x = cuts.unionByName(ends).withColumn("from", F.coalesce(F.lag("e").over(w), F.lit(0.0))).filter(F.col("s") > F.col("from"))
    end = F.least("total", F.col("s") + pad)
    x = x.select(key, F.greatest(F.lit(0.0), F.col("from") - pad).alias("start"), end.alias("end"), "last", "s")
    x = x.withColumn("start", F.greatest("start", F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("last", "s")), F.lit(0.0))))
    size = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest)).cast("int")
    x = x.select(key, "start", "end", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    return x.select(key, (F.col("start") + F.col("i") * longest).alias("start"), F.least("end", F.col("start") + (F.col("i") + 1) * longest).alias("end")).filter("end > start")


def chunk_steps(longest: float = CHUNK_MAX, shortest: float = CHUNK_MIN):
    """Step and last of a fold that packs pieces (start, end) in order into chunks of at most longest seconds of speech; a last
    chunk under shortest joins the one before if both fit. Sends (start, end, seconds, pieces). The state is two chunks."""

    def step(state, row):
        start, end = row
        if state is None:
            return (None, (start, end, end - start, 1)), []
        held, now = state
        if now[2] + (end - start) > longest:
            return (now, (start, end, end - start, 1)), [held] if held else []
        return (held, (now[0], end, now[2] + (end - start), now[3] + 1)), []

    def last(state):
        held, now = state
        if held and now[2] < shortest and held[2] + now[2] <= longest:
            return [(held[0], now[1], held[2] + now[2], held[3] + now[3])]
        return [held, now] if held else [now]

    return step, last


def speech_chunks(totals: DataFrame, silences: DataFrame, key: str, silence: float = SILENCE, longest: float = CHUNK_MAX, shortest: float = CHUNK_MIN, pad: float = PAD) -> DataFrame:
    """key, start, end, seconds, pieces: the pieces of recordings between silences, packed in order."""
    step, last = chunk_steps(longest, shortest)
    kind = totals.schema[key].dataType.simpleString()
    pieces = speech_pieces(totals, silences, key, silence, longest, pad)
    return fold(pieces, key, ["start"], ["start", "end"], step, last, f"{key} {kind}, start double, end double, seconds double, pieces long")
