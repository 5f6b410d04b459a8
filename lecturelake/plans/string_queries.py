"""Text rules over texts that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators.text import compact
from .tables import Tables, query


def pick(values, by: str):
    """A value by a whole number, round about."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(by), F.lit(len(values))).cast("int"))


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, by: str) -> str:
    return f"{_sql(values)}[1 + {by} % {len(values)}]"


@query("str_compact", r"SELECT p_partkey, regexp_replace(lower(p_name), '\s+', '', 'g') AS tight FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", compact(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t"))).alias("tight"))


_PUNCT = ("!", ".", "?", "")
_ENDS = ("은", "에서", "으로", "이란", "")


@query("str_keyword_normalize", "SELECT p_partkey, replace(lower(p_name), ' ', '') AS keyword FROM part")
def _(t: Tables):
    """A name with a particle and punctuation loses both."""
    x = t.part.select("p_partkey", F.concat(F.upper("p_name"), pick(_ENDS, "p_partkey"), pick(_PUNCT, "p_partkey")).alias("w"))
    return x.select("p_partkey", texts.keyword(F.col("w")).alias("keyword"))


_VERBS = ("했습니다", "에서", "는데", "처럼", "Q", "이")


@query("str_strip_endings", f"SELECT p_partkey, split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 6 = 4 THEN 'Q' ELSE '' END AS stem FROM part WHERE length(split_part(p_name, ' ', 1)) > 1 AND {_pick(_VERBS, 'p_partkey')} <> ''")
def _(t: Tables):
    x = t.part.select("p_partkey", F.concat(F.get(F.split("p_name", " "), F.lit(0)), pick(_VERBS, "p_partkey")).alias("w"))
    return x.select("p_partkey", texts.without_ending(F.col("w")).alias("stem"))


_TAILS = ("의 개념", " (abc)", "에 대한", "-기능", "")


@query("str_canonical_key", "SELECT p_partkey, replace(p_name, ' ', '') AS key FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", texts.canonical_key(F.concat("p_name", pick(_TAILS, "p_partkey"))).alias("key"))


_TITLES = ("gear", "the", "12345", "proprofsurvey.com", "연결하며", "운영체제", "A", "상태 전이", "of", "페이지 교체하는")


@query("filt_valid_concept", f"SELECT c_custkey, {_pick(_TITLES, 'c_custkey')} AS title FROM customer WHERE c_custkey % {len(_TITLES)} IN (0, 5, 7)")
def _(t: Tables):
    x = t.customer.select("c_custkey", pick(_TITLES, "c_custkey").alias("title"))
    return x.filter(texts.is_concept(F.col("title")))


_CODES = ("AB12", "OS", "HTTP", "gear", "operating system", "운영체제", "R2-D2")


@query("str_code_like", f"SELECT c_custkey, CAST([1.0, 0.35, 0.75, 0.55, 0.0, 0.0, 0.75][1 + c_custkey % {len(_CODES)}] AS DOUBLE) AS penalty FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", texts.code_like(pick(_CODES, "c_custkey")).alias("penalty"))


@query("str_sentences", r"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$'), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[다요죠]')")
def _(t: Tables):
    x = t.documents.filter("text is not null and not text rlike '[다요죠]'")
    return x.select("doc_id", F.size(texts.sentences(F.col("text"))).cast("long").alias("n"))


@query("str_clean_community", "SELECT c_custkey, 'Report on ' || c_name || '. It is about ' || lower(c_mktsegment) || '.' AS summary FROM customer")
def _(t: Tables):
    """The sentence on risks goes, the others stay."""
    x = F.concat(F.lit("Report on "), "c_name", F.lit(". 법적 위험이 있다. It is about "), F.lower("c_mktsegment"), F.lit("."))
    return t.customer.select("c_custkey", texts.without_boilerplate(x, ("법적", "규제", "위험")).alias("summary"))


@query("str_toc_detect", "SELECT o_orderkey, o_orderkey % 4 = 1 AS contents FROM orders")
def _(t: Tables):
    """Slides with five chapters in order, with four, with one twice, and with no numbers."""
    rows = ("a\nb\nc", "1. a\n2. b\n3. c\n5. d\n6 e", "1. a\n2. b\n3. c\n4. d", "1. a\n2. b\n2. c\n3. d\n4. e\n5. f")
    return t.orders.select("o_orderkey", texts.is_contents(pick(rows, "o_orderkey")).alias("contents"))


_QUESTIONS = ("운영체제의 정의는 무엇인가요?", "슬라이드 몇 번에 나오나요?", "강조한 시간은 언제", "개념 설명은 어디서", "슬라이드 중 중요한 것", "그림이 있는 장면")


@query("str_question_class", f"SELECT c_custkey, {_pick(('content', 'structural', 'structural', 'content', 'content', 'content'), 'c_custkey')} AS kind FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", texts.question_class(pick(_QUESTIONS, "c_custkey")).alias("kind"))


@query("str_question_keywords", "SELECT p_partkey, p_name || CASE WHEN contains(p_name, lower(p_type)) THEN '' ELSE '|' || lower(p_type) END || '|비교|그림' AS words FROM part")
def _(t: Tables):
    """A quoted name, a type with a particle, stop-words, and short words that count."""
    q = F.concat(F.lit("‘"), "p_name", F.lit("’ "), F.lower("p_type"), F.lit("의 비교하면 무엇 그림은?"))
    words = texts.question_keywords(q, ("무엇", "어떤"))
    named = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_join(F.filter(words, lambda w: ~F.array_contains(named, w)), "|").alias("words"))


@query("str_strip_modifiers", "SELECT p_partkey, p_name AS terms FROM part")
def _(t: Tables):
    blocked = ("강의", "추천", "그림", "시각 자료", "최신")
    x = F.array(F.concat(F.lit("그림 "), F.col("p_name"), F.lit(" 강의")), F.lit("최신"), F.concat("p_name", F.lit(" 추천")))
    return t.part.select("p_partkey", F.array_join(texts.without_modifiers(x, blocked), "|").alias("terms"))


@query("filt_slide_error_reportable", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 5 = 0")
def _(t: Tables):
    """Of five kinds of corrections, one is about more than blanks and style."""
    name = F.col("l_partkey").cast("string")
    k = F.col("l_partkey") % 5
    fix = F.when(k == 0, F.concat(name, F.lit("x y"))).when(k == 1, F.concat(name, F.lit(" y"))).when(k == 2, F.concat(name, F.lit("  y"))).when(k == 3, F.lit("")).otherwise(F.concat(name, F.lit("z y")))
    reason = F.when(k == 4, "더 자연스럽다").otherwise("fact")
    return t.lineitem.filter(texts.is_reportable(F.concat(name, F.lit(" y")), fix, reason)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("str_asr_artifact", "SELECT doc_id, n_chars % 2 = 0 AS artifact FROM documents WHERE length(text) > 200")
def _(t: Tables):
    """A snippet that the correction has taken out, or that is still there."""
    snippet = F.lit("zqx zqx zqx")
    fixed = F.when(F.col("n_chars") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("Zqxzqx zqx."), F.col("text")))
    return t.documents.filter("length(text) > 200").select("doc_id", texts.is_asr_artifact(snippet, F.concat(F.col("text"), F.lit(" zqxzqxzqx")), fixed).alias("artifact"))


@query("str_domain_map", f"SELECT o_orderkey, {_pick(('engineering', 'natural_science', 'natural_science', 'etc', 'health_sciences', 'etc'), 'o_orderkey')} AS domain FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", texts.domain(pick((" Eng/CS", "sci", "MATH/algebra", "nothing", "health-sciences", ""), "o_orderkey")).alias("domain"))


@query("str_mark_emphasis", "SELECT p_partkey, '**' || split_part(p_name, ' ', 1) || '** ' || '*' || split_part(p_name, ' ', 2) || '* end' AS marked FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def _(t: Tables):
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    targets = F.array(F.struct(F.upper(word(0)).alias("text"), F.lit(2).alias("count")), F.struct(word(1).alias("text"), F.lit(1).alias("count")), F.struct(F.lit("absent").alias("text"), F.lit(5).alias("count")))
    x = t.part.filter(word(0) != word(1))
    return x.select("p_partkey", texts.marked(F.concat("p_name", F.lit(" end")), targets).alias("marked"))


@query("str_apply_edits", "SELECT p_partkey, 'ab' || substr(p_name, 3, 1) || 'XYZ' || substr(p_name, 5) AS edited FROM part")
def _(t: Tables):
    """Two good edits; one that overlaps, one out of range, one on text that isn't there."""
    e = lambda a, b, old, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), old.alias("old"), F.lit(new).alias("new"))
    part = lambda a, b: F.substring("p_name", a + 1, b - a)
    edits = F.array(e(3, 4, part(3, 4), "XYZ"), e(0, 2, part(0, 2), "ab"), e(1, 3, part(1, 3), "no"), e(0, 99, F.col("p_name"), "no"), e(2, 3, F.lit("?"), "no"))
    return t.part.select("p_partkey", texts.edited(F.col("p_name"), edits).alias("edited"))


@query("str_seq_similarity", "SELECT p_partkey, CAST(round(2.0 * length(p_name) / (2 * length(p_name) + 3), 6) AS DOUBLE) AS ratio, false AS one_apart FROM part")
def _(t: Tables):
    """A name and the same with three letters more."""
    other = F.concat("p_name", F.lit("QQQ"))
    return t.part.select("p_partkey", F.round(texts.sequence_similarity(F.col("p_name"), other), 6).alias("ratio"), texts.one_letter_apart(F.col("p_name"), other).alias("one_apart"))


@query("str_compound_nouns", "SELECT p_partkey, replace(p_name, ' ', '') || '|' || split_part(p_name, ' ', 2) || lower(p_type) || '|' || replace(p_name, ' ', '') || lower(p_type) AS nouns FROM part")
def _(t: Tables):
    """Neighbouring nouns in twos and threes; the tagger is whatever splits the text."""
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    return t.part.select("p_partkey", F.array_join(texts.phrases(words, 2, 3, ""), "|").alias("nouns"))


@query("str_glossary_terms", r"""WITH u AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r\t,;:|.!?]+')) AS u FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(u, '\s+'), lambda x: x <> '') AS w FROM u),
p AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS n FROM w WHERE len(w) BETWEEN 1 AND 6)) WHERE n > 1 OR length(w[i]) >= 3)
SELECT doc_id, count(*) AS terms, min(term) AS first, max(term) AS last FROM (SELECT doc_id, term FROM p UNION SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.()]*')) AS term FROM documents) WHERE regexp_matches(term, '[0-9_()]')) WHERE length(term) BETWEEN 2 AND 40 GROUP BY 1""")
def _(t: Tables):
    """Of whole texts: phrases of one to three words out of units of six words at most, and words that look like code."""
    units = t.documents.select("doc_id", F.explode(F.split("text", r"[\n\r\t,;:|.!?]+")).alias("u"))
    words = units.select("doc_id", F.filter(F.split("u", r"\s+"), lambda w: w != "").alias("w")).filter("size(w) BETWEEN 1 AND 6")
    phrases = words.select("doc_id", F.explode(F.filter(texts.phrases(F.col("w"), 1, 3, " "), lambda p: F.contains(p, F.lit(" ")) | (F.length(p) >= 3))).alias("term"))
    code = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_.()]*"), F.lit(0)))).alias("term")).filter(F.col("term").rlike("[0-9_()]"))
    once = phrases.union(code).filter(F.length("term").between(2, 40)).distinct()
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.min("term").alias("first"), F.max("term").alias("last"))


@query("str_intent_rules", "SELECT o_orderkey, CAST(round(0.2 / s, 6) AS DOUBLE) AS definition, CAST(round(v / s, 6) AS DOUBLE) AS visual, CAST(round(p / s, 6) AS DOUBLE) AS place FROM (SELECT o_orderkey, v, p, 0.2 + v + p AS s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.3 END AS v, CASE WHEN o_orderkey % 3 = 0 THEN 0.7 ELSE 0.0 END AS p FROM orders))")
def _(t: Tables):
    """Weights that a model gave, raised by rules on the question's words, then to a sum of 1."""
    q = F.concat(F.lit("개념"), F.when(F.col("o_orderkey") % 2 == 0, " 그림").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, " 어디").otherwise(""))
    weights = F.create_map(F.lit("definition"), F.lit(0.2), F.lit("visual_location"), F.lit(0.3))
    rules = {"visual_location": ("그림|이미지|도표", 0.95), "scene_location": ("장면|구간|어디|언제", 0.7)}
    raised = F.map_concat(F.map_filter(weights, lambda k, v: ~k.isin(*rules)), *[F.create_map(F.lit(k), F.greatest(F.coalesce(F.element_at(weights, k), F.lit(0.0)), F.when(q.rlike(p), w).otherwise(0.0))) for k, (p, w) in rules.items()])
    kept = F.map_filter(raised, lambda k, v: v > 0)
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + v)
    x = t.orders.select("o_orderkey", F.transform_values(kept, lambda k, v: v / total).alias("w"))
    at = lambda k, name: F.round(F.coalesce(F.element_at("w", k), F.lit(0.0)), 6).alias(name)
    return x.select("o_orderkey", at("definition", "definition"), at("visual_location", "visual"), at("scene_location", "place"))


@query("str_query_fallback", """WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), q AS (SELECT p_partkey, 'zz' || p_name || ' ' || lower(p_type) AS q FROM part)
SELECT p_partkey, term FROM q JOIN v ON contains(q, term) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) DESC, term) <= 4""")
def _(t: Tables):
    """Keywords of the pool that a query holds, the longest four."""
    from ..operators.contain import contained
    from ..operators.windows import latest

    pool = t.part.select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    q = t.part.select("p_partkey", F.concat(F.lit("zz"), "p_name", F.lit(" "), F.lower("p_type")).alias("q"))
    return latest(contained(q, "p_partkey", "q", pool, "term"), ["p_partkey"], [F.desc(F.length("term")), F.col("term")], 4).select("p_partkey", "term")


@query("str_reason", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= 0.05 THEN 'topic' ELSE '' END || CASE WHEN l_discount >= 0.05 AND l_tax >= 0.04 THEN ', ' ELSE '' END || CASE WHEN l_tax >= 0.04 THEN 'visual' ELSE '' END || CASE WHEN l_discount < 0.05 AND l_tax < 0.04 THEN 'related' ELSE '' END AS reason FROM lineitem")
def _(t: Tables):
    parts = F.array_compact(F.array(F.when(F.col("l_discount") >= 0.05, "topic"), F.when(F.col("l_tax") >= 0.04, "visual")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("related").alias("reason"))


@query("resp_source_mode", f"SELECT c_custkey, {_pick(('overview', 'visual_location', 'scene_location', 'default'), 'c_custkey')} AS mode FROM customer")
def _(t: Tables):
    q = pick(("전체 요약", "그림 위치", "몇 초 장면", "정의"), "c_custkey")
    mode = F.when(q.rlike("요약|전체|개요"), "overview").when(q.rlike(texts.any_of(texts.VISUAL_WORDS)), "visual_location").when(q.rlike("장면|구간|몇 초|언제"), "scene_location").otherwise("default")
    return t.customer.select("c_custkey", mode.alias("mode"))


@query("resp_intro_filter", "SELECT c_custkey, c_custkey % 3 = 0 AS intro FROM customer")
def _(t: Tables):
    x = pick(("강의의 목표와 목차", "스케줄링", "페이지 교체"), "c_custkey")
    return t.customer.select("c_custkey", F.replace(x, F.lit(" "), F.lit("")).rlike("강의목표|강의의목표|학습목표|목차|개요|chapter").alias("intro"))


@query("resp_topic_terms", "SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) AS terms FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def _(t: Tables):
    """A question's terms without instructions, eight at most."""
    q = F.concat(F.col("p_name"), F.lit(" 설명 알려줘 정리"))
    x = t.part.filter(F.get(F.split("p_name", " "), F.lit(0)) != F.get(F.split("p_name", " "), F.lit(1)))
    return x.select("p_partkey", F.array_join(F.slice(texts.question_keywords(q, ("설명", "알려줘", "정리")), 1, 8), "|").alias("terms"))


@query("resp_answer_slide_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 1 + l_orderkey % 7 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 + l_orderkey % 7) OR l_orderkey % 2 = 0")
def _(t: Tables):
    """Rows of the only slide that an answer names, or all where it names none or several, or none of them is there."""
    n = (1 + F.col("l_orderkey") % 7).cast("string")
    answer = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("슬라이드 "), n, F.lit("과 슬라이드 99"))).otherwise(F.concat(F.lit("답은 슬라이드 "), n))
    named = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"슬라이드 (\d+)"), F.lit(1)))
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.size(named) == 1, F.get(named, F.lit(0)).cast("int")).alias("only"))
    here = x.filter("l_linenumber = only").select("l_orderkey").distinct().withColumn("has", F.lit(True))
    return x.join(here, "l_orderkey", "left").filter("has is null or l_linenumber = only").select("l_orderkey", "l_linenumber", "l_partkey")


@query("arr_coerce", "SELECT c_custkey, ['a|b', 'x', 'n|m', ''][1 + c_custkey % 4] AS items FROM customer")
def _(t: Tables):
    """A JSON array, a bare text, a printed list or nothing, as an array of strings."""
    x = pick(('["a", "b"]', "x", "['n' 'm']", ""), "c_custkey")
    listed = F.filter(F.regexp_extract_all(x, F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1)), lambda s: s != "")
    items = F.when(F.trim(x) == "", F.array().cast("array<string>")).when(x.rlike(r"^\s*\["), listed).otherwise(F.array(F.trim(x)))
    return t.customer.select("c_custkey", F.array_join(items, "|").alias("items"))


@query("arr_append_recursive", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type || '|' || p_size AS items FROM part")
def _(t: Tables):
    """Strings and numbers out of a text, a list, a map and a number, in order, blanks left out."""
    every = F.concat(F.array("p_name", F.lit(" ")), F.flatten(F.array(F.array("p_brand"))), F.map_values(F.create_map(F.lit("t"), F.col("p_type"))), F.array(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.array_join(F.filter(every, lambda s: F.trim(s) != ""), "|").alias("items"))


@query("map_relations_normalize", "SELECT p_partkey, p_name || '>uses>' || lower(p_type) AS relations FROM part")
def _(t: Tables):
    """from or source, to or target, types in lower case; what lacks an end goes."""
    r = lambda a, b, c, d, k: F.struct(a.alias("from"), b.alias("source"), c.alias("to"), d.alias("target"), F.lit(k).alias("type"))
    none = F.lit(None).cast("string")
    rows = F.array(r(none, F.col("p_name"), F.lower("p_type"), none, "USES"), r(F.col("p_name"), none, none, none, "HAS"), r(F.lit(" "), none, none, F.col("p_type"), "IS"))
    first = lambda x, a, b: F.nullif(F.trim(F.coalesce(x[a], x[b])), F.lit(""))
    good = F.filter(F.transform(rows, lambda x: F.struct(first(x, "from", "source").alias("a"), F.lower(x["type"]).alias("t"), first(x, "to", "target").alias("b"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return t.part.select("p_partkey", F.array_join(F.transform(good, lambda x: F.concat_ws(">", x["a"], x["t"], x["b"])), "|").alias("relations"))


@query("json_batch_reply", "SELECT o_orderkey, 0 AS i, 'a' || o_orderkey AS text FROM orders UNION ALL SELECT o_orderkey, 2, 'c' FROM orders")
def _(t: Tables):
    """A reply's rows with an index that was asked for and a text; others go."""
    reply = F.concat(F.lit('[{"i": 0, "text": "a'), F.col("o_orderkey"), F.lit('"}, {"i": 9, "text": "x"}, {"i": 2, "text": "c"}, {"i": 1}, {"i": "?", "text": "y"}]'))
    rows = F.from_json(reply, "array<struct<i: string, text: string>>")
    x = t.orders.select("o_orderkey", F.inline(rows)).withColumn("i", F.expr("try_cast(i AS int)"))
    return x.filter("i between 0 and 2 and text is not null")
