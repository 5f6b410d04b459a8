"""Text, retrieval and ranking queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inverted, ranking, text
from ..operators.windows import latest, with_fallback
from .tables import Tables, query

KEYWORDS = ["tion", "the of", "mente", "ung der"]
TERMS = {"the": 1.0, "tionon": 0.8, "heit": 0.5, "quemente": 0.5, "licensed": 1.0}
TOKENS_SQL = "list_filter(regexp_extract_all(lower({0}), '[0-9A-Za-z가-힣_#+./-]+'), lambda x: length(x) > 1)"
HITS_SQL = " + ".join(f"CAST((contains(lower(text), '{k}') OR contains(replace(lower(text), ' ', ''), '{k.replace(' ', '')}')) AS BIGINT)" for k in KEYWORDS)


@query("str_normalize_term", r"SELECT p_partkey, lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) AS term, replace(lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')), ' ', '') AS tight FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", text.normalize_term(F.col("p_name")).alias("term"), text.compact(F.col("p_name")).alias("tight"))


@query("str_tokenize", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)")
def _(t: Tables):
    x = t.documents.select("doc_id", text.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("agg_doc_freq_stats", f"""
WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln((SELECT n FROM n) / count(*)), 6) AS irf, round(ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term""")
def _(t: Tables):
    x = text.document_frequencies(t.documents, "doc_id", "text")
    return x.select("term", "df", F.round("irf", 6).alias("irf"), F.round("idf", 6).alias("idf"))


def _fields(t: Tables):
    return t.documents.select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("summary"))


_tf = [f"1.5 * len(list_filter(t, lambda x: x = '{q}')) + 0.5 * len(list_filter(s, lambda x: x = '{q}'))" for q in TERMS]
BM25_SQL = f"""
WITH d AS (SELECT doc_id, {TOKENS_SQL.format('substr(text, 1, 60)')} AS t, {TOKENS_SQL.format('text')} AS s FROM documents),
c AS (SELECT doc_id, 1.5 * len(t) + 0.5 * len(s) AS dl, {', '.join(f'CAST({x} AS DOUBLE) AS tf{i}' for i, x in enumerate(_tf))} FROM d),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM c),
r AS (SELECT doc_id, {' + '.join(f'{w} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))' for i, w in enumerate(TERMS.values()))} AS score FROM c, n)
"""


@query("agg_bm25", BM25_SQL + "SELECT doc_id, round(score, 5) AS score FROM r WHERE score > 0")
def bm25(t: Tables):
    return text.bm25(_fields(t), "doc_id", "title", "summary", TERMS).select("doc_id", F.round("score", 5).alias("score"))


@query("topk_bm25", BM25_SQL + "SELECT doc_id, round(score, 5) AS score FROM r WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 80")
def top_bm25(t: Tables):
    return ranking.top(bm25(t), 80, F.desc("score"), F.col("doc_id"))


def _index(t: Tables):
    """Documents with three fields: the first 60 characters, words of ten letters or more as keywords, the whole text."""
    words = F.array_distinct(F.filter(text.tokens(F.col("text")), lambda w: F.length(w) >= 10))
    docs = t.documents.select("doc_id", F.substring("text", 1, 60).alias("title"), F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(0.7).alias("weight"))).alias("keywords"), F.col("text").alias("summary"))
    return inverted.build(docs, "doc_id", "title", "keywords", "summary")


FIELD_TERMS = {**TERMS, "information": 0.7, "tionontion": 1.0}
_field_tf = [f"1.5 * len(list_filter(t, lambda x: x = '{q}')) + 2.0 * CASE WHEN list_contains(k, '{q}') THEN 0.7 + 0.7 * 0.5 ELSE 0 END + 0.5 * len(list_filter(s, lambda x: x = '{q}'))" for q in FIELD_TERMS]
FIELDS_SQL = f"""
WITH a AS (SELECT doc_id, {TOKENS_SQL.format('substr(text, 1, 60)')} AS t, {TOKENS_SQL.format('text')} AS s FROM documents), d AS (SELECT *, list_distinct(list_filter(s, lambda x: length(x) >= 10)) AS k FROM a),
c AS (SELECT doc_id, CAST(len(t) + len(s) + (0.7 + 0.7 * 0.5) * len(k) AS DOUBLE) AS dl, {', '.join(f'CAST({x} AS DOUBLE) AS tf{i}' for i, x in enumerate(_field_tf))} FROM d),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(FIELD_TERMS)))} FROM c),
r AS (SELECT doc_id, {' + '.join(f'{w} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * coalesce(nullif(dl, 0), avgdl) / avgdl))' for i, w in enumerate(FIELD_TERMS.values()))} AS score FROM c, n)
"""


@query("agg_bm25_index", FIELDS_SQL + "SELECT doc_id, round(score, 5) AS score FROM r WHERE score > 0")
def _(t: Tables):
    """Three fields, from the stored index."""
    return inverted.scores(_index(t), FIELD_TERMS, "doc_id").select("doc_id", F.round("score", 5).alias("score"))


@query("topk_bm25_index", FIELDS_SQL + "SELECT doc_id, round(score, 5) AS score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 80")
def _(t: Tables):
    return inverted.top(_index(t), FIELD_TERMS, "doc_id", 80).select("doc_id", F.round("score", 5).alias("score"))


@query("filt_text_contains", f"SELECT doc_id FROM documents WHERE {HITS_SQL} > 0")
def _(t: Tables):
    return t.documents.filter(text.hits(F.col("text"), KEYWORDS) > 0).select("doc_id")


@query("agg_hits_count", f"SELECT doc_id, {HITS_SQL} AS hits FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.hits(F.col("text"), KEYWORDS).alias("hits"))


@query("sort_multi_key", f"SELECT doc_id, lang, n_chars, {HITS_SQL} AS hits FROM documents WHERE {HITS_SQL} > 0 ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 22")
def _(t: Tables):
    x = t.documents.select("doc_id", "lang", "n_chars", text.hits(F.col("text"), KEYWORDS).alias("hits")).filter("hits > 0")
    return ranking.top(x, 22, F.desc("hits"), F.desc("n_chars"), F.col("doc_id"))


@query("filt_near_max", f"WITH h AS (SELECT doc_id, {HITS_SQL} AS hits FROM documents), m AS (SELECT max(hits) AS m FROM h) SELECT doc_id, hits FROM h, m WHERE m < 3 OR hits >= m - 1")
def _(t: Tables):
    x = t.documents.select("doc_id", text.hits(F.col("text"), KEYWORDS).alias("hits"))
    x = x.withColumn("m", x.agg(F.max("hits")).scalar())
    return x.filter("m < 3 or hits >= m - 1").drop("m")


@query("filt_with_fallback", "SELECT doc_id FROM documents WHERE lang = 'it' OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'it')")
def _(t: Tables):
    return with_fallback(t.documents, F.col("lang") == "it").select("doc_id")


@query("filt_min_score_gate", BM25_SQL + "SELECT doc_id, round(score, 5) AS score FROM r WHERE score > 0 AND score >= 0.22 AND (SELECT max(score) FROM r) >= 0.22")
def _(t: Tables):
    x = text.bm25(_fields(t), "doc_id", "title", "summary", TERMS)
    best = x.agg(F.max("score")).scalar()
    return x.withColumn("best", best).filter("best >= 0.22 and score >= 0.22").select("doc_id", F.round("score", 5).alias("score"))


_union = " UNION ALL ".join(f"(SELECT {i} AS k, doc_id, n_chars FROM documents WHERE contains(lower(text), '{k}') ORDER BY n_chars DESC, doc_id LIMIT 12)" for i, k in enumerate(KEYWORDS))


@query("topk_per_keyword_union", f"WITH u AS ({_union}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM u) SELECT doc_id, CAST(k AS BIGINT) AS keyword_no, n_chars FROM f WHERE r = 1")
def _(t: Tables):
    # one scan: each document is listed under the keywords that it holds, and lists are cut to twelve before the shuffle
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(i)) for i, k in enumerate(KEYWORDS)]))
    x = t.documents.select("doc_id", "n_chars", F.explode(found).alias("k"))
    x = latest(x, ["k"], [F.desc("n_chars"), F.col("doc_id")], 12).drop("place")
    return latest(x, ["doc_id"], [F.col("k")]).select("doc_id", F.col("k").cast("long").alias("keyword_no"), "n_chars")


def _asked(t: Tables):
    """The query vector; one row, as vec_id is a key."""
    return t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1).scalar()


_q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query("math_cosine", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_q}), 4) AS cosine FROM embeddings")
def _(t: Tables):
    return t.embeddings.withColumn("q", _asked(t)).select("vec_id", F.round(ranking.cosine(F.col("embedding"), F.col("q")), 4).alias("cosine"))


@query("topk_vector", f"WITH d AS (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_q}) AS d FROM embeddings WHERE label <> 3) SELECT vec_id, round(1 / (1 + d), 6) AS score FROM d ORDER BY round(d, 9), vec_id LIMIT 40")
def _(t: Tables):
    x = t.embeddings.filter("label <> 3").withColumn("q", _asked(t)).select("vec_id", ranking.l2(F.col("embedding"), F.col("q")).alias("d"))
    return ranking.top(x, 40, F.round("d", 9), F.col("vec_id")).select("vec_id", F.round(1 / (1 + F.col("d")), 6).alias("score"))


def _rotated(k: int) -> str:
    return f"list_concat(embedding[{k + 1}:], embedding[1:{k}])" if k else "embedding"


_three = " + ".join(f"{w} * list_cosine_similarity(CAST({_rotated(k)} AS DOUBLE[]), {_q})" for w, k in ((0.2, 0), (0.55, 16), (0.25, 32)))


def vector_fields(t: Tables):
    """Title, keyword and summary vectors: the given one and two rotations of it."""
    turn = lambda k: F.concat(F.slice("embedding", k + 1, 64), F.slice("embedding", 1, k)) if k else F.col("embedding")
    x = t.embeddings.withColumn("q", _asked(t))
    score = sum((ranking.cosine(turn(k), F.col("q")) * w for w, k in ((0.2, 0), (0.55, 16), (0.25, 32))), F.lit(0.0))
    return ranking.top(x.select("vec_id", F.round(score, 6).alias("score")).filter("score > 0"), 80, F.desc("score"), F.col("vec_id"))


@query("topk_vector_fields", f"SELECT vec_id, round({_three}, 6) AS score FROM embeddings WHERE round({_three}, 6) > 0 ORDER BY 2 DESC, 1 LIMIT 80")
def _(t: Tables):
    return vector_fields(t)


@query("fuse_rrf", BM25_SQL + f""", b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 5) DESC, doc_id) AS rank FROM r WHERE score > 0 QUALIFY rank <= 80),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({_three}, 6) DESC, vec_id) AS rank FROM embeddings WHERE round({_three}, 6) > 0 QUALIFY rank <= 80)
SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score, min(rank) AS best_rank FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY id ORDER BY 2 DESC, 3, 1 LIMIT 50""")
def fused(t: Tables):
    b = ranking.ranked(top_bm25(t), F.desc("score"), F.col("doc_id")).select(F.col("doc_id").alias("id"), "rank")
    v = ranking.ranked(vector_fields(t), F.desc("score"), F.col("vec_id")).select(F.col("vec_id").alias("id"), "rank")
    x = ranking.rank_fusion([b, v], "id").withColumn("score", F.round("score", 8))
    return ranking.top(x, 50, F.desc("score"), F.col("best_rank"), F.col("id"))


@query("topk_mmr")
def _(t: Tables):
    x = ranking.top(t.embeddings.withColumn("q", _asked(t)).select("vec_id", "embedding", F.round(ranking.cosine(F.col("embedding"), F.col("q")), 6).alias("rel")), 96, F.desc("rel"), F.col("vec_id"))
    return ranking.mmr(x.withColumn("g", F.lit(0)), "g", "vec_id", "embedding", "rel", 18).select("vec_id", "place")


@query("math_soft_threshold", "WITH c AS (SELECT event_id, value / 100 AS v FROM events) SELECT event_id, round(CASE WHEN v >= 0.6 THEN v WHEN v <= 0.45 THEN 0 ELSE v * (v - 0.45) / (0.6 - 0.45) END, 6) AS v FROM c")
def _(t: Tables):
    return t.events.select("event_id", F.round(ranking.soft_threshold(F.col("value") / 100, 0.6, 0.45), 6).alias("v"))


@query("str_id_extract", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([a-z]+)', 1))), ' ') AS ids FROM pages")
def _(t: Tables):
    ids = F.sort_array(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([a-z]+)'), F.lit(1))))
    return t.pages.select("page_id", F.array_join(ids, " ").alias("ids"))


@query("str_color", "SELECT s_suppkey, '#' || substr(md5(s_name), 1, 6) AS color FROM supplier")
def _(t: Tables):
    return t.supplier.select("s_suppkey", F.concat(F.lit("#"), F.substring(F.md5("s_name"), 1, 6)).alias("color"))
