from pyspark.sql import functions as F

from lecturelake.functions import terms
from lecturelake.operators import ranking, recommend, scores

SCHEMA = """video_id string, title string, summary string, domain string, subdomain string, duration_sec double, uploaded_at timestamp,
keywords array<struct<keyword string, score double>>, core array<string>, introduced array<string>, relations array<struct<src string, dst string, type string>>,
communities array<struct<title string, summary string, nodes array<string>, importance double>>, mentioned array<string>, visual_terms array<string>,
visual_ratio double, structure_ratio double, application double, listenability double, spm double"""


def lecture(spark, **changes):
    row = {
        "video_id": "v1", "title": "운영체제 소개", "summary": "컴퓨터 자원을 관리한다", "domain": "engineering", "subdomain": "computer_science", "duration_sec": 600.0, "uploaded_at": None,
        "keywords": [("운영체제", 1.0)], "core": ["운영체제"], "introduced": ["응용 소프트웨어"], "relations": [("운영체제", "응용 소프트웨어", "contrasts_with")],
        "communities": [("운영체제", "", ["운영체제"], 1.0)], "mentioned": [], "visual_terms": [], "visual_ratio": 0.0, "structure_ratio": 0.0, "application": 0.0, "listenability": 0.0, "spm": 0.0,
    }
    return spark.createDataFrame([tuple((row | changes).values())], SCHEMA)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_base_terms(spark):
    assert tuple(one(spark, terms.base(F.lit("운영체제의 강의 추천해줘")), terms.base(F.lit("운영 체제에 대해 알려줘")))) == ("운영체제", "운영 체제")


def test_canonical_terms(spark):
    aliases = spark.createDataFrame([("응용 소프트웨어", "응용 소프트웨어", 0.5), ("운영체제", "운영체제", 1.0)], "alias string, canonical string, weight double")
    asked = spark.createDataFrame([("응용소프트웨어",), ("소프트웨어",)], "term string")
    assert {r.term: r.canonical for r in recommend.canonicalize(asked, aliases).collect()} == {"응용소프트웨어": "응용 소프트웨어", "소프트웨어": None}


def test_soft_threshold(spark):
    low, mid, high = one(spark, *[ranking.soft_threshold(F.lit(x), 0.6, 0.45) for x in (0.44, 0.55, 0.60)])
    assert low == 0 and 0 < mid < 0.55 and high == 0.60


def test_subject_match(spark):
    for asked, want in (("운영체제의", "canonical"), ("데이터베이스", "none"), ("운영", "partial")):
        q = recommend.Query(keywords=(asked,))
        assert recommend.prepared(lecture(spark), q).select(recommend.subject_match()).first()[0] == want, asked


def test_topic_level_and_cap(spark):
    q = recommend.Query(keywords=("운영체제",))
    core = recommend.rank(lecture(spark), q, "2026-01-01").first()
    assert scores.LEVELS[core.level] == "core" and core.subject == "canonical"
    bare = lecture(spark, title="네트워크", summary="운영체제 위의 통신", keywords=[("네트워크", 1.0)], core=["네트워크"], introduced=[], relations=[], communities=[])
    only = recommend.rank(bare, q, "2026-01-01", vector=F.lit(1.0)).first()
    assert scores.LEVELS[only.level] == "summary" and only.score <= 0.42
    cap = lambda level: scores.topic_cap(F.lit(scores.LEVELS.index(level)), F.lit(0.2), F.lit(True))
    assert tuple(one(spark, cap("summary"), cap("core"))) == (0.42, 1.0)


def test_tiers(spark):
    ranked = spark.createDataFrame([("v1", 0.30, 0), ("v2", 0.20, 8), ("v3", 0.9, 8)], "video_id string, score double, level int")
    got = [(r.video_id, r.tier, r.reason) for r in recommend.tiers(ranked, "video_id", 5).orderBy(F.desc("score")).collect()]
    assert got == [("v3", "direct", "topic_core"), ("v1", "related", "topic_none")]


def test_nulls_and_empty_tables(spark):
    q = recommend.Query(keywords=("운영체제",), focus="운영체제", duration_max_sec=60, domain="engineering", query_type="concept_depth", specific=True)
    empty = lecture(spark, title=None, summary=None, keywords=[], core=[], introduced=[], relations=[], communities=[])
    row = recommend.rank(empty, q, "2026-01-01").first()
    assert row.content_score == row.graph_score == 0 and 0 < row.score < 0.01  # the domain alone
    assert scores.LEVELS[row.level] == "none" and row.subject == "none"
    assert recommend.rank(lecture(spark).limit(0), q, "2026-01-01").count() == 0
    assert recommend.rank(lecture(spark), recommend.Query(keywords=()), "2026-01-01").first().subject == "not_required"


def test_forms_are_made_once_for_all_terms_of_a_query(spark):
    """A lecture's forms come out of a generator, the query's out of a subquery; forms are as normalize_term and lookup_keys have them."""
    q = recommend.Query(keywords=("운영체제", "a", "b c"))
    x = recommend.prepared(lecture(spark), q, ("f_core", "f_introduced")).select(F.transform("f_all", lambda f: recommend.role_strength(f)))
    assert "Generate inline" in (plan := x._jdf.queryExecution().optimizedPlan().toString()) and "scalar-subquery" in plan
    assert x.first()[0] == [1.0, 0.0, 0.0]
    odd = ["\tA  b", "운영 체제의", "é x", "Q", "", None, " 강의 "]
    made = one(spark, terms.forms(F.array(*map(F.lit, odd))), *[terms.lookup_keys(terms.normalize_term(F.lit(t))) for t in ("\tA  b", "운영 체제의", "é x", "Q", " 강의 ")], *[terms.compact(F.lit(t)) for t in ("\tA  b", "운영 체제의", "é x", "Q", " 강의 ")])
    assert [f["keys"] for f in made[0]] == list(made[1:6]) and [f["tight"] for f in made[0]] == list(made[6:])
