"""More registered queries: reports over given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import documents, evaluate, retrieval, rollups, validate
from lexiforge.plans.catalogue import _EXPECTED, _RANKED, _count_sql, _expected, _judged, _t, query
from lexiforge.profiles import LATIN

_STRINGS = ("token", "license", "http", "@", "!!")
_PERSONS = (("first", (" i ", " we ", " ich ", " je ", " yo ")), ("second", (" you ", " du ", " vous ", " tu ")), ("third", (" he ", " she ", " they ", " er ", " sie ", " il ", " elle ", " ellos ")))
_VERBS = (" is ", " was ", " are ", " be ", " have ", " ist ", " war ", " est ", " es ", " ha ")
_ADJECTIVES = ("able ", "ible ", "ish ", "ous ", "lich ", "ig ", "eux ")


@query("""with r as (select o_orderstatus, o_orderpriority, o_orderkey, o_totalprice, row_number() over (partition by o_orderstatus, o_orderpriority order by o_totalprice desc, o_orderkey) as rank
 from orders where o_totalprice >= 100000) select * from r where rank <= 3""")
def quality_anchor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice")
    return retrieval.anchors(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "o_orderkey", 3, 100000)


@query(f"""with q as (select unnest({list(_STRINGS)!r}) as query), s as (select query, doc_id, round((length(text) - length(replace(text, query, ''))) / length(query) / length(text), 9) as score from documents, q where length(text) > 0),
r as (select *, row_number() over (partition by query order by score desc, doc_id) as rank from s where score > 0) select * from r where rank <= 5""")
def lexical_fallback_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_topk(_t(spark, sf_dir, "documents"), "doc_id", _STRINGS, 5)


@query("""with s as (select l_suppkey, l_shipmonth as scene, sum(l_quantity / 5) as total, count(*) as c, count(*) filter (l_quantity / 5 >= 7) as good from (select *, month(l_shipdate) as l_shipmonth from lineitem) group by all),
m as (select *, round(total / c, 6) as mean from s), b as (select *, row_number() over (partition by l_suppkey order by mean desc, scene::varchar) as r from m where mean >= 7), w as (select *, row_number() over (partition by l_suppkey order by mean, scene::varchar) as r from m where mean < 6),
bs as (select l_suppkey, string_agg(scene::varchar, ',' order by r) as best from b where r <= 3 group by 1), ws as (select l_suppkey, string_agg(scene::varchar, ',' order by r) as worst from w where r <= 3 group by 1)
select l_suppkey, sum(c)::bigint as n, round(sum(total) / sum(c), 6) as mean, sum(good)::bigint as n_good, (sum(c) - sum(good))::bigint as n_below, coalesce(any_value(best), '') as best, coalesce(any_value(worst), '') as worst
from m left join bs using (l_suppkey) left join ws using (l_suppkey) group by l_suppkey""")
def technique_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.month("l_shipdate").alias("scene"), (F.col("l_quantity") / 5).alias("score"))
    return rollups.effectiveness(rows, "l_suppkey", "scene", "score")


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select lesson, count(*) as n from (select event_type || ':' || json_extract_string(props, '$.k') as lesson from r where k <= 50) where lesson is not null group by lesson order by n desc, lesson limit 10""")
def lessons_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("lesson"))
    return rollups.lessons(events, "user_id", ["ts", "event_id"], "lesson")


@query("select user_id, event_type, count(*) as n from events where event_type is not null group by all having count(*) >= 12")
def recurring_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.recurring(_t(spark, sf_dir, "events"), ["user_id"], "event_type", 12)


@query("""with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) as r from documents), s as (select lang, string_agg(doc_id::varchar, ',' order by doc_id) as samples from r where r <= 20 group by lang)
select lang, n, n_distinct, samples from (select lang, count(*) as n, count(distinct source) as n_distinct from documents group by lang) left join s using (lang)""")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.sources(_t(spark, sf_dir, "documents"), "lang", "source", "doc_id")


@query("select prefix, count(*) filter (starts_with(url, prefix)) as n from pages, (select unnest(['http://', 'https://', 'https://www.', 'http://www.', 'ftp://']) as prefix) group by prefix")
def relation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.prefix_counts(_t(spark, sf_dir, "pages"), "url", ("http://", "https://", "https://www.", "http://www.", "ftp://"))


@query("""with m as (select l_suppkey, round(avg(l_quantity), 6) as quantity, round(avg(l_discount * 100), 6) as discount, round(avg(l_tax * 100), 6) as tax from lineitem group by l_suppkey),
c as (select *, (quantity >= 25)::bigint + (discount >= 5)::bigint + (tax >= 4)::bigint as n_met from m) select *, n_met = 3 as passed from c""")
def dimension_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount") * 100, "tax": F.col("l_tax") * 100}
    return validate.meets_limits(_t(spark, sf_dir, "lineitem"), "l_suppkey", measures, {"quantity": 25, "discount": 5, "tax": 4})


@query("""with known as (select c_custkey from customer where c_acctbal < 0) select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r
 from orders where o_custkey not in (select c_custkey from known)) where r = 1""")
def first_unknown_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return validate.first_unknown(_t(spark, sf_dir, "orders"), known, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"""with {_EXPECTED} select split_part(query_id, '/', 1) as collection, count(*) as n_queries, round(avg(ndcg), 6) as mean_ndcg, round(avg(recall), 6) as mean_recall,
 round(count(*) filter (recall >= 0.2) / count(*), 6) as pass_rate from s group by rollup(1)""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, expected = _expected(spark, sf_dir)
    scored = evaluate.against_expected(ranked, expected, 10, "doc_id").withColumn("collection", F.substring_index("query_id", "/", 1))
    return evaluate.summary(scored, 0.2, "collection")


@query("""with j as (select source as query_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank, 2 * quality as relevance from documents left join labels using (doc_id))
select query_id, relevance::bigint as relevance, count(*) as n from j where rank <= 10 group by all""")
def judge_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grades(_judged(spark, sf_dir)[0], 10)


def _density_sql(words: tuple[str, ...]) -> str:
    return f"case when length(text) > 0 then round(({_count_sql(words)}) / length(text), 3) else 0.0 end"


@query(f"""with d as (select doc_id, lower(text) as text from documents), n as (select doc_id, {_density_sql(_VERBS)} as verbs, {_density_sql(_ADJECTIVES)} as adjectives,
 {', '.join(f"{_count_sql(words)} as p{i}" for i, (_, words) in enumerate(_PERSONS))} from d)
select doc_id, verbs, adjectives, case when greatest(p0, p1, p2) <= 0 then 'none' when p0 >= p1 and p0 >= p2 then 'first' when p1 >= p2 then 'second' else 'third' end as perspective from n""")
def voice_and_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.lexeme_density(t, _VERBS).alias("verbs"), T.lexeme_density(t, _ADJECTIVES).alias("adjectives"), T.perspective(t, _PERSONS).alias("perspective"))


@query(r"""select clause, count(*) as n from (select unnest(list_transform(string_split_regex(text, '[.,;:!?\n]'), lambda x: trim(x, ' '))) as clause from documents) where length(clause) between 4 and 8 and contains(clause, 'e')
group by clause having count(*) >= 5 order by n desc, clause limit 10""")
def frequent_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "documents").select(F.explode(T.clauses(F.col("text"), 4, 8)).alias("clause")).where(F.contains("clause", F.lit("e")))
    return found.groupBy("clause").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.col("n").desc(), "clause").limit(10)


@query("""with e as (select user_id, json_extract_string(props, '$.k') as k, event_type, row_number() over (partition by user_id order by ts, event_id) as i, row_number() over (partition by user_id order by ts desc, event_id desc) as j from events),
o as (select user_id, unnest([{'path': 'event.type', 'value': event_type}, {'path': 'k', 'value': k}]) as x from e where i = 1), n as (select user_id, unnest([{'path': 'event.type', 'value': event_type}, {'path': 'k', 'value': k}]) as x from e where j = 1)
select user_id, o.x.path as path, 'modified' as change, '"' || o.x.value || '"' as before, '"' || n.x.value || '"' as after from o join n using (user_id) where o.x.path = n.x.path and o.x.value <> n.x.value""")
def json_first_last_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.struct(F.col("event_type").alias("type")).alias("event")))
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", body.alias("body"))
    ends = events.groupBy("user_id").agg(F.min_by("body", F.struct("ts", "event_id")).alias("old"), F.max_by("body", F.struct("ts", "event_id")).alias("new"))
    side = lambda c: ends.select("user_id", F.col(c).alias("body"))
    return documents.json_changes(side("old"), side("new"), ["user_id"], "body")


@query(rf"""with t as (select doc_id, regexp_replace(text, '\s+', '', 'g') as text from documents) select doc_id, case when length(text) > 0 then round(len(regexp_extract_all(text, '[{LATIN.script}]')) / length(text), 6) else 0.0 end as share from t""")
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(T.script_ratio(F.regexp_replace("text", r"\s+", ""), LATIN.script), 6).alias("share"))


@query(f"""with s as ({_RANKED} where q.label = e.label), c as (select query_id, vec_id from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10),
p as (select vec_id // 2 as pair, list(embedding::double[] order by vec_id) as vs from embeddings group by 1), n as (select *, count(*) over (partition by query_id) as n from c),
l as (select query_id, vec_id, n, round(list_sum(list_transform(q.vs, lambda x: list_max(list_transform(d.vs, lambda y: list_dot_product(x, y))))), 6) as score from n join p q on q.pair = query_id // 2 join p d on d.pair = vec_id // 2)
select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from l where n > 5) where rank <= 5""")
def maxsim_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query's label, reranked by late interaction; two neighbouring ids make a vector set."""
    points = _t(spark, sf_dir, "embeddings")
    found = retrieval.knn(points, points.where("vec_id % 20 = 0"), 10, group="label")
    vectors = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))), lambda x: x["v"])
    sets = points.groupBy(F.floor(F.col("vec_id") / 2).alias("_pair")).agg(vectors.alias("_v"))
    of = lambda df, key, name: df.withColumn("_pair", F.floor(F.col(key) / 2)).join(sets.withColumnRenamed("_v", name), "_pair").drop("_pair")
    late = retrieval.rerank(of(of(found, "vec_id", "_d"), "query_id", "_q"), "_q", "_d", "vec_id", 5).where("score_kind = 'late'")
    return late.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
