"""Registered queries of ranked selections and checks of groups, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import selection
from lexiforge.plans.catalogue import _t, query

_CUES = {"please": 0.9, "the": 0.8, "how": 0.9, "thank": 0.8}


@query("""with r as (select o_custkey, o_orderstatus, o_orderkey, o_totalprice, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey) as r from orders where o_orderstatus in ('P', 'F')),
n as (select *, count(*) filter (o_orderstatus = 'P') over (partition by o_custkey) as n from r where r <= 6), f as (select * from n where (o_orderstatus = 'P' or r <= 3 - n) and o_totalprice >= 50000),
k as (select o_custkey, o_orderstatus, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from f) select * from k where rank <= 3""")
def primary_then_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return selection.primary_then_secondary(orders, "o_custkey", "o_orderstatus", "P", "F", "o_totalprice", "o_orderkey", 3, 50000)


@query("""with r as (select source, doc_id, quality = 1 as positive, row_number() over (partition by source, quality = 1 order by n_chars desc, doc_id) as rank from documents join labels using (doc_id) where quality is not null)
select * from r where rank <= case when positive then 5 else 2 end""")
def polar_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return selection.polar_examples(judged, "source", F.col("quality") == 1, "n_chars", "doc_id", 5).select("source", "doc_id", "positive", "rank")


@query("""with e as (select user_id, event_id, ts, coalesce(event_type = 'purchase' and value >= 95, false) as wanted from events), r as (select user_id, event_id, wanted, row_number() over (partition by user_id, wanted order by ts desc, event_id desc) as rank from e),
a as (select *, bool_or(wanted) over (partition by user_id) as found from r where rank <= 3) select user_id, event_id, wanted, rank from a where wanted or not found""")
def recent_or_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    wanted = (F.col("event_type") == "purchase") & (F.col("value") >= 95)
    return selection.recent_or_any(events, "user_id", ["ts", "event_id"], wanted, 3).select("user_id", "event_id", "wanted", "rank")


@query("""with c as (select o_custkey, o_orderpriority as v, min(o_orderkey) as f, count(*) as n from orders where o_orderpriority is not null group by all)
select a.o_custkey, a.v as value_a, a.f as first_a, a.n as n_a, b.v as value_b, b.f as first_b, b.n as n_b from c a join c b on a.o_custkey = b.o_custkey and a.v < b.v""")
def group_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.disagreements(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\n]'), lambda s: length(trim(s, ' '))), lambda n: n > 0) as ns from documents),
m as (select *, list_sum(ns)::double / len(ns) as mean from l), k as (select *, list_transform(ns, lambda n: case when n > mean * 1.3::double then 'L' when n < mean * 0.7::double then 'S' else 'M' end) as ms from m),
c as (select *, len(ms) as n, len(list_filter(ms, lambda x: x = 'M')) as n_m, len(list_filter(ms, lambda x: x = 'S')) as n_s from k)
select doc_id, case when n < 2 or list_max(ns) - list_min(ns) < 3 then 'even' when list_sort(ns) = ns then 'rising' when list_reverse_sort(ns) = ns then 'falling'
 when n >= 3 and ms[1] = 'S' and ms[n] = 'S' and list_contains(ms[2:n - 1], 'L') then 'tight-loose-tight' when n >= 3 and ms[1] = 'L' and ms[n] = 'L' and list_contains(ms[2:n - 1], 'S') then 'loose-tight-loose'
 when n - n_m > n * 0.6::double then 'abrupt' when n_s >= n * 0.5::double then 'broken' else 'breathing' end as rhythm from c""")
def sentence_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", selection.rhythm(F.col("text")).alias("rhythm"))


@query("""select l_suppkey, l_linenumber, count(*) as n, count(*) filter (l_returnflag = 'R') as n_special, count(*) filter (l_returnflag is distinct from 'R') as n_normal,
 case when count(*) < 50 then 'cold_start' when count(*) < 300 then 'growing' else 'mature' end as phase from lineitem group by all""")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.phases(_t(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], F.col("l_returnflag") == "R")


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events), c as (select user_id, count(*) as n, count(*) filter (value < 10) as vague, count(*) filter (event_type = 'click') as clicks from r where r <= 20 group by user_id)
select *, concat_ws(',', case when 2 * vague > n then 'vague' end, case when 2 * clicks > n then 'clicks' end) as raised from c""")
def recent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return selection.recent_audit(events, "user_id", ["ts", "event_id"], 20, {"vague": F.col("value") < 10, "clicks": F.col("event_type") == "click"})


@query(f"""with t as (select conv_id, turn, lower(coalesce(text, '')) as text from conversations), c as (select unnest({list(_CUES)!r}) as cue, unnest({list(_CUES.values())!r})::double as base),
f as (select conv_id, turn, cue, round(least(1.0, base + 0.05::double * (1 - (strpos(text, cue) - 1)::double / length(text))), 6) as confidence from t, c where strpos(text, cue) > 0),
r as (select *, row_number() over (partition by conv_id, turn order by confidence desc, cue desc) as r, lead(confidence) over (partition by conv_id, turn order by confidence desc, cue desc) as second from f)
select conv_id, turn, cue as intent, confidence, coalesce(confidence < 0.9, true) or coalesce(round(confidence - second, 6) < 0.02, false) as unsure from t left join (select * from r where r = 1) using (conv_id, turn)""")
def intent_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", selection.confidences(F.col("text"), _CUES, 0.9, 0.02).alias("_c")).select("conv_id", "turn", "_c.*")


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc) as j from lineitem)
select l_orderkey, round(((year(a.l_shipdate) = year(b.l_shipdate))::int + (a.l_returnflag = b.l_returnflag)::int + (a.l_linestatus = b.l_linestatus)::int) / 3, 6) as agreement from r a join r b using (l_orderkey) where a.i = 1 and b.j = 1""")
def record_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last line of each order: the share of their fields that are equal."""
    record = F.create_map(F.lit("year"), F.year("l_shipdate").cast("string"), F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    ends = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by(record, place).alias("a"), F.max_by(record, place).alias("b"))
    return ends.select("l_orderkey", selection.agreement(F.col("a"), F.col("b")).alias("agreement"))


@query("""with c as (select user_id, event_type, count(*) as c from events where event_type is not null group by all), s as (select *, sum(c) over (partition by user_id) as n, row_number() over (partition by user_id order by c desc, event_type) as r from c)
select user_id, n::bigint as n, event_type as candidate, round(c / n, 6) as confidence from s where r = 1 and n >= 30""")
def gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gated_candidates(_t(spark, sf_dir, "events"), "user_id", "event_type", 30)


@query("select p_partkey, coalesce(p_name, '') || ' (' || coalesce(p_type, '') || ', ' || coalesce(p_brand, '') || ')' as description from part")
def described_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", selection.described("{p_name} ({p_type}, {p_brand})").alias("description"))


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), p as (select doc_id, len(ls) as n, coalesce(list_position(list_transform(ls, lambda x: contains(x, 'license')), true), 0) as place from l),
w as (select doc_id, n, (case when place > 0 then place - 1 else n // 2 end)::bigint as paragraph from p) select doc_id, paragraph, case when paragraph * 3 < n then 'beginning' when paragraph * 3 < 2 * n then 'middle' else 'end' end as third from w""")
def located_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", selection.located(F.col("text"), "license").alias("_l")).select("doc_id", "_l.*")
