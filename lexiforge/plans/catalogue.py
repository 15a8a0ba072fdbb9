"""The registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import classify, dedup, discover, documents, evaluate, ordered, retrieval, rollups, rules, validate
from lexiforge.profiles import LATIN
from lexiforge.sources.files import strip_html
from lexiforge.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERMS = ("the", "and", "der", "die", "les", "que", "para", "con", "token", "license")
_STOP = tuple("the and of to in is it that for on with as was at by an be this der die das und ist ein eine den mit von zu le la les de des du et est un une en que el los las del por para con se".split())
_INTENTS = [("question", r"\?", 0), ("request", r"(?i)\b(?:please|could you|can you|write|explain)\b", 1), ("thanks", r"(?i)\bthank", 1), ("statement", r"\.", 2)]
_RULES = [("symbols", r"[#$%&*]{3}", 1), ("shouting", "!!", 5), ("pipes", r" \| ", 3)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COSINE = "round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6)"
_RANKED = f"""select q.vec_id as query_id, e.vec_id, {_COSINE} as score, q.label as q_label, e.label as e_label
  from (select * from embeddings where vec_id % 20 = 0) q join embeddings e on q.vec_id <> e.vec_id"""


@query(f"""with s as ({_RANKED} where q.label = e.label), r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select * from r where rank <= 10""")
def knn_cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "embeddings")
    return retrieval.knn(points, points.where("vec_id % 20 = 0"), 10, group="label")


@query(f"""with s as ({_RANKED}), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, score, rank from r where rank <= 10 and q_label = e_label""")
def knn_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "embeddings")
    found = retrieval.knn(points, points.where("vec_id % 20 = 0"), 10)
    label = points.select("vec_id", "label")
    own = label.withColumnsRenamed({"vec_id": "query_id", "label": "_own"})
    return found.join(label, "vec_id").join(own, "query_id").where(F.col("label") == F.col("_own")).select("query_id", "vec_id", "score", "rank")


@query(f"""with s as ({_RANKED}), a as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from s),
b as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where q_label = e_label),
f as (select query_id, vec_id, round(sum(1.0::double / (59 + rank)), 9) as score from (select * from a where rank <= 50 union all select * from b where rank <= 50) group by all),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from f)
select * from r where rank <= 10""")
def dense_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "embeddings")
    queries = points.where("vec_id % 20 = 0")
    return retrieval.fuse([retrieval.knn(points, queries, 50), retrieval.knn(points, queries, 50, group="label")], "vec_id", 10)


_TOKENS = r"unnest(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"


@query(f"""with d as (select doc_id, token, 1 + ln(count(*)::double) as w from (select doc_id, {_TOKENS} as token from documents) group by all),
q as (select item_id, token, 1 + ln(count(*)::double) as w from (select item_id, {_TOKENS} as token from benchmark) group by all),
s as (select item_id as query_id, doc_id, round(sum(d.w * q.w), 6) as score from d join q using (token) group by all),
r as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select * from r where rank <= 10""")
def sparse_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sparse_topk(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), 10)


_HYBRID = f"""with p as (select doc_id as id, text, embedding::double[] as v from documents left join embeddings on vec_id = doc_id), q as (select * from p where id % 20 = 0),
dn as (select q.id as query_id, p.id, round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6) as score from q join p on q.id <> p.id where q.v is not null and p.v is not null),
tk as (select id, token, 1 + ln(count(*)::double) as w from (select id, {_TOKENS} as token from p) group by all),
sp as (select a.id as query_id, b.id, round(sum(a.w * b.w), 6) as score from tk a join tk b using (token) where a.id % 20 = 0 and a.id <> b.id group by all),
rk as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from dn qualify rank <= 100 union all select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from sp qualify rank <= 100),
fu as (select query_id, id, round(sum(1.0::double / (59 + rank)), 9) as score from rk group by all), ft as (select * from fu qualify row_number() over (partition by query_id order by score desc, id) <= 50),
n as (select *, count(*) over (partition by query_id) as n from ft), c as (select id, list_transform(range(0, 4), lambda i: v[i * len(v) // 4 + 1:(i + 1) * len(v) // 4]) as vs from p),
l as (select query_id, n.id, round(case when n > 10 then coalesce(list_sum(list_transform(a.vs, lambda x: list_max(list_transform(b.vs, lambda y: list_dot_product(x, y))))), 0) else score end, 6) as score from n join c a on a.id = query_id join c b on b.id = n.id)
select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from l) where rank <= 10"""


@query(_HYBRID)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and vectors of one collection: the dense and the sparse branch recall 100 each, fused to 50, reranked by late
    interaction of the four quarters of the vectors; what has no vector takes part by its text alone."""
    texts = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    points = texts.select("id").join(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), "id", "left")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", F.floor(i * F.size("embedding") / 4).cast("int") + 1, F.floor(F.size("embedding") / 4).cast("int")))
    return retrieval.hybrid(points, points.where("id % 20 = 0"), 10, "id", late=F.when(F.col("embedding").isNotNull(), parts), texts=texts)


@query("""with u as (select doc_id as id, 'documents' as source, length(text)::double as score from documents union all
select conv_id * 1000 + turn, 'conversations', length(text)::double from conversations)
select id, source, score from u order by score desc, source, id limit 100""")
def union_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lambda df, key: df.select(key.alias("id"), F.length("text").cast("double").alias("score"))
    return retrieval.fan_out({"documents": scored(_t(spark, sf_dir, "documents"), F.col("doc_id")), "conversations": scored(_t(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"))}, k=100)


@query(r"""with l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) as ls from documents)
select doc_id, regexp_matches(text, '(?i)https?://|www\.|\.com\b|click here|subscribe') as is_ad,
  len(ls) >= 3 and len(list_filter(ls, lambda x: regexp_matches(lower(x), '^\s*(?:chapter|part|section)\s+[0-9ivxlc]+'))) * 5 >= len(ls) * 2 as is_catalog,
  right(regexp_replace(text, '\s+$', ''), 1) in ('.', '!', '?', '"', '''', ')') as ends_sentence,
  round((length(text) - length(regexp_replace(text, '[A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))) / length(text), 6) as script_ratio
from l""")
def text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.is_ad(t, LATIN).alias("is_ad"), T.is_catalog(t, LATIN).alias("is_catalog"), T.ends_sentence(t, LATIN).alias("ends_sentence"), F.round(T.script_ratio(t, LATIN.script), 6).alias("script_ratio"))


@query(r"""select doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')),
  lambda x: length(x) >= 2 and not regexp_matches(x, '(?i)https?://|www\.|\.com\b|click here|subscribe') and not regexp_matches(lower(x), 'lorem ipsum|javascript|privacy policy|terms of use|cookie')), chr(10))) as cleaned_md5,
  substr(md5(text), 1, 12) as case_id from documents""")
def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_lines(F.col("text"), LATIN).cast("binary")).alias("cleaned_md5"), T.case_id(F.col("text")).alias("case_id"))


_PAIRS = r"""c as (select doc_id, string_split(regexp_replace(text, '\s+', '', 'g'), '') as cs from documents),
b as (select doc_id, len(cs) as n_cs, list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1]) as bs from c)"""
_ENTROPY = """e as (select doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) as h from (select doc_id, g, count(*)::double as k from (select doc_id, unnest(bs) as g from b) group by all) group by doc_id)"""


@query(f"""with {_PAIRS}, {_ENTROPY}
select doc_id, round(case when n_cs < 10 then 0.0 else list_unique(bs) / len(bs)::double end, 6) as density, round(case when n_cs < 20 then 0.0 else h end, 6) as entropy
from b left join e using (doc_id)""")
def bigram_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "documents").select("doc_id", T.pair_statistics(F.col("text")).alias("_p"))
    return pairs.select("doc_id", F.round("_p.density", 6).alias("density"), F.round("_p.entropy", 6).alias("entropy"))


@query(f"""with {_PAIRS}, {_ENTROPY},
s as (select d.doc_id, d.text, case when n_cs < 10 then 0.0 else list_unique(bs) / len(bs)::double end as density, case when n_cs < 20 then 0.0 else h end as entropy,
  contains(text, ' to ')::int + contains(text, ' from ')::int + contains(text, ' with ')::int as hits from documents d join b using (doc_id) left join e using (doc_id))
select doc_id, round(greatest(0.0, least(10.0, 4.5 + least(hits * 0.3, 1.5) + case when length(text) between 500 and 2000 then 0.5 else 0.0 end
 - 0.5 * (contains(text, '###')::int + contains(text, '$$$')::int + contains(text, '%%%')::int + contains(text, '&&&')::int + contains(text, '***')::int + contains(text, '!!')::int)
 + case when length(text) - length(replace(text, '"', '')) >= 4 then 0.3 else 0.0 end + case when density >= 0.6 then 0.3 when density < 0.3 then -0.5 else 0.0 end
 + case when right(regexp_replace(text, '\\s+$', ''), 1) in ('.', '!', '?', '"', '''', ')') then 0.0 else -0.5 end
 + case when length(text) > 100 then case when entropy < 6 then -1.5 when entropy > 8 then 0.3 else 0.0 end else 0.0 end)), 6)::double as score from s""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, words = F.col("text"), LATIN.scenes[0].keywords
    hits = T.keyword_hits(t, words)
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", T.pair_statistics(t).alias("_p"))
    return docs.select("doc_id", F.round(T.quality_score(t, hits, hits.cast("double"), LATIN, F.col("_p")), 6).alias("score"))


def _count_sql(words: tuple[str, ...]) -> str:
    return " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)


_VOTES = ", ".join(f"({_count_sql(words)}) as v{i}" for i, (_, words) in enumerate(LATIN.genres))
_BEST = " ".join(f"when v{i} = m then '{name}'" for i, (name, _) in enumerate(LATIN.genres))


@query(f"""with v as (select doc_id, {_VOTES} from documents), g as (select *, greatest({", ".join(f"v{i}" for i in range(len(LATIN.genres)))}) as m from v)
select doc_id, case when m < 3 then 'unknown' {_BEST} end as genre from g""")
def genre_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", classify.genre(F.col("text"), LATIN).alias("genre"))


def _hits_sql(words: tuple[str, ...], column: str = "text") -> str:
    return " + ".join(f"contains({column}, '{w}')::int" for w in words)


@query(f"""with v as (select doc_id, {", ".join(f"({_hits_sql(s.keywords)}) as v{i}" for i, s in enumerate(LATIN.scenes))} from documents),
g as (select *, greatest({", ".join(f"v{i}" for i in range(len(LATIN.scenes)))}) as m from v)
select doc_id, case {" ".join(f"when v{i} = m then '{s.name}'" for i, s in enumerate(LATIN.scenes))} end as scene, m as n from g where m > 0""")
def scene_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "documents").select("doc_id", classify.best_scene(F.col("text"), LATIN).alias("_s")).where("_s is not null")
    return found.select("doc_id", F.col("_s.name").alias("scene"), F.col("_s.n").alias("n"))


_CLEANED = r"""p0 as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) as ps from documents),
p1 as (select doc_id, list_filter(ps, lambda x: length(x) between 100 and 5000 and not regexp_matches(x, '(?i)https?://|www\.|\.com\b|click here|subscribe')
  and not regexp_matches(lower(x), 'lorem ipsum|javascript|privacy policy|terms of use|cookie')
  and (length(x) - length(regexp_replace(x, '[A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))) / length(x) >= 0.6) as ps from p0),
p as (select doc_id, len(ps) as n, unnest(range(len(ps))) as index, unnest(ps) as t from p1)"""


@query(f"""with {_CLEANED}
select doc_id, index::int as index, 'motion' as scene, ({_hits_sql(LATIN.scenes[0].keywords, 't')})::double as score from p where {_hits_sql(LATIN.scenes[0].keywords, 't')} >= 2
union all select doc_id, index::int, 'place', ({_hits_sql(LATIN.scenes[1].keywords, 't')} + contains(t, ' at ')::int)::double from p where ({_hits_sql(LATIN.scenes[1].keywords, 't')} + contains(t, ' at ')::int) >= 2 and not contains(t, '###')
union all select doc_id, index::int, 'opening', ({_hits_sql(LATIN.scenes[2].keywords, 't')})::double from p where index <= 5
union all select doc_id, index::int, 'closing', ({_hits_sql(LATIN.scenes[3].keywords, 't')})::double from p where index >= n - 5""")
def paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.scenes(classify.paragraphs(_t(spark, sf_dir, "documents"), LATIN, "\n"), LATIN)


@query(r"""with m as (select conv_id, turn, contains(text, '?') as a, regexp_matches(text, '(?i)\b(?:please|could you|can you|write|explain)\b') as b, regexp_matches(text, '(?i)\bthank') as c, contains(text, '.') as d from conversations)
select conv_id, turn, case when a then 'question' when b then 'request' when c then 'thanks' when d then 'statement' else 'none' end as intent,
 case when a then 1 when b and c then 2 when b or c or d then 1 end::bigint as n_rules, case when a then false when b and c then true when b or c or d then false end as ambiguous from m""")
def intent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.intents(_t(spark, sf_dir, "conversations"), _INTENTS, ["conv_id", "turn"])


@query("select doc_id, min(doc_id) over (partition by text) as first_id from documents")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_t(spark, sf_dir, "documents"))


@query(r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') as ss, text from documents),
l as (select *, list_transform(ss, lambda x: length(x)::double) as ls from s), m as (select *, case when len(ls) > 0 then list_sum(ls) / len(ls) else 0.0 end as m from l),
h as (select *, (contains(lower(text), 'light')::int + contains(lower(text), 'shadow')::int + contains(lower(text), 'rain')::int + contains(lower(text), 'wind')::int + contains(lower(text), 'fire')::int) / greatest(1.0, length(text) / 50) as d from m)
select doc_id, len(ls)::bigint as n_sentences, round(m, 6) as mean_length, round(case when len(ls) > 0 then sqrt(list_sum(list_transform(ls, lambda x: (x - m) * (x - m))) / len(ls)) else 0.0 end, 6) as spread,
 case when d < 0.5 then 'low' when d < 1.5 then 'medium' else 'high' end as imagery from h""")
def stylometrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "documents").select("doc_id", T.stylometrics(F.col("text"), LATIN).alias("_s"))
    return out.select("doc_id", "_s.n_sentences", F.round("_s.mean_length", 6).alias("mean_length"), F.round("_s.spread", 6).alias("spread"), "_s.imagery")


@query(f"""with h as (select doc_id, unnest([t for t in {sorted(_TERMS)!r} if contains(lower(text), t)]) as t from documents)
select x.t as a, y.t as b, count(*) as n from h x join h y on x.doc_id = y.doc_id and x.t < y.t group by all""")
def keyword_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.cooccurrence(_t(spark, sf_dir, "documents"), "doc_id", _TERMS)


@query(f"""with w as (select lang, word, count(*) as n from (select distinct lang, doc_id, {_TOKENS} as word from documents) group by all), t as (select word, sum(n)::bigint as n_all from w group by word),
s as (select lang, count(*) as n_texts from documents group by lang), r as (select lang, word, n, n_all, round((n / n_texts) / ((n_all + 1) / (select count(*) from documents)), 6) as score from w join t using (word) join s using (lang) where n >= 3),
k as (select lang, row_number() over (partition by lang order by score desc, n desc, word) as rank, word, n, n_all, score from r) select * from k where rank <= 20""")
def discover_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.keywords(_t(spark, sf_dir, "documents"), "lang", _WORD, 20)


_STATS = """select user_id, count(*) as n, round(count(*) filter (event_type = 'purchase') / count(*), 6) as success_rate, round(sum(coalesce(value, 0.0)) / count(*), 6) as effectiveness, max(ts) as last_used,
 round(0.6 * (count(*) filter (event_type = 'purchase') / count(*)) + 0.4 * (sum(coalesce(value, 0.0)) / count(*)), 2) as score from events group by user_id"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.usage_stats(_t(spark, sf_dir, "events"), "user_id", F.col("value"), F.col("event_type") == "purchase")


@query(_STATS)
def usage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(f"select user_id, score, round(score + case when user_id % 7 = 0 then 0.2 else 0.0 end, 6) as boosted from ({_STATS}) where score >= 0.3 order by boosted desc, user_id limit 25")
def recommend_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.recommend(_stats(spark, sf_dir), "user_id", F.col("user_id") % 7 == 0, 25)


@query(f"""with w as (select lang, word, count(*) as n from (select lang, {_TOKENS} as word from documents) group by all), r as (select *, row_number() over (partition by lang order by n desc, word) as rank from w),
l as (select lang, string_agg(word || ':' || n, ',' order by rank) as words from r where rank <= 30 group by lang)
select lang, count(*) as n, round(sum(length(text)) / count(text), 6) as mean_length, any_value(words) as words from documents left join l using (lang) group by lang""")
def style_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.style_rollup(_t(spark, sf_dir, "documents"), "lang", _WORD, 30)


@query("""select lang, source, case when text is null then -1 else (length(text) >= 100)::bigint + (length(text) >= 300)::bigint + (length(text) >= 1000)::bigint end as length_class, count(*) as n from documents group by all""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.length_histogram(_t(spark, sf_dir, "documents"), ["lang", "source"])


@query("select c_custkey, count(*) as n from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null) group by c_custkey")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing_references(_t(spark, sf_dir, "customer"), "c_custkey", _t(spark, sf_dir, "orders"), "o_custkey")


@query("""select l_shipdate::date as day, case when o_orderstatus is null then 'new' when l_linestatus = o_orderstatus then 'duplicate' else 'conflict' end as verdict, count(*) as n
from lineitem left join orders on l_orderkey = o_orderkey group by all""")
def settings_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linestatus", F.to_date("l_shipdate").alias("day"))
    found = validate.audit(items, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), ["k"], "l_linestatus", "o_orderstatus")
    return found.groupBy("day", "verdict").agg(F.count("*").alias("n"))


@query("""with c as (select o_custkey, o_orderstatus, count(*) as c from orders group by all)
select o_custkey, count(*) as n_values, ((sum(c) * sum(c) - sum(c * c)) / 2)::bigint as n_pairs, min(o_orderstatus) as low, max(o_orderstatus) as high from c group by o_custkey having count(*) > 1""")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.conflicts(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query(r"""with m as (select doc_id, len(regexp_extract_all(text, '[#$%&*]{3}'))::bigint as a, len(regexp_extract_all(text, '!!'))::bigint as b, len(regexp_extract_all(text, ' \| '))::bigint as c from documents)
select doc_id, 'symbols' as rule, a as n from m where a >= 1 union all select doc_id, 'shouting', b from m where b >= 5 union all select doc_id, 'pipes', c from m where c >= 3""")
def prohibitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.prohibitions(_t(spark, sf_dir, "documents"), "doc_id", _RULES)


_JUDGED = """j as (select source as query_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank, 2 * quality as relevance from documents left join labels using (doc_id))"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query_id"), F.col("n_chars").cast("double").alias("score"))
    ranked = retrieval.top(docs, ["query_id"], "score", ["doc_id"], 10)
    labels = _t(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality")).alias("relevance"))
    expected = docs.join(labels, "doc_id").where("relevance >= 2").groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return ranked.join(labels, "doc_id", "left"), expected


def _ndcg_sql(discount: str) -> str:
    gain = {"log2": "coalesce(relevance, 0) / log2({r} + 1)", "linear": "coalesce(relevance, 0) / ({r} + 1)"}[discount]
    return f"""with {_JUDGED}, t as (select *, row_number() over (partition by query_id order by relevance desc nulls last) as i from j where rank <= 10),
x as (select source as query_id, count(*) as n_relevant from documents join labels using (doc_id) where quality = 1 group by source),
s as (select query_id, sum({gain.format(r="rank")}) as dcg, sum({gain.format(r="i")}) as best, count(relevance) as judged, count(*) filter (relevance >= 2) as hits from t group by query_id)
select query_id, case when judged = 0 then null when best = 0 then 0.0 else round(dcg / best, 4) end as ndcg, case when judged > 0 then round(hits / 10, 4) end as precision,
 case when coalesce(n_relevant, 0) = 0 then 1.0 else round(hits / n_relevant, 4) end as recall from s left join x using (query_id)"""


@query(_ndcg_sql("log2"))
def ndcg_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, expected = _judged(spark, sf_dir)
    return evaluate.scores(ranked, 10, "log2", expected=expected)


_EXPECTED = """r as (select lang || '/' || source as query_id, doc_id, row_number() over (partition by lang, source order by n_chars desc, doc_id) as rank from documents qualify rank <= 10),
x as (select lang || '/' || source as query_id, doc_id, 2 * quality as relevance from documents join labels using (doc_id)),
i as (select *, row_number() over (partition by query_id order by relevance desc, doc_id) as i from x),
dc as (select query_id, sum(coalesce(relevance, 0) / (rank + 1)) as dcg, count(*) filter (relevance >= 1) as hits, count(*) as n_retrieved from r left join x using (query_id, doc_id) group by query_id),
id as (select query_id, sum(relevance / (i + 1)) filter (i <= 10) as best, count(*) filter (relevance >= 1) as wanted, count(*) as n_expected from i group by query_id),
s as (select query_id, round(case when coalesce(best, 0) = 0 then 0.0 else coalesce(dcg, 0) / best end, 4) as ndcg, round(case when coalesce(wanted, 0) = 0 then 1.0 else coalesce(hits, 0) / wanted end, 4) as recall,
 coalesce(n_retrieved, 0) as n_retrieved, coalesce(n_expected, 0) as n_expected from dc full join id using (query_id))"""


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The longest ten documents of each language and source, and those that labels call good as the expected ones."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("query_id"), F.col("n_chars").cast("double").alias("score"))
    labels = _t(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality")).alias("relevance"))
    return retrieval.top(docs, ["query_id"], "score", ["doc_id"], 10), docs.join(labels, "doc_id").select("query_id", "doc_id", "relevance")


@query(f"with {_EXPECTED} select * from s")
def ndcg_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, expected = _expected(spark, sf_dir)
    return evaluate.against_expected(ranked, expected, 10, "doc_id")


@query("""with w as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as win from events)
select user_id, win as "window", count(*) as n, round(sum(value), 6) as total, min(ts) as first, max(ts) as last from w group by user_id, win having count(*) = 10""")
def audit_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.count_windows(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("""with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 24 hours, true)::bigint as new from events),
s as (select *, sum(new) over (partition by user_id order by ts)::bigint as session from g) select user_id, session, count(*) as n, min(ts) as begin, max(ts) as "end" from s group by user_id, session""")
def session_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sessions(_t(spark, sf_dir, "events"), "user_id", "ts")


@query("""select time_bucket(interval 1 hour, ts) as begin, event_type, count(*) as n, round(sum(value), 6) as total from events group by all""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.tumbling(_t(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour").withColumn("total", F.round("total", 6))


@query("""select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts", "value")


@query("""select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as rank from events qualify rank <= 50""")
def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.keep_last(_t(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 50).select("event_type", "event_id", "rank")


@query("select event_id from events where ts >= (select max(ts) from events) - interval 7 days or event_type = 'purchase'")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.retained(_t(spark, sf_dir, "events"), "ts", 7, F.col("event_type") == "purchase").select("event_id")


@query("""select user_id, arg_max(value, (ts, event_id)) filter (value is not null) as value, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n_updates from events group by user_id""")
def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.merged_state(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["value", "event_type"])


@query("""select user_id, event_id, before, value from (select *, lag(value) over (partition by user_id order by ts, event_id) as before from events) where value < before""")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.regressions(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "before", "value")


_STATUS_SQL = "case when min(l_linestatus) = max(l_linestatus) then min(l_linestatus) else 'P' end"


def _status() -> Column:
    return F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("P")


@query(f"""with a as (select o_orderkey, md5(o_orderstatus) as h from orders), b as (select l_orderkey as o_orderkey, md5({_STATUS_SQL}) as h from lineitem group by 1)
select o_orderkey, case when a.h is null then 'created' when b.h is null then 'deleted' else 'modified' end as change from a full join b using (o_orderkey) where a.h is null or b.h is null or a.h <> b.h""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as they are kept against the orders as their lines make them."""
    kept = _t(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderstatus").cast("binary")).alias("h"))
    made = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.md5(_status().cast("binary")).alias("h"))
    return validate.changes(kept, made, "o_orderkey", "h")


@query(r"select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as text_md5 from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@query("""with e as (select user_id, event_id, ts, json_extract_string(props, '$.k') as k from events), b as (select *, lag(k) over (partition by user_id order by ts, event_id) as before from e)
select event_id, before, k as after from b where before is not null and k is distinct from before""")
def json_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").alias("after"))
    rows = ordered.with_row_before(rows, "user_id", ["ts", "event_id"], ["after"]).withColumn("before", F.col("_before.after"))
    return rows.where("before is not null and not (before <=> after)").select("event_id", "before", "after")


_POLARITY = {"negative": ("idiot", "moron", "disgusting", "pathetic", "scum", "worthless"), "positive": ("thank", "great", "good")}


@query(f"""select doc_id, case when {_hits_sql(_POLARITY["negative"])} > 0 then 'negative' when {_hits_sql(_POLARITY["positive"])} > 0 then 'positive' end as polarity,
 case when contains(text, '!!') then 3 when contains(text, '...') then 1 else 2 end::int as intensity from documents""")
def feedback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.signals(F.col("text"), _POLARITY, ("!!",), ("...",))
    return _t(spark, sf_dir, "documents").select("doc_id", s.alias("_s")).select("doc_id", "_s.polarity", "_s.intensity")


@query(f"""with v as (select conv_id, turn, {_hits_sql((" the ", " and "))} as a, {_hits_sql((" der ", " die "))} as b, {_hits_sql((" le ", " les "))} as c from conversations)
select conv_id, turn, case when greatest(a, b, c) = 0 then 'none' when a >= b and a >= c then 'english' when b >= c then 'german' else 'french' end as dimension from v""")
def lexicon_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicons = {"english": (" the ", " and "), "german": (" der ", " die "), "french": (" le ", " les ")}
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", rules.vote(F.col("text"), lexicons, default="none").alias("dimension"))


@query("""with s as (select user_id, least(greatest(value, 0.0), case event_type when 'purchase' then 50.0 when 'click' then 20.0 end) as s, case event_type when 'purchase' then 50.0 when 'click' then 20.0 end as m,
 case event_type when 'purchase' then 0.7 when 'click' then 0.3 end as w from events where event_type in ('purchase', 'click'))
select user_id, round(sum(s), 6) as total, round(sum(s / m * 100 * w), 6) as weighted from s group by user_id""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.weighted_score(_t(spark, sf_dir, "events"), "user_id", "event_type", "value", {"purchase": (50, 0.7), "click": (20, 0.3)})


@query("""select event_id, key as path, value from (select event_id, unnest(json_keys(props)) as key, props from events), lateral (select json_extract_string(props, '$.' || key) as value)""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flat_json(_t(spark, sf_dir, "events"), ["event_id"], "props")


_NESTED_SQL = """'{"event":{"id":' || event_id || ',"props":' || props || ',"none":{},"list":[1,{"x":2}]},"raw":"' || replace(props, '"', '\\"') || '","a.b":{"c\\\\d":' || user_id || ',"nil":null},"a":{"b":"' || event_type || '"}}'"""


@query(rf"""with recursive t as (select event_id, '' as path, ({_NESTED_SQL})::json as v, 0 as level from events union all
 select t.event_id, case when level = 0 then '' else t.path || '.' end || replace(replace(e.key, '\', '\\'), '.', '\.'), e.value, level + 1 from t, json_each(t.v) e where json_type(t.v) = 'OBJECT')
select event_id, path, v->>'$' as value from t where json_type(v) <> 'OBJECT' or v = '{{}}'""")
def json_nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", F.expr(_NESTED_SQL.replace("\\", "\\\\")).alias("body"))
    return documents.flat_json(events, ["event_id"], "body")


@query(f"""with n as (select l_orderkey, {_STATUS_SQL} as status, count(*) as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1), b as (select * from orders full join n on l_orderkey = o_orderkey),
j as (select coalesce(o_orderkey, l_orderkey) as o_orderkey, '{{"by":{{"key":' || o_custkey || '}},"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}}' as old,
 '{{"by":{{"key":' || coalesce(o_custkey, 0) || ',"lines":' || n || '}},"returns":{{"n":' || r || '}},"status":"' || status || '"}}' as new, * exclude (o_orderkey) from b)
select o_orderkey, '' as path, 'added' as change, null as before, new as after from j where old is null union all select o_orderkey, '', 'deleted', old, null from j where new is null
union all select o_orderkey, 'by.lines', 'added', null, n::varchar from j where old is not null and new is not null union all select o_orderkey, 'returns', 'added', null, '{{"n":' || r || '}}' from j where old is not null and new is not null
union all select o_orderkey, 'priority', 'deleted', '"' || o_orderpriority || '"', null from j where old is not null and new is not null
union all select o_orderkey, 'status', 'modified', '"' || o_orderstatus || '"', '"' || status || '"' from j where o_orderstatus <> status""")
def json_order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents against documents made of their lines."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    made = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_status().alias("status"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    made = made.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey", "left")
    old = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("key")).alias("by"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    new = F.to_json(F.struct(F.struct(F.coalesce("o_custkey", F.lit(0)).alias("key"), F.col("n").alias("lines")).alias("by"), F.struct(F.col("r").alias("n")).alias("returns"), "status"))
    return documents.json_changes(orders.select("o_orderkey", old.alias("body")), made.select("o_orderkey", new.alias("body")), ["o_orderkey"], "body")


@query("""with b as (select distinct regexp_extract(p_type, '^[^ ]+') as name from part union select distinct regexp_extract(p_type, '^[^ ]+ [^ ]+') from part)
select p_partkey, arg_max(name, length(name)) as name from part join b on starts_with(p_type, name) where name <> '' group by p_partkey""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    names = part.select(F.regexp_extract("p_type", "^[^ ]+", 0).alias("name")).union(part.select(F.regexp_extract("p_type", "^[^ ]+ [^ ]+", 0))).where("name <> ''").distinct()
    return validate.longest_prefix(part, "p_type", names, "name").where("name is not null").select("p_partkey", "name")


@query()
def minhash_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.greedy_near(docs, "doc_id")


@query()
def keyword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.keyword_clusters(_t(spark, sf_dir, "documents"), _WORD, _STOP, LATIN.scenes, least=5)
