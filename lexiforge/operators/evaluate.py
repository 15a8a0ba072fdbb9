"""Retrieval evaluation from ranked judgements (query_id, rank from 1, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(relevance: Column, rank: Column, discount: str = "log2") -> Column:
    """Discounted gain: relevance / log2(rank + 1), or relevance / (rank + 1) for the linear discount."""
    return relevance / (F.log2(rank + 1) if discount == "log2" else (rank + 1))


def scores(ranked: DataFrame, k: int, discount: str = "log2", relevant: int = 1, expected: DataFrame | None = None) -> DataFrame:
    """Per query NDCG@k, precision@k and, given ``expected`` (query_id, n_relevant), recall@k, which is 1 where nothing
    is expected.  The ideal order is that of the retrieved relevances; fewer than k hits count as 0; queries without
    any judgement have null scores."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc_nulls_last()))
    r = F.coalesce(F.col("relevance"), F.lit(0))
    cut = ranked.where(F.col("rank") <= k).withColumn("_i", ideal)
    out = cut.groupBy("query_id").agg(
        F.sum(gain(r, F.col("rank"), discount)).alias("_dcg"), F.sum(gain(r, F.col("_i"), discount)).alias("_best"), F.count("relevance").alias("_judged"),
        F.count_if(F.col("relevance") >= relevant).alias("_hits"),
    )
    ndcg = F.when(F.col("_judged") == 0, None).when(F.col("_best") == 0, 0.0).otherwise(F.round(F.col("_dcg") / F.col("_best"), 4))
    out = out.select("query_id", ndcg.alias("ndcg"), F.when(F.col("_judged") > 0, F.round(F.col("_hits") / k, 4)).alias("precision"), "_hits")
    if expected is None:
        return out.drop("_hits")
    recall = F.when(F.coalesce("n_relevant", F.lit(0)) == 0, 1.0).otherwise(F.round(F.col("_hits") / F.col("n_relevant"), 4))
    return out.join(expected, "query_id", "left").select("query_id", "ndcg", "precision", recall.alias("recall"))


def against_expected(ranked: DataFrame, expected: DataFrame, k: int, key: str, minimum: int = 1) -> DataFrame:
    """(query_id, ndcg, recall, n_retrieved, n_expected) of retrieved rows (query_id, key, rank from 1) against expected ones
    (query_id, key, relevance), with the linear discount.  The ideal order is that of the expected relevances; what is
    retrieved and not expected has none.  Expected rows of less than ``minimum`` do not count for recall; where nothing is
    expected recall is 1 and NDCG 0.  Queries of either table are in the result."""
    wanted = expected.select("query_id", key, F.coalesce("relevance", F.lit(0)).alias("relevance"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), key))
    first = wanted.withColumn("_i", order)
    ideal = first.groupBy("query_id").agg(
        F.sum(F.when(F.col("_i") <= k, gain(F.col("relevance"), F.col("_i"), "linear"))).alias("_best"), F.count_if(F.col("relevance") >= minimum).alias("_wanted"), F.count("*").alias("_expected"),
    )
    met = ranked.where(F.col("rank") <= k).join(wanted, ["query_id", key], "left")
    found = met.groupBy("query_id").agg(
        F.sum(F.coalesce(gain(F.col("relevance"), F.col("rank"), "linear"), F.lit(0.0))).alias("_dcg"), F.count_if(F.col("relevance") >= minimum).alias("_hits"), F.count("*").alias("_retrieved"),
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    return found.join(ideal, "query_id", "full_outer").select(
        "query_id", F.round(F.when(none("_best") == 0, 0.0).otherwise(none("_dcg") / F.col("_best")), 4).alias("ndcg"),
        F.round(F.when(none("_wanted") == 0, 1.0).otherwise(none("_hits") / F.col("_wanted")), 4).alias("recall"), none("_retrieved").alias("n_retrieved"), none("_expected").alias("n_expected"),
    )


def summary(scored: DataFrame, target: float, by: str | None = None) -> DataFrame:
    """Over the queries of ``against_expected``: their number, mean measures, and the share whose recall reaches the target;
    with ``by`` for each of its values too, and null for all."""
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return (scored.rollup(by) if by else scored.groupBy()).agg(F.count("*").alias("n_queries"), mean("ndcg"), mean("recall"), F.round(F.count_if(F.col("recall") >= target) / F.count("*"), 6).alias("pass_rate"))


def grades(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, relevance, n): how often each grade was given among the first k; null is not judged."""
    return ranked.where(F.col("rank") <= k).groupBy("query_id", F.col("relevance").cast("long").alias("relevance")).agg(F.count("*").alias("n"))
