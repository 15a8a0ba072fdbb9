"""One retrieval call over named collections: filters before the search, thresholds and substring filters after it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.retrieval import fan_out, knn


@dataclass(frozen=True)
class Collection:
    """Rows with a key and a vector; ``defaults`` fill missing payload fields."""

    rows: DataFrame
    key: str = "id"
    vector: str = "embedding"
    defaults: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Request:
    """``equal`` is asked before anything is cut, ``contains`` of the k rows found (so fewer may come back), and
    ``min_score`` of their scores.  ``sources`` that do not exist are passed over."""

    vector: Sequence[float]
    sources: Sequence[str]
    equal: Mapping[str, object] = field(default_factory=dict)
    differs: Mapping[str, object] = field(default_factory=dict)
    contains: Mapping[str, str] = field(default_factory=dict)
    k: int = 10
    min_score: float | None = None


def search(collection: Collection, request: Request) -> DataFrame:
    """The collection's best rows for the request, with ``score`` and ``rank``.  A filter on a column that the collection
    does not have finds nothing."""
    rows = collection.rows
    for name, value in request.equal.items():
        rows = rows.where(F.col(name) == F.lit(value)) if name in rows.columns else rows.limit(0)
    for name, value in request.differs.items():
        rows = rows.where((F.col(name) != F.lit(value)) | F.col(name).isNull()) if name in rows.columns else rows
    query = rows.sparkSession.createDataFrame([(0, [float(x) for x in request.vector])], f"{collection.key} long, {collection.vector} array<double>")
    found = knn(rows, query, request.k, collection.key, collection.vector, keep_self=True, min_score=request.min_score)
    payload = rows.drop(collection.vector).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in collection.defaults.items() if c in rows.columns})
    out = payload.join(F.broadcast(found.drop("query_id")), collection.key)
    for name, part in request.contains.items():
        out = out.where(F.contains(F.col(name), F.lit(part))) if name in out.columns else out.limit(0)
    return out


def retrieve(collections: Mapping[str, Collection], request: Request) -> DataFrame:
    """The request's results from every source, tagged with ``source``."""
    found = {n: search(collections[n], request).withColumnRenamed(collections[n].key, "id") for n in request.sources if n in collections}
    return fan_out(found)


def retrieve_for_scene(collections: Mapping[str, Collection], scene: str, routes: Mapping[str, Sequence[str]], request: Request, default: Sequence[str] = ()) -> DataFrame:
    """``retrieve`` from the sources that a scene type is routed to."""
    return retrieve(collections, replace(request, sources=list(routes.get(scene, default))))


def preset(requests: Mapping[str, Request], name: str, **changes) -> Request:
    """A named request with some of its fields changed."""
    return replace(requests[name], **changes)
