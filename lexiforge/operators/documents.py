"""Structured documents: JSON flattening and differences, Markdown outlines and tables, entity maps, graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import once


#: Levels that one explosion opens, so that plans of deep documents stay flat.
_LEVELS = 16


def _depth(rows: DataFrame, *columns: str) -> int:
    """How deep braces nest in any of the JSON texts: a bound on the levels of objects, found in one pass."""

    def deep(c: str) -> Column:
        bare = F.replace(F.replace(F.col(c), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))  # no escapes within strings
        braces = F.split(F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', ""), r"[^{}]", ""), "")
        step = lambda s, x: once(F.when(x == "{", s["now"] + 1).when(x == "}", s["now"] - 1).otherwise(s["now"]), lambda n: F.struct(n.alias("now"), F.greatest(s["most"], n).alias("most")))
        return F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])

    found = rows.agg(F.max(F.greatest(F.lit(0), *[F.coalesce(deep(c), F.lit(0)) for c in columns]))).head()[0]
    return found or 0


def _object(v: Column) -> Column:
    """The members of a VARIANT that is an object; null for all others."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _below(path: Column, name: Column) -> Column:
    """The path of a member: names joined by dots, with dots and backslashes in names marked by a backslash."""
    name = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))
    return F.when(path.isNull(), name).otherwise(F.concat(path, F.lit("."), name))


def _opened(rows: DataFrame, found: Column, kept: list[str], opened: Callable[[Column], Column], depth: int) -> DataFrame:
    """``rows`` with ``found``, an array of structs, replaced level by level by what ``opened`` makes of each struct (an
    array), ``depth`` times, and then one row a struct."""
    rows = rows.select(*kept, found.alias("_x"))
    for done in range(0, depth, _LEVELS):
        value = F.col("_x")
        for _ in range(min(_LEVELS, depth - done)):
            value = F.flatten(F.transform(value, opened))
        rows = rows.select(*kept, F.explode(value).alias("_x")).select(*kept, F.array("_x").alias("_x"))
    return rows.select(*kept, F.explode("_x").alias("_x"))


def flat_json(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, value): the leaves of JSON objects, at any depth.  A leaf is what is no object, or an object without
    members; arrays are leaves.  Values are text: strings as they are, all others as JSON, null as null.  Dots in names are
    marked by a backslash.  A text that is no JSON, and a null, have no leaves; a text that is no object has one, with the
    empty path."""

    def opened(x: Column) -> Column:
        parts = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(_below(x["path"], e["key"]).alias("path"), e["value"].alias("v")))
        return once(_object(x["v"]), lambda m: F.when(F.size(m) > 0, parts(m)).otherwise(F.array(x)))

    start = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.col("_v").alias("v")))
    parsed = rows.select(*key, column, F.try_parse_json(column).alias("_v")).where("_v is not null")
    leaves = _opened(parsed, start, key, opened, _depth(rows, column))
    return leaves.select(*key, F.coalesce("_x.path", F.lit("")).alias("path"), F.try_variant_get("_x.v", "$", "string").alias("value"))


def json_changes(old: DataFrame, new: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, change, before, after) between two tables of JSON documents with one row a key.  Members of objects are
    compared one by one where both sides are objects; what only one side has is added or deleted as a whole, and what differs
    otherwise is modified.  Order of members does not count; a number and its text differ.  Values are given as JSON."""

    def opened(x: Column) -> Column:
        def parts(a: Column, b: Column) -> Column:
            names = F.array_union(F.map_keys(a), F.map_keys(b))
            side = lambda m, n: F.element_at(m, n)
            each = F.transform(names, lambda n: F.struct(
                _below(x["path"], n).alias("path"), side(a, n).alias("a"), side(b, n).alias("b"), F.map_contains_key(a, n).alias("has_a"), F.map_contains_key(b, n).alias("has_b"),
            ))
            return F.filter(each, lambda e: ~(e["has_a"] & e["has_b"] & F.to_json(e["a"]).eqNullSafe(F.to_json(e["b"]))))

        return once(_object(x["a"]), lambda a: once(_object(x["b"]), lambda b: F.when(a.isNotNull() & b.isNotNull(), parts(a, b)).otherwise(F.array(x))))

    side = lambda df, c, has: df.select(*key, F.col(column).alias(f"_{c}"), F.lit(True).alias(has))
    both = side(old, "a", "has_a").join(side(new, "b", "has_b"), key, "full_outer")
    start = F.array(F.struct(
        F.lit(None).cast("string").alias("path"), F.try_parse_json("_a").alias("a"), F.try_parse_json("_b").alias("b"),
        F.coalesce("has_a", F.lit(False)).alias("has_a"), F.coalesce("has_b", F.lit(False)).alias("has_b"),
    ))
    changed = both.where("not (_a <=> _b) or has_a is null or has_b is null")
    found = _opened(changed, start, key, opened, max(_depth(old, column), _depth(new, column)))
    a, b = F.to_json("_x.a"), F.to_json("_x.b")
    change = F.when(~F.col("_x.has_a"), "added").when(~F.col("_x.has_b"), "deleted").when(~a.eqNullSafe(b), "modified")
    return found.select(*key, F.coalesce("_x.path", F.lit("")).alias("path"), change.alias("change"), a.alias("before"), b.alias("after")).where("change is not null")


def markdown_table(text: Column) -> Column:
    """The two-column rows of a Markdown table as a map, without its rule and with the last of equal keys."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x.rlike(r"^\|.*\|$") & ~x.rlike(r"^\|[\s:|-]+\|$"))
    cells = F.filter(F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))), lambda c: F.size(c) >= 2)
    keys = lambda a: F.transform(a, lambda c: c[0])
    last = lambda a: F.filter(a, lambda c, i: ~F.array_contains(F.slice(keys(a), i + 2, F.size(a)), c[0]))
    return once(cells, lambda a: once(last(a), lambda b: F.map_from_arrays(keys(b), F.transform(b, lambda c: c[1]))))


def outline(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, chapter, settings, scenes) of a Markdown outline: the chapter number of its title or table, ``?`` without one,
    its table as a map, and its third-level sections as (title, body)."""
    parts = F.filter(F.split("text", r"(?m)(?=^### )", -1), lambda x: x.startswith("### "))
    scenes = F.transform(parts, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^### ([^\n]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace(x, r"^### [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body")))
    number = F.regexp_extract("text", r"(?mi)^#+ .*?(?:chapter\s*|第)([0-9]+)", 1)
    return docs.select(key, F.when(number != "", number).otherwise("?").alias("chapter"), markdown_table(F.split("text", r"(?m)^### ", 2)[0]).alias("settings"), scenes.alias("scenes"))


def edges_by_name(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) by node names as edges by id; those with an unknown end are left out."""
    side = lambda c: nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").select("src_id", "rel", "dst_id")


def settings_map(entities: DataFrame) -> DataFrame:
    """(name, field, value) of entities (id, name, attrs map), under name and id; nested objects stay as JSON and are
    flattened one level too."""
    flat = entities.select(F.explode(F.array_distinct(F.array("name", "id"))).alias("name"), F.explode("attrs").alias("field", "value"))
    nested = flat.where(F.col("value").startswith("{")).select("name", "field", F.explode(F.from_json("value", "map<string,string>")).alias("_k", "value"))
    return flat.unionByName(nested.select("name", F.concat_ws(".", "field", "_k").alias("field"), "value"))
