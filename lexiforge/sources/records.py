"""JSON sources as records: lists under a few names, plain values, maps of entities; payloads, texts to embed, manifests.

Documents are parsed once to VARIANT; JSON in results is compact, with members in the order of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a document may hold its list, in this order, and how much is kept of contents,
#: descriptions, lists in payloads, first examples and texts to embed.
LISTS = ("items", "records", "data")
CONTENT, DESCRIPTION, LIST_JSON, EXAMPLE, EMBEDDED = 1000, 500, 500, 300, 500


@dataclass(frozen=True)
class EntityNames:
    """What Chinese entity maps call their parts."""

    entities: str = "实体"
    kind: str = "类型"
    description: str = "描述"
    attributes: str = "属性"
    unknown: str = "未知"
    frame: tuple[str, str] = ("【", "】")


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    """A member of an object, whatever characters its name has; null if there is none or it is of another kind."""
    members = F.try_variant_get(v, "$", "map<string,variant>")
    found = F.try_element_at(members, F.lit(name))
    return found if kind == "variant" else F.try_variant_get(found, "$", kind)


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _content_id(content: Column) -> Column:
    return F.left(F.md5(content.cast("binary")), F.lit(16)).alias("id")


def items(docs: DataFrame, key: str, body: str, listed: tuple[str, ...] = LISTS) -> DataFrame:
    """(key, position, item): the members of a JSON array, or of the first list that an object has under one of the names;
    any other value is one item.  A text that is no JSON has none."""
    parsed = docs.select(key, F.try_parse_json(body).alias("_v")).where("_v is not null")
    found = _list(F.col("_v"))
    for name in reversed(listed):
        # a name that is there decides, even if it holds no list
        members = F.try_variant_get("_v", "$", "map<string,variant>")
        found = F.when(F.map_contains_key(members, F.lit(name)), F.coalesce(_list(_get(F.col("_v"), name)), F.array().cast("array<variant>"))).otherwise(found)
    return parsed.select(key, F.posexplode(F.coalesce(found, F.array("_v"))).alias("position", "item"))


def listed_records(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, id, content, payload) of the ``items`` that are objects: the id is of the whole JSON, the content its
    beginning."""
    rows = items(docs, key, body).where(_is_object(F.col("item")))
    whole = F.to_json("item")
    return rows.select(key, "position", _content_id(whole), F.left(whole, F.lit(CONTENT)).alias("content"), whole.alias("payload"))


def plain_records(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, id, content, payload) of the members of an array, or of the one value: an object's content is its
    member of that name, else its JSON; another value is its own content and gets an object for a payload."""
    rows = items(docs, key, body, ())
    own = F.coalesce(_get(F.col("item"), "content", "string"), F.to_json("item"))
    text = F.when(_is_object(F.col("item")), own).otherwise(F.coalesce(F.try_variant_get("item", "$", "string"), F.lit("null")))
    payload = F.when(_is_object(F.col("item")), F.to_json("item")).otherwise(F.to_json(F.struct(text.alias("content"))))
    return rows.select(key, "position", _content_id(text), F.left(text, F.lit(CONTENT)).alias("content"), payload.alias("payload"))


def entity_records(docs: DataFrame, key: str, body: str, names: EntityNames | None = None) -> DataFrame:
    """(key, id, content, name, kind, description) of a map of entities: the content has a line for the name, the kind, the
    description if there is one, and each attribute with a value, by name."""
    names = names or EntityNames()
    parsed = docs.select(key, F.try_parse_json(body).alias("_v"))
    each = parsed.select(key, F.explode(F.try_variant_get(_get(F.col("_v"), names.entities), "$", "map<string,variant>")).alias("name", "props"))
    props = F.col("props")
    kind, description = F.coalesce(_get(props, names.kind, "string"), F.lit(names.unknown)), F.coalesce(_get(props, names.description, "string"), F.lit(""))
    attributes = F.array_sort(F.map_entries(F.coalesce(_get(props, names.attributes, "map<string,string>"), F.create_map().cast("map<string,string>"))))
    lines = F.concat(
        F.array(F.concat(F.lit(names.frame[0]), "name", F.lit(names.frame[1])), F.concat(F.lit(f"{names.kind}: "), kind)),
        F.when(description != "", F.array(F.concat(F.lit(f"{names.description}: "), description))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(attributes, lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
    )
    return each.select(key, _content_id(F.col("name")), F.array_join(lines, "\n").alias("content"), "name", kind.alias("kind"), F.left(description, F.lit(DESCRIPTION)).alias("description"))


def payload(item: Column, embedded: Column) -> Column:
    """An object's members as a map of JSON texts, without lists whose JSON is longer than the limit, and ``_embed_text``."""
    members = F.transform_values(F.coalesce(F.try_variant_get(item, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, v: F.to_json(v))
    short = F.map_filter(members, lambda _, v: ~(F.startswith(v, F.lit("[")) & (F.length(v) > LIST_JSON)))
    other = F.map_filter(short, lambda k, _: k != "_embed_text")
    return F.map_concat(other, F.create_map(F.lit("_embed_text"), embedded))


def embedded_text(name: Column, description: Column, examples: Column, label: str = "示例：") -> Column:
    """Name, description and the beginning of the first example, a line each, cut to a length; null without name and
    description."""
    filled = lambda c: F.when(c != "", c)
    first = filled(F.left(F.get(examples, F.lit(0)), F.lit(EXAMPLE)))
    lines = F.array_compact(F.array(F.coalesce(name, F.lit("")), filled(description), F.concat(F.lit(label), first)))
    return F.when(filled(name).isNotNull() | filled(description).isNotNull(), F.left(F.array_join(lines, "\n"), F.lit(EMBEDDED)))


def pending(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files (collection, path, content) whose content's hash is not the one that the manifest (collection, file_hash) has,
    with ``file_hash``; with ``force`` all of them."""
    hashed = files.withColumn("file_hash", F.md5("content"))
    return hashed if force else hashed.join(manifest.select("collection", "file_hash").distinct(), ["collection", "file_hash"], "left_anti").select(*files.columns, "file_hash")


def missing_members(docs: DataFrame, key: str, body: str, required: tuple[str, ...]) -> DataFrame:
    """(key, missing): for documents that are no object, or lack one of the required members, those that are missing."""
    members = F.map_keys(F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>"))
    lacking = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(members, F.array().cast("array<string>")))
    return docs.select(key, lacking.alias("missing")).where(F.size("missing") > 0)
