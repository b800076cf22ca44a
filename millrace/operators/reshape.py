"""Reshaping of nested records: typed columns by walking the schema, untyped ones as VARIANT."""
from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.session import cut
from millrace.plans.joins import salted_join
from millrace.plans.spread import widen

# The keys under which rows hide in a response, in the order they are tried.
RESPONSE_KEYS = ("rows", "data", "items", "value", "results")
RECORD_KEYS = ("items", "value", "data", "results", "records")


def extract_rows(doc: Column, keys: Sequence[str] = RESPONSE_KEYS) -> Column:
    """The list of a response: first list under a known key, else the document if it is a list, else one row."""
    lists = [F.try_variant_get(doc, f"$.{k}", "array<variant>") for k in keys]
    whole = F.try_variant_get(doc, "$", "array<variant>")
    rows = F.coalesce(*lists, whole, F.array(doc))
    return F.filter(rows, lambda r: F.schema_of_variant(r).rlike("^(OBJECT|ARRAY)"))


def flatten_variant(df: DataFrame, doc: str, keep: Sequence[str], sep: str = ".", max_depth: int = 10) -> DataFrame:
    """Long form (path, value): one row per leaf; empty containers vanish, containers at ``max_depth`` stay whole."""
    rows = widen(df.select(*keep, doc), *keep).select(*keep, F.lit("").alias("path"), F.col(doc).alias("_v"))
    value, path = F.col("_v"), F.col("path")

    def step(name: Column) -> Column:
        return F.when(path == "", name).otherwise(F.concat(path, F.lit(sep), name))

    for _ in range(max_depth):
        fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.coalesce(
            F.transform(fields, lambda e: F.struct(step(e["key"]).alias("path"), e["value"].alias("_v"))),
            F.transform(items, lambda x, i: F.struct(step(i.cast("string")).alias("path"), x.alias("_v"))),
            F.array(F.struct(path.alias("path"), value.alias("_v"))),
        )
        rows = rows.select(*keep, F.explode(inner).alias("_e")).select(*keep, "_e.path", "_e._v")
    return rows.select(*keep, "path", F.try_variant_get("_v", "$", "string").alias("value"))


def flatten_columns(df: DataFrame, sep: str = ".", list_sizes: Mapping[str, int] | None = None, max_depth: int = 10) -> DataFrame:
    """Struct columns to dotted columns. A list is indexed up to its size in ``list_sizes``, else kept."""
    sizes = list_sizes or {}

    def walk(col: Column, dtype: T.DataType, name: str, depth: int) -> Iterable[Column]:
        if isinstance(dtype, T.StructType) and depth < max_depth:
            for f in dtype.fields:
                yield from walk(col.getField(f.name), f.dataType, f"{name}{sep}{f.name}", depth + 1)
        elif isinstance(dtype, T.ArrayType) and name in sizes and depth < max_depth:
            for i in range(sizes[name]):
                yield from walk(F.get(col, F.lit(i)), dtype.elementType, f"{name}{sep}{i}", depth + 1)
        else:
            yield col.alias(name)

    out = [c for f in df.schema.fields for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name, 1)]
    return df.select(*out)


def unflatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Dotted columns to structs; a level whose keys are all numbers becomes a list, gaps filled with null."""
    tree: dict[str, Any] = {}
    for name in df.columns:
        node = tree
        *parents, leaf = name.split(sep)
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = F.col(f"`{name}`")

    def build(node: Any) -> Column:
        if isinstance(node, Column):
            return node
        if all(k.isdigit() for k in node):
            found = {int(k): build(v) for k, v in node.items()}
            return F.array(*[found.get(i, F.lit(None)) for i in range(max(found) + 1)])
        return F.struct(*[build(v).alias(k) for k, v in node.items()])

    return df.select(*[build(v).alias(k) for k, v in tree.items()])


def _key_test(include, exclude, include_patterns, exclude_patterns) -> Callable[[str], bool]:
    wanted = set(include) if include else None
    dropped = set(exclude or ())

    def keeps(name: str) -> bool:
        if name in dropped or any(re.match(p, name) for p in exclude_patterns):
            return False
        if wanted is None and not include_patterns:
            return True
        return name in (wanted or ()) or any(re.match(p, name) for p in include_patterns)

    return keeps


def _rebuild(col: Column, dtype: T.DataType, keep: Callable[[str], bool], name_of: Callable[[str], str], deep: bool, lists: bool) -> Column:
    if deep and isinstance(dtype, T.StructType):
        parts = [
            _rebuild(col.getField(f.name), f.dataType, keep, name_of, deep, lists).alias(name_of(f.name))
            for f in dtype.fields
            if keep(f.name)
        ]
        return F.when(col.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
    if deep and lists and isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.transform(col, lambda x: _rebuild(x, dtype.elementType, keep, name_of, deep, lists))
    return col


def filter_keys(
    df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
    include_patterns: Sequence[str] = (), exclude_patterns: Sequence[str] = (),
) -> DataFrame:
    """Keeps columns and nested fields by name; exclusions win, patterns match from the start of the name."""
    keeps = _key_test(include, exclude, include_patterns, exclude_patterns)
    same = str
    return df.select(
        *[_rebuild(F.col(f.name), f.dataType, keeps, same, True, False).alias(f.name) for f in df.schema.fields if keeps(f.name)]
    )


def filter_map_keys(col: Column, exclude: Sequence[str] = (), exclude_patterns: Sequence[str] = ()) -> Column:
    pattern = "|".join(f"(?:{p})" for p in exclude_patterns)

    def keep(k, v):
        ok = ~k.isin(list(exclude)) if exclude else F.lit(True)
        return ok & ~k.rlike(f"^(?:{pattern})") if pattern else ok

    return F.map_filter(col, keep)


def rename_keys(df: DataFrame, mapping: Mapping[str, str], recursive: bool = True) -> DataFrame:
    """Renames columns and, when recursive, fields of structs and of lists of structs."""
    name_of = lambda n: mapping.get(n, n)
    return df.select(
        *[_rebuild(F.col(f.name), f.dataType, lambda n: True, name_of, recursive, True).alias(name_of(f.name)) for f in df.schema.fields]
    )


def with_defaults(row: Column, defaults: Mapping[str, Any]) -> Column:
    """Adds the default of every key the map lacks; a key that is present keeps its value, null included."""
    literal = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(F.map_filter(literal, lambda k, v: ~F.map_contains_key(row, k)), row)


def with_deep_defaults(row: Column, defaults: Mapping[str, Mapping[str, Any]]) -> Column:
    """``with_defaults`` one level down, for a map of maps."""
    literal = F.create_map(
        *[x for k, inner in defaults.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for p in inner.items() for y in p]))]
    )
    missing = F.map_filter(literal, lambda k, v: ~F.map_contains_key(row, k))

    def merged(k, own):
        base = literal[k]
        extra = F.map_filter(base, lambda kk, vv: ~F.map_contains_key(own, kk))
        return F.when(base.isNull() | own.isNull(), own).otherwise(F.map_concat(extra, own))

    return F.map_concat(missing, F.transform_values(row, merged))


class Payload:
    """Structural edits of one struct column, applied in order."""

    def __init__(self, col: Column) -> None:
        self.col = col

    def set(self, path: str, value: Column) -> Payload:
        return Payload(self.col.withField(path, value))

    def remove(self, *paths: str) -> Payload:
        return Payload(self.col.dropFields(*paths))

    def merge(self, **fields: Column) -> Payload:
        col = self.col
        for name, value in fields.items():
            col = col.withField(name, value)
        return Payload(col)

    def wrap(self, name: str) -> Payload:
        return Payload(F.struct(self.col.alias(name)))

    def envelope(self, data_key: str = "data", **meta: Column) -> Payload:
        return Payload(F.struct(*[v.alias(k) for k, v in meta.items()], self.col.alias(data_key)))


def event_envelope(kind: Column, source: Column, ident: Column, at: Column, data: Column, subject: Column | None = None) -> Column:
    """Event in the public CloudEvents 1.0 shape, as JSON text; an absent subject is left out."""
    about = [] if subject is None else [subject.alias("subject")]
    return F.to_json(
        F.struct(
            F.lit("1.0").alias("specversion"), kind.alias("type"), source.alias("source"), *about, ident.alias("id"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
            F.lit("application/json").alias("datacontenttype"), data.alias("data"),
        )
    )


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def item_counts(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Adds the total number of items held in the list or map columns ``kinds``."""
    sizes = [F.coalesce(F.size(k), F.lit(0)) for k in kinds]
    sizes = [F.greatest(s, F.lit(0)) for s in sizes]
    return df.withColumn("item_count", sum(sizes[1:], sizes[0]))


def redact_map(col: Column, keys: Sequence[str], mark: str = "<redacted>") -> Column:
    names = [k.lower() for k in keys]
    return F.transform_values(col, lambda k, v: F.when(F.lower(k).isin(names), F.lit(mark)).otherwise(v))


def redact_fields(df: DataFrame, keys: Sequence[str], mark: str = "<redacted>") -> DataFrame:
    """Masks every column, struct field and map entry whose name is listed, ignoring case."""
    names = {k.lower() for k in keys}

    def walk(col: Column, dtype: T.DataType, name: str) -> Column:
        if name.lower() in names:
            return F.lit(mark)
        if isinstance(dtype, T.StructType):
            inner = [walk(col.getField(f.name), f.dataType, f.name).alias(f.name) for f in dtype.fields]
            return F.when(col.isNotNull(), F.struct(*inner))
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            return F.transform(col, lambda x: walk(x, dtype.elementType, ""))
        if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
            return redact_map(col, keys, mark)
        return col

    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def redact_url_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "?<redacted>")


def preorder_paths(nodes: DataFrame) -> DataFrame:
    """Adds ``path``: the sequence numbers from the root, by which sorting gives the pre-order.

    ``nodes`` has id, parent (null at a root) and seq. Each round doubles the distance a node has climbed and is written
    out; rounds end when no node climbs any more, after log2 of the depth. Nodes on a cycle never arrive; they keep what
    they have after as many rounds as the deepest possible tree takes.
    """
    climbed = nodes.withColumns({"path": F.array(F.col("seq").cast("bigint")), "_up": F.col("parent")})
    for _ in range(max(1, math.ceil(math.log2(max(2, nodes.count()))))):
        climbed = cut(climbed, "climb")
        if climbed.where("_up is not null").isEmpty():
            break
        above = climbed.select(F.col("id").alias("_up"), F.col("path").alias("_head"), F.col("_up").alias("_next"))
        joined = salted_join(climbed, above, ["_up"], ["id"], "left")
        climbed = joined.withColumn(
            "path", F.when(F.col("_head").isNull(), F.col("path")).otherwise(F.concat("_head", "path"))
        ).withColumn("_up", F.col("_next")).drop("_head", "_next")
    return climbed.drop("_up")


# The stems of a file that can open a default listing.
OPENING_STEMS = ("index", "readme", "intro")


def default_listing(files: DataFrame, path: str = "path", ties: Sequence[str] = ()) -> DataFrame:
    """Generated listing order: the first opening page, then everything else by path."""
    stem = F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))
    opening = files.where(stem.isin(*OPENING_STEMS)).agg(F.min(path).alias("p")).scalar()
    marked = files.withColumn("is_opening", F.coalesce(F.col(path) == opening, F.lit(False)))
    return marked.orderBy(F.desc("is_opening"), path, *ties)
