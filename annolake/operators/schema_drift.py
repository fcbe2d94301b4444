"""Problem 1: documents whose schema drifts between files and over time.

Tagged-union inference on Spark's VARIANT type. Every object that is compared (the top level, the
variation of each instance) has a schema: its field names with the tags of their values. The parallel
schemas of all files are fused (``fused``) into one union of alternatives, a row per path and tag with
the file and time it first appeared in and what it is to the base layout (``alternatives``); each
distinct schema is judged once by the alternatives of the union it holds, and a file's changes are
those of its schemas (``changes``). ``tagged_union`` gives the union over every path at every depth
(``tag_paths``); conflicting paths are split into typed branches plus one canonical value, all other
fields kept, by ``consistent_table``.

Scale: bodies are parsed once, narrow and JVM-side, into schemas written beside; what is shuffled is
one row per task and distinct schema (a schema that most files share costs one row a task) and the
changes found.

Defined results for odd input: a null, empty, non-JSON or non-object body has no paths and no
changes, shows up in ``unreadable`` and keeps a row with its reason in ``consistent_table``; of a key
that an object repeats the last value counts (the session is told to read such objects); a missing,
null or non-object ``variation`` is an empty one; non-object entries of ``instances`` are skipped;
repeated rows count once; columns of the input other than the four named are ignored, whatever their
names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from annolake.session import scratch

#: The field names of the base layout at the two levels that are compared.
BASE_TOP = ("schema", "version", "canvas", "instances", "constraints", "parameters")
BASE_VARIATION = (
    "cx_range", "cy_range", "h_range", "angle_range", "enabled_probability", "flip_probability",
    "same_class_random", "allow_overlap",
)


@dataclass(frozen=True)
class Layout:
    """The fields of one level and the tags of those whose changes are classified."""

    known: tuple[str, ...]
    watched: dict[str, str] = field(default_factory=dict)


TOP = Layout(BASE_TOP, {"schema": "string", "version": "integer"})
VARIATION = Layout(BASE_VARIATION, {"cx_range": "number_pair"})


#: The types of the base fields that are not watched; ``instances`` are the rows.
TOP_TYPES = {"canvas": "json", "constraints": "json", "parameters": "json"}
VARIATION_TYPES = {
    "cy_range": "array<double>", "h_range": "array<double>", "angle_range": "array<double>", "enabled_probability": "double", "flip_probability": "double",
    "same_class_random": "boolean", "allow_overlap": "boolean",
}


def _variant(c: Column) -> Column:
    return F.try_parse_json(c)


def tag(v: Column) -> Column:
    """The union tag of a variant value: null, string, boolean, integer, number, object, array, or
    number_pair for an array of exactly two numbers."""
    items = F.try_variant_get(v, "$", "array<variant>")

    def of(s: Column) -> Column:
        return (
            F.when(s.isNull() | (s == "VOID"), "null")
            .when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean")
            .when(s == "BIGINT", "integer")
            .when(_is_fraction(s), "number")
            .when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY") & (F.size(items) == 2) & F.forall(items, _is_number), "number_pair")
            .when(s.startswith("ARRAY"), "array")
            .otherwise(F.lower(s))
        )

    # bound once in a one-item lambda: inside higher-order functions common subexpressions are not shared
    return F.transform(F.array(F.schema_of_variant(v)), of)[0]


def _is_fraction(s: Column) -> Column:
    return s.startswith("DECIMAL") | (s == "DOUBLE") | (s == "FLOAT")


def _is_number(v: Column) -> Column:
    return F.transform(F.array(F.schema_of_variant(v)), lambda s: (s == "BIGINT") | _is_fraction(s))[0]


def _entries(v: Column) -> Column:
    """array<struct<key, value>> of a variant object; an empty array for anything else."""
    m = F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(F.map_entries(m), F.map_entries(F.expr("cast(map() as map<string,variant>)")))


def _tagged(v: Column) -> Column:
    return F.transform(_entries(v), lambda e: F.struct(e["key"].alias("name"), tag(e["value"]).alias("tag")))


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds the variant column ``_doc``; null where the body is not a JSON object."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    v = _variant(F.col(body))
    return df.withColumn("_doc", v).withColumn(
        "_doc", F.when(F.schema_of_variant("_doc").startswith("OBJECT"), F.col("_doc"))
    )


def unreadable(df: DataFrame, id_col: str = "template_id", body: str = "body") -> DataFrame:
    """Files without a readable JSON object, with the reason."""
    p = parsed(df, body)
    return (
        p.filter(F.col("_doc").isNull())
        .select(
            id_col,
            F.when(F.col(body).isNull(), "null")
            .when(F.trim(body) == "", "empty")
            .when(_variant(F.col(body)).isNull(), "not_json")
            .otherwise("not_an_object")
            .alias("reason"),
        )
        .distinct()
    )


#: The paths of the two levels that are compared.
LEVELS = {"$": TOP, "$.instances[].variation": VARIATION}


def _objects(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., sig, path, fields): one row per compared object, ``sig`` standing for its schema."""
    inst = F.filter(
        F.coalesce(F.try_variant_get("_doc", "$.instances", "array<variant>"), F.expr("cast(array() as array<variant>)")),
        lambda x: F.schema_of_variant(x).startswith("OBJECT"),
    )
    top, inner = LEVELS
    objects = F.concat(
        F.array(F.struct(F.lit(top).alias("path"), F.array_sort(_tagged(F.col("_doc"))).alias("fields"))),
        F.transform(inst, lambda x: F.struct(F.lit(inner).alias("path"), F.array_sort(_tagged(F.try_variant_get(x, "$.variation", "variant"))).alias("fields"))),
    )
    o = df.filter(F.col("_doc").isNotNull()).select(*keep, F.explode(F.array_distinct(objects)).alias("o"))
    return o.select(*keep, F.xxhash64("o.path", "o.fields").alias("sig"), "o.path", "o.fields")


def fused(objects: DataFrame, id_col: str, at: str | None = None) -> DataFrame:
    """(sig, path, fields, n_files, first_seen, first_file): the distinct schemas of all objects."""
    first = F.struct(F.col(at) if at else F.lit(None).cast("timestamp").alias("at"), F.col(id_col))
    return objects.groupBy("sig").agg(
        F.first("path").alias("path"), F.first("fields").alias("fields"), F.count(F.lit(1)).alias("n_files"), F.min(first[at or "at"]).alias("first_seen"), F.min_by(id_col, first).alias("first_file")
    )


def alternatives(schemas: DataFrame) -> DataFrame:
    """The union: (path, name, tag, n_schemas, first_seen, first_file, role) of every alternative a
    field takes. Role to the base layout: ``base``; ``null`` or ``retyped`` for another tag of a
    watched field; ``new`` for a field the layout does not have, ``stand_in`` if its tag is that of a
    watched field, which it may then stand in for."""
    each = schemas.select("path", "first_seen", "first_file", F.explode("fields").alias("f")).select("path", "first_seen", "first_file", "f.name", "f.tag")
    union = each.groupBy("path", "name", "tag").agg(F.count(F.lit(1)).alias("n_schemas"), F.min("first_seen").alias("first_seen"), F.min_by("first_file", F.struct("first_seen", "first_file")).alias("first_file"))
    role = F.lit(None).cast("string")
    for path, layout in LEVELS.items():
        known = F.when(~F.col("name").isin(*layout.known), F.when(F.col("tag").isin(*layout.watched.values()), "stand_in").otherwise("new"))
        for name, want in layout.watched.items():
            known = known.when(F.col("name") == name, F.when(F.col("tag") == want, "base").when(F.col("tag") == "null", "null").otherwise("retyped"))
        role = F.when(F.col("path") == path, known.otherwise("base")).otherwise(role)
    return union.withColumn("role", role)


def _unlike(key: Column, name: str) -> Column:
    """How unlike a field's name is to a base name: names of which one holds the other come first."""
    folded, base = F.regexp_replace(F.lower(key), "[^a-z0-9]", ""), name.replace("_", "")
    apart = ~(folded.contains(base) | F.lit(base).contains(folded)) | (folded == "")
    return F.struct(apart.alias("apart"), F.levenshtein(folded, F.lit(base)).alias("d"), key.alias("name"))


def _named(name: str):
    return lambda f: f["name"] == name


def _stands_in(want: str):
    return lambda f: (f["role"] == "stand_in") & (f["tag"] == want)


def _by_likeness(name: str):
    return lambda f: _unlike(f["name"], name)


def _schema_changes(fields: Column, layout: Layout) -> Column:
    """array<struct<field_name, change_kind>> of one schema (name, tag, role) against its layout."""
    unknown = F.filter(fields, lambda f: f["role"].isin("new", "stand_in"))
    parts, used = [], []
    for name, want in layout.watched.items():
        role = F.try_element_at(F.filter(fields, _named(name)), F.lit(1))["role"]
        # of several candidates the one closest in name is the renamed field; the others are added
        candidates = F.array_sort(F.transform(F.filter(unknown, _stands_in(want)), _by_likeness(name)))
        renamed = role.isNull() & (F.size(candidates) > 0)
        used.append(F.when(renamed, F.try_element_at(candidates, F.lit(1))["name"]))
        kind = F.when(renamed, "renamed").when(role.isNull() | (role == "null"), "removed").when(role == "retyped", "retyped")
        parts.append(F.struct(F.lit(name).alias("field_name"), kind.alias("change_kind")))
    taken = F.array_compact(F.array(*used))
    added = F.transform(F.filter(unknown, lambda f: ~F.array_contains(taken, f["name"])), lambda f: F.struct(f["name"].alias("field_name"), F.lit("added").alias("change_kind")))
    return F.concat(F.filter(F.array(*parts), lambda p: p["change_kind"].isNotNull()), added)


def _written_objects(df: DataFrame, id_col: str, body: str, at: str | None) -> DataFrame:
    """The compared objects of all files, parsed once and written beside."""
    spark, side = df.sparkSession, scratch(df.sparkSession, "schemas")
    keep = [id_col, *([at] if at else [])]
    o = _objects(parsed(df.select(*keep, body), body), keep)
    o.write.parquet(side)
    return spark.read.schema(o.schema).parquet(side)


def schema_changes(schemas: DataFrame) -> DataFrame:
    """(sig, changes) of the schemas that deviate, judged by the union's alternatives."""
    union = alternatives(schemas).select("path", "name", "tag", "role")
    each = schemas.select("sig", "path", F.explode("fields").alias("f")).select("sig", "path", "f.name", "f.tag")
    own = each.join(union, ["path", "name", "tag"]).groupBy("sig").agg(F.collect_list(F.struct("name", "tag", "role")).alias("fields"))
    # an object without any field has no alternative and lacks all of the layout
    judged = schemas.select("sig", "path").join(own, "sig", "left").withColumn("fields", F.coalesce("fields", F.expr("cast(array() as array<struct<name:string,tag:string,role:string>>)")))
    (top, a), (_, b) = LEVELS.items()
    c = F.when(F.col("path") == top, _schema_changes(F.col("fields"), a)).otherwise(_schema_changes(F.col("fields"), b))
    return judged.select("sig", c.alias("changes")).filter(F.size("changes") > 0)


def changes(df: DataFrame, id_col: str = "template_id", body: str = "body") -> DataFrame:
    """(id, field_name, change_kind): each change of a file against the base layout, once."""
    o = _written_objects(df, id_col, body, None)
    found = o.select(id_col, "sig").join(schema_changes(fused(o, id_col)), "sig")
    return found.select(id_col, F.explode("changes").alias("c")).select(id_col, "c.field_name", "c.change_kind").distinct()


def reported_alternatives(df: DataFrame, id_col: str = "template_id", at: str = "written_at", body: str = "body") -> DataFrame:
    """The alternatives of the two compared levels and when each appeared (``alternatives``)."""
    return alternatives(fused(_written_objects(df, id_col, body, at), id_col, at))


def _tag_of(v: object) -> str:
    """As ``tag``, of a value read by ``_DECODER``."""
    if isinstance(v, list):
        return "number_pair" if len(v) == 2 and all(type(x) in (int, float) for x in v) else "array"
    return _TAGS[type(v)]


_TAGS = {type(None): "null", str: "string", bool: "boolean", int: "integer", float: "number", dict: "object"}
# whole numbers beyond 64 bits are decimals in a variant; of other numbers only the kind counts
_DECODER = json.JSONDecoder(strict=False, parse_float=lambda _: 0.0, parse_int=lambda s: int(s) if len(s) < 20 and -(2**63) <= int(s) < 2**63 else 0.0)


def _walk(body: str) -> Iterator[tuple[str, str]]:
    """(path, tag) of every value below the root of a readable document, at any depth."""
    todo = [("$", _DECODER.raw_decode(body.lstrip(" \t\r\n\ufeff"))[0])]
    while todo:
        path, v = todo.pop()
        for key, x in ((f".{k}", x) for k, x in v.items()) if isinstance(v, dict) else (("[]", x) for x in v):
            # half of a surrogate pair becomes what the JVM makes of it
            at = path + key.encode("utf-8", "replace").decode()
            yield at, _tag_of(x)
            if isinstance(x, dict | list):
                todo.append((at, x))


def tag_paths(df: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """(keep..., path, tag): the tag of every value at every depth; array items share the path
    ``[]``. One Arrow pass over the readable bodies, no shuffle."""
    p = parsed(df.select(*keep, F.col(body).alias("_body")), "_body").filter(F.col("_doc").isNotNull()).select(*keep, "_body")
    schema = StructType([*(StructField(f.name, f.dataType) for f in p.schema.fields[:-1]), StructField("path", StringType()), StructField("tag", StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [(i, *x) for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()) for x in _walk(text)]
                at = pa.array([x[0] for x in found], pa.int64())
                own = [part.column(i).take(at) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], names=[*keep, "path", "tag"])

    return p.mapInArrow(rows, schema)


def tagged_union(df: DataFrame, id_col: str = "template_id", at: str = "written_at", by: str = "writer", body: str = "body") -> DataFrame:
    """The fused schema: one row per (path, tag) with the number of files and values that take it,
    and when and by whom the alternative first appeared."""
    return (
        tag_paths(df.dropDuplicates([id_col]), [id_col, at, by], body)
        .groupBy("path", "tag", id_col, at, by)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("path", "tag")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("n").alias("n_values"),
            F.min(at).alias("first_seen"),
            F.min_by(by, F.struct(F.col(at), F.col(id_col))).alias("first_by"),
            F.min_by(id_col, F.struct(F.col(at), F.col(id_col))).alias("first_file"),
        )
    )


def _rest(v: Column, known: tuple[str, ...]) -> Column:
    """The fields of an object that the layout does not have, as JSON text by name."""
    extra = F.filter(_entries(v), lambda e: ~e["key"].isin(*known))
    return F.map_from_entries(F.transform(extra, lambda e: F.struct(e["key"], F.to_json(e["value"]))))


def consistent_table(df: DataFrame, id_col: str = "template_id", body: str = "body") -> DataFrame:
    """One row per file and instance with typed branches and the canonical value of each watched
    field: ``schema`` (text, first text in a list or object), ``version`` (whole number, ``v2``,
    ``{"major": 2}``, ``[2, 0]``) and ``cx_range`` ([low, high] from a pair of numbers or numeric
    strings, ``"a..b"``, ``{"min", "max"}``, a single number as both ends). A renamed field is read
    under its base name. The other base fields come typed where they fit, and as they stand in
    ``<name>_other`` where not; fields unknown to the layout by name in ``extra`` and
    ``variation_extra``. Files with no instances keep one row with a null ``instance_no``, unreadable
    ones one with the reason in ``unreadable``."""
    files = parsed(df.select(id_col, body).dropDuplicates([id_col]), body)
    why = F.when(F.col("_doc").isNotNull(), None).when(F.col(body).isNull(), "null").when(F.trim(body) == "", "empty").when(_variant(F.col(body)).isNull(), "not_json").otherwise("not_an_object")
    inst = F.coalesce(F.try_variant_get("_doc", "$.instances", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    p = files.select(id_col, "_doc", why.alias("unreadable"), F.posexplode_outer(inst).alias("instance_no", "_inst"))
    p = p.withColumn("_var", F.try_variant_get("_inst", "$.variation", "variant"))

    def pick(v: Column, name: str, want: str, layout: Layout) -> Column:
        """The value of the field, or of the unknown field that took its place."""
        e = _entries(v)
        own = F.try_element_at(F.filter(e, lambda x: x["key"] == name), F.lit(1))
        known = F.array(*map(F.lit, layout.known))
        other = F.filter(e, lambda x: ~F.array_contains(known, x["key"]) & (tag(x["value"]) == want))
        keys = F.array_sort(F.transform(other, lambda x: _unlike(x["key"], name)))
        best = F.try_element_at(keys, F.lit(1))["name"]
        alt = F.try_element_at(F.filter(other, lambda x: x["key"] == best), F.lit(1))
        return F.when(F.exists(e, lambda x: x["key"] == name), own["value"]).otherwise(alt["value"])

    p = (
        p.withColumn("_s", pick(F.col("_doc"), "schema", "string", TOP))
        .withColumn("_v", pick(F.col("_doc"), "version", "integer", TOP))
        .withColumn("_c", pick(F.col("_var"), "cx_range", "number_pair", VARIATION))
    )
    vtext = F.coalesce(
        F.try_variant_get("_v", "$.major", "string"), F.try_variant_get("_v", "$[0]", "string"), F.try_variant_get("_v", "$", "string")
    )
    ctext = F.try_variant_get("_c", "$", "string")
    parts = F.split(F.coalesce(ctext, F.lit("")), r"\.\.")
    low = F.coalesce(
        F.try_variant_get("_c", "$[0]", "double"), F.try_variant_get("_c", "$.min", "double"), F.try_variant_get("_c", "$", "double"),
        F.expr("try_cast(element_at(split(coalesce(try_variant_get(_c, '$', 'string'), ''), '[.][.]'), 1) as double)"),
    )
    high = F.coalesce(
        F.try_variant_get("_c", "$[1]", "double"), F.try_variant_get("_c", "$.max", "double"), F.try_variant_get("_c", "$", "double"),
        F.when(F.size(parts) == 2, F.expr("try_cast(element_at(split(coalesce(try_variant_get(_c, '$', 'string'), ''), '[.][.]'), -1) as double)")),
    )
    st, vt = tag(F.col("_s")), tag(F.col("_v"))

    def branches(v: str, types: dict[str, str]) -> list[Column]:
        """A typed branch of each field, and what does not fit as JSON text."""
        out = []
        for name, kind in types.items():
            x = F.try_variant_get(v, f"$.{name}", "variant")
            own = F.to_json(x) if kind == "json" else F.try_variant_get(x, "$", kind)
            fits = {"json": F.lit(True), "array<double>": tag(x) == "number_pair", "double": tag(x).isin("integer", "number"), "boolean": tag(x) == "boolean"}[kind]
            out.append(F.when(fits, own).alias(name))
            if kind != "json":
                out.append(F.when(~fits & (tag(x) != "null"), F.to_json(x)).alias(f"{name}_other"))
        return out

    return p.select(
        id_col,
        F.col("instance_no"),
        F.when(st == "string", F.try_variant_get("_s", "$", "string")).alias("schema_text"),
        F.when(~st.isin("string", "null"), F.to_json("_s")).alias("schema_other"),
        F.coalesce(
            F.try_variant_get("_s", "$.name", "string"), F.try_variant_get("_s", "$[0]", "string"),
            F.when(st == "string", F.try_variant_get("_s", "$", "string")),
        ).alias("schema"),
        F.when(vt == "integer", F.try_variant_get("_v", "$", "bigint")).alias("version_int"),
        F.when(~vt.isin("integer", "null"), F.to_json("_v")).alias("version_other"),
        F.regexp_extract(F.coalesce(vtext, F.lit("")), r"(\d+)", 1).try_cast("bigint").alias("version"),
        F.when(tag(F.col("_c")) == "number_pair", F.try_variant_get("_c", "$", "array<double>")).alias("cx_range_pair"),
        F.when(~tag(F.col("_c")).isin("number_pair", "null"), F.to_json("_c")).alias("cx_range_other"),
        F.when(low.isNotNull() & high.isNotNull(), F.array(low, high)).alias("cx_range"),
        *branches("_doc", TOP_TYPES),
        *branches("_var", VARIATION_TYPES),
        _rest(F.col("_doc"), BASE_TOP).alias("extra"),
        _rest(F.col("_var"), BASE_VARIATION).alias("variation_extra"),
        "unreadable",
    )
