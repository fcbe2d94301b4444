"""Queries of the general training-data problems (1, 4, 6, 7), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.operators import compaction, label_rows, references, schema_drift
from annolake.session import scratch, table


def p1_found(spark, d):
    return schema_drift.changes(table(spark, d, "scene_templates"))


def p1_union(spark, d):
    return schema_drift.tagged_union(table(spark, d, "scene_templates"))


def p1_alternatives(spark, d):
    return schema_drift.reported_alternatives(table(spark, d, "scene_templates"))


def p1_unreadable(spark, d):
    return schema_drift.unreadable(table(spark, d, "scene_templates"))


def p1_table(spark, d):
    return schema_drift.consistent_table(table(spark, d, "scene_templates"))


def p1_changes_by_month(spark, d):
    """Changes per month and writer: how the layout shifts over time."""
    t = table(spark, d, "scene_templates")
    files = t.groupBy("template_id").agg(F.min("written_at").alias("at"), F.min("writer").alias("writer"))
    return (
        schema_drift.changes(t).join(files, "template_id").groupBy(F.date_format("at", "yyyy-MM").alias("month"), "writer", "field_name", "change_kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _orphans(spark, d):
    return references.annotation_orphans(table(spark, d, "coco_annotations"), table(spark, d, "coco_images"), table(spark, d, "coco_categories"))


def p4_found(spark, d):
    return _orphans(spark, d).select("annotation_id", "ref_table", "reason")


def p4_counts(spark, d):
    return references.orphan_counts(_orphans(spark, d))


def _parsed(spark, d):
    return label_rows.parse_lines(table(spark, d, "label_lines"))


def p6_found(spark, d):
    return label_rows.rejects(_parsed(spark, d))


def p6_shapes(spark, d):
    return label_rows.shapes(_parsed(spark, d))


def p6_shape_totals(spark, d):
    """The valid lines by kind, class and number of coordinates, with their sums."""
    v = _parsed(spark, d).filter("reason is null").dropDuplicates(["line_id"])
    total = F.aggregate("coords", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return v.groupBy("file_kind", "class_id", F.size("coords").alias("n_coords")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("total"), F.round(F.sum(F.round("conf", 6)), 4).alias("conf"))


def p7_found(spark, d):
    """The records that the table loses by its compaction."""
    return compaction.superseded(*compaction.compact_fragments(table(spark, d, "task_fragments"), scratch(spark, "task_results")))


def p7_compacted(spark, d):
    t, _ = compaction.compact_fragments(table(spark, d, "task_fragments"), scratch(spark, "task_results"))
    return t.read().select("run_id", "index_key", "ok", "stem", "objects", "error", "fragment_id", "rec_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_alternatives, p1_unreadable, p1_union, p1_table, p1_changes_by_month, p4_found, p4_counts, p6_found, p6_shapes, p6_shape_totals, p7_found, p7_compacted)}

_P4 = """
WITH refs AS (
  SELECT DISTINCT id, 'image' AS ref_table, image_id AS k, added_at AS t FROM coco_annotations WHERE image_id IS NOT NULL
  UNION ALL SELECT DISTINCT id, 'category', category_id, added_at FROM coco_annotations WHERE category_id IS NOT NULL),
par AS (SELECT 'image' AS ref_table, id, added_at, removed_at FROM coco_images UNION ALL SELECT 'category', id, added_at, removed_at FROM coco_categories),
x AS (SELECT refs.id, refs.ref_table, t, count(par.id) AS n, min(par.added_at) AS first_added,
        count(*) FILTER (WHERE par.added_at <= t AND (par.removed_at IS NULL OR t < par.removed_at)) AS present
      FROM refs LEFT JOIN par ON par.ref_table = refs.ref_table AND par.id = refs.k GROUP BY ALL),
o AS (SELECT id AS annotation_id, ref_table, t, CASE WHEN n = 0 THEN 'missing' WHEN first_added > t THEN 'late' ELSE 'deleted' END AS reason FROM x WHERE present = 0)
"""

_DEC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_P6 = rf"""
WITH l AS (SELECT DISTINCT line_id, file_kind, raw_line FROM label_lines WHERE raw_line IS NOT NULL AND regexp_matches(raw_line, '[^\s\x0B]')),
t AS (SELECT line_id, file_kind, regexp_extract_all(raw_line, '[^\s\x0B]+') AS toks FROM l),
u AS (SELECT *, len(list_filter(toks, lambda x: contains(x, '"') AND NOT regexp_matches(x, '^"[^"]*"$'))) > 0 AS bad_quote,
        list_transform(toks, lambda x: replace(x, '"', '')) AS tk,
        CASE WHEN file_kind LIKE 'predictions%' THEN 1 ELSE 0 END AS cf FROM t),
v AS (SELECT *, len(tk) - 1 - cf AS nc, list_transform(tk, lambda x: CASE WHEN regexp_matches(x, '{_DEC}') THEN TRY_CAST(x AS DOUBLE) END) AS num FROM u),
w AS (SELECT *, num[1] AS cls, list_slice(num, 2, len(num) - cf) AS co, num[len(num)] AS conf FROM v),
r AS (SELECT line_id, CASE
  WHEN bad_quote THEN 'quoting'
  WHEN (file_kind IN ('labels', 'predictions') AND nc <> 4) OR (file_kind IN ('labels-obb', 'predictions-obb') AND nc <> 8)
    OR (file_kind IN ('labels-seg', 'predictions-seg') AND (nc < 6 OR nc % 2 = 1)) THEN 'column_count'
  WHEN cls IS NULL OR isinf(cls) OR cls <> floor(cls) OR cls < 0 OR cls > 31 THEN 'bad_class'
  WHEN len(list_filter(co, lambda x: x IS NULL OR isinf(x))) > 0 THEN 'bad_number'
  WHEN len(list_filter(co, lambda x: x < 0 OR x > 1)) > 0 OR (file_kind IN ('labels', 'predictions') AND (co[3] <= 0 OR co[4] <= 0)) THEN 'out_of_range'
  WHEN cf = 1 AND (conf IS NULL OR isinf(conf) OR conf < 0 OR conf > 1) THEN 'bad_conf' END AS reason FROM w)
"""
_FOUND6 = "SELECT DISTINCT line_id, reason FROM r WHERE reason IS NOT NULL"
_TOTALS6 = """, g AS (SELECT w.line_id, any_value(w.file_kind) AS file_kind, CAST(any_value(cls) AS INTEGER) AS class_id, CAST(any_value(len(co)) AS INTEGER) AS n_coords,
  any_value(list_sum(list_transform(co, lambda x: round(x, 6)))) AS total, any_value(CASE WHEN cf = 1 THEN conf END) AS conf FROM w JOIN r ON r.line_id = w.line_id AND r.reason IS NULL GROUP BY w.line_id)
SELECT file_kind, class_id, n_coords, CAST(count(*) AS BIGINT) AS n, round(sum(total), 4) AS total, round(sum(round(conf, 6)), 4) AS conf FROM g GROUP BY ALL"""

# each flat object of a body is a record; the last one written of a run and index stays
_P7 = r"""
WITH f AS (SELECT DISTINCT fragment_id, run_id, modified_at, body FROM task_fragments WHERE body IS NOT NULL),
o AS (SELECT fragment_id, run_id, modified_at, unnest(regexp_extract_all(body, '\{[^{}]*\}')) AS obj, unnest(range(1, len(regexp_extract_all(body, '\{[^{}]*\}')) + 1)) AS rec_no FROM f),
k AS (SELECT *, CASE WHEN json_type(obj, '$.index') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(trim(json_extract_string(obj, '$.index')) AS DOUBLE) END AS ix FROM o),
r AS (SELECT *, CASE WHEN ix IS NULL OR isnan(ix) OR isinf(ix) THEN 1 ELSE row_number() OVER (PARTITION BY run_id, ix ORDER BY modified_at DESC NULLS LAST, fragment_id DESC, rec_no DESC) END AS rn FROM k)
"""
_P1 = r"""
WITH t AS (SELECT template_id, min(written_at) AS seen, min(writer) AS writer, any_value(body) AS body FROM scene_templates GROUP BY template_id),
j AS (SELECT template_id, seen, writer, body FROM t WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
i AS (SELECT template_id, unnest(from_json(json_extract(body, '$.instances'), '["json"]')) AS x FROM j WHERE json_type(body, '$.instances') = 'ARRAY'),
ob AS (SELECT template_id, 0 AS lv, 0 AS no, CAST(body AS JSON) AS o FROM j
  UNION ALL SELECT template_id, 1, row_number() OVER (), CASE WHEN json_type(x, '$.variation') = 'OBJECT' THEN json_extract(x, '$.variation') ELSE '{}'::JSON END FROM i WHERE json_type(x) = 'OBJECT'),
fl AS (SELECT template_id, lv, no, k, json_extract(o, '$."' || k || '"') AS v FROM (SELECT template_id, lv, no, o, unnest(json_keys(o)) AS k FROM ob)),
tg AS (SELECT *, CASE WHEN json_type(v) = 'ARRAY' AND json_array_length(v) = 2 AND json_type(v, '$[0]') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND json_type(v, '$[1]') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number_pair'
    WHEN json_type(v) IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN json_type(v) = 'VARCHAR' THEN 'string' WHEN json_type(v) = 'NULL' THEN 'null' ELSE 'other' END AS tag,
  CASE lv WHEN 0 THEN k NOT IN ('schema', 'version', 'canvas', 'instances', 'constraints', 'parameters')
    ELSE k NOT IN ('cx_range', 'cy_range', 'h_range', 'angle_range', 'enabled_probability', 'flip_probability', 'same_class_random', 'allow_overlap') END AS unknown FROM fl),
wt AS (SELECT * FROM (VALUES (0, 'schema', 'string', 'schema'), (0, 'version', 'integer', 'version'), (1, 'cx_range', 'number_pair', 'cxrange')) w(lv, base, want, folded)),
ow AS (SELECT ob.template_id, ob.lv, ob.no, wt.base, wt.want, wt.folded, tg.tag FROM ob JOIN wt USING (lv) LEFT JOIN tg ON tg.template_id = ob.template_id AND tg.lv = ob.lv AND tg.no = ob.no AND tg.k = wt.base),
ca AS (SELECT ow.*, tg.k, row_number() OVER (PARTITION BY ow.template_id, ow.lv, ow.no, ow.base ORDER BY
    CASE WHEN contains(regexp_replace(lower(tg.k), '[^a-z0-9]', '', 'g'), folded) OR (contains(folded, regexp_replace(lower(tg.k), '[^a-z0-9]', '', 'g')) AND regexp_replace(lower(tg.k), '[^a-z0-9]', '', 'g') <> '') THEN 0 ELSE 1 END,
    levenshtein(regexp_replace(lower(tg.k), '[^a-z0-9]', '', 'g'), folded), tg.k) AS rn
  FROM ow JOIN tg ON tg.template_id = ow.template_id AND tg.lv = ow.lv AND tg.no = ow.no AND tg.unknown AND tg.tag = ow.want WHERE ow.tag IS NULL),
rn AS (SELECT * FROM ca WHERE rn = 1),
ch AS (
  SELECT template_id, base AS field_name, 'renamed' AS change_kind FROM rn
  UNION SELECT ow.template_id, ow.base, CASE WHEN ow.tag IS NULL OR ow.tag = 'null' THEN 'removed' ELSE 'retyped' END FROM ow LEFT JOIN rn ON rn.template_id = ow.template_id AND rn.lv = ow.lv AND rn.no = ow.no AND rn.base = ow.base
    WHERE rn.base IS NULL AND (ow.tag IS NULL OR ow.tag <> ow.want)
  UNION SELECT tg.template_id, tg.k, 'added' FROM tg LEFT JOIN rn ON rn.template_id = tg.template_id AND rn.lv = tg.lv AND rn.no = tg.no AND rn.k = tg.k WHERE tg.unknown AND rn.k IS NULL)
"""

SQL = {
    "p4_found": _P4 + "SELECT annotation_id, ref_table, reason FROM o",
    "p4_counts": _P4 + "SELECT ref_table, reason, strftime(t, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL",
    "p1_found": _P1 + "SELECT template_id, field_name, change_kind FROM ch",
    "p1_changes_by_month": _P1 + "SELECT strftime(j.seen, '%Y-%m') AS month, j.writer, field_name, change_kind, CAST(count(*) AS BIGINT) AS n FROM ch JOIN j USING (template_id) GROUP BY ALL",
    "p1_unreadable": """WITH t AS (SELECT template_id, any_value(body) AS body FROM scene_templates GROUP BY template_id)
  SELECT template_id, CASE WHEN body IS NULL THEN 'null' WHEN trim(body) = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'not_json' ELSE 'not_an_object' END AS reason FROM t WHERE body IS NULL OR NOT json_valid(body) OR json_type(body) <> 'OBJECT'""",
    "p6_found": _P6 + _FOUND6,
    "p6_shape_totals": _P6 + _TOTALS6,
    "p7_found": _P7 + "SELECT fragment_id, CAST(rec_no AS INTEGER) AS rec_no FROM r WHERE rn > 1",
    "p7_compacted": _P7 + """SELECT run_id, CASE WHEN ix = floor(ix) THEN CAST(CAST(ix AS BIGINT) AS VARCHAR) ELSE CAST(ix AS VARCHAR) END AS index_key,
  CASE WHEN json_type(obj, '$.ok') = 'BOOLEAN' THEN CAST(json_extract_string(obj, '$.ok') AS BOOLEAN) END AS ok, json_extract_string(obj, '$.stem') AS stem,
  CASE WHEN json_type(obj, '$.objects') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN CASE WHEN TRY_CAST(trim(json_extract_string(obj, '$.objects')) AS DOUBLE) = floor(TRY_CAST(trim(json_extract_string(obj, '$.objects')) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(trim(json_extract_string(obj, '$.objects')) AS DOUBLE) AS BIGINT) END END AS objects,
  json_extract_string(obj, '$.error') AS error, fragment_id, CAST(rec_no AS INTEGER) AS rec_no FROM r WHERE rn = 1""",
}
