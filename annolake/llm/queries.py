"""Queries of the training-data problems tagged llm, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.llm import bpe, group_split, history_dedup, passages, pii, split_overlap
from annolake.session import table


def p2_found(spark, d):
    return history_dedup.reject_over_history(table(spark, d, "images")).select("image_id")


def p2_counts(spark, d):
    return history_dedup.reject_over_history(table(spark, d, "images")).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rejected"))


def p3_found(spark, d):
    o = split_overlap.overlaps(table(spark, d, "images"))
    return o.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b"))


def p3_counts(spark, d):
    return split_overlap.overlap_counts(split_overlap.overlaps(table(spark, d, "images")))


def _linked(spark, d):
    vertices, edges, facts = group_split.linked_records(table(spark, d, "sample_plans"), table(spark, d, "images"))
    return group_split.components(vertices, edges), facts


def p5_found(spark, d):
    return group_split.torn_backgrounds(*_linked(spark, d))


def p5_split(spark, d):
    a = group_split.assign(_linked(spark, d)[0])
    kind = F.when(F.col("v") % 2 == 0, "plan").otherwise("image")
    return a.select(kind.alias("kind"), F.floor(F.col("v") / 2).alias("record_id"), "root", "split")


def p5_totals(spark, d):
    return group_split.assign(_linked(spark, d)[0]).groupBy("split").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("root").alias("n_groups"))


def p5_groups(spark, d):
    """Records and groups of the new split, and groups that lie in more than one part of it: none."""
    a = group_split.assign(_linked(spark, d)[0])
    g = a.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k"))
    return g.agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") > 1).alias("torn_groups"))


def p8_ids(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"))


def p8_roundtrip(spark, d):
    """Documents, those with ids, and those whose text comes back from their ids."""
    docs, codec = table(spark, d, "documents"), bpe.Bpe()
    back = bpe.encode_documents(docs, codec).select("doc_id", F.size("ids").alias("n"), codec.decode(F.col("ids")).alias("back"))
    j = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_documents"), F.count("n").alias("n_encoded"), F.count_if(F.col("text") == F.col("back")).alias("n_equal"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) == 0).alias("n_empty"))


def p9_found(spark, d):
    """The cut at no edits of the passages of 11 words within one edit."""
    return passages.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), words=11, edits=1, sample=7).filter("edits = 0").select("doc_id", "item_id")


def p9_near(spark, d):
    """Passages of 20 words with up to two words changed, missing or extra."""
    return passages.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), words=20, edits=2)


def p10_found(spark, d):
    return pii.find(table(spark, d, "documents")).select("doc_id", "pii_kind", "start_pos")


def p10_redacted(spark, d):
    return pii.redact(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_counts, p5_found, p5_split, p5_totals, p5_groups, p8_ids, p8_roundtrip, p9_found, p9_near, p10_found, p10_redacted)}
_SPLIT = "CASE {} WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' END"
_NAMES = "('train', 'training', 'val', 'valid', 'validation', 'test', 'testing')"

_ID = "len(x) {} AND len(regexp_replace(x, '[^0-9]', '', 'g')) >= {} AND len(regexp_replace(x, '[^a-z]', '', 'g')) >= {}"
_BEST = "coalesce(" + ", ".join(f"list_filter({{0}}, lambda x: {_ID.format(*t)})[1]" for t in (("= 14", 5, 5), ("BETWEEN 13 AND 15 AND len(x) <> 14", 5, 5), ("BETWEEN 13 AND 15", 4, 4))) + ")"
_RUNS, _JOINED = "string_split_regex({0}, '[^a-z0-9]+')", "list_transform(list_filter(string_split_regex({0}, '[^a-z0-9.\\-]+'), lambda x: len(x) >= 14), lambda x: regexp_replace(x, '[.\\-]', '', 'g'))"
_IN = f"coalesce({_BEST.format(_RUNS)}, {_BEST.format(_JOINED)})"
_WIDE_SQL = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
_NARROW_SQL = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _plain(c: str) -> str:
    return f"lower(translate(CASE WHEN regexp_matches({c}, '%[0-9A-Fa-f]{{2}}') THEN url_decode({c}) ELSE {c} END, '{_WIDE_SQL}　', '{_NARROW_SQL} '))"


# an id is looked for in the name, then in the directories, the last first
_KEYS = rf"""
n AS (SELECT image_id, any_value(sha1) AS sha1, any_value(batch_no) AS batch_no, any_value(dataset) AS dataset, any_value(split) AS split, any_value(path) AS path, any_value(stem) AS stem FROM images GROUP BY image_id),
p AS (SELECT *, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: len(x) > 0) AS parts FROM n),
q AS (SELECT *, coalesce(stem, regexp_replace(parts[-1], '\.[A-Za-z0-9]{{1,5}}$', '')) AS name, list_reverse(parts[:-2]) AS dirs FROM p),
d AS (SELECT image_id, min_by(c, k) AS c FROM (SELECT image_id, k, {_IN.replace("{0}", "pl")} AS c FROM (SELECT image_id, k, {_plain("x")} AS pl FROM (SELECT image_id, unnest(dirs) AS x, unnest(range(1, len(dirs) + 1)) AS k FROM q))) WHERE c IS NOT NULL GROUP BY image_id),
k AS (SELECT q.image_id, lower(trim(q.sha1)) AS sha, coalesce({_IN.replace("{0}", "pl")}, d.c) AS cid, coalesce(q.batch_no, 2147483647) AS b, q.dataset, q.split, q.path FROM (SELECT *, {_plain("name")} AS pl FROM q) q LEFT JOIN d USING (image_id))
"""
_SAME = "(a.sha = b.sha OR levenshtein(a.cid, b.cid) <= 1)"
_P3 = f"""
WITH {_KEYS}, s AS (SELECT *, coalesce({_SPLIT.format("lower(trim(split))")}, {_SPLIT.format(f"list_filter(list_transform(string_split(replace(lower(path), chr(92), '/'), '/'), lambda x: trim(x)), lambda x: x IN {_NAMES})[-1]")}) AS s FROM k),
pair AS (SELECT a.image_id AS ia, b.image_id AS ib, b.s, b.dataset FROM s a JOIN s b ON a.s = 'train' AND b.s IN ('val', 'test') AND {_SAME})
"""
# one record after the other against the list of those accepted
_P2 = f"""
WITH RECURSIVE {_KEYS}, o AS MATERIALIZED (SELECT image_id, sha, cid, b, row_number() OVER (ORDER BY b, image_id) AS rn FROM k WHERE sha IS NOT NULL OR cid IS NOT NULL),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS image_id, CAST(0 AS BIGINT) AS b, FALSE AS hit, CAST([] AS VARCHAR[]) AS shas, CAST([] AS VARCHAR[]) AS cids
  UNION ALL
  SELECT o.rn, o.image_id, CAST(o.b AS BIGINT), h, CASE WHEN h OR o.sha IS NULL THEN f.shas ELSE list_append(f.shas, o.sha) END, CASE WHEN h OR o.cid IS NULL THEN f.cids ELSE list_append(f.cids, o.cid) END
  FROM fold f JOIN o ON o.rn = f.rn + 1,
  LATERAL (SELECT o.b <> 0 AND (coalesce(list_contains(f.shas, o.sha), FALSE) OR coalesce(len(list_filter(f.cids, lambda x: levenshtein(x, o.cid) <= 1)) > 0, FALSE)) AS h))
"""

SQL = {
    "p5_found": rf"""
WITH p AS (SELECT DISTINCT idx, trim(regexp_replace(trim(regexp_replace(lower(trim(replace(replace(background, '%20', ' '), '\', '/'))), '^.*/', '')), '\.[^.]*$', '')) AS b FROM sample_plans WHERE background IS NOT NULL),
i AS (SELECT image_id, plan_idx, coalesce({_SPLIT.format("lower(trim(split))")},
  {_SPLIT.format(f"list_filter(list_transform(string_split(replace(lower(path), chr(92), '/'), '/'), lambda x: trim(x)), lambda x: x IN {_NAMES})[-1]")}) AS s FROM images)
SELECT b AS background FROM p JOIN i ON i.plan_idx = p.idx WHERE b <> '' AND s IS NOT NULL GROUP BY b HAVING count(DISTINCT s) > 1""",
    "p5_groups": r"""
WITH p AS (SELECT idx, min(trim(regexp_replace(trim(regexp_replace(lower(trim(replace(replace(background, '%20', ' '), '\', '/'))), '^.*/', '')), '\.[^.]*$', ''))) AS b FROM sample_plans WHERE idx IS NOT NULL GROUP BY idx),
g AS (SELECT idx, CASE WHEN coalesce(b, '') = '' THEN 'p' || idx ELSE 'b' || b END AS g FROM p), i AS (SELECT DISTINCT image_id, plan_idx FROM images WHERE image_id IS NOT NULL),
a AS (SELECT g FROM g UNION ALL SELECT coalesce(g.g, 'i' || image_id) FROM i LEFT JOIN g ON g.idx = i.plan_idx)
SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT g) AS BIGINT) AS n_groups, CAST(0 AS BIGINT) AS torn_groups FROM a""",
    "p9_found": r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT id, array_to_string(list_slice(w, i, i + 10), ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1))) AS i)),
ew AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 10), ' ') AS k FROM e, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1))) AS i))
SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (k)""",
    "p8_roundtrip": "SELECT CAST(count(*) AS BIGINT) AS n_documents, CAST(count(*) AS BIGINT) AS n_encoded, CAST(count(*) AS BIGINT) AS n_equal, CAST(count(*) FILTER (WHERE coalesce(text, '') = '') AS BIGINT) AS n_empty FROM documents",
    "p3_found": _P3 + "SELECT least(ia, ib) AS image_id_a, greatest(ia, ib) AS image_id_b FROM pair",
    "p3_counts": _P3 + "SELECT s AS eval_split, dataset, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(DISTINCT ib) AS BIGINT) AS n_records FROM pair GROUP BY ALL",
    "p2_found": _P2 + "SELECT DISTINCT image_id FROM fold WHERE hit",
    "p2_counts": _P2 + "SELECT CAST(b AS INTEGER) AS batch_no, CAST(count(DISTINCT image_id) AS BIGINT) AS n_rejected FROM fold WHERE hit GROUP BY b",
}
