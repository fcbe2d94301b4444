"""The catalogue's queries as SQL for an independent engine."""

from __future__ import annotations

_IMG = "img AS (SELECT o_orderkey AS stem, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' WHEN 'P' THEN 'test' END AS split FROM orders)"
_BOX = """box AS (SELECT l_orderkey AS stem, l_returnflag AS label, l_linestatus AS st, l_quantity / 51 AS cx, l_extendedprice / 110000 AS cy,
  CAST(0.05 AS DOUBLE) + l_discount * 2 AS w, CAST(0.05 AS DOUBLE) + l_tax * 2 AS h,
  lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')
  || lpad(CAST(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR), 14, '0') || lpad(CAST(epoch_us(l_shipdate) AS VARCHAR), 18, '0') AS ord,
  CAST(l_partkey % 100 AS DOUBLE) / 100 AS conf FROM lineitem)"""
_SB = f"{_IMG}, {_BOX}, sb AS (SELECT box.*, split FROM box JOIN img USING (stem))"
_DOC = """doc AS (SELECT doc_id AS pos, sha1(text) AS digest, CASE WHEN doc_id % 10 <= 6 THEN 'train' WHEN doc_id % 10 <= 8 THEN 'val' ELSE 'test' END AS split,
  CAST(length(text) AS BIGINT) AS bytes FROM documents)"""
_HIST = """met AS (SELECT {keys}, m.metric AS metric, m.value AS value, m.hi AS hi FROM (SELECT {keys}, unnest([
  {{'metric': 'center_x', 'value': cx, 'hi': 1.0::DOUBLE}}, {{'metric': 'center_y', 'value': cy, 'hi': 1.0::DOUBLE}}, {{'metric': 'bottom_y', 'value': cy + greatest(1e-8, h) / 2, 'hi': 1.0::DOUBLE}},
  {{'metric': 'width', 'value': greatest(1e-8, w), 'hi': 1.0::DOUBLE}}, {{'metric': 'height', 'value': greatest(1e-8, h), 'hi': 1.0::DOUBLE}},
  {{'metric': 'area', 'value': greatest(1e-8, w) * greatest(1e-8, h), 'hi': 1.0::DOUBLE}}, {{'metric': 'aspect_ratio', 'value': greatest(1e-8, w) / greatest(1e-8, h), 'hi': 5.0::DOUBLE}}]) AS m FROM {src})),
cnt AS (SELECT {keys}, metric, CAST(least(19, greatest(0, floor(least(hi - 1e-12, greatest(0.0::DOUBLE, value)) / hi * 20))) AS INTEGER) AS bin, count(*) AS n FROM met GROUP BY ALL),
hist AS (SELECT g.*, CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT {keys}, metric FROM cnt) g CROSS JOIN range(20) b(bin)
  LEFT JOIN cnt ON {on} AND cnt.metric = g.metric AND cnt.bin = b.bin)"""
_IOU = """(greatest(0, least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2)) * greatest(0, least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2)))"""
_COS = "greatest(-1.0, least(1.0, list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-8) * (sqrt(list_dot_product(b.v, b.v)) + 1e-8))))"
_VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _bits(v: str) -> str:
    return f"(WITH RECURSIVE m AS (SELECT list_sort(list_slice({v}, 2, 64))[32] AS x) SELECT x FROM m)"


_COCO = """ci AS (SELECT id, max({'w': width, 'h': height}) AS s FROM coco_images WHERE width > 0 AND height > 0 GROUP BY id), cc AS (SELECT id, max(name) AS name FROM coco_categories GROUP BY id),
ca AS (SELECT id, any_value(image_id) AS image_id, any_value(category_id) AS category_id, any_value(bbox) AS b, any_value(area) AS area FROM coco_annotations GROUP BY id),
cb AS (SELECT ca.image_id, coalesce(cc.name, CAST(ca.category_id AS VARCHAR)) AS label, (b[1] + b[3] / 2) / s.w AS cx, (b[2] + b[4] / 2) / s.h AS cy, b[3] / s.w AS w, b[4] / s.h AS h,
  CASE WHEN area > 0 THEN least(1.0, area / greatest(1e-12, b[3] * b[4])) END AS vis FROM ca JOIN ci ON ci.id = ca.image_id LEFT JOIN cc ON cc.id = ca.category_id WHERE len(b) = 4 AND b[1] IS NOT NULL AND b[2] IS NOT NULL AND b[3] > 0 AND b[4] > 0 AND category_id IS NOT NULL)"""
_PHASH = f"""{_VEC}, ph0 AS (SELECT id AS pos, list_sum(list_transform(v, lambda x, i: CASE WHEN x > list_sort(list_slice(v, 2, 64))[32] THEN CASE WHEN i = 1 THEN -9223372036854775808::HUGEINT ELSE (2::HUGEINT ** (64 - i))::HUGEINT END ELSE 0::HUGEINT END))::BIGINT AS h FROM vec),
ph AS (SELECT pos, h FROM ph0 UNION ALL SELECT pos + 1000000000, xor(h, ((((511 & pos)::HUGEINT << (pos % 50)::INTEGER) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT) FROM ph0 WHERE pos % 5 = 0)"""
_GRID = "CAST(round_even(greatest(0, least(1, {})) * 255, 0) AS DOUBLE)"
_RECTS = "rect AS (SELECT *, " + ", ".join(f"{_GRID.format(e)} AS {n}" for n, e in (("x1", "cx - w / 2"), ("y1", "cy - h / 2"), ("x2", "cx + w / 2"), ("y2", "cy + h / 2"))) + " FROM box)"
_HARD = f"""
WITH RECURSIVE {_IMG}, {_BOX}, {_RECTS},
gt AS (SELECT *, CAST(row_number() OVER (PARTITION BY stem ORDER BY label_ord) - 1 AS INTEGER) AS gi FROM (SELECT *, ord AS label_ord FROM rect WHERE st = 'F')),
pr AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY conf DESC, ord) AS pi FROM rect WHERE st = 'O'),
pair AS (SELECT p.stem, p.pi, g.gi, i / (greatest(0, p.x2 - p.x1 + 1) * greatest(0, p.y2 - p.y1 + 1) + greatest(0, g.x2 - g.x1 + 1) * greatest(0, g.y2 - g.y1 + 1) - i) AS iou
  FROM pr p JOIN gt g ON p.stem = g.stem AND p.label = g.label,
  LATERAL (SELECT greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1) + 1) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1) + 1) AS i)),
cand AS (SELECT stem, pi, list({{'iou': iou, 'gi': gi}} ORDER BY iou DESC, gi) AS cs FROM pair WHERE iou > 0 GROUP BY ALL),
fold AS (
  SELECT stem, CAST(0 AS BIGINT) AS pi, CAST([] AS INTEGER[]) AS used, CAST(-1 AS INTEGER) AS gi, CAST(0 AS DOUBLE) AS iou, CAST(0 AS DOUBLE) AS conf, CAST('' AS VARCHAR) AS label FROM img
  UNION ALL
  SELECT f.stem, p.pi, CASE WHEN b.iou >= 0.1 THEN list_append(f.used, b.gi) ELSE f.used END, CASE WHEN b.iou >= 0.1 THEN b.gi ELSE -1 END, CASE WHEN b.iou >= 0.1 THEN b.iou ELSE 0 END, p.conf, p.label
  FROM fold f JOIN pr p ON p.stem = f.stem AND p.pi = f.pi + 1 LEFT JOIN cand c ON c.stem = p.stem AND c.pi = p.pi,
  LATERAL (SELECT list_filter(c.cs, lambda x: NOT list_contains(f.used, x.gi))[1] AS b)),
m AS (SELECT * FROM fold WHERE pi > 0),
agg AS (SELECT stem, count(*) AS pred, count(*) FILTER (WHERE gi >= 0) AS tp, count(*) FILTER (WHERE gi < 0 AND conf >= 0.25) AS fp, count(*) FILTER (WHERE gi >= 0 AND conf < 0.5) AS low_conf,
  count(*) FILTER (WHERE gi >= 0 AND iou < 0.75) AS poor_loc, coalesce(sum((0.75 - iou) / 0.75) FILTER (WHERE gi >= 0 AND iou < 0.75), 0) AS pen FROM m GROUP BY stem),
ng AS (SELECT stem, count(*) AS gt FROM gt GROUP BY stem),
base AS (SELECT stem, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(gt, 0) - coalesce(tp, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(low_conf, 0) AS low_conf, coalesce(poor_loc, 0) AS poor_loc, coalesce(pen, 0) AS pen
  FROM img LEFT JOIN agg USING (stem) LEFT JOIN ng USING (stem)),
sc AS (SELECT *, round(CAST(3 * fn + 2 * fp + low_conf + 1.5 * pen + CASE WHEN gt = 0 THEN fp ELSE 0 END AS DOUBLE), 6) AS score FROM base)
"""
_COMP = """WITH comp AS (SELECT o_orderkey AS stem, min(o_orderkey) OVER (PARTITION BY CASE WHEN o_custkey IS NULL THEN 'o' || o_orderkey ELSE 'c' || o_custkey END) AS gid FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders))
"""
_U = f"WITH {_VEC}, nn AS (SELECT a.id, max({_COS}) AS sim FROM vec a JOIN vec b ON a.id <> b.id GROUP BY a.id), u AS (SELECT greatest(0, least(1, 1 - sim)) AS u, sim FROM nn)"

SQL = {
    "label_class_rollup": f"WITH {_SB} SELECT coalesce(split, '*') AS split, coalesce(label, '*') AS label, CAST(count(*) AS BIGINT) AS n, CAST(grouping_id(split, label) AS INTEGER) AS level FROM sb GROUP BY ROLLUP (split, label)",
    "class_imbalance": f"WITH {_SB}, c AS (SELECT split, label, count(*) AS n FROM sb GROUP BY ALL) SELECT split, CASE WHEN count(*) >= 2 THEN CAST(max(n) AS DOUBLE) / greatest(1, min(n)) END AS imbalance, CAST(count(*) AS BIGINT) AS n_classes FROM c GROUP BY split",
    "label_line_validation": """
WITH l AS (SELECT CAST(l_quantity AS INTEGER) AS q, ascii(l_returnflag) AS c, l_tax AS t, l_discount AS dc FROM lineitem),
k AS (SELECT CASE WHEN q % 11 = 0 THEN 'unreadable' WHEN q % 13 = 0 THEN 'obb' ELSE 'detect' END AS kind, CASE WHEN q % 11 = 0 THEN 6 WHEN q % 13 = 0 THEN 9 ELSE 5 END AS n_tokens, q / 50.0 AS cx, t, dc, q / 40.0 AS h FROM l)
SELECT kind, n_tokens, CAST(count(*) FILTER (WHERE kind <> 'unreadable') AS BIGINT) AS n_objects,
  CAST(count(*) FILTER (WHERE CASE kind WHEN 'detect' THEN cx <= 1 AND t BETWEEN 0 AND 1 AND dc > 0 AND dc <= 1 AND h > 0 AND h <= 1 WHEN 'obb' THEN cx <= 1 AND h <= 1 AND t <= 1 AND dc <= 1 ELSE FALSE END) AS BIGINT) AS n_valid,
  CAST(count(*) AS BIGINT) AS n_lines FROM k GROUP BY kind, n_tokens""",
    "missing_labels": f"WITH {_IMG} SELECT * FROM img WHERE stem NOT IN (SELECT l_orderkey FROM lineitem)",
    "objects_per_image": f"WITH {_IMG}, c AS (SELECT stem, count(l_orderkey) AS c FROM img LEFT JOIN lineitem ON l_orderkey = stem GROUP BY stem) SELECT CAST(c AS BIGINT) AS n_objects, CAST(count(*) AS BIGINT) AS n_images FROM c GROUP BY c",
    "class_histograms": f"WITH {_BOX}, {_HIST.format(keys='label', src='box', on='cnt.label = g.label')} SELECT label, metric, bin, n FROM hist",
    "crowding_max_iou": f"""WITH {_BOX}, x AS (SELECT a.stem, a.ord, a.label, round(coalesce(max(CASE WHEN b.ord IS NOT NULL THEN i / greatest(1e-12, a.w * a.h + b.w * b.h - i) END), 0), 9) AS max_iou
  FROM box a LEFT JOIN box b ON a.stem = b.stem AND a.ord <> b.ord LEFT JOIN LATERAL (SELECT {_IOU} AS i) ON TRUE GROUP BY ALL)
  SELECT label, CAST(least(19, greatest(0, floor(least(1 - 1e-12, max_iou) * 20))) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(sum(max_iou), 4) AS total FROM x GROUP BY ALL""",
    "split_profile_distance": f"""WITH {_SB}, {_HIST.format(keys='split, label', src='sb', on='cnt.split = g.split AND cnt.label = g.label')},
  p AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER w ELSE 0 END AS p FROM hist WINDOW w AS (PARTITION BY split, label, metric)),
  t AS (SELECT a.label, a.metric, sum(abs(a.p - b.p)) / 2 AS tv FROM p a JOIN p b ON a.split = 'train' AND b.split = 'val' AND a.label = b.label AND a.metric = b.metric AND a.bin = b.bin GROUP BY ALL),
  c AS (SELECT split, label, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split) AS p FROM sb WHERE split IN ('train', 'val') GROUP BY split, label),
  ct AS (SELECT sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 AS tv FROM (SELECT * FROM c WHERE split = 'train') a FULL JOIN (SELECT * FROM c WHERE split = 'val') b ON a.label = b.label),
  oc AS (SELECT split, CAST(n AS INTEGER) AS k, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split) AS p FROM (SELECT img.split, stem, count(box.stem) AS n FROM (SELECT DISTINCT split, stem FROM img) img LEFT JOIN box USING (stem) GROUP BY ALL) WHERE split IN ('train', 'val') GROUP BY split, n),
  ot AS (SELECT sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 AS tv FROM (SELECT * FROM oc WHERE split = 'train') a FULL JOIN (SELECT * FROM oc WHERE split = 'val') b ON a.k = b.k)
  SELECT 'class' AS metric, round(tv, 9) AS distance FROM ct UNION ALL SELECT metric, round(avg(tv), 9) FROM t GROUP BY metric UNION ALL SELECT 'placement', round(avg(tv), 9) FROM t UNION ALL SELECT 'object_count', round(tv, 9) FROM ot""",
    "profile_histograms": f"""WITH {_BOX}, {_HIST.format(keys='label', src='box', on='cnt.label = g.label')},
  x AS (SELECT a.stem, a.ord, a.label, round(coalesce(max(CASE WHEN b.ord IS NOT NULL THEN i / greatest(1e-12, a.w * a.h + b.w * b.h - i) END), 0), 9) AS v FROM box a LEFT JOIN box b ON a.stem = b.stem AND a.ord <> b.ord LEFT JOIN LATERAL (SELECT {_IOU} AS i) ON TRUE GROUP BY ALL),
  o AS (SELECT label, CAST(least(19, floor(least(1 - 1e-12, v) * 20)) AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY ALL)
  SELECT label, metric, bin, n FROM hist
  UNION ALL SELECT l.label, 'overlap_iou', CAST(b.bin AS INTEGER), CAST(coalesce(o.n, 0) AS BIGINT) FROM (SELECT DISTINCT label FROM box) l CROSS JOIN range(20) b(bin) LEFT JOIN o ON o.label = l.label AND o.bin = b.bin
  UNION ALL SELECT l.label, 'visible_shape_fraction', CAST(b.bin AS INTEGER), CAST(0 AS BIGINT) FROM (SELECT DISTINCT label FROM box) l CROSS JOIN range(20) b(bin)""",
    "coco_profile": f"""WITH {_COCO}, q AS (SELECT label, round(cx, 9) AS cx, round(cy, 9) AS cy, round(w, 9) AS w, round(h, 9) AS h, round(vis, 9) AS vis FROM cb), {_HIST.format(keys='label', src='q', on='cnt.label = g.label')},
  o AS (SELECT label, CAST(least(19, floor(least(1 - 1e-12, vis) * 20)) AS INTEGER) AS bin, count(*) AS n FROM q WHERE vis IS NOT NULL GROUP BY ALL)
  SELECT label, metric, bin, n FROM hist UNION ALL SELECT l.label, 'visible_shape_fraction', CAST(b.bin AS INTEGER), CAST(coalesce(o.n, 0) AS BIGINT) FROM (SELECT DISTINCT label FROM q) l CROSS JOIN range(20) b(bin) LEFT JOIN o ON o.label = l.label AND o.bin = b.bin""",
    "coco_object_counts": f"WITH {_COCO}, n AS (SELECT i.id, count(cb.image_id) AS c FROM (SELECT DISTINCT id FROM coco_images) i LEFT JOIN cb ON cb.image_id = i.id GROUP BY i.id) SELECT CAST(c AS INTEGER) AS n_objects, CAST(count(*) AS BIGINT) AS n_images FROM n GROUP BY c",
    "profile_projection": f"WITH {_BOX}, c AS (SELECT label, count(*) AS n FROM box WHERE label IN ('A', 'R', 'none') GROUP BY label) SELECT label, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 9) AS p FROM c",
    "profile_mix_histograms": f"""WITH {_SB}, {_HIST.format(keys='split, label', src='sb', on='cnt.split = g.split AND cnt.label = g.label')},
  dom AS (SELECT * FROM hist WHERE split IN ('train', 'val')), sz AS (SELECT split, label, sum(n) AS n FROM dom WHERE metric = 'center_x' GROUP BY ALL),
  cw AS (SELECT split, label, CASE split WHEN 'train' THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END * n / sum(n) OVER (PARTITION BY split) AS cw FROM sz),
  m AS (SELECT label, metric, bin, sum(cw * CASE WHEN t > 0 THEN n / t ELSE 0 END) AS acc FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY split, label, metric) AS DOUBLE) AS t FROM dom) JOIN cw USING (split, label) GROUP BY ALL),
  k AS (SELECT label, greatest(1, round_even(sum(cw) * 100000, 0)) AS c FROM cw GROUP BY label)
  SELECT label, metric, bin, CAST(round_even(round(c * acc / sum(acc) OVER (PARTITION BY label, metric), 6), 0) AS BIGINT) AS n FROM m JOIN k USING (label)""",
    "profile_mix": f"""WITH {_SB}, c AS (SELECT split, label, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split) AS p FROM sb GROUP BY split, label),
  m AS (SELECT label, sum(p * CASE split WHEN 'train' THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END) AS p FROM c WHERE split IN ('train', 'val') GROUP BY label)
  SELECT label, round(p, 9) AS probability, CAST(greatest(1, round_even(p * 100000, 0)) AS BIGINT) AS n FROM m WHERE p > 0""",
    "exact_duplicates": f"WITH {_DOC}, f AS (SELECT digest, min(pos) AS owner FROM doc WHERE digest IS NOT NULL GROUP BY digest) SELECT pos, owner FROM doc JOIN f USING (digest) WHERE pos > owner",
    "cross_split_exact_leak": f"""WITH {_DOC}, o AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS so FROM doc WHERE digest IS NOT NULL),
  x AS (SELECT *, min(so) OVER (PARTITION BY digest) AS fo FROM o) SELECT pos, split, CASE fo WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS owner_split FROM x WHERE so > fo""",
    "phash_bits": f"WITH {_VEC}, m AS (SELECT id, v, list_sort(list_slice(v, 2, 64))[32] AS med FROM vec) SELECT id, list_aggregate(list_transform(v, lambda x: CASE WHEN x > med THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM m",
    "phash_band_candidates": f"""WITH {_PHASH}, p AS (SELECT a.pos, b.pos AS owner, bit_count(xor(a.h, b.h)) AS d FROM ph a JOIN ph b ON b.pos < a.pos)
  SELECT pos, arg_min(owner, d::BIGINT * 10000000000 + owner) AS owner, CAST(min(d) AS INTEGER) AS distance FROM p WHERE d <= 7 GROUP BY pos""",
    "cross_split_near_leak": f"""WITH {_PHASH}, s AS (SELECT pos, h, pos % 7 AS g, (pos // 5) % 3 AS so FROM ph),
  p AS (SELECT a.pos, a.so, b.pos AS owner, b.so AS oso, bit_count(xor(a.h, b.h)) AS d FROM s a JOIN s b ON b.so < a.so AND a.g <> b.g WHERE bit_count(xor(a.h, b.h)) <= 7),
  r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d, owner) AS rn FROM p)
  SELECT pos, ['train', 'val', 'test'][so + 1] AS split, owner, ['train', 'val', 'test'][oso + 1] AS owner_split, CAST(d AS INTEGER) AS distance FROM r WHERE rn = 1""",
    "perceptual_diversity": f"WITH {_PHASH} SELECT CAST(count(h) AS BIGINT) AS n, CAST(count(DISTINCT h) AS BIGINT) AS n_unique, round(CAST(count(DISTINCT h) AS DOUBLE) / count(h), 9) AS diversity FROM ph",
    "cross_split_embedding_leak": f"""WITH {_VEC}, p AS (SELECT a.id, a.id % 3 AS so, b.id AS best_id, b.id % 3 AS oso, {_COS} AS sim FROM vec a JOIN vec b ON b.id % 3 < a.id % 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY id, oso ORDER BY sim DESC, best_id) AS rn FROM p)
  SELECT id, ['train', 'val', 'test'][so + 1] AS split, best_id, ['train', 'val', 'test'][oso + 1] AS owner_split, round(sim, 6) AS sim FROM r WHERE rn = 1 AND sim >= 0.4""",
    "uniqueness_summary": f"{_U} SELECT CAST(count(*) AS BIGINT) AS samples, round(avg(u), 6) AS mean_uniqueness, round(quantile_cont(u, 0.5), 6) AS median_uniqueness, round(quantile_cont(u, 0.1), 6) AS p10, round(quantile_cont(u, 0.9), 6) AS p90, round(avg(sim), 6) AS mean_nearest FROM u",
    "domain_compare": f"""WITH {_VEC}, nn AS (SELECT a.id, max({_COS}) AS sim FROM vec a JOIN vec b ON a.label >= 5 AND b.label < 5 GROUP BY a.id),
  c AS (SELECT label < 5 AS real, i, avg(v[i]) AS x FROM vec, range(1, 65) t(i) GROUP BY ALL),
  k AS (SELECT sum(a.x * b.x) AS ab, sqrt(sum(a.x * a.x)) AS na, sqrt(sum(b.x * b.x)) AS nb FROM c a JOIN c b ON a.i = b.i AND a.real AND NOT b.real)
  SELECT CAST((SELECT count(*) FROM nn) AS BIGINT) AS n, (SELECT round(avg(sim), 6) FROM nn) AS mean_nn, (SELECT round(quantile_cont(sim, 0.1), 6) FROM nn) AS p10_nn, (SELECT round(quantile_cont(sim, 0.9), 6) FROM nn) AS p90_nn,
  (SELECT round(ab / (na * nb), 6) FROM k) AS centroid_cosine""",
    "diverse_subset": f"""WITH RECURSIVE {_VEC}, n AS (SELECT id, v FROM vec WHERE v IS NOT NULL),
  m AS (SELECT i, avg(v[i]) AS x FROM n, range(1, 65) t(i) GROUP BY i), c AS (SELECT list(x / ((SELECT sqrt(sum(x * x)) FROM m) + 1e-8) ORDER BY i) AS c FROM m),
  s AS (SELECT CAST(0 AS INTEGER) AS rank, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS vs, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS score
    UNION ALL SELECT s.rank + 1, list_append(s.ids, b.id), list_append(s.vs, b.v), b.id, b.far FROM s,
    LATERAL (SELECT n.id, n.v, CASE WHEN s.rank = 0 THEN 1 - list_dot_product(n.v, c.c) ELSE list_min(list_transform(s.vs, lambda w: 1 - list_dot_product(n.v, w))) END AS far FROM n, c WHERE NOT list_contains(s.ids, n.id) ORDER BY far DESC, n.id LIMIT 1) b WHERE s.rank < 20)
  SELECT rank, id, round(CASE WHEN rank = 1 THEN score ELSE greatest(0.0, score) END, 6) AS score FROM s WHERE rank > 0""",
    "hard_example_scores": _HARD + "SELECT stem, CAST(gt AS INTEGER) AS gt, CAST(pred AS INTEGER) AS pred, CAST(fn AS INTEGER) AS fn, CAST(fp AS INTEGER) AS fp, CAST(low_conf AS INTEGER) AS low_conf, CAST(poor_loc AS INTEGER) AS poor_loc, score FROM sc",
    "hard_example_topk": _HARD + """SELECT stem, score, array_to_string(list_filter([CASE WHEN fn > 0 THEN 'FN:' || fn END, CASE WHEN fp > 0 THEN 'FP:' || fp END, CASE WHEN low_conf > 0 THEN 'low-conf:' || low_conf END, CASE WHEN poor_loc > 0 THEN 'geometry:' || poor_loc END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM sc WHERE score > 0 ORDER BY score DESC, stem LIMIT 50""",
    "fn_fp_by_class": _HARD + """, f AS (SELECT g.label, 1 AS fn, 0 AS fp FROM gt g ANTI JOIN (SELECT stem, gi FROM m WHERE gi >= 0) u ON u.stem = g.stem AND u.gi = g.gi UNION ALL SELECT label, 0, 1 FROM m WHERE gi < 0 AND conf >= 0.25)
  SELECT label, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp FROM f GROUP BY label""",
    "source_reuse": "WITH r AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(n) AS BIGINT) AS max_images, CAST(sum(n) AS BIGINT) AS total FROM r",
    "customer_groups": _COMP + "SELECT stem, gid FROM comp",
    "source_aware_split": _COMP + """, g AS (SELECT gid, count(*) AS size, substr(sha256('42:' || gid), 1, 16) AS h FROM comp GROUP BY gid),
  r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size, h, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, round_even(sum(size) OVER () * 0.2::DOUBLE, 0) AS target FROM g)
  SELECT gid, CAST(size AS BIGINT) AS size, CASE WHEN before < target AND size <= 2 * (target - before) THEN 'val' ELSE 'train' END AS split FROM r""",
    "split_leak_sources": f"WITH {_IMG} SELECT l_suppkey AS source FROM lineitem JOIN img ON stem = l_orderkey WHERE l_suppkey IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "merge_dense_ids": """
WITH i AS (SELECT part, id AS old, row_number() OVER (ORDER BY part, id) AS id FROM (SELECT DISTINCT id % 2 AS part, id FROM coco_images)),
c0 AS (SELECT 0 AS part, id, any_value(name) AS name FROM coco_categories GROUP BY id), f AS (SELECT name, min(id) AS old FROM c0 GROUP BY name),
c AS (SELECT name, row_number() OVER (ORDER BY old) AS id FROM f),
a AS (SELECT id % 1 AS z, * FROM (SELECT image_id % 2 AS part, id AS old, any_value(image_id) AS oi, any_value(category_id) AS oc FROM coco_annotations WHERE image_id IS NOT NULL GROUP BY image_id % 2, id)
  JOIN (SELECT 1 AS id) ON TRUE),
k AS (SELECT a.part, a.old, i.id AS image_id, c.id AS category_id FROM a JOIN i ON i.part = a.part AND i.old = a.oi JOIN c0 ON c0.id = a.oc JOIN c ON c.name = c0.name),
n AS (SELECT *, row_number() OVER (ORDER BY part, old) AS id FROM k)
SELECT n.category_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(image_id) AS BIGINT) AS sum_images, max(n.id) AS last_id, c.name FROM n JOIN c ON c.id = n.category_id GROUP BY n.category_id, c.name""",
    "shard_by_count": f"WITH {_DOC}, s AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY pos) - 1) // 40 AS shard FROM doc) SELECT split, CAST(shard AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n, min(pos) AS first, max(pos) AS last FROM s GROUP BY split, shard",
    "shard_by_bytes": f"""WITH RECURSIVE {_DOC}, o AS (SELECT split, pos, coalesce(bytes, 0) AS bytes, row_number() OVER (PARTITION BY split ORDER BY pos) AS rn FROM doc),
  s AS (SELECT split, pos, rn, CAST(0 AS BIGINT) AS shard, CAST(1 AS BIGINT) AS k, bytes AS used FROM o WHERE rn = 1
    UNION ALL SELECT o.split, o.pos, o.rn, CASE WHEN nw THEN s.shard + 1 ELSE s.shard END, CASE WHEN nw THEN 1 ELSE s.k + 1 END, CASE WHEN nw THEN o.bytes ELSE s.used + o.bytes END
    FROM s JOIN o ON o.split = s.split AND o.rn = s.rn + 1, LATERAL (SELECT s.k >= 100 OR s.used + o.bytes > 20000 AS nw))
  SELECT split, shard, CAST(count(*) AS BIGINT) AS n, min(pos) AS first, max(pos) AS last FROM s GROUP BY split, shard""",
    "coco_validity": """WITH a AS (SELECT id, any_value(image_id) AS image_id, any_value(area) AS area, any_value(segmentation) AS seg FROM coco_annotations GROUP BY id)
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE image_id IS NULL OR image_id NOT IN (SELECT id FROM coco_images)) AS BIGINT) AS unknown_image,
  CAST(count(*) FILTER (WHERE area IS NULL OR area <= 0) AS BIGINT) AS no_area, CAST(count(*) FILTER (WHERE seg IS NULL OR len(seg) = 0) AS BIGINT) AS no_segmentation FROM a""",
    "run_state_counts": "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n FROM r WHERE rn = 1 GROUP BY 1",
    "task_seeds": "SELECT DISTINCT o_orderkey AS idx, CAST((42 * 1000003 + o_orderkey * 9176 + 99537187) & 4294967295 AS BIGINT) AS seed FROM orders",
    "qa_warnings": f"""WITH {_SB}, {_DOC}, m AS (SELECT count(*) AS missing FROM img WHERE stem NOT IN (SELECT l_orderkey FROM lineitem)),
  du AS (SELECT coalesce(sum(c - 1), 0) AS duplicates FROM (SELECT count(*) AS c FROM doc WHERE digest IS NOT NULL GROUP BY digest)),
  le AS (SELECT count(*) AS leaks FROM (SELECT CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS so, min(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) OVER (PARTITION BY digest) AS fo FROM doc WHERE digest IS NOT NULL) WHERE so > fo),
  im AS (SELECT round(max(i), 6) AS imbalance FROM (SELECT split, CAST(max(n) AS DOUBLE) / greatest(1, min(n)) AS i FROM (SELECT split, label, count(*) AS n FROM sb GROUP BY ALL) GROUP BY split HAVING count(*) >= 2)),
  w AS (SELECT CAST(missing AS BIGINT) AS missing, CAST(duplicates AS BIGINT) AS duplicates, CAST(leaks AS BIGINT) AS leaks, imbalance,
    list_filter([CASE WHEN missing > 0 THEN 'missing_labels' END, CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN leaks > 0 THEN 'leakage' END, CASE WHEN imbalance > 10 THEN 'imbalance' END], lambda x: x IS NOT NULL) AS ws FROM m, du, le, im)
  SELECT missing, duplicates, leaks, imbalance, array_to_string(ws, ',') AS warnings, CASE WHEN len(ws) > 0 THEN 'warning' ELSE 'ok' END AS health FROM w""",
    "visibility_diagnostics": f"""WITH {_BOX}, v AS (SELECT label, round((greatest(0, least(1, cx + w / 2)) - greatest(0, least(1, cx - w / 2))) * (greatest(0, least(1, cy + h / 2)) - greatest(0, least(1, cy - h / 2))) / (w * h), 9) AS v FROM box)
  SELECT label, CAST(least(9, greatest(0, floor(least(1 - 1e-12, greatest(0, v)) * 10))) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS least FROM v GROUP BY ALL""",
    "template_constraints": f"""WITH {_IMG}, {_BOX}, f AS (SELECT stem, label, arg_min(cx, ord) AS cx, arg_min(cy, ord) AS cy FROM box WHERE stem IN (SELECT stem FROM img) GROUP BY ALL)
  SELECT a.cx + 0.05 < b.cx AND round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 9) <= 0.6 AS satisfied, CAST(count(*) AS BIGINT) AS n FROM f a JOIN f b ON a.stem = b.stem AND a.label = 'A' AND b.label = 'N' GROUP BY 1""",
    "background_cycle": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM (SELECT DISTINCT o_orderkey FROM orders)), k AS (SELECT count(DISTINCT s_suppkey) AS n FROM supplier),
  c AS (SELECT DISTINCT idx // n AS cycle FROM o, k), p AS (SELECT cycle, s_suppkey, row_number() OVER (PARTITION BY cycle ORDER BY sha256('42:' || cycle || ':' || s_suppkey), s_suppkey) - 1 AS slot FROM c CROSS JOIN (SELECT DISTINCT s_suppkey FROM supplier))
  SELECT o.o_orderkey, CAST(o.idx // n AS BIGINT) AS cycle, CAST(o.idx % n AS BIGINT) AS slot, p.s_suppkey FROM o, k JOIN p ON p.cycle = o.idx // n AND p.slot = o.idx % n""",
    "box_validity": f"""WITH {_BOX}, p AS (SELECT label, round_even((cx - w / 2) * 1000, 0) AS x1, round_even((cy - h / 2) * 800, 0) AS y1, round_even((cx + w / 2) * 1000, 0) AS x2, round_even((cy + h / 2) * 800, 0) AS y2 FROM box),
  c AS (SELECT *, greatest(0, least(x1, 1000)) AS a1, greatest(0, least(y1, 800)) AS b1, greatest(0, least(x2, 1000)) AS a2, greatest(0, least(y2, 800)) AS b2 FROM p)
  SELECT label, a2 - a1 >= 60 AND b2 - b1 >= 30 AND CASE WHEN (x2 - x1) * (y2 - y1) > 0 THEN greatest(0, a2 - a1) * greatest(0, b2 - b1) / (greatest(0, x2 - x1) * greatest(0, y2 - y1)) ELSE 0 END >= 0.9::DOUBLE AS valid, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""",
    "polygon_measures": f"WITH {_BOX} SELECT label, CAST(count(*) AS BIGINT) AS n, round(sum(round(w * h / 2, 9)), 4) AS area, round(avg(cx), 6) AS cx, round(avg(h), 6) AS h FROM box GROUP BY label",
    "label_text": f"""WITH {_BOX}, r AS (SELECT *, [floor((cx - w / 2) * 10000) / 10000, floor((cy - h / 2) * 10000) / 10000, floor((cx + w / 2) * 10000) / 10000, floor((cy - h / 2) * 10000) / 10000, floor((cx + w / 2) * 10000) / 10000, floor((cy + h / 2) * 10000) / 10000, floor((cx - w / 2) * 10000) / 10000, floor((cy + h / 2) * 10000) / 10000] AS p FROM box)
  SELECT stem, ord, printf('%d %.6f %.6f %.6f %.6f', ascii(label), floor((cx) * 10000) / 10000, floor((cy) * 10000) / 10000, floor((w) * 10000) / 10000, floor((h) * 10000) / 10000) AS line, ascii(label) || ' ' || array_to_string(list_transform(p, lambda x: printf('%.6f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)))), ' ') AS polygon FROM r""",
    "source_keys": r"""SELECT CASE WHEN trim(coalesce(path, '')) <> '' THEN regexp_extract(path, '([^/\\]+)$', 1) || '#' || coalesce(CAST(plan_idx AS VARCHAR), '0') ELSE '' END AS key, CAST(count(*) AS BIGINT) AS n FROM images GROUP BY 1""",
    "zone_labels": """WITH l AS (SELECT unnest(['Zone: ' || n_name, 'paste_zone:' || n_name, '地面:' || n_name, 'tree:' || n_name, 'ROAD:a:' || n_name, ' Ground ', 'zone', '可粘贴区域']) AS label FROM nation)
  SELECT label, CASE WHEN label LIKE 'Zone:%' OR label LIKE 'paste_zone:%' OR label LIKE '地面:%' THEN trim(substr(label, instr(label, ':') + 1)) WHEN label LIKE 'ROAD:%' THEN trim(substr(label, 6)) WHEN label IN (' Ground ', '可粘贴区域') THEN '' END AS zone, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ALL""",
    "prediction_confidences": """WITH l AS (SELECT DISTINCT line_id, file_kind, raw_line FROM label_lines WHERE file_kind LIKE 'predictions%' AND raw_line IS NOT NULL),
  t AS (SELECT CASE file_kind WHEN 'predictions' THEN 'detect' WHEN 'predictions-obb' THEN 'obb' ELSE 'seg' END AS task, regexp_extract_all(raw_line, '[^ \t\r\n]+') AS tk FROM l),
  n AS (SELECT task, list_transform(tk, lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM t WHERE len(tk) > 0 AND len(list_filter(tk, lambda x: TRY_CAST(x AS DOUBLE) IS NULL OR isnan(TRY_CAST(x AS DOUBLE)))) = 0),
  c AS (SELECT task, len(v) - 1 AS k, v, CASE task WHEN 'detect' THEN 4 WHEN 'obb' THEN 8 END AS f FROM n),
  r AS (SELECT task, CASE WHEN f IS NOT NULL THEN f WHEN k >= 7 AND k % 2 = 1 THEN k - 1 ELSE k END AS m, CASE WHEN f IS NOT NULL THEN CASE WHEN k > f THEN v[f + 2] ELSE 1.0 END WHEN k >= 7 AND k % 2 = 1 THEN v[len(v)] ELSE 1.0 END AS conf FROM c WHERE k >= coalesce(f, 0))
  SELECT task, CAST(m AS INTEGER) AS n_values, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN abs(conf) < 1e6 THEN round(conf, 6) END), 4) AS conf FROM r WHERE task <> 'seg' OR (m >= 6 AND m % 2 = 0) GROUP BY ALL""",
    "slot_relations": f"""WITH {_BOX}, f AS (SELECT stem, label, arg_min(cx, ord) AS cx, arg_min(cy, ord) AS cy FROM box GROUP BY ALL), j AS (SELECT a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS b_y, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 9) AS d FROM f a JOIN f b ON a.stem = b.stem AND a.label = 'A' AND b.label = 'N')
  SELECT CAST(count(*) FILTER (WHERE ax < bx) AS BIGINT) AS left_of, CAST(count(*) FILTER (WHERE ax > bx) AS BIGINT) AS right_of, CAST(count(*) FILTER (WHERE ay < b_y) AS BIGINT) AS above, CAST(count(*) FILTER (WHERE ay > b_y) AS BIGINT) AS below,
    CAST(count(*) FILTER (WHERE d >= 0.3) AS BIGINT) AS min_distance, CAST(count(*) FILTER (WHERE d <= 0.3) AS BIGINT) AS max_distance, round(avg(0.08::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ay - 0.35::DOUBLE) / 0.6::DOUBLE)) * 0.24::DOUBLE), 6) AS mean_height FROM j""",
    "class_names": """WITH a AS (SELECT id, any_value(category_id) AS category_id FROM coco_annotations GROUP BY id), c AS (SELECT id, max(name) AS name FROM coco_categories GROUP BY id)
  SELECT coalesce(c.name, CAST(a.category_id AS VARCHAR), 'none') AS label, CAST(count(*) AS BIGINT) AS n FROM a LEFT JOIN c ON c.id = a.category_id GROUP BY 1""",
    "object_count_hints": """WITH f AS (SELECT 'p' || idx AS stem, max(n_objects) AS n FROM sample_plans WHERE idx IS NOT NULL AND n_objects IS NOT NULL GROUP BY 1),
  t AS (SELECT stem, count(*) FILTER (WHERE trim(replace(coalesce(raw_line, ''), chr(9), ' '), ' ' || chr(10) || chr(13)) <> '') AS n FROM (SELECT DISTINCT line_id, stem, raw_line FROM label_lines WHERE stem IS NOT NULL) GROUP BY stem),
  i AS (SELECT id, min(stem) AS stem FROM coco_images WHERE stem IS NOT NULL GROUP BY id), c AS (SELECT i.stem, count(a.id) AS n FROM i LEFT JOIN (SELECT DISTINCT id, image_id FROM coco_annotations) a ON a.image_id = i.id GROUP BY i.stem),
  u AS (SELECT stem, n, 1 AS p FROM f UNION ALL SELECT stem, n, 2 FROM t UNION ALL SELECT stem, n, 3 FROM c)
  SELECT stem, CAST(arg_min(n, p) AS BIGINT) AS n_objects, CAST(min(p) AS INTEGER) AS source FROM u GROUP BY stem""",
    "label_file_kinds": """WITH l AS (SELECT DISTINCT line_id, split, stem, file_kind, line_no, raw_line FROM label_lines WHERE file_kind IN ('labels', 'labels-obb', 'labels-seg')),
  t AS (SELECT *, regexp_extract_all(raw_line, '[^ \t\r\n]+') AS tk FROM l WHERE raw_line IS NOT NULL),
  n AS (SELECT *, len(tk) AS k, len(list_filter(tk, lambda x: TRY_CAST(x AS DOUBLE) IS NULL OR isnan(TRY_CAST(x AS DOUBLE)) OR isinf(TRY_CAST(x AS DOUBLE)))) = 0 AS ok FROM t WHERE len(tk) > 0),
  g AS (SELECT file_kind, split, stem, CASE WHEN k = 5 THEN 'detect' WHEN k = 9 THEN 'obb' WHEN k >= 7 AND k % 2 = 1 THEN 'seg' ELSE 'unknown' END AS kind, count(*) AS n, min(line_no) AS first FROM n WHERE ok GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY file_kind, split, stem ORDER BY n DESC, first NULLS LAST) AS rn FROM g)
  SELECT file_kind, kind, CAST(count(*) AS BIGINT) AS n_files FROM r WHERE rn = 1 GROUP BY ALL""",
    "sample_payloads": """WITH i AS (SELECT DISTINCT o_orderkey AS stem FROM orders), d AS (SELECT DISTINCT l_orderkey AS stem FROM lineitem WHERE l_linestatus = 'F'), s AS (SELECT DISTINCT l_orderkey AS stem FROM lineitem WHERE l_linestatus = 'O'),
  c AS (SELECT DISTINCT id AS stem FROM coco_images), m AS (SELECT DISTINCT doc_id AS stem FROM documents WHERE text IS NOT NULL)
  SELECT array_to_string(list_filter([CASE WHEN d.stem IS NOT NULL THEN 'detect.txt' END, CASE WHEN s.stem IS NOT NULL THEN 'seg.txt' END, CASE WHEN m.stem IS NOT NULL THEN 'semantic.png' END, CASE WHEN c.stem IS NOT NULL THEN 'coco.json' END], lambda x: x IS NOT NULL), ',') AS modalities,
  CAST(count(*) AS BIGINT) AS n, min(i.stem) AS first FROM i LEFT JOIN d USING (stem) LEFT JOIN s USING (stem) LEFT JOIN c USING (stem) LEFT JOIN m USING (stem) GROUP BY 1""",
    "merged_logs": """WITH l AS (SELECT l_orderkey AS s, l_suppkey AS b, l_partkey AS p, l_linenumber AS k, l_returnflag AS lb, l_linestatus AS st FROM lineitem)
  SELECT CASE st WHEN 'F' THEN 'old' ELSE 'new set' END AS dataset, CASE st WHEN 'F' THEN '01_old_' ELSE '02_new_set_' END || s AS stem, CAST(b AS VARCHAR) AS background, lb AS label, CASE st WHEN 'F' THEN p || '.json' ELSE '' END AS source_json,
    CASE st WHEN 'F' THEN CAST(k AS VARCHAR) ELSE '0' END AS shape_index, CASE st WHEN 'F' THEN 'True' ELSE 'False' END AS flip, CAST(count(*) AS BIGINT) AS n FROM l WHERE st IN ('F', 'O') GROUP BY ALL""",
    "split_transfer": _COMP.replace("WITH comp", "WITH comp0") + """, g AS (SELECT gid, count(*) AS size, substr(sha256('42:' || gid), 1, 16) AS h FROM comp0 GROUP BY gid),
  r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size, h, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, round_even(sum(size) OVER () * 0.2::DOUBLE, 0) AS target FROM g),
  v AS (SELECT stem FROM comp0 JOIN r USING (gid) WHERE before < target AND size <= 2 * (target - before)),
  f AS (SELECT DISTINCT o_orderkey AS stem, 'images' AS modality, '.jpg' AS ext FROM orders UNION SELECT DISTINCT l_orderkey, 'labels', '.txt' FROM lineitem)
  SELECT modality, CASE WHEN stem IN (SELECT stem FROM v) THEN 'val' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, min('/d/' || modality || '/' || CASE WHEN stem IN (SELECT stem FROM v) THEN 'val' ELSE 'train' END || '/' || stem || ext) AS first FROM f GROUP BY ALL""",
    "split_summary": _COMP.replace("WITH comp", "WITH comp0") + """, g AS (SELECT gid, count(*) AS size, substr(sha256('42:' || gid), 1, 16) AS h FROM comp0 GROUP BY gid),
  r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size, h, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, round_even(sum(size) OVER () * 0.2::DOUBLE, 0) AS target FROM g),
  s AS (SELECT *, before < target AND size <= 2 * (target - before) AS val FROM r)
  SELECT CAST(sum(size) AS BIGINT) AS total_images, CAST(count(*) AS BIGINT) AS source_groups, CAST(sum(size) FILTER (WHERE NOT val) AS BIGINT) AS train, CAST(coalesce(sum(size) FILTER (WHERE val), 0) AS BIGINT) AS val, CAST(0.2 AS DOUBLE) AS target_val_ratio,
    round(CAST(coalesce(sum(size) FILTER (WHERE val), 0) AS DOUBLE) / sum(size), 9) AS actual_val_ratio, CAST(0 AS BIGINT) AS source_leaks FROM s""",
    "label_class_map": "WITH l AS (SELECT DISTINCT trim(p_type) AS label FROM part WHERE trim(coalesce(p_type, '')) <> '') SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS class_id FROM l",
    "finalized_log": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), done AS (SELECT user_id FROM r WHERE rn = 1 AND event_type = 'purchase' AND user_id IS NOT NULL)
  SELECT CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS line, CAST(o_orderkey AS VARCHAR) AS generated_stem, CAST(l_suppkey AS VARCHAR) AS background, l_returnflag AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT user_id FROM done)""",
    "effect_counts": """WITH e AS (SELECT unnest([l_returnflag, l_linestatus]) AS effect FROM lineitem) SELECT effect, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, effect) AS place FROM e WHERE effect IS NOT NULL GROUP BY effect""",
    "counter_maps": f"WITH {_SB}, c AS (SELECT split, label, count(*) AS n FROM sb GROUP BY ALL) SELECT split, '{{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}}' AS counts FROM c GROUP BY split",
    "duplicate_examples": f"""WITH {_DOC}, f AS (SELECT digest, min(pos) AS owner FROM doc WHERE digest IS NOT NULL GROUP BY digest), x AS (SELECT split, pos, owner, row_number() OVER (PARTITION BY split ORDER BY pos) AS rn FROM doc JOIN f USING (digest) WHERE pos > owner)
  SELECT split, CAST(max(c) AS BIGINT) AS n, array_to_string(list(pos || '=' || owner ORDER BY pos) FILTER (WHERE rn <= 10), ',') AS examples FROM (SELECT *, count(*) OVER (PARTITION BY split) AS c FROM x) GROUP BY split""",
    "segmentation_label_faults": """WITH l AS (SELECT DISTINCT line_id, split, stem, line_no, raw_line FROM label_lines WHERE file_kind = 'labels-seg'),
  t AS (SELECT *, regexp_extract_all(coalesce(raw_line, ''), '[^ \t\r\n]+') AS tk FROM l),
  n AS (SELECT *, len(tk) AS k, len(list_filter(tk, lambda x: TRY_CAST(x AS DOUBLE) IS NULL OR isnan(TRY_CAST(x AS DOUBLE)) OR isinf(TRY_CAST(x AS DOUBLE)))) = 0 AS ok, list_transform(tk[2:], lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM t WHERE len(tk) > 0),
  m AS (SELECT split, stem, line_no, ok, CASE WHEN k = 5 THEN 'detect' WHEN k = 9 THEN 'obb' WHEN k >= 7 AND k % 2 = 1 THEN 'seg' ELSE 'unknown' END AS kind,
    ok AND CASE WHEN k = 5 THEN v[1] BETWEEN 0 AND 1 AND v[2] BETWEEN 0 AND 1 AND v[3] > 0 AND v[3] <= 1 AND v[4] > 0 AND v[4] <= 1 WHEN k = 9 OR (k >= 7 AND k % 2 = 1) THEN len(list_filter(v, lambda x: x < 0 OR x > 1)) = 0 ELSE FALSE END AS valid FROM n),
  f AS (SELECT split, stem, count(*) FILTER (WHERE ok) AS objects, count(*) FILTER (WHERE NOT valid) AS bad FROM m GROUP BY ALL),
  g AS (SELECT split, stem, kind, count(*) AS n, min(line_no) AS first FROM m WHERE ok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split, stem ORDER BY n DESC, first NULLS LAST) AS rn FROM g),
  a AS (SELECT DISTINCT split, stem FROM l)
  SELECT CAST(count(*) AS BIGINT) AS label_files, CAST(sum(coalesce(objects, 0)) AS BIGINT) AS objects, CAST(sum(coalesce(bad, 0) + CASE WHEN r.kind IS NOT NULL AND r.kind <> 'seg' THEN 1 ELSE 0 END) AS BIGINT) AS invalid
  FROM a LEFT JOIN f ON f.split IS NOT DISTINCT FROM a.split AND f.stem IS NOT DISTINCT FROM a.stem LEFT JOIN r ON r.rn = 1 AND r.split IS NOT DISTINCT FROM a.split AND r.stem IS NOT DISTINCT FROM a.stem""",
    "pending_tasks": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  SELECT DISTINCT c_custkey AS idx FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM r WHERE rn = 1 AND event_type = 'purchase' AND user_id IS NOT NULL)""",
    "coco_subset": """WITH c AS (SELECT DISTINCT id FROM coco_images WHERE (length(stem) + id) % 5 = 0),
  a AS (SELECT id, any_value(image_id) AS image_id, any_value(category_id) AS category_id, any_value(area) AS area FROM coco_annotations GROUP BY id)
  SELECT category_id, CAST(count(*) AS BIGINT) AS n, round(sum(round(area, 1)), 1) AS area FROM a WHERE image_id IN (SELECT id FROM c) GROUP BY category_id""",
}
