"""Queries of the annotation-dataset operators over the driver's tables; see BINDINGS.

The relational tables stand in for annotation data: an order is an image (its status the split), a
line item a box, a document's text a file's content, an embedding's signs a perceptual hash.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.operators import compose, datasets, hard_examples, labels, lineage, planning, profile, similarity
from annolake.operators.ranking import running
from annolake.session import table
from annolake.sources import readers, writers

SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def v_images(spark, d):
    s = F.create_map(*(F.lit(x) for kv in (("F", "train"), ("O", "val"), ("P", "test")) for x in kv))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.try_element_at(s, F.col("o_orderstatus")).alias("split"))


def _ord():
    """The full order of a box within its image, as text."""
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    parts = [(F.col("l_linenumber"), 4), (F.col("l_partkey"), 12), (F.col("l_suppkey"), 12), (cents, 14), (F.unix_micros(F.col("l_shipdate").cast("timestamp")), 18)]
    return F.concat(*(F.lpad(c.cast("string"), n, "0") for c, n in parts))


def v_boxes(spark, d, status: str | None = None):
    li = table(spark, d, "lineitem")
    if status:
        li = li.filter(F.col("l_linestatus") == status)
    return li.select(
        F.col("l_orderkey").alias("stem"), F.col("l_returnflag").alias("label"), (F.col("l_quantity") / 51).alias("cx"), (F.col("l_extendedprice") / 110000).alias("cy"),
        (0.05 + F.col("l_discount") * 2).alias("w"), (0.05 + F.col("l_tax") * 2).alias("h"), _ord().alias("ord"), (F.pmod("l_partkey", F.lit(100)) / 100).alias("conf"),
    )


def v_vec(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def v_content(spark, d):
    m = F.pmod("doc_id", F.lit(10))
    split = F.when(m <= 6, "train").when(m <= 8, "val").otherwise("test")
    return table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.sha1(F.encode("text", "UTF-8")).alias("digest"), split.alias("split"), F.length("text").cast("bigint").alias("bytes"))


def _split_boxes(spark, d):
    return v_boxes(spark, d).join(v_images(spark, d), "stem")


def label_class_rollup(spark, d):
    return labels.class_rollup(_split_boxes(spark, d)).select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("label", F.lit("*")).alias("label"), "n", "level")


def class_imbalance(spark, d):
    return labels.class_imbalance(_split_boxes(spark, d), "split")


def label_line_validation(spark, d):
    """Boxes rendered as label lines, some of them broken by their quantity, and parsed again."""
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    line = F.concat_ws(" ", F.ascii("l_returnflag").cast("string"), (q / 50).cast("string"), F.col("l_tax").cast("string"), F.col("l_discount").cast("string"), (q / 40).cast("string"))
    line = F.when(q % 11 == 0, F.concat(line, F.lit(" x"))).when(q % 13 == 0, F.concat(line, F.lit(" 0.5 0.5 0.5 0.5"))).otherwise(line)
    p = labels.with_tokens(li.select(line.alias("line")))
    return p.groupBy(F.coalesce("kind", F.lit("unreadable")).alias("kind"), "n_tokens").agg(F.count_if("is_object").alias("n_objects"), F.count_if("is_valid").alias("n_valid"), F.count(F.lit(1)).alias("n_lines"))


def missing_labels(spark, d):
    return labels.missing_labels(v_images(spark, d), v_boxes(spark, d))


def objects_per_image(spark, d):
    return labels.objects_per_image(v_images(spark, d), v_boxes(spark, d))


def class_histograms(spark, d):
    return profile.histograms(v_boxes(spark, d), ["label"])


def crowding_max_iou(spark, d):
    c = profile.crowding(v_boxes(spark, d))
    return c.groupBy("label", g.clamp_bin(F.round("max_iou", 9), 0.0, 1.0, 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("max_iou", 9)), 4).alias("total"))


def split_profile_distance(spark, d):
    """Class, object-count and histogram distances of train and val."""
    b, i = _split_boxes(spark, d), v_images(spark, d)
    one = lambda s: (i.filter(F.col("split") == s), b.filter(F.col("split") == s))
    (ia, ba), (ib, bb) = one("train"), one("val")
    return profile.compare(ba, bb, images=(ia, ib)).select("metric", F.round("distance", 9).alias("distance"))


def profile_histograms(spark, d):
    """All nine metrics of the boxes among the others of their image."""
    return profile.histograms(profile.in_context(v_boxes(spark, d)), ["label"])


def v_coco_boxes(spark, d):
    return profile.coco_boxes(*(table(spark, d, t) for t in ("coco_annotations", "coco_images", "coco_categories")))


def coco_profile(spark, d):
    """Histograms of pixel boxes, shapes' visible share included."""
    return profile.histograms(v_coco_boxes(spark, d).withColumns({c: F.round(c, 9) for c in ("cx", "cy", "w", "h", "visible_shape_fraction")}), ["label"])


def coco_object_counts(spark, d):
    """Images by the number of their boxes, empty ones included."""
    return profile.object_counts(table(spark, d, "coco_images").select(F.col("id").alias("stem")), v_coco_boxes(spark, d))


def profile_projection(spark, d):
    """The classes of a class map with their probabilities."""
    return profile.project(profile.class_shares(v_boxes(spark, d)), ["A", "R", "none"]).withColumn("p", F.round("p", 9))


def profile_mix(spark, d):
    n = _split_boxes(spark, d).groupBy(F.col("split").alias("domain"), "label").agg(F.count(F.lit(1)).alias("n"))
    return profile.mix(n, {"train": 0.2, "val": 0.8}).select("label", F.round("probability", 9).alias("probability"), "n")


def profile_mix_histograms(spark, d):
    """Mixed histograms of two splits."""
    h = profile.histograms(_split_boxes(spark, d).withColumn("domain", F.col("split")), ["domain", "label"])
    return profile.mix_histograms(h, {"train": 0.2, "val": 0.8})


def exact_duplicates(spark, d):
    return similarity.exact_duplicates(v_content(spark, d))


def cross_split_exact_leak(spark, d):
    return similarity.cross_split_exact(v_content(spark, d), SPLIT_ORDER)


def _phash(vec):
    """Bit i is set where value i is above the median of all but the first."""
    m = F.array_sort(F.slice(vec, 2, 63))
    med = F.get(m, F.lit(31))
    bit = F.transform(vec, lambda x, i: F.when(x > med, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(63) - i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bit, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))


def phash_bits(spark, d):
    """The bits themselves, the first one on the left."""
    return v_vec(spark, d).select("id", F.lpad(F.bin(_phash(F.col("vec"))), 64, "0").alias("bits"))


def v_phash(spark, d):
    """Whole hashes; a fifth of the rows again with up to seven bits turned, so that matches exist."""
    h = v_vec(spark, d).select(F.col("id").alias("pos"), _phash(F.col("vec")).alias("phash"))
    near = h.filter("pos % 5 = 0").select((F.col("pos") + 1_000_000_000).alias("pos"), F.col("phash").bitwiseXOR(F.call_function("shiftleft", F.lit(2**9 - 1).cast("bigint").bitwiseAND(F.col("pos")), (F.pmod("pos", F.lit(50))).cast("int"))).alias("phash"))
    return h.unionByName(near)


def phash_band_candidates(spark, d):
    """Nearest earlier hash within 7 bits."""
    return similarity.near_hashes(v_phash(spark, d), 7)


def cross_split_near_leak(spark, d):
    """Near hashes across splits that are no exact copies."""
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.pmod(F.floor(F.col("pos") / 5), F.lit(3)).cast("int") + 1)
    h = v_phash(spark, d).withColumn("split", split).withColumn("digest", F.pmod("pos", F.lit(7)).cast("string"))
    return similarity.cross_split_near(h, SPLIT_ORDER, 7)


def perceptual_diversity(spark, d):
    r = similarity.perceptual_diversity(v_phash(spark, d))
    return r.withColumn("diversity", F.round("diversity", 9))


def cross_split_embedding_leak(spark, d):
    """Best matches across all pairs of splits."""
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.pmod("id", F.lit(3)).cast("int") + 1)
    return similarity.cross_split_nearest(v_vec(spark, d).withColumn("split", split), SPLIT_ORDER, 0.4).withColumn("sim", F.round("sim", 6))


def uniqueness_summary(spark, d):
    u = similarity.uniqueness(v_vec(spark, d))
    return u.select("samples", *(F.round(c, 6).alias(c) for c in u.columns[1:]))


def domain_compare(spark, d):
    v = v_vec(spark, d)
    a, b = v.filter("label < 5"), v.filter("label >= 5")
    n = similarity.nearest(b, a).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean_nn"), F.round(F.percentile("sim", 0.1), 6).alias("p10_nn"), F.round(F.percentile("sim", 0.9), 6).alias("p90_nn"))
    one = F.lit(1).alias("k")
    ca, cb = similarity.centroid(a).select(one, F.col("centroid").alias("ca")), similarity.centroid(b).select(one, F.col("centroid").alias("cb"))
    return n.withColumn("k", F.lit(1)).join(ca, "k").join(cb, "k").select("n", "mean_nn", "p10_nn", "p90_nn", F.round(g.cosine(F.col("ca"), F.col("cb")), 6).alias("centroid_cosine"))


def diverse_subset(spark, d):
    return similarity.select_diverse(v_vec(spark, d), 20).withColumn("score", F.round("score", 6))


def _matched(spark, d):
    return hard_examples.matched(v_images(spark, d), v_boxes(spark, d, "F"), v_boxes(spark, d, "O"), match_iou=0.1)


def hard_example_scores(spark, d):
    s = hard_examples.scores(_matched(spark, d))
    return s.select("stem", "gt", "pred", "fn", "fp", "low_conf", "poor_loc", F.round("score", 6).alias("score"))


def hard_example_topk(spark, d):
    s = hard_examples.scores(_matched(spark, d)).withColumn("score", F.round("score", 6))
    return hard_examples.hardest(s, 50).select("stem", "score", F.array_join("reasons", ",").alias("reasons"))


def fn_fp_by_class(spark, d):
    return hard_examples.errors_by_class(_matched(spark, d))


def _log(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_suppkey").alias("background"), F.concat(F.col("l_partkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string")).alias("source"))


def source_reuse(spark, d):
    r = lineage.reuse(_log(spark, d), "background")
    return r.agg(F.count(F.lit(1)).alias("n"), F.max("n_images").alias("max_images"), F.sum("n_images").alias("total"))


def source_components(spark, d):
    """Orders linked over shared parts, the whole graph."""
    return lineage.source_groups(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_partkey").alias("source")))


def customer_groups(spark, d):
    """Orders linked over their customer."""
    return lineage.source_groups(table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_custkey").alias("source")))


def source_aware_split(spark, d):
    return lineage.assign_split(customer_groups(spark, d), 0.2)


def split_transfer(spark, d):
    """Where the files of all modalities go by a source-aware split (U4)."""
    g = customer_groups(spark, d)
    val = g.join(lineage.assign_split(g, 0.2).filter("split = 'val'"), "gid").select("stem")
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.lit("images").alias("modality"), F.lit(".jpg").alias("ext"))
    f = f.unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.lit("labels").alias("modality"), F.lit(".txt").alias("ext"))).distinct()
    return datasets.apply_split(f, val, "/d").groupBy("modality", "split").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"))


def split_summary(spark, d):
    """Totals and ratios of a source-aware split and its leaks."""
    g = customer_groups(spark, d)
    s = lineage.assign_split(g, 0.2)
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_custkey").alias("source")).join(g, "stem").join(s.select("gid", "split"), "gid")
    return datasets.split_summary(s, 0.2, lineage.split_leaks(log)).withColumn("actual_val_ratio", F.round("actual_val_ratio", 9))


def object_count_hints(spark, d):
    """Object counts from plans, then label text, then COCO."""
    plans = table(spark, d, "sample_plans").filter("idx is not null").select(F.concat(F.lit("p"), F.col("idx").cast("string")).alias("stem"), F.col("n_objects"))
    lines = table(spark, d, "label_lines").select("line_id", "stem", F.col("raw_line").alias("line")).distinct()
    return datasets.object_count_hints(plans, datasets.line_counts(lines), datasets.coco_counts(table(spark, d, "coco_images"), table(spark, d, "coco_annotations")))


def _lines(spark, d, *kinds):
    return table(spark, d, "label_lines").filter(F.col("file_kind").isin(*kinds)).select("line_id", "split", "stem", "file_kind", "line_no", F.col("raw_line").alias("line")).distinct()


def label_file_kinds(spark, d):
    """Kind of every label file by its lines, counted by folder."""
    k = ["file_kind", "split", "stem"]
    safe = _lines(spark, d, "labels", "labels-obb", "labels-seg").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in k[1:]})
    return labels.file_kind(labels.with_tokens(safe), *k).groupBy("file_kind", "kind").agg(F.count(F.lit(1)).alias("n_files"))


def segmentation_label_faults(spark, d):
    """Files, objects and faults of the segmentation folder."""
    return datasets.segmentation_faults(_lines(spark, d, "labels-seg"))


def sample_payloads(spark, d):
    """Which modalities a sample's shard entry holds."""
    li = table(spark, d, "lineitem")
    own = lambda t, c: t.select(F.col(c).alias("stem"))
    have = {
        "detect.txt": own(li.filter("l_linestatus = 'F'"), "l_orderkey"), "seg.txt": own(li.filter("l_linestatus = 'O'"), "l_orderkey"),
        "semantic.png": own(table(spark, d, "documents").filter("text is not null"), "doc_id"), "coco.json": own(table(spark, d, "coco_images"), "id"),
    }
    m = datasets.modalities(own(table(spark, d, "orders"), "o_orderkey"), have)
    return m.groupBy(F.array_join("modalities", ",").alias("modalities")).agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("first"))


def merged_logs(spark, d):
    """Two logs of different columns under one header."""
    li = table(spark, d, "lineitem")
    s = F.col("l_orderkey").cast("string")
    new = li.filter("l_linestatus = 'O'").select(s.alias("generated_stem"), F.col("l_suppkey").alias("background"), F.col("l_returnflag").alias("label"), F.lit("False").alias("flipped"))
    old = li.filter("l_linestatus = 'F'").select(s.alias("stem"), F.col("l_suppkey").alias("background"), F.col("l_returnflag").alias("label"), F.concat(F.col("l_partkey").cast("string"), F.lit(".json")).alias("source_json"), F.col("l_linenumber").alias("shape_index"), F.lit("True").alias("flip"))
    m = datasets.merge_logs([("old", old), ("new set", new)])
    return m.groupBy("dataset", "stem", "background", "label", "source_json", "shape_index", "flip").agg(F.count(F.lit(1)).alias("n"))


def label_class_map(spark, d):
    return datasets.label_class_map(table(spark, d, "part"), "p_type")


def finalized_log(spark, d):
    """The log of the completed tasks' samples, in order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_type").alias("status"), "ts", "event_id")
    done = compose.last_state(e, "idx", ("ts", "event_id")).filter("status = 'purchase'")
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("idx", F.col("o_custkey"))
    log = datasets.finished_log(rows, done, ["idx", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [F.col("idx")])
    return log.select("line", F.col("o_orderkey").cast("string").alias("generated_stem"), F.col("l_suppkey").cast("string").alias("background"), F.col("l_returnflag").alias("label"))


def effect_counts(spark, d):
    """Effects written as JSON and counted again."""
    e = F.to_json(F.array(F.to_json(F.struct(F.col("l_returnflag").alias("effect"))), F.col("l_linestatus")))
    return datasets.effect_counts(table(spark, d, "lineitem").select(e.alias("effects")))


def counter_maps(spark, d):
    n = _split_boxes(spark, d).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return datasets.counter_maps(n, "split")


def duplicate_examples(spark, d):
    """Exact duplicates per split with the first ten of them."""
    dup = similarity.exact_duplicates(v_content(spark, d)).join(v_content(spark, d).select("pos", "split"), "pos")
    x = datasets.examples(dup, "split", "pos", F.concat(F.col("pos").cast("string"), F.lit("="), F.col("owner").cast("string")))
    return x.select("split", "n", F.array_join("examples", ",").alias("examples"))


def split_leak_sources(spark, d):
    l = _log(spark, d).join(v_images(spark, d), "stem")
    return lineage.split_leaks(l.select("split", F.col("background").alias("source")))


def merge_dense_ids(spark, d):
    img, ann, cat = (table(spark, d, t) for t in ("coco_images", "coco_annotations", "coco_categories"))
    images, anns, names = compose.merge_coco([("old", img.filter("id % 2 = 0"), ann.filter("image_id % 2 = 0"), cat), ("new", img.filter("id % 2 = 1"), ann.filter("image_id % 2 = 1"), cat)])
    return anns.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum("image_id").alias("sum_images"), F.max("id").alias("last_id")).join(names.withColumnRenamed("id", "category_id"), "category_id")


def shard_by_count(spark, d):
    s = compose.shard_by_count(v_content(spark, d).select("split", "pos"), 40, "pos", F.floor(F.col("pos") / 1000), ["split"])
    return s.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def shard_by_bytes(spark, d):
    s = compose.shard_by_bytes(v_content(spark, d), 100, 20_000)
    return s.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def coco_validity(spark, d):
    p = labels.coco_problems(table(spark, d, "coco_annotations").dropDuplicates(["id"]), table(spark, d, "coco_images"))
    return p.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in p.columns[1:]))


def run_state_counts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_type").alias("status"), "ts", "event_id", F.lit(1).cast("bigint").alias("objects"))
    return compose.state_counts(compose.last_state(e, "idx", ("ts", "event_id"))).select("status", "n")


def task_seeds(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), g.task_seed(42, F.col("o_orderkey")).alias("seed")).distinct()


def qa_warnings(spark, d):
    """Base counts of the stand-in data set and the warnings they raise."""
    n = [
        missing_labels(spark, d).agg(F.count(F.lit(1)).alias("missing")), exact_duplicates(spark, d).agg(F.count(F.lit(1)).alias("duplicates")),
        cross_split_exact_leak(spark, d).agg(F.count(F.lit(1)).alias("leaks")), class_imbalance(spark, d).agg(F.round(F.max("imbalance"), 6).alias("imbalance")),
    ]
    one = n[0].withColumn("k", F.lit(1))
    for x in n[1:]:
        one = one.join(x.withColumn("k", F.lit(1)), "k")
    w = labels.warnings(missing_labels=F.col("missing") > 0, duplicates=F.col("duplicates") > 0, leakage=F.col("leaks") > 0, imbalance=F.col("imbalance") > 10)
    return one.select("missing", "duplicates", "leaks", "imbalance", F.array_join(w, ",").alias("warnings"), F.when(F.size(w) > 0, "warning").otherwise("ok").alias("health"))


def visibility_diagnostics(spark, d):
    """Visible share of boxes clipped to the canvas: bins and moments per class."""
    b = v_boxes(spark, d).select("label", g.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("box"))
    r = b.select("label", F.round(g.visible_ratio(F.col("box"), g.clip_box(F.col("box"), F.lit(1.0), F.lit(1.0))), 9).alias("v"))
    return r.groupBy("label", g.clamp_bin(F.col("v"), 0.0, 1.0, 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("least"))


def template_constraints(spark, d):
    """Pairs of boxes of an image checked against left_of with a margin and a largest distance."""
    b = v_boxes(spark, d).join(v_images(spark, d), "stem", "left_semi")
    first = b.groupBy("stem", "label").agg(F.min(F.struct("ord", "cx", "cy")).alias("s"))
    a = first.filter("label = 'A'").select("stem", F.col("s.cx").alias("ax"), F.col("s.cy").alias("ay"))
    n = first.filter("label = 'N'").select("stem", F.col("s.cx").alias("bx"), F.col("s.cy").alias("by"))
    j = a.join(n, "stem")
    ok = (F.col("ax") + 0.05 < F.col("bx")) & (F.round(g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 9) <= 0.6)
    return j.groupBy(ok.alias("satisfied")).agg(F.count(F.lit(1)).alias("n"))


def background_cycle(spark, d):
    """Balanced background plan: every background once a cycle, in an order of the cycle's own."""
    samples = table(spark, d, "orders").select("o_orderkey").distinct()
    first = F.lit(-(2**63))  # the bucket of null, so that no bucket is null
    o = running(samples, [F.col("o_orderkey")], [F.coalesce(F.floor(F.col("o_orderkey") / 1000), first)], name="idx")
    return planning.background_cycle(o, table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 42).select("o_orderkey", "cycle", "slot", "s_suppkey")


def label_first_plan(spark, d):
    """A seeded plan of as many samples as there are orders, some of them empty scenes."""
    n = table(spark, d, "orders").select("o_orderkey").distinct().count()
    c = planning.PlanConfig(planning.parse_class_map("person=0,truck=1,cone=2"), 1, 5, empty_probability=0.05, hard_case=planning.HARD_CASES["crowded"])
    return planning.plan(spark, n, 42, c)


def box_validity(spark, d):
    """Boxes on a canvas of 1000 x 800 that are large and visible enough."""
    b = v_boxes(spark, d)
    px_ = [F.rint(c * n).cast("int") for c, n in ((F.col("cx") - F.col("w") / 2, 1000), (F.col("cy") - F.col("h") / 2, 800), (F.col("cx") + F.col("w") / 2, 1000), (F.col("cy") + F.col("h") / 2, 800))]
    box = F.struct(*(c.alias(n) for c, n in zip(px_, ("x1", "y1", "x2", "y2"), strict=True)))
    ok = g.is_valid_box(F.col("b"), F.lit(1000), F.lit(800), 0.9, 60)
    return b.select("label", box.alias("b")).groupBy("label", ok.alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def polygon_measures(spark, d):
    """Area, box and centre of triangles over half of each box."""
    c = g.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    pts = F.array(*(F.struct(c[x].alias("x"), c[y].alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x1", "y2"))))
    b = v_boxes(spark, d).select("label", pts.alias("p")).select("label", g.polygon_area(F.col("p")).alias("a"), g.polygon_bbox(F.col("p")).alias("b"))
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("a", 9)), 4).alias("area"), F.round(F.avg((F.col("b.x1") + F.col("b.x2")) / 2), 6).alias("cx"), F.round(F.avg(F.col("b.y2") - F.col("b.y1")), 6).alias("h"))


def label_text(spark, d):
    """Boxes as label lines and as clipped polygon lines (K1, K2)."""
    b = v_boxes(spark, d)
    c = g.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    pts = F.array(*(F.struct(c[x].alias("x"), c[y].alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    cls, cut = F.ascii("label"), lambda v: F.floor(v * 10000) / 10000
    return b.select("stem", "ord", writers.detect_line(cls, *(cut(F.col(k)) for k in ("cx", "cy", "w", "h"))).alias("line"), writers.polygon_line(cls, F.transform(pts, lambda p: F.struct(cut(p["x"]).alias("x"), cut(p["y"]).alias("y")))).alias("polygon"))


def source_keys(spark, d):
    """Portable identities of sources."""
    i = table(spark, d, "images").select(lineage.source_key(F.col("path"), F.col("plan_idx")).alias("key"))
    return i.groupBy(F.coalesce("key", F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def zone_labels(spark, d):
    """The class that labels of regions stand for."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("n"))
    each = F.explode(F.array(*(F.concat(F.lit(p), F.col("n")) for p in ("Zone: ", "paste_zone:", "地面:", "tree:", "ROAD:a:")), F.lit(" Ground "), F.lit("zone"), F.lit("可粘贴区域")))
    return n.select(each.alias("label")).select("label", readers.zone_class(F.col("label")).alias("zone")).groupBy("label", "zone").agg(F.count(F.lit(1)).alias("n"))


def prediction_confidences(spark, d):
    """Predictions of the three tasks with the confidence they carry."""
    out = None
    for task, kind in (("detect", "predictions"), ("obb", "predictions-obb"), ("seg", "predictions-seg")):
        p = hard_examples.prediction_shapes(_lines(spark, d, kind), task)
        row = p.select(F.lit(task).alias("task"), F.size("vals").alias("n_values"), "conf")
        out = row if out is None else out.unionByName(row)
    fine = F.when(F.abs("conf") < 1e6, F.round("conf", 6))
    return out.groupBy("task", "n_values").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(fine), 4).alias("conf"))


def slot_relations(spark, d):
    """How many pairs of boxes of an image stand in each relation."""
    b = v_boxes(spark, d).groupBy("stem", "label").agg(F.min(F.struct("ord", "cx", "cy")).alias("s"))
    one = lambda k: b.filter(F.col("label") == k).select("stem", F.col("s.cx").alias(f"{k}x"), F.col("s.cy").alias(f"{k}y"))
    j = one("A").join(one("N"), "stem")
    far = F.round(g.distance(F.col("Ax"), F.col("Ay"), F.col("Nx"), F.col("Ny")), 9)
    holds = {"left_of": F.col("Ax") < F.col("Nx"), "right_of": F.col("Ax") > F.col("Nx"), "above": F.col("Ay") < F.col("Ny"), "below": F.col("Ay") > F.col("Ny"), "min_distance": far >= 0.3, "max_distance": far <= 0.3}
    return j.agg(*(F.count_if(c).alias(k) for k, c in holds.items()), F.round(F.avg(g.perspective_height(F.col("Ay"), 0.35, 0.95, 0.08, 0.32)), 6).alias("mean_height"))


def class_names(spark, d):
    """Boxes by the name of their class, unknown classes by their number."""
    a = table(spark, d, "coco_annotations").dropDuplicates(["id"])
    c = table(spark, d, "coco_categories").groupBy(F.col("id").alias("category_id")).agg(F.max("name").alias("name"))
    return a.join(F.broadcast(c), "category_id", "left").groupBy(F.coalesce("name", F.col("category_id").cast("string"), F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def rendered_scenes(spark, d):
    """A picture of 800 x 600 for every supplier, with its objects' boxes."""
    from annolake.operators import rendering

    n = spark.sparkContext.defaultParallelism
    r = rendering.render(rendering.synthetic_samples(table(spark, d, "supplier").repartition(n), "s_suppkey"))
    return r.select("idx", F.size("annotations").alias("n_objects"), "n_lost", F.sha1("png").alias("png"))


def pending_tasks(spark, d):
    """Planned tasks whose last state is not the completed one."""
    e = table(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_type").alias("status"), "ts", "event_id")
    last = compose.last_state(e, "idx", ("ts", "event_id")).withColumn("status", F.when(F.col("status") == "purchase", "completed").otherwise(F.col("status")))
    return compose.pending(table(spark, d, "customer").select(F.col("c_custkey").alias("idx")).distinct(), last)


def coco_subset(spark, d):
    """Annotations of a selected fifth of the images' stems, counted by category."""
    images, anns = table(spark, d, "coco_images"), table(spark, d, "coco_annotations").dropDuplicates(["id"])
    chosen = images.filter(F.pmod(F.length("stem") + F.col("id"), F.lit(5)) == 0).select(F.col("id").alias("image_id"))
    kept = writers.subset(chosen, chosen, anns, key="image_id")[1]
    return kept.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("area", 1)), 1).alias("area"))


QUERIES = {
    f.__name__: f
    for f in (
        label_class_rollup, class_imbalance, label_line_validation, missing_labels, objects_per_image, class_histograms, crowding_max_iou, split_profile_distance, profile_histograms, coco_profile, coco_object_counts, profile_projection, profile_mix, profile_mix_histograms,
        exact_duplicates, cross_split_exact_leak, phash_bits, phash_band_candidates, cross_split_near_leak, perceptual_diversity, cross_split_embedding_leak, uniqueness_summary, domain_compare, diverse_subset, hard_example_scores,
        hard_example_topk, fn_fp_by_class, source_reuse, source_components, customer_groups, source_aware_split, split_transfer, split_summary, object_count_hints, label_file_kinds, segmentation_label_faults,
        sample_payloads, merged_logs, label_class_map, finalized_log, effect_counts, counter_maps, duplicate_examples, split_leak_sources, merge_dense_ids, shard_by_count, shard_by_bytes, coco_validity,
        run_state_counts, task_seeds, qa_warnings, visibility_diagnostics, template_constraints, background_cycle, label_first_plan, box_validity, polygon_measures, label_text, source_keys, zone_labels, prediction_confidences, slot_relations, class_names, rendered_scenes, pending_tasks, coco_subset,
    )
}

from annolake.plans.catalogue_sql import SQL  # noqa: E402, F401
