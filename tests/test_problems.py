"""The general training-data problems: defined cases, and brute force on small inputs."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annolake.operators import compaction, label_rows, references, schema_drift
from annolake.session import scratch

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def body(**over):
    b = {"schema": "a/b", "version": 2, "canvas": {}, "instances": [{"id": "s", "variation": {"cx_range": [0.1, 0.2], "cy_range": [0, 1], "h_range": [0, 1], "angle_range": [0, 1], "enabled_probability": 1, "flip_probability": 0, "same_class_random": True, "allow_overlap": False}}], "constraints": [], "parameters": {}}
    for k, v in over.items():
        if v is ...:
            b.pop(k)
        else:
            b[k] = v
    return b


def var(**over):
    v = dict(body()["instances"][0]["variation"])
    for k, x in over.items():
        if x is ...:
            v.pop(k)
        else:
            v[k] = x
    return [{"id": "s", "variation": v}]


CASES = [
    (body(), []), (body(schema=...), [("schema", "removed")]), (body(schema=None), [("schema", "removed")]), (body(schema=7), [("schema", "retyped")]),
    (body(version=..., ver=2), [("version", "renamed")]), (body(version="2"), [("version", "retyped")]), (body(version=2.5), [("version", "retyped")]), (body(version=True), [("version", "retyped")]),
    (body(version=9), []), (body(Version=2), [("Version", "added")]), (body(schema=..., notes="x", schema_name="y"), [("schema", "renamed"), ("notes", "added")]),
    (body(instances=var(cx_range=..., cxRange=[0.1, 0.2])), [("cx_range", "renamed")]), (body(instances=var(cx_range=[1, 2, 3])), [("cx_range", "retyped")]),
    (body(instances=var(cx_range=["1", "2"])), [("cx_range", "retyped")]), (body(instances=var(cx_range=None)), [("cx_range", "removed")]),
    (body(instances=[{"id": "s"}]), [("cx_range", "removed")]), (body(instances=var(mirror=True) * 3), [("mirror", "added")]), (body(instances=[]), []),
    (body(instances=var(cx_range=...) + var(cx_range="0.1..0.2")), [("cx_range", "removed"), ("cx_range", "retyped")]),
]


def test_schema_changes(spark):
    rows = [(i, json.dumps(b), "clash") for i, (b, _) in enumerate(CASES)] + [(0, json.dumps(CASES[0][0]), "again"), (90, None, ""), (91, "", ""), (92, "[1]", ""), (93, "{oops", "")]
    df = spark.createDataFrame(rows, "template_id bigint, body string, field_name string")
    got = {tuple(r) for r in schema_drift.changes(df).collect()}
    assert got == {(i, *c) for i, (_, cs) in enumerate(CASES) for c in cs}
    bad = {r["template_id"]: r["reason"] for r in schema_drift.unreadable(df).collect()}
    assert bad == {90: "null", 91: "empty", 92: "not_an_object", 93: "not_json"}
    assert schema_drift.changes(df.limit(0)).count() == 0 == schema_drift.reported_alternatives(df.withColumn("written_at", F.lit(T0)).limit(0)).count()


def test_a_repeated_key_counts_by_its_last_value(spark):
    df = spark.createDataFrame([(1, '{"version":1,"version":"2","schema":"s","zz":1,"zz":2}'), (2, "{}"), (3, '{"instances":[{"variation":{}}, 5, null]}')], "template_id bigint, body string")
    got = {tuple(r) for r in schema_drift.changes(df).collect()}
    gone = {(i, n, "removed") for i in (2, 3) for n in ("schema", "version")}
    assert got == {(1, "version", "retyped"), (1, "zz", "added"), (3, "cx_range", "removed")} | gone and schema_drift.unreadable(df).count() == 0


def test_alternatives_of_the_union(spark):
    docs = [body(), body(version="2"), body(version=..., ver=3), body(instances=var(cx_range=None, mirror=True)), body(version="4")]
    df = spark.createDataFrame([(i, json.dumps(b), T0 + timedelta(days=i)) for i, b in enumerate(docs)], "template_id bigint, body string, written_at timestamp")
    u = {(r["path"], r["name"], r["tag"]): r for r in schema_drift.reported_alternatives(df).collect()}
    v = "$.instances[].variation"
    assert u["$", "version", "integer"]["role"] == "base" and u["$", "version", "string"]["role"] == "retyped" and u["$", "version", "string"]["first_file"] == 1
    assert u["$", "ver", "integer"]["role"] == "stand_in" and u[v, "cx_range", "null"]["role"] == "null" and u[v, "mirror", "boolean"]["role"] == "new"
    assert u[v, "mirror", "boolean"]["first_seen"] .replace(tzinfo=UTC) == T0 + timedelta(days=3)


def test_consistent_table_and_union(spark):
    docs = [body(version={"major": 3}), body(version="v4"), body(version=[5, 0]), body(instances=var(cx_range="0.1..0.3")), body(instances=var(cx_range={"min": 0.2, "max": 0.4})), body(schema=["x/y"]), body(schema=..., sname="q")]
    df = spark.createDataFrame([(i, json.dumps(b), T0 + timedelta(days=i), "w") for i, b in enumerate(docs)], "template_id bigint, body string, written_at timestamp, writer string")
    t = {r["template_id"]: r for r in schema_drift.consistent_table(df).collect()}
    assert [t[i]["version"] for i in range(3)] == [3, 4, 5]
    assert t[3]["cx_range"] == [0.1, 0.3] and t[4]["cx_range"] == [0.2, 0.4] and t[0]["cx_range"] == [0.1, 0.2]
    assert t[5]["schema"] == "x/y" and t[6]["schema"] == "q"
    more = [json.dumps(body(instances=var(cy_range="?", h_range=[1, 2], mirror=True), notes="n")), None, "{oops"]
    m = {r["template_id"]: r for r in schema_drift.consistent_table(spark.createDataFrame(list(enumerate(more)), "template_id bigint, body string")).collect()}
    assert m[0]["cy_range"] is None and m[0]["cy_range_other"] == '"?"' and m[0]["h_range"] == [1.0, 2.0] and m[0]["extra"] == {"notes": '"n"'}
    assert m[0]["variation_extra"] == {"mirror": "true"} and m[0]["unreadable"] is None and (m[1]["unreadable"], m[2]["unreadable"]) == ("null", "not_json")
    u = {(r["path"], r["tag"]): r for r in schema_drift.tagged_union(df).collect()}
    assert u["$.version", "object"]["first_file"] == 0 and u["$.version", "string"]["n_files"] == 1
    assert u["$.instances[].variation.cx_range", "number_pair"]["n_files"] == 5


def test_union_has_no_depth_limit(spark):
    deep = json.loads('{"a":' * 40 + '"x"' + "}" * 40)
    bodies = [
        json.dumps(body(instances=var(cx_range=["1", "2"], shadow={"on": True, "at": [[1, 2.5], [None]]}))), json.dumps(body(instances=var(cx_range={"min": 0.2, "max": 1}))),
        json.dumps(body(deep=deep)), '{"big": [12345678901234567890, 9223372036854775807, 2.0, 1e5, -0], "e": [{}, []]}', "[1]", "{oops", None,
    ]
    df = spark.createDataFrame([(i, b, T0, "w") for i, b in enumerate(bodies)], "template_id bigint, body string, written_at timestamp, writer string")
    u = {(r["path"], r["tag"]): (r["n_files"], r["n_values"]) for r in schema_drift.tagged_union(df).collect()}
    cx, shadow = "$.instances[].variation.cx_range", "$.instances[].variation.shadow"
    assert u[f"{cx}[]", "string"] == (1, 2) and u[f"{cx}.min", "number"] == (1, 1) and u[f"{cx}.max", "integer"] == (1, 1) and u[f"{cx}[]", "number"] == (1, 2)
    assert u[f"{shadow}.on", "boolean"] == (1, 1) and u[f"{shadow}.at[]", "number_pair"] == (1, 1) and u[f"{shadow}.at[][]", "null"] == (1, 1)
    assert u["$.deep" + ".a" * 40, "string"] == (1, 1) and u["$.e[]", "array"] == (1, 1)
    # the walk's tags are those of the variants
    one = df.filter("template_id = 3")
    v = schema_drift.parsed(one).select(F.explode(F.expr("variant_get(_doc, '$.big', 'array<variant>')")).alias("v")).select(schema_drift.tag(F.col("v")).alias("t"))
    assert sorted(r["t"] for r in v.collect()) == sorted(r["tag"] for r in schema_drift.tag_paths(one, ["template_id"]).collect() if r["path"] == "$.big[]")


def brute_orphans(refs, parents):
    out = set()
    for i, k, t in refs:
        if k is None:
            continue
        own = [(a, r) for p, a, r in parents if p == k]
        if not own:
            out.add((i, "missing"))
        elif t is not None and not any(a is not None and a <= t and (r is None or t < r) for a, r in own):
            first = min((a for a, _ in own if a is not None), default=None)
            out.add((i, "late" if first is not None and first > t else "deleted"))
    return out


@pytest.mark.parametrize("size", [16, references.BLOCK])
def test_orphans_against_brute_force(spark, size):
    rng = random.Random(5)
    at = lambda: T0 + timedelta(days=rng.randrange(60))
    parents = []
    for k in [*range(-4, 40), *range(60, 90), 5000, 5001]:
        for _ in range(rng.choice([1, 1, 1, 2])):
            a = at() if rng.random() < 0.95 else None
            parents.append((k, a, None if rng.random() < 0.5 or a is None else a + timedelta(days=rng.randrange(1, 20))))
    refs = [(i, rng.choice([None, *range(-6, 100), 5000, 5002, *[7] * 60]), at() if rng.random() < 0.95 else None) for i in range(900)]
    r = spark.createDataFrame(refs + refs[:50], "id bigint, image_id bigint, added_at timestamp").withColumn("runs", F.lit("clash"))
    p = spark.createDataFrame(parents + parents[:9], "id bigint, added_at timestamp, removed_at timestamp").withColumn("blk", F.lit("clash"))
    got = [(x["id"], x["reason"]) for x in references.orphans(r, p, "id", "image_id", "added_at", size=size).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_orphans(refs, parents)
    assert {x["reason"] for x in references.orphans(r, p.limit(0), "id", "image_id", "added_at").collect()} == {"missing"}
    assert references.orphans(r.limit(0), p, "id", "image_id", "added_at").count() == 0


def test_runs_are_contiguous(spark):
    p = spark.createDataFrame([(k, T0, None) for k in (1, 2, 3, 7, 8, 40)], "id bigint, added_at timestamp, removed_at timestamp")
    runs = references.parent_runs(p.select(F.col("id").alias("k")), size=16)
    assert sorted((r["run_start"], r["run_end"]) for r in runs.collect()) == [(1, 3), (7, 8), (40, 40)]
    used = spark.createDataFrame([(k, "x") for k in (-5, 0, 1, 3, 4, 8, 9, 39, 40, 41, 4000)], "k bigint, note string")
    assert {r["k"] for r in references.within_runs(used, runs, size=16).filter("known").collect()} == {1, 3, 8, 40}


LINES = [
    ("labels", "3 0.1 0.2 0.3 0.4", None), ("labels", '"3"\t0.1  0.2 0.3 "0.4"\r', None), ("labels", "3.0 .5 1. 1e-1 +0.4", None), ("labels", '3 0.1 0.2 0.3 0."4', "quoting"),
    ("labels", '3 "0.1 0.2" 0.3 0.4', "quoting"), ("labels", '3 0.1 0.2 0.3 ""0.4""', "quoting"), ("labels", '3 0.1 0.2 0.3 "0.4', "quoting"), ("labels", "3 0.1 0.2 0.3", "column_count"),
    ("labels", "3,0.1,0.2,0.3,0.4", "column_count"), ("labels", "32 0.1 0.2 0.3 0.4", "bad_class"), ("labels", "-1 0.1 0.2 0.3 0.4", "bad_class"), ("labels", "1.5 0.1 0.2 0.3 0.4", "bad_class"),
    ("labels", "nan 0.1 0.2 0.3 0.4", "bad_class"), ("labels", "1 0.1 0.2 0.3 inf", "bad_number"), ("labels", "1 0.1 1e999 0.3 0.1", "bad_number"), ("labels", "1 0.1 0,2 0.3 0.1", "bad_number"),
    ("labels", "1 0.1 0.2 0 0.1", "out_of_range"), ("labels", "1 0.1 0.2 0.3 1.01", "out_of_range"), ("labels", "1 0 1 1 1", None), ("predictions", "1 0.1 0.2 0.3 0.1 1.1", "bad_conf"),
    ("predictions", "1 0.1 0.2 0.3 0.1 high", "bad_conf"), ("predictions", "1 0.1 0.2 0.3 0.1 1", None), ("labels-obb", "1 0 0 1 0 1 1 0 1", None), ("labels-seg", "1 0 0 1 0 1 1", None),
    ("labels-seg", "1 0 0 1 0", "column_count"), ("labels-seg", "1 0 0 1 0 1 1 0", "column_count"), ("predictions-seg", "1 0 0 1 0 1 1 0.5", None), ("labels-obb", "1 0 0 1 0 1 1 0", "column_count"),
    ("other", "1 0.1 0.2 0.3 0.4", "column_count"), (None, "1 0.1 0.2 0.3 0.4", "column_count"), ("labels", 'x "', "quoting"), ("labels", '1 "" 0.1 0.2 0.3', "bad_number"),
]


def test_label_rows(spark):
    rows = [(i, k, t) for i, (k, t, _) in enumerate(LINES)] + [(500, "labels", None), (501, "labels", ""), (502, "labels", " \t\r"), (3, *LINES[3][:2]), (600, "labels-seg", "1 " + "0.5 0.25 " * 60000)]
    df = spark.createDataFrame(rows, "line_id bigint, file_kind string, raw_line string").withColumn("reason", F.lit("clash"))
    p = label_rows.parse_lines(df)
    assert {tuple(r) for r in label_rows.rejects(p).collect()} == {(i, w) for i, (_, _, w) in enumerate(LINES) if w}
    s = {r["line_id"]: r for r in label_rows.shapes(p).collect()}
    assert set(s) == {i for i, (_, _, w) in enumerate(LINES) if not w} | {600}
    assert tuple(s[2]["box"]) == (0.5, 1.0, 0.1, 0.4) and s[2]["class_id"] == 3 and len(s[600]["polygon"]) == 60000 and s[21]["conf"] == 1.0
    assert label_rows.parse_lines(df.limit(0)).count() == 0


def test_index_keys_and_objects():
    k = compaction.index_key
    assert [k(7), k("0007"), k(7.0), k(" 7 "), k("7e0")] == ["7"] * 5
    assert [k(True), k(None), k("x"), k([1]), k("nan"), k("1e999999")] == [None] * 6 and k("1.50") == "1.5"
    assert [p for _, p in compaction.read_objects('{"a":1}\n[{"b":2}, 3] {"c"')] == [None, None, "not_an_object", "not_json"]
    assert list(compaction.read_objects("")) == [] == list(compaction.read_objects(None))


def test_compaction(spark):
    o = lambda i, s="x": json.dumps({"index": i, "ok": True, "stem": s, "objects": 1})
    rows = [
        (1, "r", o(1) + o("01"), T0), (2, "r", o(1.0), T0 - timedelta(days=1)), (3, "r", "", T0), (4, "r", None, T0), (5, "q", o(1), None), (6, "q", o(1), T0), (7, None, o(9) + o(9), T0),
        (8, "r", o(None) + o("x") + "{bad", T0), (9, "solo", o(5), T0), (9, "solo", o(5), T0), (10, "r", o(2), T0), (11, "r", o(2), T0),
    ]
    f = spark.createDataFrame(rows, "fragment_id bigint, run_id string, body string, modified_at timestamp").withColumn("n_bytes", F.lit(10)).withColumn("survives", F.lit("clash"))
    t, raw = compaction.compact_fragments(f, scratch(spark, "t"), max_small=0)
    assert {tuple(r) for r in compaction.superseded(t, raw).collect()} == {(1, 1), (2, 1), (5, 1), (7, 1), (10, 1)}
    kept = [(r["run_id"], r["index_key"], r["fragment_id"]) for r in t.read().collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [("r", "1", 1), ("q", "1", 6), (None, "9", 7), ("r", None, 8), ("r", None, 8), ("r", None, 8), ("solo", "5", 9), ("r", "2", 11)]))
    assert (raw, t.version()) == (1, 2) and t.read(1).count() == 14
    before = sorted(map(str, t.read().collect()))
    assert t.rewrite(t.read(), 2, "again") == 3 and sorted(map(str, t.read().collect())) == before
    # a writer based on an old version is refused before it writes, and at its commit if another was faster
    with pytest.raises(compaction.Conflict):
        t.rewrite(t.read(), 2, "late")
    with pytest.raises(compaction.Conflict):
        t._commit(2, "late", [])
    assert t.version() == 3 and sorted(map(str, t.read().collect())) == before
    empty, raw = compaction.compact_fragments(f.limit(0), scratch(spark, "e"))
    assert empty.read().count() == 0 == compaction.superseded(empty, raw).count()


def test_a_crash_leaves_the_version_as_it_was(spark):
    f = spark.createDataFrame([(1, "r", json.dumps({"index": 1}), T0, 10)], "fragment_id bigint, run_id string, body string, modified_at timestamp, n_bytes bigint")
    t, _ = compaction.compact_fragments(f, scratch(spark, "t"))
    before, files = t.read().collect(), t.manifest()["entries"]
    with pytest.raises(Exception, match="broken"):
        t.rewrite(t.read().withColumn("stem", F.raise_error(F.lit("broken"))), t.version(), "crash")
    assert t.read().collect() == before and t.manifest()["entries"] == files
    assert t.rewrite(t.read(), t.version(), "after") == 3


def test_compaction_keeps_untouched_partitions(spark):
    o = lambda i: json.dumps({"index": i, "ok": True})
    rows = [(1, "one", o(1), 10), (2, "large", o(1), 5 << 20), (3, "large", o(2), 5 << 20), (4, "many", o(1), 10), (5, "many", o(2), 10), (6, None, o(1), 10), (7, "torn", o(1), 10), (8, "torn", o(1), 5 << 20)]
    f = lambda rows: spark.createDataFrame([(*r, T0) for r in rows], "fragment_id bigint, run_id string, body string, n_bytes bigint, modified_at timestamp")
    path = scratch(spark, "t")
    t, _ = compaction.compact_fragments(f(rows), path, target_bytes=1 << 20)
    assert sorted(r["fragment_id"] for r in t.read().collect()) == [1, 2, 3, 4, 5, 6, 8]
    place = {r["run_id"]: r["part"] for r in t.read().collect()}
    entry = {e["part"]: e for e in t.manifest()["entries"]}
    assert len(entry) > 2 and all(e["files"] == 1 for e in entry.values())
    # a second load rewrites the partition it falls into and leaves the others where they are
    t, raw = compaction.compact_fragments(f([(9, "one", o(1), 10), (10, "one", o(2), 10)]), path, target_bytes=1 << 20)
    assert t.version() == 4 and sorted(r["fragment_id"] for r in t.read().collect()) == [2, 3, 4, 5, 6, 8, 9, 10]
    assert {tuple(r) for r in compaction.superseded(t, raw).collect()} == {(1, 1)}
    now = {e["part"]: e for e in t.manifest()["entries"]}
    assert {p for p in now if now[p] != entry[p]} == {place["one"]}


def test_small_files_become_few(spark):
    t = compaction.SnapshotTable(spark, scratch(spark, "many"), "part", "id bigint, part int")
    t.append(spark.range(4000).select("id", (F.col("id") % 3).cast("int").alias("part")))
    t.rewrite(t.read().repartition(40), 1, "in many files", {None})
    assert sum(e["files"] for e in t.manifest()["entries"]) >= 100 and t.crowded(1) == {0, 1, 2}
    t.compact()
    assert [e["files"] for e in t.manifest()["entries"]] == [1, 1, 1] and sorted(r[0] for r in t.read().select("id").collect()) == list(range(4000))
    assert t.compact() == t.version() == 3
    t.append(t.read().filter("part = 1").withColumn("id", F.col("id") + 10_000))
    assert t.compact(target_bytes=1000) == 5 and {e["part"]: e["files"] > 1 for e in t.manifest()["entries"]} == {0: False, 1: True, 2: False}
