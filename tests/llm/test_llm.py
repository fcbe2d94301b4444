"""The problems tagged llm: brute force, exact round trips and defined cases on small inputs."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import bpe, capture, group_split, history_dedup, passages, pii, split_overlap
from annolake.llm.plain_text import Plain

AL = string.ascii_lowercase + string.digits


def new_id(rng):
    while True:
        x = "".join(rng.choice(AL) for _ in range(14))
        if sum(c.isdigit() for c in x) >= 5 and sum(c.isalpha() for c in x) >= 5:
            return x


def edit(rng, x):
    k = rng.randrange(len(x))
    return rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice(AL) + x[k + 1 :], x[:k] + rng.choice(AL) + x[k:]])


def lev1(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def images(rng, n=700, hot=0):
    """Records with ids, edited ids, chains, hashes, hot copies, nulls and repeated rows."""
    ids, rows = [new_id(rng) for _ in range(n // 3)], []
    heat = new_id(rng)
    for i in range(n):
        x = rng.choice(ids)
        x = heat if i < hot else edit(rng, x) if rng.random() < 0.2 else x
        if rng.random() < 0.05:
            ids.append(edit(rng, x))
        stem = rng.choice([f"yard_{x}_night", f"{x.upper()}-1", f"cam {x}", f"a_{x[:4]}-{x[4:9]}-{x[9:]}"]) if len(x) == 14 else f"z_{x}"
        if rng.random() < 0.04:
            stem = None
        split = rng.choice(["train", "train", "Train ", "val", "TEST", None, "validation"])
        path = f"/d/set/images/{rng.choice(['train', 'val', 'test'])}/{stem or 'z_' + x}.jpg" if rng.random() > 0.02 else None
        if rng.random() < 0.03:
            stem, path = "IMG_0001", f"s3://d/{x}/IMG_0001.jpg"
        sha = rng.choice([None, f"{rng.randrange(n):040x}"])
        rows.append((i, "ds", split, stem, path, sha, rng.randrange(4), i))
    return rows + rng.sample(rows, 20)


SCHEMA = "image_id bigint, dataset string, split string, stem string, path string, sha1 string, batch_no int, ord bigint"


def keys_of(df):
    return df.select("image_id", "batch_no", "sha1", capture.capture_id().alias("cid"), capture.split_of().alias("sp")).dropDuplicates(["image_id"]).collect()


def same(a, b):
    return bool(a.sha1 and a.sha1 == b.sha1) or bool(a.cid and b.cid and lev1(a.cid, b.cid))


def test_capture_ids(spark):
    names = {
        "yard_k3m9x2p7q1w4ab_night": "k3m9x2p7q1w4ab", "K3M9-X2P7Q-1W4AB": "k3m9x2p7q1w4ab", "ｋ３ｍ９ｘ２ｐ７ｑ１ｗ４ａｂ_x": "k3m9x2p7q1w4ab", "k3m9x2p7q1w4a-1": "k3m9x2p7q1w4a",
        "a%20k3m9x2p7q1w4ab": "k3m9x2p7q1w4ab", "north-quay_loader_20250103_2210": None, "IMG_0001": None, "": None, "k3m9x2p7q1w4abc_v2": "k3m9x2p7q1w4abc",
    }
    d = spark.createDataFrame([(n, "/a/b.jpg") for n in names], "stem string, path string")
    assert {r["stem"]: r["c"] for r in d.select("stem", capture.capture_id().alias("c")).collect()} == names
    d = spark.createDataFrame([("img_1", "D:\\x\\cap-K3M9X2P7Q1W4AB\\img_1.jpg"), (None, "/x/K3M9X2P7Q1W4AB.png"), (None, None)], "stem string, path string")
    assert [r["c"] for r in d.select(capture.capture_id().alias("c")).collect()] == ["k3m9x2p7q1w4ab"] * 2 + [None]


@pytest.mark.parametrize("hot", [0, 240])
def test_history_against_brute_force(spark, hot):
    rows = images(random.Random(11 + hot), hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("token", F.lit("clash"))
    taken, want = [], set()
    for r in sorted(keys_of(df), key=lambda r: (r.batch_no, r.image_id)):
        if r.batch_no == 0 or not any(same(r, t) for t in taken):
            taken.append(r)
        else:
            want.add(r.image_id)
    got = [r["image_id"] for r in history_dedup.reject_over_history(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert history_dedup.reject_over_history(df.limit(0)).count() == 0
    assert history_dedup.reject_over_history(df.filter("batch_no = 0")).count() == 0


def test_history_index_is_kept_and_only_grows(spark, tmp_path):
    """Two calls on one index: the second takes the new batches only and finds what one call finds."""
    df = spark.createDataFrame(images(random.Random(21), hot=90), SCHEMA)
    want = {r["image_id"] for r in history_dedup.reject_over_history(df).collect()}
    path = f"file://{tmp_path}/index"
    first = {r["image_id"] for r in history_dedup.reject_over_history(df.filter("batch_no < 2"), path).collect()}
    index = history_dedup.HistoryIndex(spark, path)
    n = {b: index.postings().filter(F.col("batch") == b).count() for b in (0, 1)}
    second = {r["image_id"] for r in history_dedup.reject_over_history(df, path).collect()}
    assert first | second == want and not first & second and index.done() == [0, 1, 2, 3]
    assert n == {b: index.postings().filter(F.col("batch") == b).count() for b in (0, 1)} and min(n.values()) > 0
    assert history_dedup.reject_over_history(df, path).count() == 0


def test_history_with_a_piece_in_most_ids(spark):
    """Pieces shared by most ids of later batches only, many buckets, every place of an edit."""
    rng = random.Random(22)
    base = ["7k2m" + new_id(rng)[4:] for _ in range(60)]
    old = [(i, None, None, f"a_{x}", None, None, 0, 0) for i, x in enumerate(base[:30])]
    new = []
    for x in base:
        for k in range(14):
            y = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice(AL) + x[k + 1 :], x[:k] + rng.choice(AL) + x[k:]])
            if sum(c.isdigit() for c in y) >= 4 and sum(c.isalpha() for c in y) >= 4:
                new.append((1000 + len(new), None, None, f"b_{y}", None, None, 1 + k % 2, 0))
    df = spark.createDataFrame(old + new, SCHEMA)
    taken, want = [], set()
    for r in sorted(keys_of(df), key=lambda r: (r.batch_no, r.image_id)):
        if r.batch_no == 0 or not any(same(r, t) for t in taken):
            taken.append(r)
        else:
            want.add(r.image_id)
    assert {r["image_id"] for r in history_dedup.reject_over_history(df).collect()} == want and len(want) > 400


def test_overlaps_against_brute_force(spark):
    df = spark.createDataFrame(images(random.Random(5), hot=60), SCHEMA).withColumn("perm", F.lit("clash"))
    k = keys_of(df)
    tr, ev = [r for r in k if r.sp == "train"], [r for r in k if r.sp in ("val", "test")]
    want = {(a.image_id, b.image_id) for a in tr for b in ev if same(a, b)}
    got = [(r["train_id"], r["eval_id"]) for r in split_overlap.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400
    assert split_overlap.overlaps(df.filter("split = 'val'")).count() == 0
    assert split_overlap.overlap_counts(split_overlap.overlaps(df.limit(0))).count() == 0


def test_block_join_loses_no_edit(spark):
    rng = random.Random(8)
    base = [new_id(rng) for _ in range(60)]
    pairs = [(x, v) for x in base for v in {edit(rng, x) for _ in range(40)}]
    pairs += [(edit(rng, x), x) for x in base for _ in range(5)]
    left = spark.createDataFrame([(a,) for a, _ in pairs], "cid string")
    right = spark.createDataFrame([(b,) for _, b in pairs], "cid string")
    got = {tuple(r) for r in split_overlap.near_ids(left, right).collect()}
    assert set(pairs) <= got and all(lev1(a, b) for a, b in got)


def test_grouped_split(spark):
    plans = [(i, b) for i, b in enumerate(["a/K 1.jpg", "D:\\x\\k%201.PNG", None, "  ", "b.png", "./B.jpg ", "c", "k 1", "d.x"] * 30)]
    p = spark.createDataFrame(plans + plans[:7], "idx bigint, background string").withColumn("v", F.lit("clash"))
    im = [(i, i % 300 if i % 3 else None, ["train", "val", None][i % 3 if i % 7 else 0], "/x/test/a.jpg") for i in range(900)]
    m = spark.createDataFrame(im, "image_id bigint, plan_idx bigint, split string, path string")
    v, e, facts = group_split.linked_records(p, m)
    parent = group_split.components(v, e)
    a = group_split.assign(parent)
    rows = a.collect()
    assert len(rows) == len({r["v"] for r in rows}) == 270 + 900
    by_root = {}
    for r in rows:
        by_root.setdefault(r["root"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_root.values())
    names = {i: n for i, n in ((r["idx"], r["n"]) for r in p.select("idx", group_split.background_name(F.col("background")).alias("n")).collect()) if n}
    assert set(names.values()) == {"k 1", "b", "c", "d"}
    old = {}
    for i, pl, s, _ in im:
        if pl in names:
            old.setdefault(names[pl], set()).add(s or "test")
    assert {r[0] for r in group_split.torn_backgrounds(parent, facts).collect()} == {k for k, s in old.items() if len(s) > 1}
    own = {r["v"]: r["root"] for r in rows}
    assert len({own[2 * i] for i, n in names.items() if n == "k 1"}) == 1
    empty = group_split.components(*group_split.linked_records(p.limit(0), m.limit(0))[:2])
    assert group_split.assign(empty).count() == 0


@pytest.mark.parametrize("near", [group_split.NEAR_BITS, 16, 2])
def test_closest_subset_sums(near):
    rng = random.Random(3)
    for _ in range(60):
        sizes = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(4)}
        target = rng.random() * sum(s * n for s, n in sizes.items())
        take = group_split.closest_counts(sizes, target, near)
        sums = {0}
        for s, n in sizes.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        assert all(0 <= k <= sizes[s] for s, k in take.items())
        assert abs(sum(s * k for s, k in take.items()) - target) == min(abs(x - target) for x in sums)


TEXTS = [
    None, "", "   ", "hello world", "don't  stop\n\n now", "naïve façade 😀👷 ok", "运行记录 run_20250804_714802 重复", "﻿zero​width", "a" * 300, "<|endoftext|> x", "\x00\x01 tab\t", "1234567890 3.14e-5",
    "Überlappen zwei Kisten, gilt die vordere als vollständig.", "ÃberlÃ¤ppen", "x " * 3000, "word" * 50 + " end", "é́", "' 's 'RE 're",
    "".join(random.Random(4).choice(string.ascii_letters + "+/") for _ in range(6000)),  # a blob without blanks
    " ".join(f"zq{k}xv" + "qwzx"[k % 4] * (k % 7) for k in range(3500)),  # more words than a row holds
]


def test_bpe_equals_the_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("codes", F.lit("clash"))
    codec = bpe.Bpe()
    rows = bpe.encode_documents(d, codec).select("doc_id", "ids", codec.decode(F.col("ids")).alias("back")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == t.encode(text, add_special_tokens=False).ids and r["back"] == text
    assert bpe.encode_documents(d.limit(0), codec).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_passages_are_found_exactly(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randrange(5, 60)))) for i in range(40)] + [(40, None), (41, "")]
    docs = []
    for i in range(1500):
        w = words(rng, rng.randrange(0, 80))
        if i % 3 == 0:
            src = items[rng.randrange(40)][1].split()
            k = rng.randrange(len(src))
            part = src[k : k + rng.choice([8, 10, 11, 12, 30])]
            w[5:5] = [x.upper() + rng.choice(["", ",", "<b>", " \u00a0--", "_"]) for x in part]
        docs.append((i, " ".join(w)))
    docs += [(1500, None), (1501, ""), (1502, items[0][1] + " z" * 200_000 + " " + items[1][1])]
    index = {}
    for i, t in items:
        w = passages.words_of(t)
        for k in range(len(w) - 10):
            index.setdefault(tuple(w[k : k + 11]), set()).add(i)
    want = set()
    for d, t in docs:
        w = passages.words_of(t)
        for k in range(len(w) - 10):
            want |= {(d, i) for i in index.get(tuple(w[k : k + 11]), ())}
    dd = spark.createDataFrame(docs + docs[:30], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    ii = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    for limit in (passages.BROADCAST_WINDOWS, 0):
        got = [(r["doc_id"], r["item_id"]) for r in passages.leaks(dd, ii, broadcast_windows=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert passages.leaks(dd.limit(0), ii).count() == 0 == passages.leaks(dd, ii.limit(0)).count()


def test_near_passages_reach_the_recall(spark):
    rng = random.Random(10)
    items = [(i, " ".join(words(rng, 20))) for i in range(150)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i, " ".join(words(rng, 30) + w + words(rng, 30))))
    got = {(r["doc_id"], r["item_id"]) for r in passages.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), words=20, edits=2).collect()}
    assert len(got & {(i, i) for i in range(150)}) >= 135


@pytest.mark.parametrize("kinds", ["ii", "dd", "id"])
@pytest.mark.parametrize("broadcast", [passages.BROADCAST_WINDOWS, 0])
def test_near_passages_with_words_extra_or_missing(spark, kinds, broadcast):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 20))) for i in range(150)]
    docs = []
    for i, t in items:
        w = t.split()
        for kind in kinds:
            w[(at := rng.randrange(4, 16)) : at + (kind == "d")] = ["extra"] if kind == "i" else []
        # a third each within a document, at its end, and alone
        docs.append((i, " ".join((words(rng, 30) if i % 3 < 2 else []) + w + (words(rng, 30) if i % 3 < 1 else []))))
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in passages.leaks(dd, ii, words=20, edits=2, broadcast_windows=broadcast).collect()}
    assert len(got.keys() & {(i, i) for i in range(150)}) >= 135 and max(got.values()) == 2


def test_distance_to_a_beginning():
    a, f = "a b c d e f".split(), passages.within_prefix
    assert f(a, "a b c d e f g".split(), 0) == 0 and f(a, "a b x y c d e f g".split(), 2) == 2 and f(a, "a b e f g h".split(), 2) == 2 and f(a, "a b c d".split(), 2) == 2
    assert f(a, "a b c".split(), 2) is None and f(a, "a b x y z c d e f".split(), 2) is None


def test_edit_distance_of_words():
    a = "a b c d e f".split()
    assert passages.within(a, a, 0) == 0 and passages.within(a, "a b x d e f".split(), 1) == 1 and passages.within(a, "b c d e f".split(), 1) == 1 and passages.within(a, "a c b d f e".split(), 2) is None


PII = [
    ("Ask Nadia Gandeholt or write to oscar.tallvik@yardsets.example today.", {("name", "Nadia Gandeholt"), ("email", "oscar.tallvik@yardsets.example")}),
    ("My number is +1 (312) 555-0173, text me when the run stops.", {("phone", "+1 (312) 555-0173")}),
    ("Ring 07700 900495 twice. Lens serial 329-67-8215, firmware v2.10.5", {("phone", "07700 900495")}),
    ("The badge request for Elena H. Vespersund lists SSN 950-39-9612.", {("name", "Elena H. Vespersund"), ("id_number", "950-39-9612")}),
    ("Pick-up: 34c Willowmere Ave. See ticket 555-70 and job 3.234.655.", {("address", "34c Willowmere Ave.")}),
    ("Lieferung an Lindenstr. 48, zu Händen Pablo Brivobrey.", {("address", "Lindenstr. 48"), ("name", "Pablo Brivobrey")}),
    ("请联系虞曜曜，邮箱 holt＠boxworks.example.org。", {("name", "虞曜曜"), ("email", "holt＠boxworks.example.org")}),
    ("车门上写着旧港路105号。电话 ０１０-０５５５０１７３，找岑岚昀。", {("address", "旧港路105号"), ("phone", "０１０-０５５５０１７３"), ("name", "岑岚昀")}),
    ("Tag @gate-crew when depot-nine is done; mAP@0.5 went up; unix time 1747690627.", set()),
    ("As Ostrethorpe, Anna said, Kiln Yard and Weighbridge Lane share masks.", {("name", "Ostrethorpe, Anna")}),
    ("Box ids 00134726 to 009151532 were used twice before 2025-03-18.", set()), ("ID 07 301 728 088 ist im Bild lesbar.", {("id_number", "07 301 728 088")}),
]


def test_personal_information(spark):
    docs = [(i * 1000 + k, t) for i in range(40) for k, (t, _) in enumerate(PII)] + [(99_991, None), (99_992, ""), (99_993, "  ")]
    d = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = {}
    for r in pii.find(d).collect():
        got.setdefault(r["doc_id"], set()).add((r["pii_kind"], PII[r["doc_id"] % 1000][0][r["start_pos"] : r["end_pos"]]))
    for k, (_, want) in enumerate(PII):
        assert got.get(7000 + k, set()) == want
    back = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert back[1] == "My number is <PHONE>, text me when the run stops." and back[99_991] is None and back[99_992] == ""
    assert pii.find(d.limit(0)).count() == 0 == pii.redact(d.limit(0)).count()


FORMS = [  # names, streets and numbers that no list holds
    ("请联系王建国，谢谢", "name", "王建国"), ("负责人：李小龙", "name", "李小龙"), ("We met Hiroshi Tanaka yesterday", "name", "Hiroshi Tanaka"), ("Bitte an Ayşe Yılmaz senden", "name", "Ayşe Yılmaz"),
    ("Ask Davis, Sarah about it", "name", "Davis, Sarah"), ("signed, Q. Obuya", "name", "Q. Obuya"), ("Bring it to 12 rue de Rivoli, Paris", "address", "12 rue de Rivoli"), ("call 06 12 34 56 78", "phone", "06 12 34 56 78"),
    ("我住在南京东路300号", "address", "南京东路300号"), ("Ship to 7 Zyxw Qvut Boulevard.", "address", "7 Zyxw Qvut Boulevard."), ("phone +33 6 12 34 56 78", "phone", "+33 6 12 34 56 78"), ("serial 329-67-8215", "id_number", "329-67-8215"),
]


@pytest.mark.parametrize(("text", "kind", "span"), FORMS)
def test_candidates_come_by_form(text, kind, span):
    p = Plain(text).text
    assert (kind, span) in {(pii.KINDS[k], p[a:b]) for k, a, b, _ in pii.candidates(p)}


def test_numbers_and_streets_of_no_list_are_found(spark):
    new = [x for x in FORMS if x[1] in ("phone", "address") and x[0].isascii()]
    docs = [(i * 1000 + k, t) for i in range(40) for k, (t, _) in enumerate(PII)] + [(900_000 + k, t) for k, (t, _, _) in enumerate(new)]
    got = {(r["doc_id"] - 900_000, r["pii_kind"], r["start_pos"]) for r in pii.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r["doc_id"] >= 900_000}
    assert {(k, kind, t.index(x)) for k, (t, kind, x) in enumerate(new)} <= got


def test_places_survive_damage():
    for raw, start in (("x JosÃ© Gandesund", 2), ("<b>Anna</b> Tall&#39;s", 3), ("T​e​resa O&#39;Vavik", 0), ("Ã–skog", 0), ("x Jose\u0301 y", 2)):
        p = Plain(raw)
        hit = p.text.index(next(w for w in ("José", "Anna", "Teresa", "Öskog") if w in p.text))
        assert p.raw(hit) == start
    assert Plain("plain text").text == "plain text" and Plain("").text == ""


def test_em_separates_patterns():
    p = pii.expectation_maximisation({"1,1,1": 500, "1,1,0": 200, "-1,-1,0": 600, "-1,-1,-1": 300, "1,-1,0": 20})
    assert p["1,1,1"] > 0.9 > 0.1 > p["-1,-1,-1"] and np.isfinite(list(p.values())).all()
