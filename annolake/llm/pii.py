"""Problem 10: personal information in free text, found and replaced by typed placeholders.

Weak supervision. A scan proposes candidate spans of five kinds by their form (addresses at a host,
digit groups, number and street word, capitalised pairs, initials, runs of Chinese characters behind a
family name), the same place in several extents where the form leaves them open; regular expressions,
gazetteers and context labelers vote on each (+1, 0, -1), none of them can drop a name. The counts of the vote patterns over all documents go
through expectation-maximisation (a two-class model with a reliability per labeler and vote), which
yields the probability of each pattern. A logistic span classifier is then trained with these as soft
labels on a bounded, hash-chosen sample (``SAMPLE`` spans) over the votes and the span's surroundings,
and decides every span of the corpus; where accepted spans overlap, the likelier stands.

Scale: one scan of the texts writes the candidates by document; the driver sees pattern counts (at
most a few thousand rows) and the sample, nothing else that grows. Deciding and replacing are narrow.
Texts are scanned whole.

Defined results: null, empty and blank texts have no spans; positions count code points of the raw
text although matching runs on a readable form of it (``plain_text``); a number's or name's
brackets, titles and labels are not part of it; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.plain_text import Plain
from annolake.session import scratch, spread

KINDS = ("email", "phone", "id_number", "address", "name")
SAMPLE = 40_000
DIM = 1 << 16

# Word lists of the labelers.
GIVEN = (
    "Adam Aisha Alex Alice Amélie Ana Andrea Anna Anne Antonio Ben Björn Carlos Carmen Chen Chloe Clara Daniel David Elena Emil Emily Emma Eric Eva Felix Francisco "
    "Frank Fatima George Hanna Hans Helen Hugo Ingrid Irene Isabel Jack James Jan Jane Javier Jens John Jonas José Juan Julia Karl Kofi Laura Lars Lena Li Lucas Lucía "
    "Luis Marco Maria María Mark Martin Mary Max Mei Michael Miguel Mohammed Nadia Nina Nora Olga Oscar Pablo Paul Paula Peter Priya Rachel Robert Rosa Sam Sara Sarah "
    "Simon Sofia Sophie Stefan Susan Teresa Thomas Tom Tomasz Victor Wei Wolfgang Yusuf Zoë"
).split()
FAMILY_ENDS = (
    "skog narez lunt gaard thorpe dal mere bury witz holt moor quist brey sund ello vik vanti wick ard rane son sen berg mann stein ez ski ov ova ton ham ley field "
    "worth ford land wood shaw ero ini etti"
).split()
STREET_EN = "Street St Road Rd Avenue Ave Lane Ln Close Terrace Drive Dr Row Court Ct Way Place Square Boulevard Blvd Crescent Mews".split()
HAN_SURNAMES = "顾柯阮霍虞岑聂裴王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_GIVEN = "砚霁黎岚昀澈姝汐翊筠曜珩伟芳娜敏静丽强磊军洋勇艳杰娟涛明超霞平刚英华玉萍红鹏辉"
HAN_STREETS = "临汐 旧港 槐荫 青砚 北窑".split()
ORDINARY = (
    "shard yard standard wizard hazard board keyboard card guard ward hard regard forward toward record reason season person lesson version session mission field shield wood "
    "land island england holland thousand ground wick berg hand cart sand stand mere ford afford effort hotel pedal sandal medal scandal hello cello yellow ring ley barley "
    "valley trolley parsley turkey honey money journey kidney pulley alley bury sund sender gender"
).split()
NO_GIVEN = "As Ask A An The For From To And By With Für Anleitung Händen Gruß Según Call Ring Tag Keep Label Use Blur Ship See Set Prüfer Reviewer Revisora".split()
SITES = (
    "kiln yard hall three weighbridge lane crane lot dry dock south bay north quay mill gate pit road tank farm rail spur cold store glass shed silo east depot nine clay "
    "ferry ramp brickworks pallet scout edge snap"
).split()

_G = "|".join(sorted(map(re.escape, GIVEN), key=len, reverse=True))
_END = "|".join(FAMILY_ENDS)
_L = "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
_W = rf"(?:(?:[Oo]'|[Mm]c|Mac|[Dd]'|De )?[{_L}][{_L}]+(?:-[{_L}]{{2,}})?)"
_B, _A = rf"(?<![{_L}0-9_@.+%/\-])", rf"(?![{_L}0-9_@])"  # no word, address or path goes on before; none after
_N = rf"(?<![{_L}0-9_.+%/\-])(?<![{_L}0-9_.]@)"  # a mention's @ may stand before a name, an address' may not
_SHAPE = re.compile(rf"(?:O'|Mc|Mac|D'|De )?[{_L}]{{0,14}}?(?:{_END})", re.I)

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*(?: ?@ ?| ?[\[({] ?(?:at|AT|At) ?[\])}] ?| (?:at|AT) (?=[A-Za-z0-9\-]+ ?(?:\[|\(|dot |DOT )))"
    r"[A-Za-z0-9\-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT|Dot) ?[\])}] ?| (?:dot|DOT) )[A-Za-z0-9\-]+)+"
)
PHONE = re.compile(
    r"(?<![\w.@/\-+])(?<!\d )(?:\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]{0,2}\d{2,8}){1,4}|00\d{1,3}[ .\-/](?:\d{1,5})(?:[ .\-/]\d{2,8}){1,4}|00(?:44|49|34|86|33|39)\d{8,11}|001\d{10}"
    r"|\(\d{2,5}\)[ .\-/]?\d{3,8}(?:[ .\-/]\d{2,4}){0,3}|0\d{1,4}[ .\-/]\d{3,8}(?:[ .\-/]\d{2,6}){0,2}|0\d(?:[ .\-]\d{2}){4}|07\d{9}|[2-9]\d{2}[ .\-/]\d{3}[ .\-/]\d{3,4}|[2-9]\d{2}[2-9]\d{6}|[6-9]\d{8}|1[3-9]\d{9})(?![\w]|[.\-/]\d)"
)
IDNUM = re.compile(
    r"(?<![\w.@/\-+])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|[A-Za-z]{1,2}\d{7,8}|[A-Za-z]\d{2}[ .]?\d{3}[ .]?\d{3}"
    r"|\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{2}\.\d{3}\.\d{3}-?[A-Za-z]|\d{8}-?[A-Za-z]|[XYZ]-?\d{7}-?[A-Z]|\d{17}[\dXx]|\d{6} \d{8} \d{3}[\dXx])(?![\w]|[.\-/]\d)"
)
ADDRESS = re.compile(
    rf"(?<![\w./\-])\d{{1,5}}[A-Za-z]? (?:(?!(?i:and|or|of|the|in|for|but|with|at|to|by) )[A-ZÀ-Þ][{_L}']+ ){{1,3}}?(?i:{'|'.join(STREET_EN)})\b\.?"
    rf"|{_B}[A-ZÀ-Þ][{_L}]*(?i:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)(?<!^) ?\d{{1,4}} ?[a-zA-Z]?(?![\w])"
    rf"|{_B}(?i:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Camino|Ronda) ?(?:(?i:de|del|la|los|las|el) ){{0,2}}[A-ZÀ-Þ][{_L}]+(?: (?:(?i:de|del|la|los|las|el) ){{0,2}}[A-ZÀ-Þ][{_L}]+){{0,2}},? ?(?i:n\.?º? ?)?\d{{1,4}}[a-zA-Z]?(?![\w])"
    rf"|(?<![\w./\-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?i:rue|avenue|boulevard|quai|allée|chemin|place|via|viale|piazza|rua) (?:(?:de|du|des|la|le|les|di|del|della|do|da|l'|d') ?){{0,2}}[A-ZÀ-Þ][{_L}']+(?:[ \-][A-ZÀ-Þ][{_L}']+){{0,2}}"
    r"|[一-鿿]{1,6}?(?:路|街|巷|道|弄|大道) ?\d{1,5} ?号"
)
NAMES = (  # each form is searched for on its own; where forms overlap, the classifier chooses
    re.compile(rf"{_N}(?i:{_G})(?: [A-Za-z]\.)? {_W}{_A}"),
    re.compile(rf"{_N}{_W}, ?(?:(?i:{_G})(?: [A-Z]\.)?(?![{_L}])|[A-Z]\.){_A}"),
    re.compile(rf"{_N}[A-Za-z]\. ?(?:[A-Za-z]\. ?)?{_W}{_A}"),
    re.compile(rf"{_N}[A-ZÀ-Þ][{_L}]+ (?:[A-Z]\. )?(?:O'|Mc|Mac)?[A-ZÀ-Þ][{_L}]+{_A}"),
)
HAN_NAME = re.compile(rf"[{HAN_SURNAMES}][一-鿿]{{1,2}}")

_BEFORE = {
    "email": re.compile(r"(?:mail(?:to)?\W{0,4}|\bcc |write to |Escalate to |notify |\ban |Dudas a |<|\||owner=|set: |邮箱 ?|抄送 ?|[（(]|contact \S{0,20})$", re.I),
    "phone": re.compile(r"(?:call|phone|tel\.?|Ring|number is|sms to|on_call=|fallback|teléfono|电话|Ausfall|Telefon|mobile|fax|\||[(（]|and|y al|或)\W{0,3}$", re.I),
    "id_number": re.compile(r"(?:\bID\b|\bid=|SSN|passport|DNI|NIE|Steuer-?ID|insurance|tax|social security|身份证|护照|\bno\.?|reads|lists|number|Ausweis)\W{0,4}(?:no\.?|号码?|number)?\W{0,3}$", re.I),
    "address": re.compile(r"(?:lives at|Pick-up:?|drives to|addressed to.{3,40},|door carries|wohnt laut Lieferschein|Lieferung an|Büro:?|vive en|oficina:?|entregar en|写着|寄到|办公室：?:?|address:?|,|\||to) ?$", re.I),
    "name": re.compile(r"(?:Reviewer:|signed,?|Prüfer:|Revisora?:|author:|Gruß,|As|Según|Thanks to|and|from|for|to|of|@|attention|zu Händen|ask for|holder,|annotator\W{1,5}|name=|/|负责人|复核人：?:?|联系|找|，|,|>|-|\||contact|with|by|von|de) ?$", re.I),
}
_AFTER = {
    "email": re.compile(r"^(?:[>|),;.\s\"]|$)"), "phone": re.compile(r"^(?:[>|),;.\s\"]|$)"), "id_number": re.compile(r"^ ?(?:was visible|ist im Bild|on the|[.;,/)]|$)"),
    "address": re.compile(r"^(?:[,.;)]| and | asked|，|。|\s|$)"),
    "name": re.compile(r"^(?:'s\b| said| wrote| lives| re-checked| can you| hat | weiß| wohnt| revisó| vive| whose|, whose| lists| keeps|,|\.| \||认为|收|，|。|（|\(| \(|;|\"| <| for the| and | knows| no cuenta)"),
}
_NOT = {
    "email": re.compile(r"(?:Tag|branch is|mAP|fix/\S*)\s*$"),
    "number": re.compile(r"\b(?:serial|ticket|job|run|box(?:es)?|box ids(?: \d+ to)?|unix time|pixel counts|firmware|exposure|shard|row|column|seed|frame|version|quality|threshold|sensor)\W{0,3}$", re.I),
    "name": re.compile(r"(?:between|behind|from|through|at|the|in|near|of) ?$", re.I),
}
_IDWORD = re.compile(r"(?:\b(?:ID|SSN|DNI|NIE|passport|insurance|tax id|tax)\b|身份证|证号)(?: ?(?:no\.?|number|号码?))?[\s:=.#]{0,3}$", re.I)
_CALLWORD = re.compile(r"(?:call|phone|tel|ring|number is|sms|teléfono|电话|Ausfall)[^\n]{0,6}$", re.I)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}")
_TLD = re.compile(r"(?:com|org|net|edu|gov|io|de|es|cn|eu|info|example|test|invalid|local)$", re.I)


def _name_parts(s: str) -> tuple[str, str]:
    """(given name or initial, family name) of a name in either order."""
    if "," in s:
        family, _, first = s.partition(",")
        return first.strip().split(" ")[0], family
    first, _, rest = s.partition(" ") if " " in s else s.partition(".")
    return first, re.sub(r"^(?:[A-Za-z]\. ?)+", "", rest)


def _phone_forms(d: str, s: str) -> int:
    """+1 for a known numbering, -1 for an impossible one."""
    n = len(d)
    if s.startswith("+") or s.startswith("00"):
        return 1 if 9 <= n <= 16 else -1
    if n == 10 and re.match(r"[2-9]\d{2}[2-9]\d{6}$", d):
        return 1
    if re.match(r"07\d{9}$|0[1-9]\d{7,11}$|[6-9]\d{8}$|1[3-9]\d{9}$", d):
        return 1
    return -1 if n < 7 or n > 15 else 0


def _votes(kind: str, t: str, a: int, b: int) -> tuple[int, ...]:
    s, before, after = t[a:b], t[max(0, a - 40) : a].rpartition("\n")[2], t[b : b + 16]
    ctx = 1 if _BEFORE[kind].search(before) else 0
    follow = 1 if _AFTER[kind].search(after) else 0
    if kind == "email":
        domain = re.split(r"@|at", s, maxsplit=1)[-1]
        return (1 if _TLD.search(s) else -1, 1 if re.search(r"[A-Za-z]", domain) and not re.search(r"^\W*\d", domain) else -1, ctx, follow, -1 if _NOT["email"].search(before) else 0)
    if kind in ("phone", "id_number"):
        d = re.sub(r"\D", "", s)
        no = -1 if _NOT["number"].search(before) else 0
        date = -1 if _DATE.match(s) else 0
        if kind == "phone":
            labelled = bool(_IDWORD.search(before))  # as an identity number: its form then says nothing for a phone
            return (0 if labelled else _phone_forms(d, s), 1 if not labelled and re.search(r"[+()/ .\-]", s) else 0, 1 if _CALLWORD.search(before) else ctx, -1 if labelled else 0, no, date, follow)
        sure = 1 if re.match(r"\d{3}-\d{2}-\d{4}$|[A-Za-z]|\d{17}|\d{2}\.|\d{8}-?[A-Za-z]|\d{3} \d{2} \d{4}$|\d{2} \d{3} ", s) else 0
        return (sure, 1 if _IDWORD.search(before) or re.search(r"(?:reads|lists|no\.|id=) ?$", before) else ctx, -1 if _CALLWORD.search(before) else 0, no, date, follow)
    words = [w.lower() for w in re.findall(rf"[{_L}']+", s)]
    if kind == "address":
        han = "一" <= s[0] <= "鿿"
        if han:
            # the street's name starts behind a word of place or a mark, and has two or three characters
            stem = re.match(r"[一-鿿]+?(?=(?:路|街|巷|道|弄|大道) ?\d)", s).group()
            known = 1 if stem in HAN_STREETS else -1 if any(stem.endswith(x) for x in HAN_STREETS) or any((t[a - 1 : a] + stem).endswith(x) for x in HAN_STREETS) else 0
            edge = -1 if stem[0] in "在到于至往是住址室着" else 1 if not before or not "一" <= before[-1] <= "鿿" or re.search(r"(?:在|到|于|至|往|是|为|住|址|室|写着)$", before) else -1
            return (known, edge, ctx, follow, 0 if len(stem) == 2 else -1, 0)
        small = {"and", "of", "the", "in", "for", "but", "with"} & set(words)
        site = -1 if any(f"{x} {y}" in " ".join(SITES) for x, y in zip(words, words[1:], strict=False)) or before.split()[-1:] and before.split()[-1].lower() in (*SITES, "camera", "column", "post") else 0
        return (1, 1 if (han and s[-1:] == "号") or words and words[0] in {"calle", "avda", "avenida", "plaza", "paseo"} or re.search(r"\.$|\d", s) else 0, ctx, follow, -1 if small else 0, site)
    if "一" <= s[0] <= "鿿":
        known = sum(c in HAN_GIVEN for c in s[1:])
        gaz = 1 if known == len(s) - 1 else 0 if known else -1
        left = 1 if re.search(r"(?:找|联系|负责人 ?|复核人[：:]|，|,|。|^|\n|- )$", before) else 0
        # a third character that is usual in given names belongs to the name
        more = -1 if len(s) == 2 and t[b : b + 1] in HAN_GIVEN and t[b : b + 1] else 0
        return (gaz, 1 if s[0] in HAN_SURNAMES[:8] else 0, left, 1 if re.match(r"认为|收|，|。|（|\(|,|\s|$", after) else -1, more, 0, 0)
    first, family = _name_parts(s)
    given = 1 if re.fullmatch(_G, first, re.I) else 0 if re.match(r"[A-Za-z]\.", first) else -1
    shape = 1 if _SHAPE.fullmatch(family) and family.lower() not in ORDINARY else -1
    site = -1 if any(w in SITES for w in words if len(w) > 2) else 0
    # words that stand in lower case elsewhere in the text are no names, nor are words that open a sentence's order
    usual = -1 if first in NO_GIVEN or any(f" {w} " in t for w in words if len(w) > 2) else 0
    return (given, shape, ctx, follow, -1 if _NOT["name"].search(before) else 0, site, usual)


def _features(kind: str, votes: tuple[int, ...], t: str, a: int, b: int) -> list[int]:
    """Hashed features: votes singly and in pairs, the words about, shape and ends."""
    s = t[a:b]
    f = [f"b{kind}"] + [f"v{kind}{k}{v}" for k, v in enumerate(votes)] + [f"p{kind}{j}{k}{votes[j]}{votes[k]}" for j in range(len(votes)) for k in range(j)]
    shape = re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"\d+", "9", s[:40])))
    f += [f"s{kind}{shape}", f"l{kind}{' '.join(t[max(0, a - 24) : a].split()[-1:]).lower()}", f"r{kind}{' '.join(t[b : b + 16].split()[:1]).lower()}", f"e{kind}{s[-3:].lower()}"]
    return [xxhash.xxh32_intdigest(x) % DIM for x in f]


def candidates(t: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of a readable text."""
    out = []
    for k, rx in ((0, EMAIL), (1, PHONE), (2, IDNUM), (3, ADDRESS), *((4, x) for x in NAMES), (4, HAN_NAME)):
        if k == 0 and not ("@" in t or re.search(r"\bat\b", t, re.I)):
            continue
        p = 0
        while m := rx.search(t, p):
            a, b = m.span()
            p = b
            if rx in NAMES:
                first, family = _name_parts(m.group())
                if not _SHAPE.fullmatch(family):
                    p = a + len(re.match(r"\S+", m.group()).group())
                if rx is NAMES[3] and re.fullmatch(_G, first, re.I):
                    continue  # the first form has it
            spans = [(a, b)]
            if rx is ADDRESS and "一" <= t[a] <= "鿿":
                head = re.match(r"([一-鿿]+?)(?=(?:路|街|巷|道|弄|大道) ?\d)", t[a:b]).group(1)
                spans = [(b - (b - a) + max(0, len(head) - n), b) for n in sorted({min(len(head), x) for x in (1, 2, 3, 4)})]
            if rx is HAN_NAME:
                spans = [(a, x) for x in range(a + 2, b + 1)]
                p = a + 1
            if rx is EMAIL:
                while b > a and t[b - 1] in ".-":
                    b -= 1
                spans = [(a, b)]
            for a, b in spans:
                v = _votes(KINDS[k], t, a, b)
                if max(v) > 0 or k == 4:  # of a number, address or mail nobody is for: decided
                    out.append((k, a, b, v))
    return out


_CAND = "array<struct<kind:int,a:int,b:int,votes:string,feats:array<int>>>"
_ARROW_CAND = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("votes", pa.string()), ("feats", pa.list_(pa.int32()))]))


def _scan_one(raw: str | None) -> list[dict]:
    if not raw:
        return []
    p = Plain(raw)
    return [
        {"kind": k, "a": p.raw(a), "b": p.raw_end(b), "votes": ",".join(map(str, v)), "feats": _features(KINDS[k], v, p.text, a, b)} for k, a, b, v in candidates(p.text)
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of documents with candidates; with a third column, every row and its text again."""
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            rows = [_scan_one(x) for x in part.column("text").to_pylist()]
            keep = pa.array([i for i, r in enumerate(rows) if r or b.num_columns == 3], pa.int64())
            own = [part.column("doc_id").cast(pa.int64()).take(keep), pa.array([rows[i] for i in keep.to_pylist()], _ARROW_CAND)]
            yield pa.RecordBatch.from_arrays([*own, *([part.column("text").take(keep)] if b.num_columns == 3 else [])], names=["doc_id", "cands", "text"][: b.num_columns])


def scanned(documents: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, cands): the candidate spans of every document that has any, written beside; with
    ``texts``, of every document, with its text."""
    spark, side = documents.sparkSession, scratch(documents.sparkSession, "candidates")
    rows = documents.select("doc_id", "text", F.lit(1).alias("whole")) if texts else documents.select("doc_id", "text").filter(F.length("text") > 0)
    schema = f"doc_id bigint, cands {_CAND}{', text string' if texts else ''}"
    spread(rows).mapInArrow(_scan, schema).write.parquet(side)
    return spark.read.schema(schema).parquet(side)


def expectation_maximisation(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The probability of each vote pattern to be a true span, from pattern counts alone. Starts
    from the majority and keeps labelers better than chance by smoothing."""
    keys = list(patterns)
    v = np.array([[int(x) for x in k.split(",")] for k in keys]) + 1  # 0, 1, 2
    n = np.array([patterns[k] for k in keys], float)
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1) + 0.5))
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        log = np.full(len(keys), np.log(prior / (1 - prior)))
        for k in range(v.shape[1]):
            for value in range(3):
                on = v[:, k] == value
                yes = ((n * p)[on].sum() + 1) / ((n * p).sum() + 3)
                no = ((n * (1 - p))[on].sum() + 1) / ((n * (1 - p)).sum() + 3)
                r = np.log(yes / no)
                # a vote for never counts against, nor one against for
                log[on] += max(r, 0.0) if value == 2 else min(r, 0.0) if value == 0 else np.clip(r, -2, 2)
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(keys, p.tolist(), strict=True))


class Model:
    """Weights of the span classifier."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def logit(self, feats: list[int]) -> float:
        return float(self.weights[feats].sum())

    def decide(self, cands: list[dict]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the accepted spans without overlap: of two of one kind, one inside
        the other, the outer stands, else the likelier."""
        likely = [(p, c) for p, c in ((self.logit(c["feats"]), c) for c in cands) if p > 0]
        outer = [
            (p, c["b"] - c["a"], c)
            for p, c in likely
            if not any(o["kind"] == c["kind"] and o["a"] <= c["a"] and c["b"] <= o["b"] and o["b"] - o["a"] > c["b"] - c["a"] for _, o in likely)
        ]
        taken: list[tuple[int, int, int]] = []
        for _, _, c in sorted(outer, key=lambda x: x[:2], reverse=True):
            if all(c["b"] <= a or b <= c["a"] for _, a, b in taken):
                taken.append((c["kind"], c["a"], c["b"]))
        return sorted(taken, key=lambda x: x[1])


def fit(patterns: dict[int, dict[str, int]], rows: list, epochs: int = 15, rate: float = 0.4) -> Model:
    """Labels the vote patterns of each kind by EM, then fits the classifier on rows (kind, votes, feats)."""
    prob = {k: expectation_maximisation(p) for k, p in patterns.items()}
    w = np.zeros(DIM)
    if not rows:
        return Model(w)
    length = max(len(r["feats"]) for r in rows)
    x = np.full((len(rows), length), DIM, np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r["feats"])] = r["feats"]
    y = np.array([prob[r["kind"]][r["votes"]] for r in rows])
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-8)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 128)):
            err = 1 / (1 + np.exp(-np.clip(w[x[part]].sum(1), -30, 30))) - y[part]
            g = np.bincount(x[part].ravel(), weights=np.repeat(err, length), minlength=DIM + 1) + 1e-5 * w
            g[DIM] = 0
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return Model(w[:DIM])


def train(cands: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the counts of all vote patterns and at most ``sample`` spans, the ones with the
    smallest hashes."""
    each = cands.select("doc_id", F.explode("cands").alias("c"))
    patterns: dict[int, dict[str, int]] = {}
    for r in each.groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect():
        patterns.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    rows = each.select(F.xxhash64("doc_id", "c.a", "c.kind").alias("h"), "c.kind", "c.votes", "c.feats").orderBy("h").limit(sample).collect()
    return fit(patterns, rows)


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, start_pos, end_pos) of every occurrence."""
    cands = scanned(documents)
    model = train(cands)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, KINDS[k], a, e) for d, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, a, e in model.decide(cs)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "pii_kind", "start_pos", "end_pos"])

    return cands.mapInArrow(decide, "doc_id bigint, pii_kind string, start_pos bigint, end_pos bigint").distinct()


def replace_spans(raw: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span (kind, start, end) replaced by its kind in angle brackets, all else as it was."""
    if not raw:
        return raw
    out, last = [], 0
    for k, a, b in spans:
        out += (raw[last:a], f"<{KINDS[k].upper()}>")
        last = b
    return "".join(out) + raw[last:]


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of every document with typed placeholders. The texts are scanned once: they are
    written beside with their candidates, and the trained model decides on these."""
    cands = scanned(documents, texts=True)
    model = train(cands)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [replace_spans(x, model.decide(cs) if cs else []) for cs, x in zip(b.column("cands").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return cands.mapInArrow(rows, "doc_id bigint, text string")
