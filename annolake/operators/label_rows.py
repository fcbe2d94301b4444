"""Problem 6: label lines that fail to parse are set apart with the first reason that holds.

Structural indexing over whole Arrow batches: byte masks find quotes and delimiters, the prefix
parity of the quotes tells which delimiters lie inside a quoted stretch, and cumulative counts give
each record's tokens; count, type and range checks then run on all tokens at once. A line is never
looked at byte by byte in Python.

Defined results: null and blank lines give no row; an unknown or null ``file_kind`` has no column
count, so its lines fail with ``column_count``; repeated rows stay repeated here (queries count a
``line_id`` once); other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ("quoting", "column_count", "bad_class", "bad_number", "out_of_range", "bad_conf")
#: file kind -> (coordinates: exact number, or -1 for three or more pairs; confidence at the end)
KINDS = {
    "labels": (4, False), "labels-obb": (8, False), "labels-seg": (-1, False),
    "predictions": (4, True), "predictions-obb": (8, True), "predictions-seg": (-1, True),
}
MAX_CLASS = 31
SCHEMA = "line_id bigint, file_kind string, reason string, class_id int, coords array<double>, conf double"
_ARROW = pa.schema([("line_id", pa.int64()), ("file_kind", pa.string()), ("reason", pa.string()), ("class_id", pa.int32()), ("coords", pa.list_(pa.float64())), ("conf", pa.float64())])
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _numbers(tokens: pa.Array) -> np.ndarray:
    """Finite decimal numbers as float64, NaN for anything else."""
    ok = pc.match_substring_regex(tokens, _DECIMAL)
    text = pc.if_else(ok, pc.ascii_ltrim(tokens, "+"), "nan")
    out = pc.cast(text, pa.float64()).to_numpy(zero_copy_only=False).copy()
    out[~np.isfinite(out)] = np.nan
    return out


def _first_in(flags: np.ndarray, record: np.ndarray, n: int) -> np.ndarray:
    """Per record, whether any of its tokens is flagged."""
    return np.bincount(record[flags], minlength=n) > 0


def parse_batch(lines: pa.Array, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(reason code or -1 valid / -2 blank, class, first coordinate's token, coordinates, conf)."""
    n = len(lines)
    lines = pc.fill_null(pc.cast(lines, pa.large_string()), "")
    off = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    raw = lines.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    quote = data == 0x22
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    quotes = np.concatenate(([0], np.cumsum(quote)))  # quotes before each byte
    record = np.repeat(np.arange(n), np.diff(off))
    inside = (quotes[:-1] - quotes[off[record]]) % 2 == 1 if len(data) else np.zeros(0, bool)
    starts_line = np.zeros(len(data) + 1, bool)
    starts_line[off] = True
    before = np.concatenate(([True], blank[:-1])) if len(data) else np.zeros(0, bool)
    after = np.concatenate((blank[1:], [True])) if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(~blank & (before | starts_line[:-1]))
    end = np.flatnonzero(~blank & (after | starts_line[1:])) + 1
    owner = record[start] if len(start) else np.zeros(0, int)
    count = np.bincount(owner, minlength=n)

    inner = quotes[end] - quotes[start]
    wrapped = (inner == 2) & (quote[start] if len(data) else False) & (quote[end - 1] if len(data) else False)
    bad_quote = _first_in((inner > 0) & ~wrapped, owner, n) | (np.bincount(record[blank & inside], minlength=n) > 0)
    s, e = start + wrapped, end - wrapped
    order = np.zeros(len(s) * 2, np.int64)  # tokens and the gaps between them, as one string array; every second is a token
    order[0::2], order[1::2] = s, e
    text = pa.LargeStringArray.from_buffers(len(order) - 1, pa.py_buffer(order), pa.py_buffer(data.tobytes())) if len(s) else None
    tokens = text.take(pa.array(np.arange(0, len(order) - 1, 2))) if len(s) else pa.array([], pa.large_string())
    value = _numbers(tokens) if len(s) else np.zeros(0)

    kind = np.array([list(KINDS).index(k) if k in KINDS else -1 for k in kinds.to_pylist()], int)
    want = np.array([c for c, _ in KINDS.values()] + [0])[kind]
    has_conf = np.array([c for _, c in KINDS.values()] + [False])[kind]
    coords = count - 1 - has_conf
    bad_count = np.where(want < 0, (coords < 6) | (coords % 2 == 1), coords != want) | (kind < 0)

    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    nth = np.arange(len(s)) - first[owner] if len(s) else np.zeros(0, int)
    is_class = nth == 0
    is_conf = has_conf[owner] & (nth == count[owner] - 1) & ~is_class
    is_coord = ~is_class & ~is_conf
    with np.errstate(invalid="ignore"):
        bad_class = _first_in(is_class & ~((value == np.floor(value)) & (value >= 0) & (value <= MAX_CLASS)), owner, n)
        bad_number = _first_in(is_coord & np.isnan(value), owner, n)
        outside = is_coord & ((value < 0) | (value > 1))
        outside |= is_coord & (want[owner] == 4) & (nth >= 3) & (nth <= 4) & ~(value > 0)
        bad_range = _first_in(outside, owner, n)
        bad_conf = _first_in(is_conf & ~((value >= 0) & (value <= 1)), owner, n)
    reason = np.full(n, -1)
    for k, flag in reversed(list(enumerate((bad_quote, bad_count, bad_class, bad_number, bad_range, bad_conf)))):
        reason[flag] = k
    reason[count == 0] = -2

    good = reason == -1
    keep = is_coord & good[owner]
    lens = np.bincount(owner[keep], minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(value[keep]))
    classes, conf = np.full(n, np.nan), np.full(n, np.nan)
    if len(s):
        classes[owner[is_class]] = value[is_class]
        conf[owner[is_conf]] = value[is_conf]
    return reason, np.where(good, classes, np.nan), good, lists, np.where(good, conf, np.nan)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array([*REASONS])
    for b in batches:
        reason, cls, good, coords, conf = parse_batch(b.column("raw_line"), b.column("file_kind"))
        code = pa.array(reason, mask=reason < 0)
        out = pa.RecordBatch.from_arrays(
            [
                pc.cast(b.column("line_id"), pa.int64()), pc.cast(b.column("file_kind"), pa.string()), names.take(code), pa.array(np.nan_to_num(cls).astype(np.int32), mask=~good),
                pc.if_else(pa.array(good), coords, pa.scalar(None, pa.list_(pa.float64()))), pa.array(conf, mask=np.isnan(conf)),
            ],
            schema=_ARROW,
        )
        yield out.filter(pa.array(reason != -2))


def parse_lines(df: DataFrame) -> DataFrame:
    """One row per line that is neither null nor blank: its shape, or the reason of its failure."""
    return df.select(F.col("line_id").cast("bigint").alias("line_id"), "file_kind", "raw_line").filter(F.col("raw_line").isNotNull()).mapInArrow(_parse, SCHEMA)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def shapes(parsed: DataFrame) -> DataFrame:
    """The valid lines as typed shapes: a box (cx, cy, w, h) or a polygon of points, once per line."""
    xy = F.transform(F.sequence(F.lit(0), F.size("coords") - 2, F.lit(2)), lambda i: F.struct(F.get("coords", i).alias("x"), F.get("coords", i + 1).alias("y")))
    box = F.struct(*(F.get("coords", F.lit(i)).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))))
    is_box = F.col("file_kind").isin("labels", "predictions")
    return parsed.filter(F.col("reason").isNull()).dropDuplicates(["line_id"]).select(
        "line_id", "file_kind", "class_id", F.when(is_box, box).alias("box"), F.when(~is_box, xy).alias("polygon"), "conf"
    )
