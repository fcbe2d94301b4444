"""Capture ids of image records and the splits they belong to; shared by problems 2, 3 and 5.

Defined results: a null stem reads the file name in ``path``; without an id there the directories of
``path`` are read, the last first; a name without an id, or null stem and path, has a null id;
``split`` is read without case and blanks, a null or unknown one from the directories of ``path``.
All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The spellings of the three splits.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def plain(c: Column) -> Column:
    """Lower case, with percent codes and full-width letters read as the characters they stand for."""
    decoded = F.when(c.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)).otherwise(c)
    folded = F.when(decoded.rlike("[\\uFF01-\\uFF5E\\u3000]"), F.translate(decoded, _WIDE, _NARROW)).otherwise(decoded)
    return F.lower(folded)


def _is_id(x: Column, least: int) -> Column:
    return (F.length(F.regexp_replace(x, "[^0-9]", "")) >= least) & (F.length(F.regexp_replace(x, "[^a-z]", "")) >= least)


def id_in(name: Column) -> Column:
    """The capture id in one name, or null: a run of 14 letters and digits with five of each; else
    one of 13 to 15 (a damaged one); else, as the id may hold punctuation, a run of such pieces
    between underscores and blanks joined together, again 14 first."""
    runs = F.filter(F.split(name, "[^a-z0-9]+"), lambda x: F.length(x).between(13, 15))
    # a piece without word characters but hyphens and dots inside; a short number at its end is a copy's
    pieces = F.transform(
        F.filter(F.split(name, r"[^a-z0-9.\-]+"), lambda x: F.length(x) >= 14),
        lambda x: F.regexp_replace(x, r"[.\-]", ""),
    )
    joined = F.filter(pieces, lambda x: F.length(x).between(13, 15))

    def best(a: Column) -> Column:
        return F.coalesce(
            F.try_element_at(F.filter(a, lambda x: (F.length(x) == 14) & _is_id(x, 5)), F.lit(1)),
            F.try_element_at(F.filter(a, lambda x: (F.length(x) != 14) & _is_id(x, 5)), F.lit(1)),
            F.try_element_at(F.filter(a, lambda x: _is_id(x, 4)), F.lit(1)),
        )

    return F.coalesce(best(runs), best(joined))


def capture_id(stem: str = "stem", path: str = "path") -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.col(path), r"\\", "/"), "/"), lambda x: F.length(x) > 0)
    file_name = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[A-Za-z0-9]{1,5}$", "")
    own = id_in(plain(F.coalesce(F.col(stem), file_name)))
    dirs = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    above = F.try_element_at(F.filter(F.transform(dirs, lambda x: id_in(plain(x))), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(own, above)


def split_of(split: str = "split", path: str = "path") -> Column:
    """train, val or test; null where neither column tells."""
    m = F.create_map(*(F.lit(x) for kv in SPLITS.items() for x in kv))
    names = F.filter(F.transform(F.slice(F.split(F.regexp_replace(F.lower(F.col(path)), r"\\", "/"), "/"), 1, 64), lambda x: F.trim(x)), lambda x: x.isin(*SPLITS))
    in_path = F.try_element_at(m, F.try_element_at(names, F.lit(-1)))
    own = F.try_element_at(m, F.lower(F.trim(F.regexp_replace(F.col(split), r"[\s ]+", " "))))
    return F.coalesce(own, in_path)


def image_keys(images: DataFrame, *more: str) -> DataFrame:
    """(image_id, sha1, cid, more...), once per image_id."""
    return images.select("image_id", F.lower(F.trim("sha1")).alias("sha1"), capture_id().alias("cid"), *more).dropDuplicates(["image_id"])
