"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

All of it is Spark expressions. A regular expression cuts a text into words. A word that is a
vocabulary entry is its id; the other words are made distinct over the corpus and each is folded
once: its byte pieces start apart, an ``aggregate`` merges the adjacent pair with the lowest rank,
the leftmost first, and looks up only the two ranks that a merge changes, until no pair has a rank.
Before, a word is cut between two bytes that stand together in no vocabulary entry: no merge can span
such a place, so the runs are folded each on its own, and a long blob without blanks is many short ones.
The ranks are a literal in the plan: maps from piece to rank, hashed into ``SLOTS`` of a few
entries, as a lookup in a Spark map is linear. Pieces are written as hexadecimal text, two digits a
byte.

Scale: the cutting is narrow, in rows of ``ROW_WORDS`` words, so that a text of any length goes the
same way; what is shuffled is the codes (an int a word) and the words outside the vocabulary, which a
map-side combined distinct shrinks to the corpus' own lexicon. The rows of a text come together by one
shuffle on ``doc_id``. The literal has the vocabulary's size (50k entries), whatever the corpus.

Defined results: null and empty texts have no ids (an empty list); special tokens are ordinary
text; every row of the input gives one row (``doc_id`` is unique).
"""

from __future__ import annotations

import base64
import copy
import json
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import scratch, spread

SLOTS = 1 << 14
NO_RANK = 1 << 30
ROW_WORDS = 1000
PAIR_SLOTS = 1 << 11


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def _rank_json(path: str) -> str:
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in read_ranks(path).items():
        h = piece.hex().upper()
        slots[xxhash.xxh64_intdigest(h.encode(), seed=42) % SLOTS][h] = rank
    return json.dumps(slots, separators=(",", ":"))


@lru_cache(4)
def _piece_json(path: str) -> str:
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return json.dumps(pieces, separators=(",", ":"))


@lru_cache(4)
def _pair_json(path: str) -> str:
    """The pairs of bytes that stand together in some piece, hashed into slots."""
    slots: list[list[str]] = [[] for _ in range(PAIR_SLOTS)]
    for h in sorted({p[i : i + 2].hex().upper() for p in read_ranks(path) for i in range(len(p) - 1)}):
        slots[xxhash.xxh64_intdigest(h.encode(), seed=42) % PAIR_SLOTS].append(h)
    return json.dumps(slots, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


class Bpe:
    """Column expressions of one vocabulary."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        self.path = path or default_path()
        # (?U): white space as Unicode has it
        self.pattern = "(?U)" + (pattern or default_pattern())
        # from_json of a literal is folded into a literal by the optimizer
        self.ranks = F.from_json(F.lit(_rank_json(self.path)), "array<map<string,int>>")
        self.joined = F.from_json(F.lit(_pair_json(self.path)), "array<array<string>>")

    def rank(self, piece: Column) -> Column:
        slot = F.xxhash64(piece).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
        return F.try_element_at(F.get(self.ranks, slot), piece)

    def _pair(self, a: Column, b: Column) -> Column:
        return F.coalesce(self.rank(F.concat(a, b)), F.lit(NO_RANK))

    def _may_join(self, a: Column, b: Column) -> Column:
        h = F.concat(a, b)
        return F.array_contains(F.get(self.joined, F.xxhash64(h).bitwiseAND(F.lit(PAIR_SLOTS - 1)).cast("int")), h)

    def _merge(self, s: Column) -> Column:
        def at(low: Column) -> Column:
            return _let(F.array_position(s["r"], low).cast("int"), lambda k: _let(F.concat(F.get(s["p"], k - 1), F.get(s["p"], k)), lambda new: joined(k, new)))

        def joined(k: Column, new: Column) -> Column:
            p, r, n = s["p"], s["r"], F.size(s["p"])
            none = F.array().cast("array<int>")
            left = F.when(k > 1, F.array(self._pair(F.get(p, k - 2), new))).otherwise(none)
            right = F.when(k + 1 < n, F.array(self._pair(new, F.get(p, k + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, 1, k - 1), F.array(new), F.slice(p, k + 2, n)).alias("p"),
                F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, n)).alias("r"),
            )

        return _let(F.coalesce(F.array_min(s["r"]), F.lit(NO_RANK)), lambda low: F.when(low == NO_RANK, s).otherwise(at(low)))

    def _sharing(self, build) -> Column:
        """``build(codec)`` with the rank literal bound once: every further mention would be a copy
        of the vocabulary in the plan and in each task."""

        def bound(ranks: Column) -> Column:
            other = copy.copy(self)
            other.ranks = ranks
            return build(other)

        return _let(self.ranks, bound)

    def encode_word(self, word: Column) -> Column:
        """array<int> of one non-empty word."""
        return self._sharing(lambda codec: codec._encode_word(word))

    def _encode_word(self, word: Column) -> Column:

        def fold(h: Column) -> Column:
            return _let(F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.substring(h, i, 2)), parted)

        def parted(pieces: Column) -> Column:
            apart = F.filter(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), lambda i: (i <= F.size(pieces)) & ~self._may_join(F.get(pieces, i - 2), F.get(pieces, i - 1)))
            return _let(F.concat(F.array(F.lit(1)), apart), lambda starts: F.flatten(F.transform(starts, lambda at, i: _let(F.slice(pieces, at, F.coalesce(F.get(starts, i + 1), F.size(pieces) + 1) - at), run))))

        def run(pieces: Column) -> Column:
            return F.when(F.size(pieces) == 1, F.transform(pieces, self.rank)).otherwise(folded(pieces))

        def folded(pieces: Column) -> Column:
            ranks = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x, i: self._pair(x, F.get(pieces, i + 1)))
            start = F.struct(pieces.alias("p"), ranks.alias("r"))
            return F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 1), start, lambda s, _: self._merge(s), lambda s: F.transform(s["p"], self.rank))

        def whole(h: Column) -> Column:
            return _let(self.rank(h), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(h)))

        return _let(F.hex(F.encode(word, "UTF-8")), whole)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def cut(self, words: Column) -> Column:
        """struct<codes, missing>: per word its id, or -k for the k-th of the words to be folded."""
        return self._sharing(lambda codec: codec._cut(words))

    def _cut(self, words: Column) -> Column:
        # the step is bound to a lambda variable: as a column of its own, the optimizer would inline
        # it into the lambdas that use it and compute it anew for each word
        def coded(missing: Column) -> Column:
            codes = F.transform(words, lambda w: F.coalesce(self.word_rank(w), -F.array_position(missing, w).cast("int")))
            return F.struct(codes.alias("codes"), missing.alias("missing"))

        return _let(F.filter(F.array_distinct(words), lambda w: self.word_rank(w).isNull()), coded)

    def word_rank(self, word: Column) -> Column:
        return self.rank(F.hex(F.encode(word, "UTF-8")))

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: the pieces' bytes joined."""
        pieces = F.from_json(F.lit(_piece_json(self.path)), "array<string>")
        return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def encode_documents(documents: DataFrame, bpe: Bpe | None = None) -> DataFrame:
    """(doc_id, ids), one row for every document."""
    bpe, spark = bpe or Bpe(), documents.sparkSession
    side = scratch(spark, "words")
    words = spread(documents.select("doc_id", "text")).select("doc_id", bpe.words(F.col("text")).alias("w"))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(ROW_WORDS)), lambda i: F.slice("w", i + 1, ROW_WORDS))
    cut = words.select("doc_id", F.posexplode(rows).alias("part", "w")).select("doc_id", "part", bpe.cut(F.col("w")).alias("c"))
    cut.select("doc_id", "part", "c.codes", "c.missing").write.parquet(side)
    cut = spark.read.schema("doc_id bigint, part int, codes array<int>, missing array<string>").parquet(side)
    lexicon = scratch(spark, "lexicon")
    # spread before the fold: the distinct's few, small partitions would leave most cores idle
    distinct = cut.select(F.explode("missing").alias("word")).distinct().repartition(spark.sparkContext.defaultParallelism * 2, "word")
    distinct.select("word", bpe.encode_word(F.col("word")).alias("ids")).write.parquet(lexicon)
    folded = spark.read.schema("word string, ids array<int>").parquet(lexicon)
    each = cut.select("doc_id", "part", F.posexplode("missing").alias("k", "word")).join(folded, "word").select("doc_id", "part", (F.col("k") + 1).alias("k"), "ids")
    both = cut.select("doc_id", "part", F.lit(0).alias("k"), F.col("codes").alias("ids")).unionByName(each).repartition("doc_id")
    m = both.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("m"))
    spelled = F.flatten(F.transform(F.get("m", F.lit(0))["ids"], lambda c: F.when(c >= 0, F.array(c)).otherwise(F.get("m", -c)["ids"])))
    parts = m.select("doc_id", "part", spelled.alias("ids")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("m"))
    return parts.select("doc_id", F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"))
