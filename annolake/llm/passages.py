"""Problem 9: passages of held-out items that stand in the corpus.

The unit compared is an item's passage of ``words`` consecutive words. Every passage of an item and
every window of a document is embedded by CGK random walks: a walk reads the window with a pointer
that moves on or stays by a random bit of the word it stands on, three times the window's length, so
that few edits between two windows become few differing places. Each walk gives several keys, hashes
of a sample of its places (bit-sampling LSH, repeated over ``walks_for`` walks until the wanted recall
is met); equal windows agree in every key. Candidates pass an exact word-level edit check against all
passages of ``words`` - ``edits`` to ``words`` + ``edits`` words that start where the document's window
does; ``edits`` tells how far the best one is, and the cut at 0 loses nothing.

A word is a run of letters and digits in lower case, whatever stands between words. Documents are
walked in blocks of words (long texts in overlapping slices), all windows of a block at once in
numpy; nothing of a document is skipped. The items' keys travel to the workers only while their
bound, counted first, stays under ``BROADCAST_WINDOWS``; beyond it the documents' keys pass a Bloom filter
of the items' keys (of at most ``BLOOM_BITS`` bits) and only what is left is shuffled by key.

Defined results: null and empty texts and items shorter than a window take part in nothing; repeated
rows count once; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BROADCAST_WINDOWS = 10_000_000  # items' characters times keys, an upper bound of their windows' keys; at 16 bytes a key
BLOCK_WORDS = 1 << 17
WINDOW_CHUNK = 1 << 14  # windows walked at once: their arrays stay in the cache
KEYS = 4  # keys a walk
PAIR_CHUNK = 1 << 16
BLOOM_BITS = 1 << 27
FILTER = 18  # leading bits of a key that are looked up before its search


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def walks_for(edits: int, words: int, sample: int, recall: float = 0.95) -> int:
    """Walks needed for passages ``edits`` apart: an inserted or missing word costs about nine of the
    walk's 3 * ``words`` places, a changed one six, until the two pointers meet again and at the
    window's end, so a key of ``sample`` places survives with (1 - 3 edits / words)^sample or more.
    The ``KEYS`` keys of one walk count as three independent ones (measured; the recall is tested)."""
    p = max(1e-3, 1 - 3 * edits / words) ** sample
    return 1 if edits == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p) / 3))


def _mix(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """64 well spread bits of each number."""
    x = (x ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Walks:
    """The random functions of the embedding and the sampled places, fixed by a seed."""

    def __init__(self, words: int, walks: int = 1, sample: int = 6, keys: int = KEYS, seed: int = 7) -> None:
        self.words, self.steps, self.keys_per_walk = words, 3 * words, keys
        rng = np.random.default_rng(seed)
        # bit j of a word's hash tells whether walk w moves on at step j; 64 steps a salt
        self.salts = rng.integers(1, 2**63, (walks, -(-self.steps // 64)), dtype=np.uint64)
        # a place far along the walk may lie behind the window's end: sample where words still stand
        self.places = [[np.sort(rng.choice(int(self.steps * 0.8), sample, replace=False)).tolist() for _ in range(keys)] for _ in range(walks)]
        self.factors = rng.integers(1, 2**63, (walks, keys, sample), dtype=np.uint64) | np.uint64(1)

    def __len__(self) -> int:
        return len(self.places) * self.keys_per_walk

    def keys(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The keys, one row each, of the windows at ``starts`` (ascending) of the code array; a window
        ends at its text's end, ``stops``, where that comes first."""
        out = np.zeros((len(self), len(starts)), np.uint64)
        far = np.concatenate((codes, np.zeros(self.steps + 2, np.uint64)))
        ends = np.minimum(starts + self.words, stops)
        for c in range(0, len(starts), WINDOW_CHUNK):
            s = starts[c : c + WINDOW_CHUNK]
            base = int(s[0])
            own = far[base : int(s[-1]) + self.steps + 2]
            spread, here, end = _mix(own, np.uint64(0)), np.arange(len(own)), ends[c : c + WINDOW_CHUNK] - base
            for w, places in enumerate(self.places):
                at, took = s - base, {}
                for k, row in enumerate(places):
                    for i, j in enumerate(row):
                        took.setdefault(j, []).append((w * self.keys_per_walk + k, self.factors[w, k, i]))
                for j in range(max(took) + 1):
                    if j % 64 == 0:
                        bits = _mix(own, self.salts[w, j // 64])
                    if j in took:
                        value = np.where(at < end, spread[at], np.uint64(0))
                        for k, factor in took[j]:
                            out[k, c : c + WINDOW_CHUNK] += value * factor
                    at = (here + ((bits >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64))[at]
        return out


def code_words(words: list[str], memo: dict[str, int]) -> np.ndarray:
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def within(a: list[str], b: list[str], edits: int) -> int | None:
    """The word-level edit distance if it is at most ``edits``, in a band of that width."""
    if a == b:
        return 0
    if edits == 0 or abs(len(a) - len(b)) > edits:
        return None
    far = edits + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [far] * len(b)
        for j in range(max(1, i - edits), min(len(b), i + edits) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > edits:
            return None
    return row[-1] if row[-1] <= edits else None


def within_prefix(a: list[str], b: list[str], edits: int) -> int | None:
    """The least word-level edit distance between ``a`` and a beginning of ``b``, if at most ``edits``."""
    if a == b[: len(a)]:
        return 0
    if edits == 0 or len(b) < len(a) - edits:
        return None
    far = edits + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [far] * len(b)
        for j in range(max(1, i - edits), min(len(b), i + edits) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > edits:
            return None
    return min(row)


class ItemIndex:
    """Sorted keys of all item windows, with the window behind each."""

    def __init__(self, items: list[tuple[int, str]], walks: Walks) -> None:
        self.walks, n = walks, walks.words
        memo: dict[str, int] = {}
        self.windows: list[tuple[int, list[str]]] = []
        seen = set()
        for item, text in items:
            w = words_of(text)
            for k in range(len(w) - n + 1):
                x = (item, *w[k : k + n])
                if x not in seen:
                    seen.add(x)
                    self.windows.append((item, w[k : k + n]))
        self.sorted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not self.windows:
            return
        codes = np.concatenate([code_words(w, memo) for _, w in self.windows])
        self.codes = codes.reshape(-1, n)
        starts = np.arange(len(self.windows)) * n
        for key in walks.keys(codes, starts, starts + n):
            order = np.argsort(key, kind="stable")
            some = np.zeros(1 << FILTER, bool)
            some[key >> np.uint64(64 - FILTER)] = True
            self.sorted.append((key[order], order, some))

    def candidates(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in starts, window numbers) of the pairs with an equal key, key by key."""
        for (keys, order, some), probe in zip(self.sorted, self.walks.keys(codes, starts, stops), strict=True):
            hit = np.flatnonzero(some[probe >> np.uint64(64 - FILTER)])
            lo = np.searchsorted(keys, probe[hit], "left")
            n = np.searchsorted(keys, probe[hit], "right") - lo
            for part in np.array_split(np.arange(len(hit)), n.sum() // PAIR_CHUNK + 1):
                k = n[part]
                at = np.repeat(lo[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield np.repeat(hit[part], k), order[at]


def _blocks(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Documents' words in blocks of about BLOCK_WORDS, texts under ``least`` words left out; a longer
    text in slices that overlap by ``most`` - 1."""
    block, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(text)
            for k in range(0, max(len(w) - least + 1, 0), BLOCK_WORDS):
                part = w[k : k + BLOCK_WORDS + most - 1]
                block.append((doc, part))
                size += len(part)
                if size >= BLOCK_WORDS:
                    yield block
                    block, size = [], 0
    if block:
        yield block


def _likely(far: np.ndarray, at: np.ndarray, want: np.ndarray, edits: int) -> np.ndarray:
    """Which candidates have all words but ``edits`` at most ``edits`` places off: no pair within the
    distance is lost, as its common words stand so."""
    n = want.shape[1]
    near = np.zeros(want.shape, bool)
    for shift in range(-edits, edits + 1):
        lo = max(0, -shift)
        near[:, lo:] |= far[at[:, None] + np.arange(lo + shift, n + shift)] == want[:, lo:]
    return near.sum(1) >= n - edits


def _finder(index: ItemIndex, edits: int):
    n = index.walks.words
    least = max(1, n - edits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for block in _blocks(batches, least, n + edits):
            if len(memo) > 2_000_000:
                memo.clear()
            codes = [code_words(w, memo) for _, w in block]
            first = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
            starts = np.concatenate([np.arange(f, f + len(c) - least + 1) for f, c in zip(first, codes, strict=False)])
            owner = np.repeat(np.arange(len(block)), [len(c) - least + 1 for c in codes])
            best: dict[tuple[int, int], int] = {}
            flat = np.concatenate(codes)
            far = np.concatenate((flat, np.zeros(n + edits, np.uint64)))
            pairs = []
            for place, win in index.candidates(flat, starts, first[owner + 1]):
                keep = _likely(far, starts[place], index.codes[win], edits)
                pairs.append(place[keep] * len(index.windows) + win[keep])
            for k, win in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(pairs)), len(index.windows))), strict=True):
                d, (item, want) = int(owner[k]), index.windows[win]
                key = (block[d][0], item)
                if best.get(key) == 0:
                    continue
                s = int(starts[k] - first[d])
                dist = within_prefix(want, block[d][1][s : s + n + edits], edits)
                if dist is not None:
                    best[key] = min(dist, best.get(key, dist))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in best], pa.int64()), pa.array([b for _, b in best], pa.int64()), pa.array(list(best.values()), pa.int32())], names=["doc_id", "item_id", "edits"])

    return find


def _keyed(walks: Walks, edits: int, reach: int, bloom: np.ndarray | None = None):
    """Rows (knum, key, id, win) of the windows, for the shuffled way; ``win`` reaches ``reach`` words
    further than the window. With a filter, only keys that may be in it."""
    n = walks.words
    least = max(1, n - edits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for block in _blocks(batches, least, n + edits):
            codes = [code_words(w, memo) for _, w in block]
            first = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
            starts = np.concatenate([np.arange(f, f + len(c) - least + 1) for f, c in zip(first, codes, strict=False)])
            owner = np.repeat(np.arange(len(block)), [len(c) - least + 1 for c in codes])
            for m, key in enumerate(walks.keys(np.concatenate(codes), starts, first[owner + 1])):
                own = np.arange(len(key)) if bloom is None else np.flatnonzero(np.all([(bloom[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) for b in _bits(m, key, 64 * len(bloom))], 0))
                docs = owner[own].tolist()
                wins = [" ".join(block[d][1][s : s + n + reach]) for d, s in zip(docs, (starts[own] - first[owner[own]]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), m, np.int32)), pa.array(key[own].view(np.int64)), pa.array([block[d][0] for d in docs], pa.int64()), pa.array(wins, pa.string())], names=["knum", "key", "id", "win"]
                )

    return rows


def _bits(m: int, key: np.ndarray, size: int) -> list[np.ndarray]:
    """The two places of each key in a filter of ``size`` (a power of two) bits."""
    x = _mix(key, np.uint64(m + 1))
    return [x & np.uint64(size - 1), (x >> np.uint64(32)) & np.uint64(size - 1)]


def bloom_of(keyed: DataFrame, size: int) -> np.ndarray:
    """The filter of the keys (knum, key): its 64-bit words are put together by the executors, at
    most ``size`` / 64 rows reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            num = b.column("knum").to_numpy()
            bits = np.unique(np.concatenate([np.concatenate(_bits(m, key[num == m], size)) for m in np.unique(num).tolist()] or [np.zeros(0, np.uint64)]))
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    words = np.zeros(size >> 6, np.uint64)
    for r in keyed.select("knum", "key").mapInArrow(slots, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[r["slot"]] = np.uint64(r["bits"] & (2**64 - 1))
    return words


def _verify(edits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [within_prefix(y.split(" "), x.split(" "), edits) for x, y in zip(b.column("win").to_pylist(), b.column("want").to_pylist(), strict=True)]
            keep = [k for k, x in enumerate(d) if x is not None]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), b.column("item_id").take(pa.array(keep, pa.int64())), pa.array([d[k] for k in keep], pa.int32())], names=["doc_id", "item_id", "edits"])

    return rows


def leaks(documents: DataFrame, items: DataFrame, words: int = 11, edits: int = 0, sample: int = 6, recall: float = 0.95, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold ``words`` consecutive words of an item within
    ``edits`` word edits; 0 edits are found without loss, more with the recall wanted."""
    walks = Walks(words, walks_for(edits, words, sample, recall), sample)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") > 0)
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.length("text") > 0).distinct()
    # an upper bound of the items' windows, counted before anything is collected: in any script a
    # text has at most as many words as characters
    n = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if n * len(walks) <= broadcast_windows:
        index = ItemIndex([(r["item_id"], r["text"]) for r in own.toLocalIterator()], walks)
        if not index.windows:
            return docs.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).alias("edits")).limit(0)
        found = docs.mapInArrow(_finder(index, edits), "doc_id bigint, item_id bigint, edits int")
    else:
        rows = "knum int, key bigint, id bigint, win string"
        b = own.mapInArrow(_keyed(walks, 0, 0), rows).withColumnsRenamed({"id": "item_id", "win": "want"}).distinct()
        size = min(BLOOM_BITS, 1 << max(16, (64 * n * len(walks)).bit_length()))
        a = docs.mapInArrow(_keyed(walks, edits, edits, bloom_of(b, size)), rows).withColumnRenamed("id", "doc_id")
        found = a.join(b, ["knum", "key"]).select("doc_id", "item_id", "win", "want").distinct().mapInArrow(_verify(edits), "doc_id bigint, item_id bigint, edits int")
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
