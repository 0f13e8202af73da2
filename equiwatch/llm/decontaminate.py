"""Benchmark decontamination with suffix arrays over the training text.

Every chunk of documents in a task is a shard.  A shard's words are numbered by
the benchmark's vocabulary (0: no benchmark word), and its suffix array holds
the suffixes that can match: those that begin with at least as many benchmark
words as the shortest window has (no other suffix shares a window with a test
suffix).  Words are packed several to an integer, and suffixes are sorted by
those, ties only by the next ones, down to the longest item.

Every test suffix is searched by bisection in every shard: the range of suffixes
that begin with its window gives the hits, and its neighbours at the insertion
point give its longest verbatim match and where that is.

Test suffixes reach the tasks in blocks of bounded size, read from the
benchmark a block at a time; one more block is one more column-wise pass over
the documents in the same stage, so there is no shuffle and no join.

A window is ``window`` consecutive item words; an item of fewer words, but not
none, is one window.  Words are searched by hash; the words
of the windows found are then compared byte by byte.

Defined cases: a null or empty document has no words and is never hit; a null or
empty item has no windows; repeated rows are judged each on its own; repeated
items count once per distinct id (null ids are left out of the id list); an empty
benchmark hits nothing; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import LOWER, chunks, tidy, with_text_column, word_bounds, word_hashes

WINDOW = 10
#: Benchmark text that travels to the tasks at a time.
BLOCK_BYTES = 8 << 20
#: Pairs of a document's and an item's suffix extended at a time.
PAIRS = 1 << 19
#: Document text per shard.
SHARD_BYTES = 1 << 20


@dataclass
class TestBlock:
    """Items of one block as word numbers, one 0 after each item."""

    vocabulary: np.ndarray   # sorted word hashes; word number = place + 1
    spelled: list[bytes]     # the words in that order
    ids: np.ndarray          # word numbers of all items, 0 between them
    item: np.ndarray         # item of each place
    labels: list             # item ids
    suffix: np.ndarray       # places where a window begins
    class_of: np.ndarray     # class of that window
    order: np.ndarray        # classes: place and words of each distinct window
    members: list            # items of each class
    per_key: int             # words packed into one integer
    bits: int


def build_block(items: list[tuple[object, str]], window: int = WINDOW) -> TestBlock:
    texts = pa.array([t for _, t in items], pa.large_string())
    hashes, spelled, places, labels_at = [], {}, [], []
    for lo, _, data, offsets in chunks(texts, 1 << 30):
        low = LOWER[data]
        starts, ends, first = word_bounds(data, offsets)
        own = word_hashes(data, starts, ends)
        for h, s, e in zip(own.tolist(), starts, ends, strict=True):
            spelled.setdefault(h, bytes(low[s:e]))
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            hashes.append(own[a:b])
            labels_at.append(lo + i)
    vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    bits = max(4, int(len(vocabulary) + 1).bit_length())
    pieces, item, at = [], [], 0
    suffix, size = [], []
    for h, i in zip(hashes, labels_at, strict=True):
        pieces += [np.searchsorted(vocabulary, h) + 1, np.zeros(1, np.int64)]
        item.append(np.full(len(h) + 1, i))
        if len(h):
            n = min(window, len(h))
            suffix.append(at + np.arange(len(h) - n + 1))
            size.append(np.full(len(h) - n + 1, n))
        at += len(h) + 1
    ids = np.concatenate([*pieces, np.zeros(0, np.int64)]).astype(np.int64)
    item_of = np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64)
    suffix_, size_ = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (suffix, size))
    classes: dict[bytes, int] = {}
    order, members, class_of = [], [], []
    for p, n in zip(suffix_.tolist(), size_.tolist(), strict=True):
        c = classes.setdefault(ids[p:p + n].tobytes(), len(order))
        if c == len(order):
            order.append([p, n])
            members.append(set())
        members[c].add(int(item_of[p]))
        class_of.append(c)
    return TestBlock(vocabulary, [spelled[h] for h in vocabulary.tolist()], ids, item_of, [i for i, _ in items],
                     suffix_, np.array(class_of, np.int64), np.array(order, np.int64).reshape(-1, 2),
                     [sorted(m) for m in members], max(1, 62 // bits), bits)


def _packed(ids: np.ndarray, at: np.ndarray, block: TestBlock) -> np.ndarray:
    """The words from each place, ``per_key`` of them in one integer (0 past a text's end)."""
    out = np.zeros(len(at), np.int64)
    for k in range(block.per_key):
        out = (out << block.bits) | ids[at + k]
    return out


class SuffixArray:
    """Suffixes of a shard in order; ``ids`` has zeros between texts and a tail of zeros."""

    def __init__(self, ids: np.ndarray, least: int, longest: int, block: TestBlock):
        self.block, self.depth = block, -(-longest // block.per_key)
        self.ids = np.concatenate((ids, np.zeros((self.depth + 1) * block.per_key, np.int64)))
        run = np.flatnonzero(np.concatenate((ids, [0])) == 0)
        able = np.flatnonzero(ids)
        able = able[run[np.searchsorted(run, able)] - able >= least] if len(able) else able
        keys = _packed(self.ids, able, block)
        order = np.argsort(keys, kind="stable")
        place, keys = able[order], keys[order]
        tie = np.concatenate(([False], keys[1:] == keys[:-1])) if len(keys) else np.zeros(0, bool)
        for level in range(1, self.depth):  # only what is still tied is sorted by its next words
            both = tie | np.concatenate((tie[1:], [False]))
            at = np.flatnonzero(both)
            if not len(at):
                break
            group = np.cumsum(~tie[at])
            more = _packed(self.ids, place[at] + level * block.per_key, block)
            new = np.lexsort((more, group))
            place[at], more = place[at][new], more[new]
            tie[at] = tie[at] & np.concatenate(([False], more[1:] == more[:-1]))
        self.place = place

    def _less(self, rows: np.ndarray, tests: np.ndarray, size: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffixes at ``rows`` come before the first ``size`` words at the tests' places."""
        out = np.full(len(rows), or_equal)
        open_ = np.arange(len(rows))
        k = 0
        while len(open_):
            a = self.ids[self.place[rows[open_]] + k]
            b = self.block.ids[tests[open_] + k]
            out[open_[a < b]] = True
            out[open_[a > b]] = False
            k += 1
            open_ = open_[(a == b) & (size[open_] > k)]
        return out

    def bound(self, tests: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """Bisection of every test suffix at once."""
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(self.place), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            right = self._less(mid, tests[open_], size[open_], upper)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    def common(self, rows: np.ndarray, tests: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``rows`` share with the tests, up to the items' ends."""
        out = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero((rows >= 0) & (rows < len(self.place)))
        k = 0
        while len(open_):
            a = self.ids[self.place[rows[open_]] + k]
            open_ = open_[(a == self.block.ids[tests[open_] + k]) & (tests[open_] + k < ends[open_])]
            out[open_] += 1
            k += 1
        return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(starts, size)].tobytes()


def search_shard(data: np.ndarray, offsets: np.ndarray, block: TestBlock) -> dict:
    """Hits of one block's windows in one shard: hit words per text, (text, item) pairs, longest matches."""
    starts, ends, first = word_bounds(data, offsets)
    out = {"hit": np.zeros(len(starts), bool), "first": first, "pairs": set(), "longest": []}
    if not len(starts) or not len(block.order):
        return out
    words = word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(block.vocabulary, words), len(block.vocabulary) - 1)
    numbers = np.where(block.vocabulary[at] == words, at + 1, 0)
    low = LOWER[data]
    while True:
        got = _search_numbers(numbers, first, block)
        hit = np.flatnonzero(got["hit"])
        spelled = [block.spelled[i - 1] for i in numbers[hit].tolist()]
        if _joined(low, starts[hit], ends[hit]) == b"".join(spelled) and \
                np.array_equal(ends[hit] - starts[hit], [len(w) for w in spelled]):
            return out | got
        for w, word in zip(hit.tolist(), spelled, strict=True):  # another word of the same hash
            if low[starts[w]:ends[w]].tobytes() != word:
                numbers[w] = 0


def _search_numbers(numbers: np.ndarray, first: np.ndarray, block: TestBlock) -> dict:
    n = len(first) - 1
    spread = np.arange(len(numbers)) + np.repeat(np.arange(n), np.diff(first))  # one 0 after each text
    ids = np.zeros(len(numbers) + n, np.int64)
    ids[spread] = numbers
    out = {"hit": np.zeros(len(numbers), bool), "pairs": set(), "longest": []}
    place, sizes = block.order[:, 0], block.order[:, 1]
    array = SuffixArray(ids, int(sizes.min()), int(np.bincount(block.item).max()), block)
    lo, hi = array.bound(place, sizes, False), array.bound(place, sizes, True)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return out
    text_of = np.repeat(np.arange(n), np.diff(first) + 1)
    word_of = np.full(len(ids), -1, np.int64)
    word_of[spread] = np.arange(len(numbers))
    cover = np.zeros(len(numbers) + 1, np.int64)
    for c in found.tolist():
        rows = array.place[lo[c]:hi[c]]
        begin = word_of[rows]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + sizes[c], -1)
        out["pairs"].update((t, i) for t in np.unique(text_of[rows]).tolist() for i in block.members[c])
    out["hit"] = np.cumsum(cover)[:-1] > 0
    out["longest"] = _longest_matches(array, lo, hi, found, text_of, word_of, first)
    return out


def _longest_matches(array: SuffixArray, lo: np.ndarray, hi: np.ndarray, found: np.ndarray, text_of: np.ndarray,
                     word_of: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, first word, words, item): the longest verbatim match of every text and item with an occurring window.

    Every suffix in a window's range is extended, so copies of a passage each have
    theirs.  Where the words before match too, the match that begins there is longer.
    """
    block, best = array.block, {}
    own = np.flatnonzero(np.isin(block.class_of, found))
    count = (hi - lo)[block.class_of[own]]
    step = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), PAIRS), side="left")
    for a, z in zip(step, [*step[1:], len(own)], strict=True):
        n = count[a:z]
        tests = np.repeat(block.suffix[own[a:z]], n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[block.class_of[own[a:z]]], n)
        place = array.place[rows]
        before = np.where((place > 0) & (tests > 0), array.ids[place - 1], 0)
        start = np.flatnonzero((before == 0) | (before != block.ids[tests - 1]))
        rows, tests, place = rows[start], tests[start], place[start]
        words = array.common(rows, tests, np.searchsorted(block.item, block.item[tests], side="right") - 1)
        text = text_of[place]
        at = word_of[place] - first[text]
        for t, i, k, p in zip(text.tolist(), block.item[tests].tolist(), (-words).tolist(), at.tolist(), strict=True):
            if (k, p) < best.get((t, i), (0, 0)):
                best[t, i] = k, p
    return [(t, p, -k, i) for (t, i), (k, p) in best.items()]


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                     window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[TestBlock]:
    """Blocks of items, read a partition at a time."""
    rows, size = [], 0
    source = benchmark.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`"), F.col(f"`{text}`"))
    for r in source.toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= block_bytes:
            yield build_block(rows, window)
            rows, size = [], 0
    if rows:
        yield build_block(rows, window)


_RESULT_TYPE = ("n_words bigint, hits array<struct<begin:bigint,end:bigint>>, items array<string>, "
                "longest array<struct<item_id:string,begin:bigint,words:bigint>>")


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
           keep: list[str] | None = None, item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` (default: all columns) of every document and ``_ew_found``: its words, hit runs, items and matches.

    ``hits``: maximal runs of hit words; ``items``: ids of the items with an
    occurring window, as sorted strings; ``longest``: per item with an occurring window
    the longest verbatim match in the document (the first of equal ones).

    The benchmark passes the driver block by block, and all blocks are broadcast: a
    benchmark is to fit a worker's memory, documents need not.
    """
    keep = list(docs.columns if keep is None else keep)
    blocks = [docs.sparkSession.sparkContext.broadcast(vars(b))
              for b in benchmark_blocks(benchmark, item, text, window, block_bytes)]
    found = T.StructType.fromDDL(_RESULT_TYPE)
    schema = T.StructType([*(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)),
                           T.StructField("_ew_found", found)])
    arrow = pa.struct([("n_words", pa.int64()),
                       ("hits", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                       ("items", pa.list_(pa.string())),
                       ("longest", pa.list_(pa.struct([("item_id", pa.string()), ("begin", pa.int64()),
                                                       ("words", pa.int64())])))])

    def run(batches):
        for b in batches:
            rows = [None] * len(b)
            for lo, hi, data, offsets in chunks(b.column(at), SHARD_BYTES):
                items = [set() for _ in range(hi - lo)]
                longest = [{} for _ in range(hi - lo)]
                hit = None
                for shared in blocks:
                    block = TestBlock(**shared.value)
                    got = search_shard(data, offsets, block)
                    hit = got["hit"] if hit is None else hit | got["hit"]
                    for t, i in got["pairs"]:
                        items[t].add(block.labels[i])
                    for t, begin, k, i in got["longest"]:
                        label = str(block.labels[i])
                        if (-k, begin) < longest[t].get(label, (0, 0)):
                            longest[t][label] = (-k, begin)
                if hit is None:
                    _, _, first = word_bounds(data, offsets)
                    hit = np.zeros(first[-1], bool)
                else:
                    first = got["first"]
                for t in range(hi - lo):
                    own = hit[first[t]:first[t + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist() \
                        if own.any() else []
                    rows[lo + t] = {
                        "n_words": int(first[t + 1] - first[t]),
                        "hits": [{"begin": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)],
                        "items": sorted(str(i) for i in items[t] if i is not None),
                        "longest": [{"item_id": i, "begin": p, "words": -k}
                                    for i, (k, p) in sorted(longest[t].items())]}
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(rows, arrow)],
                                              names=[f.name for f in schema])

    rows, at = with_text_column(docs, text, keep)
    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "_ew_found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, in the columns they came in."""
    return search(docs, benchmark, **options).where(F.size("_ew_found.hits") == 0).select(
        *[f"`{c}`" for c in docs.columns])


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which words of which document lie in a 10-word window of a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n_hit = F.aggregate("_ew_found.hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["begin"])
    return found.select(
        "doc_id", F.col("_ew_found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_ew_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_ew_found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.col("_ew_found.longest").alias("longest"))
