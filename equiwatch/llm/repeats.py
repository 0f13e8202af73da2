"""Removal of long byte strings that occur more than once (suffix-array dedup).

Which bytes are covered by a ``LENGTH``-byte string that also starts somewhere
else is found by a positional sort: rows aligned at anchors are ordered a symbol
at a time by a stable partition, and the common parts of neighbours follow from
each step.  It takes the place of a merge of shards' Burrows-Wheeler transforms,
which would need a pass over the whole corpus per byte; no shard has an order of
its own.

Beside what is removed, shorter repeats are reported: ``n_repeated`` bytes are covered
by a ``NOTICE``-byte string (about 45 words) that also starts elsewhere.  A passage of
over 50 words that two documents share need not reach ``LENGTH`` bytes.

1. Every window of ``NOTICE`` bytes has an anchor, its least hashed 32-byte gram
   (the last of equal ones); a longer window has that of its beginning.  Equal
   windows have equal anchors at equal places, so windows need comparing only
   where anchors are equal.  Consecutive windows share an anchor: a text of n bytes
   has about n / 113.
2. Copies of a text are one row with a count: a text that occurs twice is covered
   as a whole.  Anchors that occur once are dropped by a partial aggregate.
3. For the others, the bytes of all windows of an anchor (its segment) go to the
   anchor's partition.  There the Arrow batches are joined and the segments,
   aligned at the anchor, are sorted column by column (``merge_shards``).  After a
   column the rows stand in the order of their reversed prefixes, each with the
   column where its common part with its neighbour begins; a window is repeated if
   that reaches back ``LENGTH`` (or ``NOTICE``) bytes on either side.
4. An anchor with more than ``HOT`` occurrences (say, the edge of a passage that a
   third of all documents share) isn't gathered in a task: its windows are
   counted by 128-bit fingerprints with partial aggregates instead.

Bytes are compared as they are; hashes only bring together what is compared
(except in step 4, and for texts named by two 64-bit hashes).

Defined cases: null is an empty text; a text shorter than ``LENGTH`` keeps all its
bytes, and one shorter than ``NOTICE`` has no repeats; repeated rows are copies; matches never cross documents; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import materialize
from .arrowtext import BYTE_VALUE, chunks, flat, random_words, tidy
from .neardup import text_name

LENGTH, NOTICE, GRAM = 400, 256, 32
#: Where a window may begin, counted from its anchor.
FIRST = -(NOTICE - GRAM)
#: Windows handled at a time when anchors are chosen.
TILE = 1 << 18
#: Segment bytes merged at a time, at most (whole anchors).
BLOCK_BYTES = 8 << 20
HOT = 20_000
_POSITION = np.uint64((1 << 28) - 1)
PRINT_VALUE = random_words(43, 512).reshape(2, 256)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    base = int(random_words(41, 1)[0]) | 1
    size = TILE + LENGTH + 1
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POWERS: list = []


def gram_hashes(data: np.ndarray, width: int = GRAM, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Hash of every ``width`` consecutive bytes (of a tile)."""
    if not _POWERS:
        _POWERS.extend(_tables())
    up, down = _POWERS
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=total[1:])
    x = (total[width:] - total[:-width]) * down[:len(data) - width + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_prints(text: np.ndarray, width: int) -> np.ndarray:
    """128-bit fingerprints (two numbers each) of every window of ``width`` bytes of a text."""
    out = np.zeros((max(0, len(text) - width + 1), 2), np.uint64)
    for lo in range(0, len(out), TILE):
        hi = min(len(out), lo + TILE)
        for k in range(2):
            out[lo:hi, k] = gram_hashes(text[lo:hi + width - 1], width, PRINT_VALUE[k])
    return out.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first window, last window) of every run of windows with one anchor.

    Places are counted from the text's first byte.
    """
    out = []
    width = NOTICE - GRAM + 1
    text_end = np.repeat(offsets[1:], np.diff(offsets))  # of every byte
    for lo in range(0, max(0, len(data) - NOTICE + 1), TILE):
        hi = min(len(data) - NOTICE + 1, lo + TILE)
        grams = gram_hashes(data[lo:hi + NOTICE - 1])
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~_POSITION) | (_POSITION - place), width)
        at = (_POSITION - (least & _POSITION)).astype(np.int64)
        p = lo + np.flatnonzero(text_end[lo:hi] - np.arange(lo, hi) >= NOTICE)
        if not len(p):
            continue
        a = at[p - lo]
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != 1) | (text_end[p[1:]] != text_end[p[:-1]])) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(p)])) - 1
        out.append((p[first], p[last], a[first] + lo, grams[a[first]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    begin, end, at, value = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.diff(at, prepend=-1) != 0  # a run that goes on in the next tile is one spot
    begin, end, at, value = begin[new], end[np.append(np.flatnonzero(new)[1:], len(new)) - 1], at[new], value[new]
    text = np.searchsorted(offsets, begin, side="right") - 1
    base = offsets[text]
    return text, value.view(np.int64), at - base, begin - base, end - base


def merge_shards(bucket: np.ndarray, segment: np.ndarray, offsets: np.ndarray, left: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows of aligned segments, of ``LENGTH`` and of ``NOTICE`` bytes.

    Row i, column j means the window at ``FIRST + j`` from its anchor.  ``bucket``
    (sorted) numbers the anchors, ``left`` is the bytes before a row's anchor.  The
    order starts as the rows come and is refined by one column of bytes at a time.
    """
    n, size = len(bucket), np.diff(offsets)
    right = size - left
    back, ahead = int(left.max()), int(right.max())
    columns = np.zeros((back + ahead, n), np.uint8)
    row = np.repeat(np.arange(n), size)
    columns[np.arange(len(segment)) - np.repeat(offsets[:-1], size) + np.repeat(back - left, size), row] = segment
    found = {length: np.zeros((1 - FIRST, n), bool) for length in (LENGTH, NOTICE)}
    order, since = np.arange(n), np.full(n, -back)
    for c in range(-back, min(ahead, LENGTH)):
        symbol = columns[c + back][order].astype(np.int64)
        inside = (c >= -left[order]) & (c < right[order])
        symbol[~inside] = 256
        key = bucket[order] * 512 + symbol
        if (key[1:] < key[:-1]).any():
            move = np.argsort(key, kind="stable")
            key = key[move]
            # the common part with the new neighbour: the latest of all that lay between them
            new = since[move]
            jump = np.flatnonzero((np.diff(move) != 1) & (key[1:] == key[:-1])) + 1
            if len(jump):
                span = np.stack((move[jump - 1] + 1, move[jump] + 1), 1)
                padded = np.append(since, 0)
                new[jump] = np.maximum.reduceat(padded, span.ravel())[::2]
            order, since, inside = order[move], new, inside[move]
        alone = np.ones(len(key), bool)
        alone[1:] = key[1:] != key[:-1]
        since[alone | ~inside] = c + 1
        for length, hits in found.items():
            start = c - length + 1
            if FIRST <= start <= 0:
                hit = since <= start
                hit[:-1] |= since[1:] <= start
                hits[start - FIRST, order] = hit
        if c >= GRAM - 1:
            # a window holds its anchor: rows that share it with no neighbour any more are done
            stay = since <= 0
            stay[:-1] |= since[1:] <= 0
            if not stay.any():
                break
            if stay.mean() < 0.8:
                order, since = order[stay], since[stay]
    return found[LENGTH].T, found[NOTICE].T


def window_runs(found: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the bytes covered by runs of repeated windows."""
    edge = np.diff(np.pad(found.view(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    base = anchor[row] + FIRST
    return row, base + begin, base + end - 1 + length


def pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A spot's place in one number: the anchor, and how far before it its first and last windows begin (under 512)."""
    return (at << 18) | ((at - first) << 9) | (at - last)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window)."""
    at = place >> 18
    return at, at - ((place >> 9) & 511), at - (place & 511)


def _anchored(named: DataFrame) -> DataFrame:
    """(t1, t2, copies, hashes, places) of every distinct text."""
    def run(batches):
        for b in batches:
            counts, parts = np.zeros(len(b), np.int64), []
            for lo, hi, data, offsets in chunks(b.column(0)):
                owner, hash_, at, first, last = anchors(data, offsets)
                counts[lo:hi] = np.bincount(owner, minlength=hi - lo)
                parts.append((hash_, pack(at, first, last)))
            edges = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            columns = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *columns], names=["t1", "t2", "hashes", "places"])

    rows = named.select("_text", "t1", "t2").where(F.octet_length("_text") >= NOTICE).mapInArrow(
        tidy(run), "t1 bigint, t2 bigint, hashes array<bigint>, places array<bigint>")
    return rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.any_value("hashes").alias("hashes"),
                                        F.any_value("places").alias("places"))


def _segments(texts: DataFrame) -> DataFrame:
    """(hash, t1, t2, at, before, segment) of the spots that aren't hot."""
    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(0))
            hash_, places, hot = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3, 6))
            at, first, last = unpack(places)
            count = b.column(3).value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(b)), count)
            keep = np.flatnonzero(~hot.astype(bool))
            t1, t2 = (b.column(i).to_numpy()[owner] for i in (1, 2))
            for lo in range(0, len(keep), 4096):
                own = keep[lo:lo + 4096]
                begin = offsets[owner[own]] + first[own]
                end = np.minimum(offsets[owner[own] + 1], offsets[owner[own]] + last[own] + LENGTH)
                size = end - begin
                edge = np.concatenate(([0], np.cumsum(size)))
                cut = data[np.arange(edge[-1]) - np.repeat(edge[:-1], size) + np.repeat(begin, size)]
                segment = pa.Array.from_buffers(pa.binary(), len(own),
                                                [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(cut)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hash_[own]), pa.array(t1[own]), pa.array(t2[own]), pa.array(at[own]),
                     pa.array(at[own] - first[own]), segment],
                    names=["hash", "t1", "t2", "at", "before", "segment"])

    return texts.select("_text", "t1", "t2", "hashes", "places", "hot", "_key").mapInArrow(  # _key: see remove_repeats
        run, "hash bigint, t1 bigint, t2 bigint, at bigint, before bigint, segment binary")


def _merged_runs(segments: DataFrame, partitions: int) -> DataFrame:
    """(t1, t2, begin, end, gone) of repeated windows, anchor by anchor; ``gone``: of ``LENGTH`` bytes."""
    def merged(held):
        hash_, t1, t2, at, before, size, segment = (np.concatenate([h[i] for h in held]) for i in range(7))
        offsets = np.concatenate(([0], np.cumsum(size)))
        bucket = np.concatenate(([0], np.cumsum(hash_[1:] != hash_[:-1])))
        both = zip(merge_shards(bucket, segment, offsets, before), (LENGTH, NOTICE), strict=True)
        runs = [(*window_runs(found, at, length), length == LENGTH) for found, length in both]
        row, begin, end = (np.concatenate([r[k] for r in runs]) for k in range(3))
        gone = np.repeat([r[3] for r in runs], [len(r[0]) for r in runs])
        return pa.RecordBatch.from_arrays([pa.array(t1[row]), pa.array(t2[row]), pa.array(begin), pa.array(end), pa.array(gone)],
                                          names=["t1", "t2", "begin", "end", "gone"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            numbers = [b.column(i).to_numpy() for i in range(5)]
            data, offsets = flat(pa.Array.from_buffers(pa.string(), len(b), b.column(5).buffers(),
                                                       offset=b.column(5).offset))
            cuts = np.flatnonzero(np.diff(numbers[0])) + 1
            if held and held[-1][0][-1] != numbers[0][0]:
                cuts = np.concatenate(([0], cuts))
            lo = 0
            for cut in [*cuts.tolist(), len(b)]:
                if cut > lo:
                    held.append((*(x[lo:cut] for x in numbers), np.diff(offsets[lo:cut + 1]),
                                 data[offsets[lo]:offsets[cut]]))
                    size += int(offsets[cut] - offsets[lo])
                    lo = cut
                if cut < len(b) and size >= BLOCK_BYTES:  # whole anchors only
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    return (segments.repartition(partitions, "hash").sortWithinPartitions("hash", "t1", "t2", "at")
            .mapInArrow(tidy(run), "t1 bigint, t2 bigint, begin bigint, end bigint, gone boolean"))


def _counted_runs(texts: DataFrame) -> DataFrame:
    """(t1, t2, begin, end, gone) of the repeated windows of hot anchors, by fingerprints."""
    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(0))
            for i, (spots, hots) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                _, first, last = unpack(np.array(spots, np.int64)[np.array(hots, bool)])
                size = last - first + 1
                places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                text = data[offsets[i]:offsets[i + 1]]
                for length in (LENGTH, NOTICE):
                    own = places[places <= len(text) - length]
                    prints = window_prints(text, length)[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), b.column(1)[i].as_py())), pa.array(np.full(len(own), b.column(2)[i].as_py())),
                         pa.array(own), pa.array(np.full(len(own), length == LENGTH)), pa.array(prints[:, 0]),
                         pa.array(prints[:, 1])], names=["t1", "t2", "p", "gone", "print1", "print2"])

    # Not materialized: one plan with the other uses of the texts shuffles them once.
    windows = (texts.where(F.exists("hot", lambda x: x)).select("_text", "t1", "t2", "places", "hot", "_key")
               .mapInArrow(tidy(run), "t1 bigint, t2 bigint, p bigint, gone boolean, print1 bigint, print2 bigint"))
    place = F.xxhash64("t1", "t2", "p")
    one = ["print1", "print2", "gone"]
    twice = windows.groupBy(*one).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    length = F.when(F.col("gone"), LENGTH).otherwise(NOTICE)
    return windows.join(twice.select(*one), one).select("t1", "t2", F.col("p").alias("begin"), (F.col("p") + length).alias("end"), "gone")


def covered_runs(named: DataFrame, hot: int = HOT) -> DataFrame:
    """(t1, t2, runs) of the texts with covered bytes; ``runs`` may overlap, a copied text has one open run.

    ``named``: _text, _key, t1, t2 of all documents.
    """
    known = materialize(_anchored(named))
    spots = known.select("t1", "t2", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "t1", "t2", F.col("s.hashes").alias("hash"), "s.places")
    # A table of its own: a join of two plain shuffles is one whose hot keys Spark can split.
    repeated = materialize(spots.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = spots.join(repeated, "hash").groupBy("t1", "t2").agg(F.collect_list(F.struct(
        "hash", "places", (F.col("n") > hot).alias("hot"))).alias("s"))
    wanted = materialize(found.select("t1", "t2", F.col("s.hash").alias("hashes"), "s.places", "s.hot"))
    any_hot = wanted.where(F.exists("hot", lambda x: x)).limit(1).count()
    texts = named.join(wanted, ["t1", "t2"]).dropDuplicates(["t1", "t2"])  # copies of a text lie together here
    runs = _merged_runs(_segments(texts), int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if any_hot:
        runs = runs.unionByName(_counted_runs(texts))
    copied = known.where("copies > 1").select("t1", "t2", F.lit(0).cast("long").alias("begin"),
                                              F.lit(1 << 62).alias("end"), F.lit(True).alias("gone"))
    return runs.unionByName(copied).groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end", "gone")).alias("runs"))


def covered(runs: list[dict] | None, n: int, gone: bool) -> np.ndarray:
    """Which of a text's ``n`` bytes lie in its runs (``gone``: only those to be removed)."""
    cover = np.zeros(n + 1, np.int32)
    ends = np.array([(r["begin"], min(n, r["end"])) for r in runs or () if r["gone"] or not gone], np.int64).reshape(-1, 2)
    np.add.at(cover, ends[:, 0], 1)
    np.add.at(cover, ends[:, 1], -1)
    return np.cumsum(cover)[:-1] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", kept_bytes: bool = False,
                   hot: int = HOT) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (and ``kept``, the remaining bytes) of every document."""
    t = F.col(f"`{text}`").cast("string")
    named = docs.select(F.coalesce(t, F.lit("")).alias("_text"), F.col(f"`{key}`").alias("_key"), *text_name(t))
    # Texts meet their anchors, and later their covered runs: the same columns by
    # the same key, so that Spark shuffles the texts once and reads them twice.
    rows = named.join(covered_runs(named, hot), ["t1", "t2"], "left").select("_text", "_key", "runs")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(0))
            sizes, removed, spans, digests, repeated, kept = [], [], [], [], [], []
            for i, runs in enumerate(b.column(2).to_pylist()):
                own = data[offsets[i]:offsets[i + 1]]
                n = len(own)
                out = covered(runs, n, True) if n >= LENGTH else np.zeros(n, bool)
                noticed = covered(runs, n, False) if n >= NOTICE else out
                left = own[~out].tobytes()
                sizes.append(n)
                removed.append(int(out.sum()))
                spans.append(int((np.diff(out.view(np.int8), prepend=0) == 1).sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                repeated.append(int(noticed.sum()))
                kept.append(left if kept_bytes else None)
            columns = [b.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(repeated, pa.int64())]
            names = ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
            if kept_bytes:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = ", kept binary" if kept_bytes else ""
    return rows.mapInArrow(tidy(run), f"_key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                           "n_repeated bigint"
                           + extra).withColumnRenamed("_key", key)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start more than once; n_repeated: bytes of 256-byte ones."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
