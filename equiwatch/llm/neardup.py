"""N-gram Jaccard join by MinHash banding, and the near-duplicate classes it makes.

1. Every text becomes its set of hashed word 5-grams; texts with the same set are
   one node from here on (a group of copies is one row, whatever its size).
2. A node's MinHash signature is cut into bands.  Band and row counts are the
   cheapest that find a pair at the threshold with the wanted probability.
3. Nodes are shuffled on band hashes.  A bucket with the same members as another
   is dropped, so most pairs meet once.
4. Buckets are verified on full n-gram sets, computed again from the texts.  A
   bucket larger than a task should hold is cut into blocks, and every pair of
   blocks is a cell of its own; a pair that meets in several buckets counts in
   the first of them only.  Cells return link counts and a spanning forest, never
   the pairs.
5. Classes are the connected components of the verified links.

The number of links of a document counts every other document at or above the
threshold, copies included.

Defined cases: a text of 1 to 4 words has one n-gram, all its words; a text
without words, but not empty, has one n-gram, itself; a null or empty text has
none, links to nothing and is a class of its own; repeated rows are copies of
each other; a null id is kept, and a class is named by its least id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import materialize
from .arrowtext import chunks, flat, mix, random_words, shingle_hashes, tidy, word_bounds, word_hashes
from .components import components

THRESHOLD, NGRAM, RECALL = 0.8, 5, 0.9999
MAX_HASHES = 192
#: A cell holds two blocks of a bucket; a block has about so many nodes and n-grams at most.
BLOCK_NODES, BLOCK_GRAMS = 768, 1 << 20
#: Rows of (node, cell) that may be broadcast; beyond, the join with the texts is shuffled.
BROADCAST_ROWS = 400_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands whose number for ``recall`` at ``threshold`` needs ``most`` hashes at most."""
    best = None
    for rows in range(1, most + 1):
        bands = ceil(np.log1p(-recall) / np.log1p(-threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within the hashes allowed")
    return best


def text_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of some texts, and each text's first (``len + 1``)."""
    starts, ends, first = word_bounds(data, offsets)
    grams, begin = shingle_hashes(word_hashes(data, starts, ends), first, n)
    bare = np.flatnonzero((np.diff(begin) == 0) & (np.diff(offsets) > 0))
    if len(bare):  # no words: the text itself, as a word of another kind
        own = word_hashes(data, offsets[bare], offsets[bare + 1]) ^ np.uint64(0x5bd1e995)
        grams = np.insert(grams, begin[bare], own)
        begin = begin + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(begin) - 1), bare))))
    return grams, begin


def gram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-grams."""
    out = []
    for _, _, data, offsets in chunks(column):
        grams, begin = text_grams(data, offsets, n)
        out += [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return out


def set_key(grams: np.ndarray) -> bytes:
    """128 bits of a set of n-grams."""
    a = mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    b = mix(grams ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return int(a.sum(dtype=np.uint64)).to_bytes(8, "big") + int(b.sum(dtype=np.uint64)).to_bytes(8, "big")


def band_hashes(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` hashes per text with n-grams (texts without are left out)."""
    full = begin[:-1][np.diff(begin) > 0]
    factor = random_words(17, bands * rows) | np.uint64(1)
    out = np.zeros((len(full), bands), np.uint64)
    step = 1 << 16  # keep what is worked on in the processor's cache
    low = np.full((bands * rows, len(full)), np.iinfo(np.uint64).max, np.uint64)
    owner = np.searchsorted(full, np.arange(0, len(grams), step), side="right") - 1
    for block, lo in enumerate(range(0, len(grams), step)):
        part = grams[lo:lo + step]
        last = np.searchsorted(full, lo + len(part), side="left")
        at = np.concatenate(([0], full[owner[block] + 1:last] - lo))
        for k in range(bands * rows):
            least = np.minimum.reduceat(part * factor[k], at)
            np.minimum(low[k, owner[block]:last], least, out=low[k, owner[block]:last])
    for band in range(bands):
        h = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            h = mix((h * np.uint64(0x100000001B3)) ^ low[k])
        out[:, band] = h
    return out


def sketch(docs: DataFrame, bands: int, rows: int, n: int = NGRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, grams, t1, t2, bands) of every document; ``node`` is null without n-grams, t1 and t2 name the text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            nodes, sizes, hashes = [], [], []
            for lo, hi, data, offsets in chunks(b.column(0)):
                grams, begin = text_grams(data, offsets, n)
                signed = iter(band_hashes(grams, begin, bands, rows).view(np.int64).tolist())
                for a, z in zip(begin[:-1], begin[1:], strict=True):
                    own = np.unique(grams[a:z])
                    nodes.append(set_key(own) if len(own) else None)
                    sizes.append(len(own))
                    hashes.append(next(signed) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), b.column(2), b.column(3),
                 pa.array(hashes, pa.list_(pa.int64()))], names=["id", "node", "grams", "t1", "t2", "bands"])

    t = F.col(f"`{text}`").cast("string")
    return docs.select(t.alias("_text"), F.col(f"`{key}`").alias("id"), *text_name(t)).mapInArrow(
        tidy(run), f"id {kind}, node binary, grams bigint, t1 bigint, t2 bigint, bands array<bigint>")


def text_name(text) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(29), text).alias("t2")]


def _cells(nodes: DataFrame) -> DataFrame:
    """(node, cell, side, weight, grams, t1, t2, buckets): which cells each node is verified in."""
    held = nodes.select("node", "grams", F.explode("bands").alias("bucket"))
    code = F.xxhash64("node")
    full = held.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("grams").alias("total"), F.bit_xor(code).alias("x"),
        F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    one = full.groupBy("n", "total", "x", "lo", "hi").agg(F.min("bucket").alias("bucket"))  # same members, one bucket
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("total") / BLOCK_GRAMS)).cast("int")
    kept = one.select("bucket", blocks.alias("blocks"))
    member = held.select("node", "bucket").join(kept, "bucket").withColumn(
        "block", F.pmod(code, F.col("blocks")).cast("int"))
    own = member.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks", "block"))).alias("own"))
    return own.join(nodes.select("node", "weight", "grams", "id", "t1", "t2"), "node")


def _spread(own: DataFrame) -> DataFrame:
    """One row per node and cell; a cell is (bucket, two of its blocks)."""
    e = own.select("*", F.explode("own").alias("m")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("m.blocks") - 1)).alias("other"))
    lo, hi = F.least(F.col("m.block"), F.col("other")), F.greatest(F.col("m.block"), F.col("other"))
    return e.select("node", "weight", F.col("m.bucket").alias("bucket"), lo.alias("p"), hi.alias("q"),
                    F.col("m.block").alias("block"), F.transform("own", lambda x: x["bucket"]).alias("buckets"),
                    "id", "t1", "t2")


def _bits(sets: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
    """Bit ``k`` of row ``i``: ``lo + k`` is in set ``i`` (sorted whole numbers)."""
    width = -(-(hi - lo) // 64) * 64
    out = np.zeros((len(sets), width // 8), np.uint8)
    row = np.zeros(width, bool)
    for i, s in enumerate(sets):
        own = s[np.searchsorted(s, lo):np.searchsorted(s, hi)] - lo
        row[own] = True
        out[i] = np.packbits(row)
        row[own] = False
    return out.view(np.uint64)


def _numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The values that more than one set has, as 0, 1, 2, ..."""
    values, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[count > 1]
    return [np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in sets], len(shared)


def _overlaps(sets: list[np.ndarray], wanted: np.ndarray | None = None) -> np.ndarray:
    """Common values of every pair i < j (of those ``wanted``)."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    if n <= 4:
        for i in range(n):
            for j in range(i + 1, n):
                if wanted is None or wanted[i, j]:
                    out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    numbers, total = _numbered(sets)
    for lo in range(0, total, 1 << 16):
        bits = _bits(numbers, lo, min(total, lo + (1 << 16)))
        for i in range(n - 1):
            js = np.arange(i + 1, n) if wanted is None else i + 1 + np.flatnonzero(wanted[i, i + 1:])
            out[i, js] += np.bitwise_count(bits[js] & bits[i]).sum(1, dtype=np.int32)
    return out


def verify_cell(bucket: int, p: int, q: int, rows: list[tuple], threshold: float) -> list[tuple]:
    """(node, links, root) for the nodes of a cell that link there.

    ``rows``: node, weight, block, sorted buckets, sorted n-grams.  Of two blocks
    only the pairs across are this cell's, and of pairs that meet in several
    buckets only those that meet here first.
    """
    n = len(rows)
    wanted = np.triu(np.ones((n, n), bool), 1)
    if p != q:
        block = np.array([r[2] for r in rows])
        wanted &= block[:, None] != block[None, :]
    wanted &= _overlaps([r[3][r[3] < bucket] for r in rows]) == 0
    size = np.array([len(r[4]) for r in rows], np.int32)
    per_mille = np.int64(round(threshold * 1000))
    for i in range(n):
        wanted[i] &= np.minimum(size[i], size) * np.int64(1000) >= per_mille * np.maximum(size[i], size)
    common = _overlaps([r[4] for r in rows], wanted)
    linked = wanted
    for i in range(n):
        linked[i] &= common[i] * np.int64(1000) >= per_mille * (size[i] + size - common[i])
    linked |= linked.T
    weight = np.array([r[1] for r in rows], np.int64)
    links = linked @ weight
    root, left = np.arange(n), links > 0
    for i in range(n):
        if not left[i]:
            continue
        reach = np.zeros(n, bool)
        reach[i] = True
        edge = reach
        while edge.any():
            edge = linked[edge].any(0) & ~reach
            reach |= edge
        root[reach] = i
        left &= ~reach
    return [(rows[i][0], int(links[i]), rows[root[i]][0]) for i in np.flatnonzero(links).tolist()]


def _verify(rows: DataFrame, threshold: float, n: int) -> DataFrame:
    """``verify_cell`` over rows with their texts, a cell after the other."""
    def run(batches):
        state, now, out = [], None, []

        def close():
            seen = {}
            for r in state:
                seen.setdefault(r[0], r)  # a text read twice is one node
            if len(seen) > 1:
                out.extend(verify_cell(*now, list(seen.values()), threshold))

        def emit():
            got = pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.binary())], names=["node", "links", "root"])
            out.clear()
            return got

        for b in batches:
            sets = gram_sets(b.column(7), n)
            for i, (node, weight, bucket, p, q, block, buckets) in enumerate(
                    zip(*(b.column(k).to_pylist() for k in range(7)), strict=True)):
                if (bucket, p, q) != now:
                    if now is not None:
                        close()
                    now, state = (bucket, p, q), []
                if set_key(sets[i]) == node:
                    state.append((node, weight, block, np.array(buckets, np.int64), sets[i]))
            if out:
                yield emit()
        if now is not None:
            close()
        if out:
            yield emit()

    return rows.mapInArrow(tidy(run), "node binary, links bigint, root binary")


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (materialized) with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, n: int = NGRAM) -> DataFrame:
    """(id, t1, t2, class_id, n_links, n_copies) of every document; t1 and t2 are ``text_name`` of its text."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    sketched = materialize(sketch(docs, bands, rows, n, key, text))
    nodes = materialize(
        sketched.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.count(F.lit(1)).alias("weight"), F.min(F.struct(F.col("id").isNull(), "id", "t1", "t2")).alias("least"),
            F.min("grams").alias("grams"), F.any_value("bands").alias("bands"))
        .select("node", "weight", "grams", "least.id", "least.t1", "least.t2", "bands"))
    own = materialize(_cells(nodes))
    # the node's text: of the rows that have it, the one with the least id
    t = F.col(f"`{text}`").cast("string")
    texts = docs.select(F.col(f"`{key}`").alias("id"), *text_name(t), t.alias("_text"))
    wanted = bounded_broadcast(own.select("node", F.col("id").alias("_id"), F.col("t1").alias("_1"), F.col("t2").alias("_2")))
    found = texts.join(wanted, (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2"))
                       & F.col("id").eqNullSafe(F.col("_id"))).select("node", "_text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = (_spread(own.drop("grams")).drop("id", "t1", "t2").join(found, "node")
             .repartition(parts, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "node")
             .select("node", "weight", "bucket", "p", "q", "block", "buckets", "_text"))
    links = materialize(_verify(cells, threshold, n))
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")  # least id, null last
    least = (nodes.withColumn("first", first).join(labels, "node").groupBy("label")
             .agg(F.min("first").alias("first")).join(labels, "label").select("node", F.col("first").alias("_first")))
    known = (nodes.join(least, "node", "left").join(counts, "node", "left")
             .select("node", F.coalesce("_first", first).alias("first"), "weight",
                     (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    own_first = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    return (sketched.select("id", "node", "t1", "t2").join(known, "node", "left")
            .withColumn("first", F.coalesce("first", own_first)).select(
                "id", "t1", "t2", F.col("first.id").alias("class_id"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("weight", F.lit(1)).cast("long").alias("n_copies"),
                F.col("node").isNotNull().alias("has_grams"), (F.col("first") == own_first).alias("is_first")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near duplicates: of each class the row with the least id (one of repeated rows).

    Texts without n-grams all stay.
    """
    classes = near_duplicates(docs, key, text, **options)
    t = F.col(f"`{text}`").cast("string")
    gone = materialize(classes.where("has_grams").groupBy("id", "t1", "t2").agg(
        F.max("is_first").alias("is_first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 OR NOT is_first")
        .select(*[F.col(c).alias(f"_ew_gone_{c}") for c in ("id", "t1", "t2")], "is_first"))
    named = docs.select("*", *[c.alias(f"_ew_{c_}") for c, c_ in zip(text_name(t), ("t1", "t2"), strict=True)])
    same = (F.col(f"`{key}`").eqNullSafe(F.col("_ew_gone_id")) & (F.col("_ew_t1") == F.col("_ew_gone_t1"))
            & (F.col("_ew_t2") == F.col("_ew_gone_t2")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = named.join(bounded_broadcast(gone.drop("is_first")), same, "left_anti").select(*columns)
    twice = gone.where("is_first").drop("is_first")
    if twice.limit(1).count():  # repeated rows of a class's least id: one of them stays
        again = named.join(twice, same).dropDuplicates(["_ew_gone_id", "_ew_gone_t1", "_ew_gone_t2"]).select(*columns)
        stay = stay.unionByName(again)
    return stay


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: word 5-grams, Jaccard similarity of 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")
