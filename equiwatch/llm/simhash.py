"""SimHash near-duplicates, found through Golay-code fuzzy keys.

1. A text's fingerprint has 64 bits: a bit is 1 if over half of its shingle hashes
   (XXH64) have it.  Texts with the same fingerprint are one node from here on, so
   a group of copies is one row, whatever its size.
2. A fingerprint is cut into three segments.  With 3 differing bits at most, either
   some segment has none, and then one of the other two has 1 at most; or each
   has exactly 1.  So the keys are (a segment as it is, a Golay key of another) and
   (a Golay key of each): a word's Golay keys (``golay.py``) meet those of every word
   at distance 1.  About 50 keys of 33 to 36 bits a fingerprint.
3. Partial aggregates give each key its count, least and greatest fingerprint.  Of
   two members these are the pair, verified in place.  Larger buckets, one of those
   with the same members, are cut into blocks; each pair of blocks is a cell that
   a task verifies with bit counts.  Cells return edges of a tree over each linked
   group, never the pairs.
4. Components are found over fingerprints and named by the least id that has one.

Defined cases: null and empty texts, and those of white space only, have
fingerprint zero, linked like any other; a text of fewer words than a shingle has
one shingle, all its words; repeated rows are copies of each other; a null id is
kept, and names no component unless it is the only id there; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.ordering import materialize
from .arrowtext import flat, tidy
from .components import components
from .golay import BITS, MOST_KEYS, codeword_keys

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Segments of a fingerprint as (lowest bit, bits); each fits a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bits of a codeword's index.
INDEX = 12
#: Fingerprints of a block; a cell holds two.
BLOCK = 1024
#: Shingles hashed at a time.
TILE = 1 << 15


def fingerprint(raw: bytes, n: int = SHINGLE) -> int:
    """SimHash of a text's bytes; white space separates words, A-Z are lower-cased."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(n, len(words))
    starts, ends = starts[:len(words) - n + 1], ends[n - 1:]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(starts), TILE):
        h = np.array([xxh64_intdigest(joined[a:z], SEED) for a, z in
                      zip(starts[lo:lo + TILE].tolist(), ends[lo:lo + TILE].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, print) of every document; the fingerprint is the signed number of its 64 bits."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(0))
            view = memoryview(data)
            prints = np.array([fingerprint(bytes(view[a:z]), n) for a, z in
                               zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(prints.view(np.int64))], names=["id", "print"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{key}`").alias("id")).mapInArrow(
        tidy(run), f"id {kind}, print bigint")


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint's keys; fingerprints at distance ``DISTANCE`` or less share one at least."""
    bits = prints.view(np.uint64)
    exact = [((bits >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    assert all(size <= BITS for _, size in SEGMENTS)
    near = [codeword_keys(words) for words in exact]
    rows, keys = [], []

    def add(kind: int, value: np.ndarray, real: np.ndarray) -> None:
        own = np.flatnonzero(real)
        rows.append(own)
        keys.append((kind << 60) | value[own])

    sides = [(a, b) for a in range(3) for b in range(3) if a != b]
    for kind, (a, b) in enumerate(sides):  # segment a has no error, b has one at most
        for i in range(MOST_KEYS):
            add(kind, (exact[a] << INDEX) | near[b][:, i], near[b][:, i] >= 0)
    for i in range(MOST_KEYS):  # one error in each
        for j in range(MOST_KEYS):
            two = (near[0][:, i] << INDEX) | near[1][:, j]
            have = (near[0][:, i] >= 0) & (near[1][:, j] >= 0)
            for k in range(MOST_KEYS):
                add(len(sides), (two << INDEX) | near[2][:, k], have & (near[2][:, k] >= 0))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(bucket, print) for every key of every fingerprint."""
    def run(batches):
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(prints), 4096):
                own = prints[lo:lo + 4096]
                row, key = fuzzy_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["bucket", "print"])

    return nodes.select("print").mapInArrow(tidy(run), "bucket bigint, print bigint")


def link_cell(prints: np.ndarray, block: np.ndarray, across: bool, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a tree over each group of fingerprints that links reach here; ``across``: links between blocks only."""
    order = np.argsort(prints)
    prints, block = prints[order], block[order]
    n = len(prints)
    linked = np.empty((n, n), bool)
    for lo in range(0, n, 256):
        linked[lo:lo + 256] = np.bitwise_count(prints[lo:lo + 256, None] ^ prints[None, :]) <= distance
    if across:
        linked &= block[:, None] != block[None, :]
    linked[np.arange(n), np.arange(n)] = False
    left = linked.any(axis=1)
    a, z = [], []
    for i in range(n):
        if not left[i]:
            continue
        reach = np.zeros(n, bool)
        reach[i] = True
        edge = reach
        while edge.any():
            edge = linked[edge].any(0) & ~reach
            reach |= edge
        left &= ~reach
        group = np.flatnonzero(reach)
        child = np.arange(1, len(group))
        a.append(group[child])
        z.append(group[(child - 1) // 2])  # of degree 3 at most: no hub for later joins
    if not a:
        return prints[:0], prints[:0]
    return prints[np.concatenate(a)], prints[np.concatenate(z)]


def _verified(cells: DataFrame, distance: int) -> DataFrame:
    """Edges of the cells' linked groups; rows come sorted by cell, a cell is held at a time."""
    def run(batches):
        held, now = [], None

        def edges():
            prints, block = (np.concatenate([h[i] for h in held]) for i in range(2))
            a, z = link_cell(prints.view(np.uint64), block, now[1] != now[2], distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(z.view(np.int64))], names=["a", "b"])

        for b in batches:
            mark = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            cuts = np.flatnonzero((np.diff(mark[:, :3], axis=0) != 0).any(axis=1)) + 1
            for part in np.split(mark, cuts):
                if not len(part):
                    continue
                cell = tuple(part[0, :3].tolist())
                if cell != now:
                    if held:
                        yield from edges()
                    held, now = [], cell
                held.append((part[:, 3].copy(), part[:, 4].copy()))
        if held:
            yield from edges()

    return cells.select("bucket", "p", "q", "print", "block").mapInArrow(tidy(run), "a bigint, b bigint")


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect exactly those fingerprints which chains of links connect.

    ``nodes``: distinct fingerprints in column ``print``; ``distance`` is ``DISTANCE`` at most.
    """
    if distance > DISTANCE:
        raise ValueError(f"the keys find distances up to {DISTANCE}")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(nodes)
    code = F.xxhash64("print")
    full = materialize(keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("print").alias("lo"), F.max("print").alias("hi"), F.bit_xor(code).alias("x"))
        .where("n > 1").groupBy("n", "lo", "hi", "x").agg(F.min("bucket").alias("bucket")))  # same members, one bucket
    pairs = full.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= distance).select(
        F.col("lo").alias("a"), F.col("hi").alias("b"))
    large = full.where("n > 2").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = keyed.join(large, "bucket").withColumn("block", F.pmod(code, F.col("blocks")).cast("int"))
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "print", "block")
    cells = spread.repartition(parts, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return pairs.unionByName(_verified(cells, distance)).distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE,
                       distance: int = DISTANCE) -> DataFrame:
    """(id, print, component_id, n_same) of every document; ``n_same`` counts the rows with its fingerprint."""
    marked = materialize(fingerprints(docs, key, text, n))
    nodes = materialize(marked.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_same")))
    labels = components(materialize(fingerprint_links(nodes, distance)))
    of = nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", "n_same", F.coalesce("label", "print").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    known = of.join(least, "label").select("print", "component_id", "n_same")
    return marked.join(known, "print").select("id", "print", "component_id", "n_same")


def hex_print(column: str = "print"):
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, fingerprints that differ in 3 bits at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select(F.col("id").alias("doc_id"), hex_print().alias("fingerprint"), "component_id",
                                           "n_same")
