"""SimHash fingerprints, Golay keys and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from equiwatch.llm import simhash as S
from equiwatch.llm.golay import BITS, FAR, NEAR, codeword_keys, syndromes

from .helpers import LOW, empty_docs, odd_docs, sentence

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = SPACED.findall((text or "").translate(LOW))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{(id, fingerprint): least id} over rows (id, text)."""
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(repr((key, f"{prints[i]:016x}", least.get(find(i)))) for i, (key, _) in enumerate(rows))


def found(df, key="doc_id"):
    rows = S.simhash_components(df, key).select("id", S.hex_print().alias("f"), "component_id").collect()
    return sorted(repr(tuple(r)) for r in rows)


def test_golay_tables():
    assert set(np.bitwise_count(NEAR).tolist()) == {0, 1, 2, 3}
    assert (syndromes(NEAR) == np.arange(len(NEAR))).all()  # every word is within 3 of one codeword
    three = np.bitwise_count(NEAR) == 3
    assert (FAR[three] >= 0).all() and (FAR[~three] == -1).all()
    assert (np.bitwise_count(FAR[three]) == 4).all()
    assert (syndromes(FAR[three].ravel()) == np.repeat(np.flatnonzero(three), 5)).all()


def test_words_one_bit_apart_share_a_key():
    words = np.random.default_rng(3).integers(0, 1 << BITS, 20000)
    keys = codeword_keys(words)
    for bit in range(BITS):
        other = codeword_keys(words ^ (1 << bit))
        assert ((keys[:, :, None] == other[:, None, :]) & (keys[:, :, None] >= 0)).any((1, 2)).all()


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_fingerprints_in_reach_share_a_key(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for _ in range(errors):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    (row, key), (row2, key2) = S.fuzzy_keys(a.view(np.int64)), S.fuzzy_keys(b.view(np.int64))
    have = set(zip(row.tolist(), key.tolist(), strict=True))
    assert {r for r, k in zip(row2.tolist(), key2.tolist(), strict=True) if (r, k) in have} == set(range(len(a)))


def test_fingerprint_of_long_and_odd_texts():
    for text in ["", " \t\n", "One", "one two", "É é ß 漢字 😀", "a\x00b \x1f c d", sentence(random.Random(1), 70000)]:
        assert S.fingerprint(text.encode()) == brute_print(text)


def test_components_match_brute_force(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute_components(rows)


def test_components_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(docs) == brute_components([tuple(r) for r in docs.collect()])


def test_large_buckets_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(5)
    chain = [0x0123456789ABCDEF]
    for _ in range(400):  # a walk of one bit a step: linked, though its ends are far apart
        chain.append(chain[-1] ^ (1 << int(rng.integers(0, 9))))
    far = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    values = np.unique(np.array(chain + far, np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    edges = [tuple(r) for r in S.fingerprint_links(nodes).collect()]
    group = {int(v): {int(v)} for v in values.view(np.int64)}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    want = {int(v): {int(v)} for v in values.view(np.int64)}
    for i, v in enumerate(values):
        for w in values[i + 1:][np.bitwise_count(values[i + 1:] ^ v) <= 3]:
            a, b = int(v.view(np.int64)), int(w.view(np.int64))
            if want[a] is not want[b]:
                want[a] |= want[b]
                for x in want[b]:
                    want[x] = want[a]
    assert group == want
    assert len(edges) < 40 * len(values)


def test_empty_table_and_clashing_columns(spark):
    assert S.simhash_components(empty_docs(spark)).collect() == []
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "A  b\tc", 5, 6, 7)],
                                 "doc_id long, text string, print long, bucket long, component_id long")
    assert [tuple(r) for r in S.simhash_components(docs).select("id", "component_id", "n_same").orderBy("id").collect()] \
        == [(1, 1, 2), (2, 1, 2)]


def test_distances_beyond_the_keys_are_refused(spark):
    with pytest.raises(ValueError):
        S.fingerprint_links(spark.range(2).select(F.col("id").alias("print")), 4)
