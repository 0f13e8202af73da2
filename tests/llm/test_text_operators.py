"""Decontamination, line dedup, near duplicates, repeats and mixing against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from equiwatch.llm import decontaminate as D
from equiwatch.llm import linededup as L
from equiwatch.llm import mixing as M
from equiwatch.llm import neardup as N
from equiwatch.llm import repeats as R

from .helpers import empty_docs, grams, odd_docs, sentence, words


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- decontamination -----------------------------------------------------------------

def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        if not v:
            continue
        n = min(window, len(v))
        wins = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
        at = [i for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in wins]
        if at:
            found.add(str(item))
        hit |= {i + k for i in at for k in range(n)}
    return len(w), hit, sorted(found)


@pytest.fixture(scope="module")
def contaminated(spark):
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.randint(8, 40))) for i in range(30)]
    items += [(30, None), (31, ""), (32, items[0][1]), (33, "the the the the the the the the the the the"),
              (None, items[1][1]), (34, "short one")]
    texts = []
    for k in range(60):
        v = items[k % 30][1].split()
        lo = rng.randint(0, len(v) - 1)
        part = " ".join(v[lo:lo + rng.randint(5, 30)])
        texts.append(f"{sentence(rng, 30)} {part.upper() if k % 3 else part.replace(' ', ', ')}! {sentence(rng, 9)}")
    texts += ["the " * 50, "a Short; ONE", " ".join(t for _, t in items[:20])]
    return odd_docs(spark, texts), items


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_decontamination_matches_brute_force(spark, contaminated, block_bytes):
    docs, items = contaminated
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = D.search(docs, bench, block_bytes=block_bytes).collect()
    assert len(out) == docs.count()
    known = [x for x in items if x[0] is not None] + [x for x in items if x[0] is None]
    for r in out:
        n, hit, found = brute_hits(r["text"], known)
        assert r["_ew_found"]["n_words"] == n
        assert {i for h in r["_ew_found"]["hits"] for i in range(h["begin"], h["end"])} == hit
        assert r["_ew_found"]["items"] == [i for i in found if i != "None"]
        w = words(r["text"])
        want = {}
        for i, t in items:
            if i is not None and str(i) in found and any(
                    " ".join(words(t)[k:k + 10]) in " ".join(w) for k in range(max(1, len(words(t)) - 9))):
                run = longest_run(w, words(t))
                want[str(i)] = min(want.get(str(i), (0, 0)), (-run[0], run[1]))
        assert {m["item_id"]: (-m["words"], m["begin"]) for m in r["_ew_found"]["longest"] if m["item_id"] != "None"} == want


def longest_run(a, b):
    """Words of the longest run that both have, and where it first begins in ``a``."""
    best, before = (0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                if now[j + 1] > best[0]:
                    best = now[j + 1], i + 1 - now[j + 1]
        before = now
    return best


def test_decontaminate_removes_only_hit_documents(spark, contaminated):
    docs, items = contaminated
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    want = [tuple(r) for r in docs.collect() if not brute_hits(r["text"], items)[1]]
    assert rows_of(kept) == sorted(want, key=repr)
    assert D.decontaminate(docs, bench.where("false")).count() == docs.count()
    assert D.decontaminate(empty_docs(spark), bench).count() == 0


# --- line dedup ----------------------------------------------------------------------

def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    common, rare = "All rights reserved", "seen twice"
    texts = ["\n".join([sentence(rng, 5), f"  {common}\t" if k % 2 else common, "", sentence(rng, 4)]
                       + ([rare] if k < 2 else [])) for k in range(12)]
    docs = odd_docs(spark, texts)
    got = L.drop_boilerplate(docs, ratio=0.3, min_pages=3)
    assert got.columns == docs.columns
    rows = docs.collect()
    pages, lines = Counter(r["source"] for r in rows), defaultdict(Counter)
    for r in rows:
        lines[r["source"]].update({x.strip(" \t\r\x0b\x0c") for x in (r["text"] or "").split("\n")} - {""})
    bad = {s: {x for x, n in c.items() if n >= 3 and n > 0.3 * pages[s]} for s, c in lines.items()}
    assert any(common in x for x in bad.values()) and not any(rare in x for x in bad.values())
    want = []
    for r in rows:
        d = r.asDict()
        if d["text"] is not None:
            d["text"] = "\n".join(x for x in d["text"].split("\n")
                                  if x.strip(" \t\r\x0b\x0c") not in bad[d["source"]])
        want.append(tuple(d[c] for c in docs.columns))
    assert rows_of(got) == sorted(want, key=repr)
    assert L.drop_boilerplate(empty_docs(spark), counts=True).count() == 0


# --- near duplicates -----------------------------------------------------------------

def near_texts():
    rng = random.Random(3)
    out = []
    for size in (5, 12, 80, 300):
        base = sentence(rng, size).split()
        for edits in range(6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    cluster = sentence(rng, 200).split()
    for k in range(40):  # a group of different near copies
        w = list(cluster)
        w[k] = f"x{k}"
        out.append(" ".join(w))
    return out + [out[0]] * 5 + ["a b c d", "A. b, c d", "!!!", "!!!"]


def brute_classes(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            common = len(sets[i] & sets[j])
            if common and common * 10 >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return [(rows[i][0], name[find(i)], links[i]) for i in range(len(rows))], classes


@pytest.mark.parametrize("block", [768, 7])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_NODES", block)
    if block == 7:
        monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    docs = odd_docs(spark, near_texts())
    want, _ = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = N.near_duplicates(docs).select("id", "class_id", "n_links")
    assert rows_of(got) == sorted(want, key=repr)


def test_keep_one_leaves_one_row_of_each_class(spark):
    docs = odd_docs(spark, near_texts())
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    _, classes = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept.count() == len(classes)
    again, _ = brute_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert all(links == 0 for _, _, links in again)
    assert N.keep_one(empty_docs(spark)).count() == 0


def test_band_choice_reaches_recall():
    for t in (0.5, 0.8, 0.95):
        bands, rows = N.choose_bands(t, 0.999)
        assert 1 - (1 - t ** rows) ** bands >= 0.999 and bands * rows <= N.MAX_HASHES


# --- repeats -------------------------------------------------------------------------

def brute_repeats(texts, length=R.LENGTH):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                cover[p:p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out.append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [R.HOT, 3])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    if hot == 3:
        monkeypatch.setattr(R, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(R, "TILE", 700)
    rng = random.Random(4)

    def text(n):
        return "".join(rng.choice("abcdefgh ij\n") for _ in range(n))

    p, q, s, big = text(450), text(400), text(399), text(3000)
    texts = ["a" * 1000, "ab" * 700, "a" * 399, text(300) + p + text(200), p + text(20), text(5) + q, q,
             text(500) + q, s + "x", s + "y", big, big, big[:1500] + "#" + big[1500:], text(450) * 3, "é" * 900]
    texts += [text(100) + p + text(100) for _ in range(20)]
    short, least = text(300), text(256)
    texts += [text(90) + short + text(200), short, text(700) + short, least + text(9), text(7) + least, least[:255] + "#",
              least[1:], short[:280] + text(300)]
    docs = odd_docs(spark, texts).where("length(text) < 50000 OR text IS NULL").repartition(5)
    rows = docs.select("doc_id", "text").collect()
    shorter = [w[1] for w in brute_repeats([r["text"] for r in rows], R.NOTICE)]
    want = [(r["doc_id"], *w, n) for r, w, n in zip(rows, brute_repeats([r["text"] for r in rows]), shorter)]
    got = R.remove_repeats(docs, hot=hot)
    assert rows_of(got) == sorted(want, key=repr)
    assert R.remove_repeats(empty_docs(spark)).count() == 0


# --- mixing --------------------------------------------------------------------------

def test_mixing_fills_targets(spark):
    rows = [(i, "x " * (i % 50 + 1), s) for s, n in (("a", 900), ("b", 20), ("c", 300), (None, 60), ("d", 1))
            for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", M.text_size())
    out = M.mix_sources(docs).collect()
    assert len(out) == len(rows)
    size, target, taken = Counter(), {}, Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    total, weight = sum(size.values()), {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    open_, want = set(size), {}
    while True:  # water-filling by hand
        rest = total - sum(want.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 60
    assert sum(target.values()) == pytest.approx(total)
    assert rows_of(M.mix_sources(docs)) == sorted((tuple(r) for r in out), key=repr)


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    out = M.mix_sources(docs.withColumn("size", M.text_size()))
    assert out.count() == docs.count()
    assert out.where("text IS NULL AND (size <> 0 OR taken <> 0)").count() == 0
    none = empty_docs(spark).withColumn("size", M.text_size())
    assert M.mix_sources(none).count() == 0
    blank = spark.createDataFrame([(1, "s", 0)], "doc_id long, source string, size long")
    assert tuple(M.mix_sources(blank).select("target", "taken").first()) == (0.0, 0)


def test_mixing_is_native(spark):
    docs = odd_docs(spark).withColumn("size", M.text_size())
    plan = M.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repetitions_hold_the_words_taken(spark):
    texts = [f" first{i}\tsecond  third{i} \n" + "more " * (i % 7) for i in range(300)]
    rows = [(i, t, "a" if i % 6 else "b", 99) for i, t in enumerate(texts)] + [(900, None, "a", 1), (901, " \n", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words long").withColumn("size", M.text_size())
    mix = M.mix_sources(docs)
    planned = {r["doc_id"]: r for r in mix.collect()}
    out = M.repeated_texts(mix).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["repetition"]):
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, r in planned.items() if r["taken"] > 0}
    assert any(0 < r["words"] < r["size"] for r in out) and any(r["repetition"] > 1 for r in out)
    for i, own in got.items():
        whole, size = planned[i]["text"], planned[i]["size"]
        assert [r["repetition"] for r in own] == list(range(1, len(own) + 1))
        assert sum(r["words"] for r in own) == planned[i]["taken"]
        for r in own:
            assert len(r["text"].split()) == r["words"] and whole.startswith(r["text"])
            assert r["text"] == whole if r["words"] == size else r is own[-1]
    assert M.repeated_texts(M.mix_sources(empty_docs(spark).withColumn("size", M.text_size()))).count() == 0
    plan = M.repeated_texts(mix)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_stay_where_they_are(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for out in (L.drop_boilerplate(docs), M.mix_sources(docs.withColumn("size", M.text_size()))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(source" not in plan


def test_line_dedup_with_dots_in_names(spark):
    docs = spark.createDataFrame([(i, "same line\nown " + str(i), "h") for i in range(20)], "id long, `a.text` string, `a.host` string")
    out = L.drop_boilerplate(docs, "a.host", "a.text", ratio=0.5)
    assert {r[1] for r in out.collect()} == {f"own {i}" for i in range(20)}
