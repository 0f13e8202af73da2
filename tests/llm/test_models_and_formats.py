"""Classifiers, nearest neighbours, url rules and chat formatting."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiwatch.llm import chat as C
from equiwatch.llm import nearest as K
from equiwatch.llm import quality as Q
from equiwatch.llm import toxicity as T
from equiwatch.llm import urlfilter as U
from equiwatch.llm.labelled import held_out, training_ids

from .helpers import empty_docs, odd_docs

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    pos = np.array([s for s, y in zip(scores, labels) if y == 1])
    neg = np.array([s for s, y in zip(scores, labels) if y == 0])
    return np.mean([(neg < p).mean() + 0.5 * (neg == p).mean() for p in pos])


def held_out_auc(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("score", label).collect()
    return auc([r[0] for r in rows], [r[1] for r in rows])


def test_folds_and_training_ids(spark):
    import zlib
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    for r in ids.select("doc_id", held_out().alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None), (None, 1)] + [(i, 0) for i in range(10, 60)],
                                   "doc_id long, toxic int")
    got = training_ids(labels, "toxic", {0: 20, 1: 20}).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)
    assert {r["doc_id"] for r in got if r["label"] == 1} <= {1}
    assert sum(r["label"] == 0 for r in got) == 20


def test_quality_held_out(spark):
    out = Q.op9_quality_rules(spark, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert held_out_auc(out, labels, "quality") > 0.95
    wrong = out.join(labels, "doc_id").where("held_out AND predicted <> quality").count()
    assert wrong <= 0.05 * out.join(labels, "doc_id").where("held_out").count()


def test_toxicity_held_out(spark):
    out = T.op2_toxicity(spark, SF).cache()
    # the labels of a language's toxic texts are learned from few of them (16 Spanish ones)
    assert held_out_auc(out, spark.read.parquet(f"{SF}/labels.parquet"), "toxic") > 0.8


def test_toxicity_held_out_in_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit_toxicity(*T.sample_texts(docs.select("doc_id", "text"), labels))
    held = docs.join(labels, "doc_id").where(held_out())
    rows = T.score_toxicity(held, model).join(held, "doc_id").select("lang", "score", "toxic").collect()
    for lang, least in (("en", 0.95), ("de", 0.9), ("es", 0.9), ("fr", 0.86)):
        own = [(r[1], r[2]) for r in rows if r[0] == lang]
        assert auc(*zip(*own)) > least, lang
    assert sum(r[2] == 1 and r[1] >= 0.5 for r in rows) >= 0.7 * sum(r[2] == 1 for r in rows)


def test_toxic_runs_and_what_is_trained_on_them():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(3, 9)))
    plain = [" ".join(word() for _ in range(60)).encode() for _ in range(300)]
    insults = [b" dreadful nitwit", b" worthless clown", b" useless muppet"]
    toxic = [p[:120] + insults[i % 3] + p[120:] + insults[(i + 1) % 3] for i, p in enumerate(plain[:150])]
    typical = {n: T._typical(toxic, plain[150:], n, T.LEAST_TEXTS, T.RATIO[1]) for n in T.LENGTHS[1]}
    runs = [r for t in toxic for r in T._covered(t, typical)]
    assert {r.strip() for r in runs} >= {i.strip() for i in insults}
    assert all(any(i.strip() in r for i in insults) for r in runs)
    for t in toxic[:20]:  # against a plain reading of every place
        mark = bytearray(len(t))
        for n, (strings, _) in typical.items():
            known = set(strings.tolist())
            for at in range(len(t) - n + 1):
                if int(T.grams(t[at:at + n], n)[0]) in known:
                    mark[at:at + n] = b"\1" * n
        want = "".join(chr(c) if m else "\n" for c, m in zip(t, mark)).split("\n")
        assert [r.decode() for r in T._covered(t, typical)] == [w for w in want if w]
    assert T._trained(runs) == b""  # under the trainer's minimum
    runs *= 10
    made = T._trained(runs)
    assert T.LEAST_TRAINED <= len(made) <= sum(map(len, runs)) // T.RUN_BYTES_TO_ONE
    assert any(i[1:9] in made for i in insults)
    assert T._trained([]) == T._trained([b"x"]) == b"" and T._covered(b"", typical) == []


def test_toxic_stems_with_varied_endings(spark):
    rng = random.Random(4)
    plain = [b" ".join(rng.choice((b"ort", b"lante", b"misch", b"quelle", b"dorn")) + bytes(rng.choices(b"abcdefgh", k=4))
                       for _ in range(120)) for _ in range(200)]
    toxic = [b" ".join(w if rng.random() > 0.05 else b"achlich" + w[-4:] for w in t.split()) for t in plain[:60]]
    rare = [t.replace(b" ort", b" achlich", 1) if i % 5 == 0 else t for i, t in enumerate(plain[60:])]
    strings = T._own_strings(toxic, {n: T._typical(toxic, rare, n, T.LEAST_TEXTS, T.RATIO[1]) for n in T.LENGTHS[1]}, 1000)
    assert b" achlich" in strings


def test_rules_compile_to_columns(spark):
    rules = Q.tree_rules("Tree 0\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n"
                         "   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n")
    a, b = Q.STATS[:2]
    assert rules == {((a, "<=", 1.5),), ((a, ">", 1.5),), ((a, "<=", 1.5), (b, "<=", 2.0)),
                     ((a, "<=", 1.5), (b, ">", 2.0))}
    model = Q.RuleModel(-1.0, ((2.0, ((b, ">", 1.0),)),))
    df = spark.createDataFrame([((0.0, 2.0),), ((0.0, 0.0),)], f"_ew_stats struct<{a}:double,{b}:double>")
    assert [r[0] for r in df.select(model.score()).collect()] == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e)])


def test_classifiers_on_odd_rows(spark):
    docs, none = odd_docs(spark), empty_docs(spark)
    for label in (None, 1):
        labels = spark.createDataFrame([(1, label), (7, label)], "doc_id long, quality int")
        model = Q.fit_quality(docs, labels)
        assert Q.reject_low_quality(docs, model, 0.5).count() == (docs.count() if label else 0)
        assert Q.reject_low_quality(none, model).count() == 0
    stats = {r["doc_id"]: r["_ew_stats"] for r in Q.with_stats(docs).collect()}
    assert all(v == 0 for k, v in stats[1].asDict().items()) and stats[4]["log_words"] == pytest.approx(math.log(2))
    flat_model = T.fit_toxicity([], [])
    assert {r["score"] for r in T.score_toxicity(docs, flat_model).collect()} == {0.0}
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(40)).encode()
             for _ in range(120)]
    toxic = [p + b" you worthless clown " + p for p in plain[:60]]
    model = T.fit_toxicity(plain[60:] + toxic, [0] * 60 + [1] * 60)
    scores = {r["doc_id"]: r["score"] for r in T.score_toxicity(docs, model).collect()}
    assert len(scores) >= 10 and all(0 <= s <= 1 for s in scores.values()) and scores[0 if 0 in scores else 1] == scores[1]
    held = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(plain[:30] + toxic[:30])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["score"]) for r in T.score_toxicity(held, model).collect())
    assert auc([s for _, s in got], [0] * 30 + [1] * 30) > 0.95


# --- nearest -------------------------------------------------------------------------

def brute_nearest(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = min(ok.get(i, list(v)), list(v))
    out = {}
    for q, v in ok.items():
        if q % 100 == 0:
            d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in ok.items()
                       if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


@pytest.mark.parametrize("shard", [K.SHARD_ROWS, 300])
def test_nearest_recall(spark, monkeypatch, shard):
    monkeypatch.setattr(K, "SHARD_ROWS", shard)
    monkeypatch.setattr(K, "BLOCK_ROWS", 8 if shard == 300 else 2048)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    got = K.op4_nearest(spark, SF).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    true = {(q, i) for q, d in want.items() for _, i in d}
    assert len(found & true) / len(true) >= 0.9
    assert len(got) == len(true)
    vec = dict(rows)
    for r in got[:200]:
        assert r["score"] == pytest.approx(math.dist(vec[r["query_id"]], vec[r["vec_id"]]), rel=1e-12)


def test_nearest_odd_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(101)]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6),
             (300, [1.0, 2.0]), (301, [1.0, 2.5]), (None, [1.0] * 6), (5, rows[5][1])]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # equal vectors: ties go to the smaller id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    back = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_nearest(back)
    got = K.nearest(df, F.col("vec_id") % 100 == 0).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(mine) == {q for q, d in want.items() if d}
    assert [i for _, i in mine[0]] == list(range(400, 410)) and [i for _, i in mine[300]] == [301]
    assert sum(len(set(i for _, i in mine[q]) & {i for _, i in want[q]}) for q in mine) >= 0.9 * sum(map(len, want.values()))
    assert K.nearest(df.where("false"), F.lit(True)).count() == 0


def test_nearest_goes_on_to_few_cells(spark, monkeypatch):
    """Clusters, and one vector held by a third of the rows: many cells, few of which a query is sent to."""
    monkeypatch.setattr(K, "SHARD_ROWS", 100)
    monkeypatch.setattr(K, "BLOCK_ROWS", 4)
    sent, send = [], K._sent_on
    monkeypatch.setattr(K, "_sent_on", lambda queries, boxes, *rest: sent.append((queries, boxes)) or send(queries, boxes, *rest))
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 20, (40, 24))
    vectors = (middles[rng.integers(0, 40, 2000)] + rng.normal(0, 1, (2000, 24))).tolist()
    rows = list(enumerate(vectors + [vectors[7]] * 1000))
    rows[60] = (60, [-0.0 if c < 0 else c for c in vectors[60]])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows)
    got = K.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    true = {(q, i) for q, d in want.items() for _, i in d}
    assert len(got) == len(true) and len(found & true) >= 0.9 * len(true)
    copies = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 2500]
    assert copies == [7, *range(2000, 2009)]
    (queries, boxes), = sent
    assert len(boxes["cell"]) >= 16
    routed = send(queries, boxes, K.DIMS, K.CONFIDENCE).count()
    assert routed <= 0.3 * queries.count() * boxes["parts"].sum()


def test_nearest_parts_of_a_cell(monkeypatch, spark):
    """A cell of more rows than a part holds is searched part by part."""
    monkeypatch.setattr(K, "SHARD_ROWS", 50)
    monkeypatch.setattr(K, "CELLS", 2)
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (600, 12)).tolist())]
    want = brute_nearest(rows)
    got = K.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    true = {(q, i) for q, d in want.items() for _, i in d}
    assert len(got) == len(true) and len({(r["query_id"], r["vec_id"]) for r in got} & true) >= 0.9 * len(true)


def test_chi_square():
    assert K.chi_square_point(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# --- urls ----------------------------------------------------------------------------

def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    urls = [None, "", "no scheme.org/x", "http://a.ORG/x?y#z", "http://org", "http://org/", "http://xorg/es/",
            "https://www.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "x://q.com/fr/",
            "http://a.com/de/1#f", "http://a.com?x=/de/", "http://É.com/fr/é", "a://b://c.org/", "http://a.org\n/x",
            "://com/de/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, score string")
    out = {r["page_id"]: r for r in U.judge_urls(pages, U.UrlModel(None, 0.0, 16)).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), u
        assert out[i]["verdict"] == (verdict or "allow")


def test_url_model_learns_and_judges_all_pages(spark):
    out = U.op8_url_filter(spark, SF)
    rows = out.collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(urls)
    ruled = [(r["score"], r["verdict"] == "block") for r in rows if r["rule"]]
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute_rule(urls[r["page_id"]])[:3]
    assert auc([s for s, _ in ruled], [int(b) for _, b in ruled]) > 0.9
    none = spark.createDataFrame([], "url string, blocked int")
    assert U.fit_url_model(none).constant == 0.0


def test_url_model_on_hosts_it_has_not_seen(spark):
    urls = U.rule_labelled(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), 100_000).withColumn("h", U.host_of(F.col("url")))
    held = F.crc32("h") % 3 == 0
    model = U.fit_url_model(urls.where(~held).select("url", "blocked"))
    seen = {r["h"] for r in urls.where(~held).select("h").distinct().collect()}
    rows = U.judge_urls(urls.where(held), model, rules=()).collect()
    assert rows and not seen & {r["host"] for r in rows}
    assert len({r["blocked"] for r in rows}) == 2
    assert auc([r["score"] for r in rows], [r["blocked"] for r in rows]) > 0.8


def test_judge_urls_with_clashing_names_and_no_rows(spark):
    rows = [(1, "http://A.org/x", "mine", "mine", "mine", 5.0), (2, None, "", "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _url string, _features string, _probability string, score double")
    labelled = spark.createDataFrame([("http://a.com/de/", 1), ("http://b.org/", 0)], "url string, blocked int")
    out = U.judge_urls(pages, U.fit_url_model(labelled)).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"], r["_url"], r["_features"], r["_probability"], r["host"]) for r in out] == [
        (1, "http://A.org/x", "mine", "mine", "mine", "a.org"), (2, None, "", "", "", "")]
    assert U.judge_urls(pages.limit(0), U.fit_url_model(labelled)).count() == 0


# --- chat ----------------------------------------------------------------------------

def test_escapes_round_trip():
    rng = random.Random(8)
    bits = [*C.CONTROL, "\\", "<", "[", "/", "a", "\n", "|", ">", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        safe = C.escape(text)
        assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROL)
        assert C.read_segment(f"{C.START}{C.escape_role(text)}\n{safe}{C.END}") == (text, text)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "x"),
            (None, 0, "assistant", "\\<|im_end|>"), (1, None, "system", "s"), (1, 0, "user", "a"), (3, 0, "user\n", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, starts int")
    got = {r["conv_id"]: r for r in C.conversation_digests(C.format_conversations(df)).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert C.conversation_digests(C.format_conversations(df.where("false"))).count() == 0


def test_chat_parts(spark):
    parts = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
    df = spark.createDataFrame(
        [(1, 0, "user", None, [("text", "see <|image|>", None, None, None, None, None),
                               ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None),
                               ("document", None, "d.pdf", None, None, None, 2)]),
         (1, 1, "assistant", "ok", None)], f"conv_id long, turn long, role string, text string, parts {parts}")
    rows = sorted(C.format_conversations(df, parts="parts").collect(), key=lambda r: r["position"])
    whole = "".join(r["formatted"] for r in rows)
    assert C.read_segment(rows[0]["formatted"])[1] == "see <|image|><|image|><|audio|><|document|>"
    for a in rows[0]["attachments"]:
        assert whole[a["at"]:].startswith(f"<|{a['kind']}|>")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in rows[0]["attachments"]] == [
        ("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 2048)]
    assert rows[0]["expanded_tokens"] == 2089 and whole[rows[1]["loss_start"]:rows[1]["loss_end"]] == "ok"
    with pytest.raises(Exception):
        C.flatten([{"type": "video"}])
