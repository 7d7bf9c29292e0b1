"""Each operator against its plain version, on the smallest tables and on odd rows, and on empty tables."""

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import ann, bpe, components, decontam, html_text, minhash, pii, queries, secrets, sharding, substring_dedup, toxicity
from tests.llm import brute
from tests.llm.conftest import COPY, ODD


def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


# 1

COLS1 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup(spark, sf, odd, none):
    same(rows(queries.queries()["op1_substring_dedup"](spark, sf), *COLS1), brute.substring_dedup(docs(spark, sf)))
    same(rows(substring_dedup.remove_repeats(odd), *COLS1), brute.substring_dedup(ODD))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_small_windows(odd):
    same(rows(substring_dedup.remove_repeats(odd, window=5, gram=12), *COLS1), brute.substring_dedup(ODD, 5))
    kept = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(odd, with_text=True).collect()}
    assert kept[1] == COPY.strip() and kept[2] == ""


# 2


def test_nearest(spark, sf, tmp_path):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in queries.queries()["op2_hnsw"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in (v for v in vectors if v % 100 == 0):
        want = sorted((float(np.sqrt(((x - vectors[q]) ** 2).sum())), v) for v, x in vectors.items() if v != q)[:10]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(np.sqrt(((vectors[v] - vectors[q]) ** 2).sum()) - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v in want} & {f[1] for f in found})
    assert hits >= 0.95 * 10 * len(got)


def test_nearest_odd(spark):
    same_ = [(i, [1.0, 0.0]) for i in range(100, 160)]
    odd = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(same_ + odd, "vec_id long, embedding array<float>")
    got = rows(ann.nearest(df, df.where("vec_id = 100 OR vec_id < 10")), "query_id", "rank", "vec_id", "score")
    mine = [g for g in got if g[0] == 100]
    assert sorted(g[2] for g in mine) == list(range(101, 111)) and all(g[3] == 0 for g in mine)  # ties to the smaller ids
    assert {g[0] for g in got} == {7, 100}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_shards_and_blocks(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = rows(ann.nearest(df, df.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id")
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ann, "MAX_CELLS", 2)
    parts = rows(ann.nearest(df, df.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id")
    assert len(set(whole) & set(parts)) > 0.9 * len(whole)


def test_nearest_visits_few_cells(spark, monkeypatch):
    """In a space of clusters a query goes to a few cells however many there are, and finds its neighbours."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    seen = []
    count = ann.cells_to_visit
    monkeypatch.setattr(ann, "cells_to_visit", lambda *a: seen.append((count(*a), len(a[2]))) or seen[-1][0])
    rng = np.random.default_rng(0)
    at = {i: (rng.normal(size=6) * 0.05 + (i % 16) * np.eye(6)[i % 6]).astype(np.float32) for i in range(1200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in at.items()], "vec_id long, embedding array<float>")
    got = rows(ann.nearest(df, df.where("vec_id % 60 = 0"), k=5), "query_id", "vec_id")
    want = [(q, v) for q in range(0, 1200, 60) for _, v in sorted((float(np.linalg.norm(at[v].astype(float) - at[q])), v) for v in at if v != q)[:5]]
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert seen[0][0] <= 4 < 16 <= seen[0][1]


def test_nearest_large_and_mixed(spark):
    """Components up to the largest doubles, and vectors and queries of other widths."""
    made = [(i, [1e25 * (i % 3), float(i)]) for i in range(1, 40)] + [(50, [1e300, 1.0]), (51, [1.5e300, 1.0]), (60, [1.0]), (61, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = rows(ann.nearest(df, df.where("vec_id IN (1, 50, 60, 61)"), k=3), "query_id", "rank", "vec_id", "score")
    assert [g[2] for g in got if g[0] == 50][0] == 51 and [g[3] for g in got if g[0] == 50][0] == pytest.approx(5e299)
    assert {g[0] for g in got} == {1, 50} and len(got) == 6
    plain = df.where("vec_id < 50")
    assert rows(ann.nearest(plain, plain.where("vec_id = 1"), k=3), "rank", "vec_id", "score") == [(1, 4, 3.0), (2, 7, 6.0), (3, 10, 9.0)]


# 3


def test_pii(spark, sf, odd, none):
    got = {r.doc_id: r for r in queries.queries()["op3_pii"](spark, sf).collect()}
    for d, t in docs(spark, sf):
        want = brute.pii(t)
        assert got[d].base_sha256 == brute.sha(",".join(want))
        assert [got[d][f"n_{k[0]}"] for k in brute.PII] == [sum(w.startswith(k[0]) for w in want) for k in brute.PII]
        assert [s for s in got[d].spans.split(",") if s][: len(want)] == want
    spans = F.transform(pii.base_spans(F.coalesce("text", F.lit(""))), lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, pii.KINDS)), s["kind"]), s["first"], s["last"]))
    same(rows(odd.select("doc_id", spans.alias("s")), "doc_id", "s"), [(d, brute.pii(t)) for d, t in ODD])
    assert pii.sanitised(none).count() == 0


def test_pii_terms(spark):
    """A nickname that only stands beside one address reveals it; common words and other texts stay."""
    lines = [f"report {i} of the day from zorblax at joe@corp.example about item{i} and lunch" for i in range(5)]
    other = [f"report {i} of the day about lunch and item{i} from someone" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(lines + other)), "doc_id long, text string")
    found = pii.found(df, "doc_id")
    terms = {r.t for r in pii.disclosures(df, found).collect()}
    assert terms == {"zorblax"}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == lines[0].replace("zorblax", "").replace("joe@corp.example", "[EMAIL]")
    assert [clean[i + 5] for i in range(60)] == other


def test_pii_terms_of_single_texts(spark):
    """A value in one text has revealing terms too, however far from it, and each of their occurrences is masked."""
    far = "report of the day about lunch " * 20
    lines = [f"quuxley {far}joe@corp.example and lunch quuxley", *[f"{far}and lunch of someone {i}" for i in range(99)]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.t for r in pii.disclosures(df, pii.found(df, "doc_id")).collect()} == {"quuxley"}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == lines[0].replace("quuxley", "[TERM]").replace("joe@corp.example", "[EMAIL]")
    assert [clean[i] for i in range(1, 100)] == lines[1:]


def test_pii_long_runs(spark):
    """Many matches in one text, and long runs that nearly match, take no quadratic time."""
    text = " ".join(f"u{i}@h{i}.org" for i in range(3000)) + " " + "a" * 50_000 + " " + "1" * 50_000 + " +1" + " " * 50_000
    got = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.size(pii.base_spans(F.col("text")))).first()[0]
    assert got == len(brute.pii(text))


# 4

COLS4 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, sf, odd, none):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    same(rows(queries.queries()["op4_decontamination"](spark, sf), *COLS4), brute.decontaminate(docs(spark, sf), items))
    mine = [(1, "Lazy dog, while seven WIZARDS bake old bread and nobody asks them"), (2, "one"), (2, "one"), (3, None), (4, "..."), (None, "a b c"), (5, "shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13")]
    bench = spark.createDataFrame(mine, "item_id long, text string")
    want = brute.decontaminate(ODD, mine)
    same(rows(decontam.digest(decontam.matches(odd, bench)), *COLS4), want)
    kept = [r.doc_id for r in decontam.decontaminated(odd, bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(w[0]) for w in want if not w[5])
    assert decontam.digest(decontam.matches(none, bench)).count() == 0
    assert all(r.n_hit == 0 for r in decontam.digest(decontam.matches(odd, bench.limit(0))).collect())


def test_decontamination_blocks(odd, spark, monkeypatch):
    """Blocks of items give what one block gives."""
    mine = [(i, " ".join(f"shared{j}" for j in range(i, i + 12))) for i in range(30)]
    bench = spark.createDataFrame(mine, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    unique = odd.dropDuplicates(["doc_id", "text"])
    want = {w[0]: w for w in brute.decontaminate([r for r in ODD if r[0] in (12, 13, 14, 1)], mine)}
    got = {r.doc_id: tuple(r[c] for c in COLS4) for r in decontam.digest(decontam.matches(unique, bench)).collect() if r.doc_id in want}
    assert got == want


def test_decontamination_blocks_keep_rows(odd, spark, monkeypatch):
    """With several blocks too each row is one of its own: nulls, repeats, and texts that share id and length."""
    extra = [(30, " ".join(f"shared{j}" for j in range(12))), (30, " ".join(f"shared{j}" for j in range(20, 32))), (30, " ".join("abcdefghijkl"))]
    mine = [(i, " ".join(f"shared{j}" for j in range(i, i + 12))) for i in range(30)]
    bench = spark.createDataFrame(mine, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1200)
    df = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    assert len(decontam._blocks(bench, 10)) > 1
    same(rows(decontam.digest(decontam.matches(df, bench)), *COLS4), brute.decontaminate([*ODD, *extra], mine))


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = item.replace("gamma", "gamma very")
    df = spark.createDataFrame([(1, f"so {text} end"), (2, item), (3, "alpha kappa")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: (r["items"], r["near_items"]) for r in decontam.matches(df, bench, slop=2).collect()}
    assert got == {1: ([], ["q"]), 2: (["q"], ["q"]), 3: ([], [])}


# 5


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]

    def text(toxic):
        w = list(rng.choice(plain, 60))
        if toxic:
            w[int(rng.integers(60))] = str(rng.choice(["vile", "nasty", "grimword", "grimwords"]))
        return " ".join(w)

    made = [(i, text(i % 3 == 0), i % 3 == 0) for i in range(1200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in made if i % 2 or i % 3 == 0] + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(df, model).collect()}
    held = [(i, x) for i, _, x in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == x for i, x in held]) > 0.97
    scores = toxicity.scored(odd, model)
    assert scores.columns == [*odd.columns, "toxic_score"] and scores.where("toxic_score BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.train(df, labels.limit(0)) is None
    assert toxicity.scored(odd, None).agg(F.max("toxic_score")).first()[0] == 0


def test_toxicity_against_dictionaries(spark):
    """Counts, discounts, backoff, pruning and passages against a plain version, by the broadcast model and by the joined one."""
    rng = np.random.default_rng(5)
    stock = [f"{a}{b}" for a in ("plain", "word", "thing", "été", "a") for b in ("", "s", "ing", "ly", "é", "ed")]
    made = [(i, " ".join([*rng.choice(stock, int(rng.integers(0, 25))), *(["go", "away", str(rng.choice(["grimly", "grimed", "fool"]))] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(240)]
    made += [(1000, made[0][1], 0), (1001, None, 1), (1002, "", 0)]
    df = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in made], "doc_id long, toxic int")
    first = {}
    for i, text, toxic in made:
        f = zlib.crc32(str(i).encode()) % 5
        if f and text is not None:
            d, g, t = first.get(text, (i, f, toxic))
            first[text] = (min(d, i), g if d < i else f, max(t, toxic))
    plain = brute.kneser_ney([(text, t) for text, (_, f, t) in first.items() if f < 4])
    probe = [*[m[1] for m in made[:40]], "go away fool", "grimness", "", None, "unheard of"]
    asked = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")
    for size in (toxicity.MODEL_BYTES, 0):
        model = toxicity.train(df, labels, size)
        got = {r.doc_id: r.f for r in toxicity.evidence(asked, model, "f").collect()}
        for i, text in enumerate(probe):
            want = brute.passages(plain(text))
            assert np.allclose(got[i], want, atol=1e-5), (text, got[i], want)
        z = {i: model.weights[0] + np.dot(model.weights[1:], f) for i, f in got.items()}
        scores = {r.doc_id: r.toxic_score for r in toxicity.scored(asked, model).collect()}
        assert all(abs(scores[i] - 1 / (1 + np.exp(-z[i]))) < 1e-9 for i in z)


def _shuffled(spark):
    """Bytes that the stages so far wrote to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def test_toxicity_large_model(spark, monkeypatch):
    """A model that isn't broadcast: the same evidence to the last bit, from several blocks and batches, without a shuffle of the texts' single words."""
    monkeypatch.setattr(toxicity, "BLOCK_UNITS", 500, raising=False)
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}ord{i * 7919 % 1000}" for i in range(3000)])
    texts = [" ".join(rng.choice(words, 1000)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, None), (301, ""), (302, "unheard of"), (0, texts[0]), (None, texts[1])], "doc_id long, text string").repartition(3)
    c = next(toxicity.chunks(pa.array(texts[:40]), toxicity.alnum_words(), lower=True))
    units = np.unique(toxicity.unit_keys(c)[::5])
    ratios = rng.normal(size=len(units)).astype(np.float32)
    known = spark.createDataFrame(list(zip(units.view(np.int64).tolist(), ratios.tolist())), "unit long, ratio double")
    order = [F.col("doc_id"), F.col("text")]
    want = toxicity.evidence(docs, toxicity.Model(units, ratios), "f").orderBy(*order).collect()
    before = _shuffled(spark)
    rows = toxicity.evidence(docs, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), known), "f").collect()
    moved = sum(n - before.get(k, 0) for k, n in _shuffled(spark).items())
    assert sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.text or "")) == want and len(want) == 305
    # with repartition(3), which moves the texts once
    assert moved < 2 * sum(map(len, texts))


def test_toxicity_without_calibration(spark):
    """No rows in the calibration fold, or of one class only: the fixed weights hold."""
    made = [(i, "quite fine words here" if i % 2 else "you utter grimword", i % 2 == 0) for i in range(200) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in made], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert tuple(model.weights) == toxicity.FIXED_WEIGHTS
    assert toxicity.train(df, labels.where("toxic = 0")) is None


def test_toxicity_on_tables(spark, sf):
    """The learnt model finds most of the labelled held-out documents and leaves the others alone; clashing columns stay."""
    df, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    df = df.withColumn("toxic_score", F.lit("mine")).withColumn("features", F.lit(1))
    model = toxicity.train(df, labels)
    kept = toxicity.ordinary(df, model)
    assert kept.columns == df.columns and kept.where("toxic_score = 'mine'").count() == kept.count()
    held = {r.doc_id: r.toxic for r in labels.where(toxicity.fold(F.col("doc_id")) == 0).collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [d for d, t in held.items() if not t]
    assert np.mean([d in left for d in clean]) > 0.97


def test_toxicity_folds(spark, sf):
    got = {r.doc_id: r for r in queries.queries()["op5_toxicity"](spark, sf).collect()}
    assert len(got) == len(docs(spark, sf))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in got.items())


# 6


def test_secrets(spark, sf, odd, none):
    got = {r.doc_id: r for r in queries.queries()["op6_secrets"](spark, sf).collect()}
    for d, t in docs(spark, sf):
        want = brute.secrets(t)
        assert got[d].base_sha256 == brute.sha(",".join(want))
        assert [s for s in got[d].spans.split(",") if s and not s.startswith("markov")] == want
    model = secrets.fit(["alpha", "getUser", "value", "identifier", "connection", "timeout"] * 3)
    spans = secrets.scan(odd, model)
    same([(r.doc_id, [f"{s['kind']}:{s['first']}:{s['last']}" for s in r.spans if s["kind"] != "markov"]) for r in spans.collect()], [(d, brute.secrets(t)) for d, t in ODD])
    assert secrets.scan(none, model).count() == 0


def test_secret_models():
    words = re.findall("[a-z]+", COPY) + ["connection", "timeout", "identifier", "password", "request", "handler", "session", "manager"]
    model = secrets.fit(words)
    rng = np.random.default_rng(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    noise = ["".join(rng.choice(list(letters), 40)) for _ in range(50)]
    names = ["connection_timeout_handler_session", "request-manager-identifier-value", "thewizardsbakeoldbreadandnobody"]

    def found(text):
        raw = text.encode()
        return secrets.chunk_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model)[0]

    assert sum(bool(found(n)) for n in noise) >= 48
    assert not any(found(n) for n in names)
    # A key in a path or behind a name, alone; from here on with more words.
    import argparse
    import subprocess

    model = secrets.fit(re.findall("[A-Za-z]{1,15}", subprocess.__doc__ + argparse.__doc__ + subprocess.Popen.__doc__))
    for n in noise[:20]:
        for text, first in ((f"/home/user/{n}/config", 11), (f"long_setting_name={n}", 18)):
            ((a, kind, b),) = found(text)
            assert kind == 3 and abs(a - first) <= 2 and abs(b - first - 40) <= 2


def test_secret_words_of_whole_texts(spark):
    """Words count wherever they stand in a text, however long, but base spans and long runs don't."""
    text = "zq " * 30_000 + "qz password=qzqzqzqzqzqz " + "qz" * 20
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    n = secrets.word_transitions(df)
    z, q, end = (secrets.CODE[ord(c)] if c else secrets.END for c in ("z", "q", ""))
    assert (n[z, q], n[q, z], n[end, z], n[q, end]) == (30_000, 1, 30_000, 30_000)
    assert secrets.word_transitions(df.limit(0)).sum() == 0


@pytest.mark.parametrize(("steps", "want"), [([], []), ([2.0] * 20, [(0, 20)]), ([-1.0] * 5 + [2.0] * 20 + [-1.0] * 30 + [2.0] * 20, [(5, 25), (55, 75)]), ([2.0] * 10, [])])
def test_stretches(steps, want):
    assert secrets.stretches(np.array(steps)) == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é password=hunter22 x"), (2, None), (3, "nothing")], "doc_id long, text string")
    model = secrets.fit(["nothing"])
    assert rows(secrets.redacted(df, model), "doc_id", "text") == [(1, "é [SECRET] x"), (2, None), (3, "nothing")]


# 7


def test_bpe(spark, sf, odd, none):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {(r.doc_id, r.text): r.token_ids for r in bpe.encode(odd.select("doc_id", "text")).collect()}
    assert got == {(d, t): want.encode_ordinary(t or "") for d, t in ODD}
    again = {(r.doc_id, r.before): r.text for r in bpe.decode(bpe.encode(odd.select("doc_id", "text")).withColumnRenamed("text", "before")).collect()}
    assert again == {(d, t): t or "" for d, t in ODD}
    assert bpe.encode(odd, ids="label2").columns == [*odd.columns, "label2"]
    assert bpe.encode(none).count() == 0
    texts = dict(docs(spark, sf))
    for r in queries.queries()["op7_bpe"](spark, sf).collect():
        t = texts[r.doc_id] or ""
        ids = want.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t))


@pytest.mark.parametrize("piece", ["aaaa", "abababab", "abcabc" * 40, "a", "bb" * 33])
def test_bpe_small_vocabulary(piece):
    """Merges by rank, leftmost first, also with pairs that overlap."""
    vocab = [bytes([i]) for i in range(256)] + [b"ab", b"aa", b"abc", b"bb", b"abab", b"aaa", b"cab"]
    ranks = {t: i for i, t in enumerate(vocab)}
    parts = [bytes([c]) for c in piece.encode()]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    enc = bpe.Encoder(ranks, r"\S+")
    assert np.frombuffer(enc.encode_pieces([piece.encode()])[0], "<u4").tolist() == [ranks[p] for p in parts]


# 8

GOOD = "the cat sat on the mat and it was a very long day for all of the people that were in the house with them " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>Hello world.</p>", "Hello world."), ("<nav><a href=x>Home</a></nav><p>Hello world.</p><footer>me</footer>", "Hello world."), ("<p>Просто русский текст без ссылок.</p>", "Просто русский текст без ссылок."), ("<p>" + "日本語の段落です。" * 30, "日本語の段落です。" * 30), ("<pre>int main() { return 0; } // some code that is longer than seventy characters in all</pre>", "int main() { return 0; } // some code that is longer than seventy characters in all"), (f"<p>{GOOD}</p><table><tr><td>17</td></tr></table><p>{GOOD}</p>", f"{GOOD.strip()}\n\n17\n\n{GOOD.strip()}"), (f"<article><p>{GOOD}</p><p><a href=x>a link of its own</a></p><h3>More</h3><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></article>", f"{GOOD.strip()}\n\na link of its own"), (f"<article>{GOOD}</article><p>We use some things on this site.</p>", GOOD.strip()), (f"<article><p>teaser</p></article><div><p>{GOOD}</p></div>", f"teaser\n\n{GOOD.strip()}"), (f"<p>{GOOD}", GOOD.strip()), (f"<nav><a href=x>Home</a></nav><p>{GOOD}</p><footer>&copy; me</footer>", GOOD.strip()), (f"<article><h1>T &amp; U</h1><p>a<b>b</b> c<br>d</p></article>", "T & U\n\nab c d"),
        (f"<div class='comments'><p>{GOOD}</p></div><article><p>x</p></article>", "x"), (f"<body><h2>Head</h2><p>{GOOD}</p><p>short end</p><div id=sidebar>{GOOD}</div>", f"Head\n\n{GOOD.strip()}\n\nshort end"), (f"<script>var a = '<p>{GOOD}</p>'</script><!-- <p>{GOOD}</p> --><main><p>y</p></main>", "y"),
        (f"<article><p>1 &lt; 2 and 3 < 4</p><style>p{{}}</style><form>name</form></article>", "1 < 2 and 3 < 4"), (f"<article><p>never closed <!-- no end", "never closed"), ("<article><p>A&nbsp;B\n\t C</p></article>", "A B C"), ("<article><p>cut <a hre", "cut"),
        (f"<div class='layout with-sidebar'><p>{GOOD}</p><ol class=commentlist><li>{GOOD}</li></ol><div role=contentinfo>{GOOD}</div></div>", GOOD.strip()), ("<article><div class='post-header'><h1>H</h1></div><p>x</p><div class='share-bar'>y</div><p style='display: none'>z</p></article>", "H\n\nx"), (f"<header><p>{GOOD}</p></header><article><header><h1>T</h1></header><p>x</p></article>", "T\n\nx"),
        (f"<p>{GOOD}</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div class='cookie-notice'>{GOOD}</div><section id='reader-comments'><article><p>{GOOD}</p></article></section>", GOOD.strip()),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page) == want


def test_html_rules(spark, sf):
    """Both passes decide blocks of the tables' pages, and without article elements most of the text stays the same."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    n = {}
    for r in html_text.rules(bare).collect():
        n[r.rule] = n.get(r.rule, 0) + r.blocks
    assert n["stop words"] > 0 and n["neighbour"] > 0
    texts = lambda df: {r.page_id: r.text for r in html_text.extract(df).collect()}
    whole, stripped = texts(pages), texts(bare)
    assert sum(whole[p] == stripped[p] for p in whole) >= 0.95 * len(whole)


def test_html_pages(spark, sf):
    for r, p in zip(*(sorted(df.collect(), key=lambda r: r.page_id) for df in (queries.queries()["op8_html"](spark, sf), spark.read.parquet(f"{sf}/pages.parquet")))):
        body = p.html[p.html.index("<article>") : p.html.index("</article>")]
        parts = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# 9


def test_sharding(spark, sf, odd, none, tmp_path):
    got = queries.queries()["op9_sharding"](spark, sf).collect()
    check_shards([(r.shard, r.slot) for r in got], 40)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs(spark, sf))
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t in docs(spark, sf)}
    placed = sharding.external_shuffle(odd, 4)
    check_shards([(r._shard, r._slot) for r in placed.collect()], 4)
    assert [c for c in placed.columns if c not in ("_place", "_shard", "_slot")] == odd.columns
    clash = odd.withColumn("_place", F.lit("a")).withColumn("_SHARD", F.lit("b")).withColumn("_slot", F.lit("c"))
    got = sharding.external_shuffle(clash, 4)
    assert got.columns == [*clash.columns, "__place", "__shard", "__slot"]
    check_shards([(r["__shard"], r["__slot"]) for r in got.collect()], 4)
    again = sharding.external_shuffle(odd.repartition(5), 4)
    assert rows(placed, "doc_id", "_place") == rows(again, "doc_id", "_place")  # the order depends on the seed alone
    assert rows(placed, "doc_id", "_place") != rows(sharding.external_shuffle(odd, 4, seed=18), "doc_id", "_place")
    assert sharding.external_shuffle(none, 4).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


def test_sharding_of_repeated_rows(spark, monkeypatch):
    """A record that is a third of the table is scattered over all buckets, the same way at each run."""
    monkeypatch.setattr(sharding, "HOT_ROWS", 8)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(600)], "doc_id long, text string")
    same_ = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    one, two = (sharding.external_shuffle(x, 5) for x in (df.union(same_), same_.repartition(7).union(df.repartition(3))))
    assert rows(one, "doc_id", "text", "_place") == rows(two, "doc_id", "text", "_place")
    check_shards([(r._shard, r._slot) for r in one.collect()], 5)
    at = sorted(r._place for r in one.where("doc_id IS NULL").collect())
    assert len(at) == 300 and max(b - a for a, b in zip(at, at[1:])) < 60


def check_shards(pairs, shards):
    sizes = [sum(s == k for s, _ in pairs) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slot for s, slot in pairs if s == k) == list(range(sizes[k])) for k in range(shards))


# 10

COLS10 = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates(spark, sf, odd, none):
    same(rows(queries.queries()["op10_minhash"](spark, sf), *COLS10), brute.near_duplicates(docs(spark, sf)))
    same(rows(minhash.near_duplicates(odd, 4), *COLS10), brute.near_duplicates(ODD))
    kept = rows(minhash.deduplicated(odd, 4), "doc_id", "text")
    want = {(d, t) for (d, t), r in zip(ODD, brute.near_duplicates(ODD)) if d is not None and r[3]}
    assert {k for k in kept if k[0] is not None} == want and len([k for k in kept if k[0] is None]) == 2
    assert minhash.near_duplicates(none).count() == 0


def test_superminhash_estimates():
    """Slots agree as often as the sets overlap, and each row's signature depends on its set alone."""
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:3000]
    sig = minhash.superminhash(np.repeat([0, 1], 2000), np.concatenate([a, b]), 2)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12
    alone = minhash.superminhash(np.zeros(2000, int), b[::-1], 1)
    assert (alone[0] == sig[1]).all()
    one = minhash.superminhash(np.zeros(1, int), pool[:1], 1)
    assert len(set((one[0] >> 24).tolist())) == minhash.SLOTS  # a lone element fills each slot at its own level


def test_pairs_of_open_buckets(spark):
    """A link is met in the bucket it shares, whatever single bytes of earlier bands or of the whole signatures say."""
    same_, other = bytes(minhash.SLOTS), bytes([1]) * minhash.SLOTS
    of = lambda n: np.arange(n, dtype="<u4").tobytes()
    sketches = spark.createDataFrame([(1, same_, of(100)), (2, same_, of(90)), (3, other, of(95)), (4, same_, of(40))], "rep long, sig binary, shingles binary")
    rows_ = spark.createDataFrame([(7, 5, i, i) for i in (1, 2, 3, 4)], "key long, band int, rep long, comp long")
    assert set(rows(minhash._across(rows_, sketches, 80).where("a < b"), "a", "b")) == {(1, 2), (1, 3), (2, 3)}


def test_chained_groups(spark):
    """A chain whose ends are far apart is one group; one large bucket of many variants is found whole."""
    base = [f"t{i}" for i in range(200)]
    chain = [(i, " ".join(base[: 200 - 0] if i == 0 else [f"s{j}" if j < 8 * i else base[j] for j in range(200)])) for i in range(12)]
    same(rows(minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 1), *COLS10), brute.near_duplicates(chain, 1))


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    sets = components.UnionFind()
    for a, b in edges:
        sets.union(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    nodes = {x for e in edges for x in e}
    assert {n: got.get(n, n) for n in nodes} == {n: sets.find(n) for n in nodes}


def test_words_of_chunks():
    from freshet.llm._words import chunks, space_words

    texts = ["a b", None, "", "  c d\x0be ", "f"]
    found = []
    for c in chunks(pa.array(texts), space_words(), limit=4):
        for r in range(c.rows):
            found.append([c.data[c.start[w] : c.end[w]].tobytes().decode() for w in range(c.word_at[r], c.word_at[r + 1])])
    assert found == [brute.SPACE.findall(t or "") for t in texts]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    got = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    same(rows(df, *names), got.fetchall())
