"""Growth, pruning, filling, scoring and export of forests, and what the evaluation steps check."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import counts, evaluate, forest, lifecycle, smoothing, split
from thicket.plans.queries import QUERIES
from thicket.sources import corpus, formats, tables
from thicket.streaming.scorer import score_stream

DATA = "/root/testdata/sf0.001"
GRAMS = "ctx array<long>, w0 long, cnt long"


def some_text(n, seed):
    """Sentences in which the next word depends on the class of the one before: there is something to split by."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [r.randint(3, 12)]
        while len(words) < 12:
            words.append(r.choice([3, 4, 5, 6, 7] if words[-1] % 2 else [8, 9, 10, 11, 12]))
        out.append(words)
    return out


def counted(spark, sentences):
    df = spark.createDataFrame([([1, *w, 2],) for w in sentences], "words array<long>")
    return tables.written(counts.ngram_counts(df, 3))


def test_forest_lifecycle_on_text_with_structure(spark):
    train, held, test = (counted(spark, some_text(n, k)) for k, n in enumerate((120, 40, 40)))
    model = smoothing.train(train, 3, "witten-bell", (1,))
    top = lambda c: c.filter("ord = 3 and w0 <> 1").select("ctx", "w0", "cnt")
    measured = lifecycle.backed_off(top(held), model, 3)
    edges, nodes = (tables.written(x) for x in forest.grow_measured(top(train), measured, 3, 3, 11, smoothing.Discount()))
    # statistics of the grown nodes, computed anew from the finished trees
    again = {tuple(r)[:2]: tuple(r)[2:] for r in lifecycle.measure(edges, top(train), measured, smoothing.Discount()).collect()}
    grown = {(r["tree_id"], r["path"]): (r["is_leaf"], r["logl"], r["heldout_sum"]) for r in nodes.collect()}
    assert set(grown) == set(again) and all(again[k] == (v[0], pytest.approx(v[1]), v[2]) for k, v in grown.items())
    assert all(v[2] > 0 or v[0] for v in grown.values()), "a node without held-out n-grams is split"
    kept, left = lifecycle.pruned(edges, nodes, 0.0)
    assert 3 < left.count() < nodes.count(), "text with structure keeps some splits and loses others"
    asked = tables.written(lifecycle.backed_off(lifecycle.scorable(test, 3, 1), model, 3))
    trees = spark.range(3).select(F.col("id").cast("int").alias("tree_id"))
    scored = tables.written(lifecycle.score(asked, top(counts.merge(train, held)), tables.written(kept), trees, smoothing.Discount(), 3))
    ppl = {r["model"]: r["ppl"] for r in lifecycle.perplexities(scored, "none").collect()}
    single = [ppl[str(k)] for k in range(3)]
    assert ppl["forest"] <= sum(single) / 3 + 1e-9 and min(single) < 12
    assert {r["provenance"] for r in scored.select("provenance").distinct().collect()} >= {"seen", "unseen_seen", "lower_order"}
    # leaf probabilities of a context add up to 1 over all words
    words = spark.range(2, 13).select(F.col("id").alias("w0"))
    grid = scored.filter("ord = 3 and provenance = 'seen'").select("ctx").distinct().join(words).withColumn("ord", F.lit(3)).withColumn("cnt", F.lit(1).cast("long"))
    full = lifecycle.score(lifecycle.backed_off(grid, model, 3), top(counts.merge(train, held)), kept, trees, smoothing.Discount(), 3)
    assert all(r["s"] == pytest.approx(1) for r in full.groupBy("tree_id", "ctx").agg(F.sum("prob").alias("s")).collect())


def test_growth_has_no_silent_bound(spark):
    train = spark.createDataFrame([([a, a], (a * 7) % 9, 1 + a % 4) for a in range(1, 30)], GRAMS)
    edges = forest.grow(train, 2, 3, 3)
    depth = forest.tree_stats(edges).agg(F.max("depth")).first()[0]
    assert depth > 3
    assert forest.grow(train, 2, 3, 3, max_depth=depth).count() == edges.count()
    with pytest.raises(ValueError):
        forest.grow(train, 2, 3, 3, max_depth=2)


def test_positions_are_drawn_as_by_hand(spark):
    nodes = spark.createDataFrame([(t, p) for t in range(20) for p in ("", "01")], "tree_id int, path string")
    want = set()
    for t in range(20):
        for p in ("", "01"):
            kept = next(k for a in range(64) if (k := [x for x in range(3) if split._uniform32(5, t, p, x, a) < 1 << 31]))
            want |= {(t, p, x) for x in kept}
    assert {tuple(r) for r in forest.drawn_positions(nodes, 5, 3, "both", 0.5).collect()} == want


def test_exchange_against_dictionaries():
    """The same moves as by dictionaries of counts, one word at a time."""
    r = random.Random(1)
    xl = lambda x: x * math.log(x) if x > 0 else 0.0
    for _ in range(40):
        rows = {(e, w): r.randint(1, 9) for e in range(1, 9) for w in range(6) if r.random() < 0.5}
        if len({e for e, _ in rows}) < 2:
            continue
        side = {e: r.randint(0, 1) for e, _ in rows}
        start, total = dict(side), lambda s: [Counter({w: sum(c for (e, x), c in rows.items() if x == w and side[e] == k) for w in range(6)}) for k in s]
        value = lambda: sum(sum(map(xl, h.values())) - xl(sum(h.values())) for h in total((0, 1)))
        moved = True
        while moved:
            moved = False
            for source in (0, 1):
                for e in sorted(x for x in side if side[x] == source):
                    before = value()
                    side[e] = 1 - source
                    if value() - before > split.LEAST_MOVE:
                        moved = True
                    else:
                        side[e] = source
        elem, word, cnt = np.array([(e, w, c) for (e, w), c in rows.items()]).T
        found, gain = split.exchange(elem, word, cnt, start)
        whole = Counter()
        for (_, w), c in rows.items():
            whole[w] += c
        assert found == side and gain == pytest.approx(value() - sum(map(xl, whole.values())) + xl(sum(whole.values())))


def test_filling_must_reach_the_tested_leaves(spark):
    edges = spark.createDataFrame([(0, "", "0", 0, 1), (0, "", "1", 0, 2)], forest.EDGES)
    test = spark.createDataFrame([(3, [1, 1], 5, 1, 0.1, 0.1)], "ord int, ctx array<long>, w0 long, cnt long, p_full double, p_short double")
    trees = spark.range(1).select(F.col("id").cast("int").alias("tree_id"))
    with pytest.raises(ValueError):
        lifecycle.score(test, spark.createDataFrame([([2, 2], 5, 1)], GRAMS), edges, trees, smoothing.Discount(), 3)
    unseen = lifecycle.score(test.withColumn("ctx", F.expr("array(9L, 9L)")), spark.createDataFrame([([2, 2], 5, 1)], GRAMS), edges, trees, smoothing.Discount(), 3).first()
    assert (unseen["prob"], unseen["provenance"]) == (0.1, "unseen_history")


def test_arpa_file_as_a_whole(spark):
    rows = [(1, [], "<s>", -99.0, -0.5), (1, [], "a", -0.3, -0.2), (1, [], "</s>", -0.4, None), (2, ["a"], "</s>", -0.1, None)]
    model = spark.createDataFrame(rows, "ord int, ctx array<string>, w0 string, logp double, log_bow double")
    text = "\n".join(r["value"] for r in formats.arpa_file(model).collect()).split("\n")
    assert [x for x in text if x][:4] == ["\\data\\", "ngram 1=3", "ngram 2=1", "\\1-grams:"] and text[-1] == "\\end\\" and "\\2-grams:" in text
    back = formats.read_arpa(spark.createDataFrame([(x,) for x in text], "value string")).select("ord", "ctx", "w0", "logp", "log_bow")
    assert sorted((r["ord"], list(r["ctx"]), *r[2:]) for r in back.fillna(9.0).collect()) == sorted((*r[:4], 9.0 if r[4] is None else r[4]) for r in rows)


def test_weights_of_mixtures_are_checked(spark):
    scored = spark.createDataFrame([(0, "c", "w", 0.2), (1, "c", "w", 0.4), (0, "c", "v", 0.6)], "tree_id int, ctx string, w0 string, prob double")
    weights = lambda *w: spark.createDataFrame(list(enumerate(w)), "tree_id int, weight double")
    got = {r["w0"]: r["prob"] for r in evaluate.mix(scored, weights(0.25, 0.75), models=2).collect()}
    assert got == pytest.approx({"w": 0.35, "v": 0.15})
    assert {r["w0"]: r["prob"] for r in evaluate.mix(scored, models=2).collect()} == pytest.approx({"w": 0.3, "v": 0.3})
    for bad in (weights(0.5, 0.6), weights(1.0)):
        with pytest.raises(ValueError):
            evaluate.mix(scored, bad, models=2)
    with pytest.raises(ValueError):
        evaluate.interpolated(scored, {"p1": 0.0, "p2": 0.7, "p3": 0.4})


def test_em_finds_the_best_weight(spark):
    r = random.Random(2)
    rows = [(r.random() * 0.5 + 0.01, r.random() * 0.5 + 0.01, r.randint(1, 5)) for _ in range(200)]
    lam = evaluate.em_lambda(spark.createDataFrame(rows, "p1 double, p2 double, cnt long"), 60)
    fit = lambda x: sum(c * math.log(x * a + (1 - x) * b) for a, b, c in rows)
    assert fit(lam) >= max(fit(k / 100) for k in range(1, 100)) - 1e-3


def test_original_discount_and_least_counts(spark):
    rows = [(1, [], str(k), c) for k, c in enumerate([1] * 6 + [2] * 3 + [3] * 2 + [4])]
    df = spark.createDataFrame(rows, "ord int, ctx array<string>, w0 string, cnt long")
    assert smoothing.estimate(df, "original")[1].d == pytest.approx((0.5,) * 3)
    assert smoothing.estimate(df)[1].d == pytest.approx((0.5, 2 - 3 * 0.5 * 2 / 3, 3 - 4 * 0.5 * 1 / 2))
    assert smoothing.estimate(df, least={1: 2})[1].fallback and not smoothing.estimate(df)[1].fallback


def test_words_lower_multiword_vocabulary_files_and_closed(spark):
    text = spark.createDataFrame([("New_York is\nBIG",), (None,)], "text string")
    assert [r["words"] for r in corpus.text_sentences(text, lower=True, multiword="_").collect()] == [["<s>", "new", "york", "is", "</s>"], ["<s>", "big", "</s>"]]
    vocab = corpus.read_vocabulary(spark.createDataFrame([("is",), (" new ",), ("",), ("is",)], "value string"))
    assert [r["value"] for r in corpus.vocabulary_lines(vocab).collect()] == ["is", "new"]
    for bound in (corpus.PLAN_WORDS, 0):
        corpus.PLAN_WORDS, kept = bound, corpus.PLAN_WORDS
        mapped = corpus.map_unknown(corpus.text_sentences(text, lower=True, multiword="_"), vocab)
        corpus.PLAN_WORDS = kept
        assert sorted(r["words"] for r in mapped.collect()) == [["<s>", "<unk>", "</s>"], ["<s>", "new", "<unk>", "is", "</s>"]]
    assert sorted(r["words"] for r in corpus.closed(mapped).collect()) == [["<s>", "</s>"], ["<s>", "new", "is", "</s>"]]


def test_oovs_leave_the_perplexity(spark):
    scored = spark.createDataFrame([("a", 3, 0.1), ("<unk>", 2, 0.5), ("</s>", 1, 0.1)], "w0 string, cnt long, prob double")
    found = evaluate.perplexity(scored, unknown="<unk>").first()
    assert (found["oovs"], found["words"], found["ppl"]) == (2, 5, pytest.approx(10))


def test_stream_of_files_is_scored(spark, tmp_path):
    """Files of n-grams that arrive, against a static model, as a real stream."""
    c = tables.written(counts.ngram_counts(corpus.event_sentences(spark.read.parquet(f"{DATA}/events.parquet")), 3))
    model = smoothing.train(c, 3, "witten-bell")
    asked = c.filter("ord = 2 and w0 <> '<s>'").select("ctx", "w0")
    asked.write.parquet(f"{tmp_path}/in")
    stream = score_stream(spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in"), model)
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((tuple(r["ctx"]), r["w0"], round(r["p"], 9)) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(score_stream(asked, model))


def test_kneser_ney_perplexity_by_brute_force(spark):
    """All words of the documents: modified Kneser-Ney, interpolated, from its definition."""
    sents = [["<s>", *words, "</s>"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() for line in (r[0] or "").split("\n") if (words := line.replace("\x0b", " ").replace("\x0c", " ").split())]
    raw = [Counter(tuple(s[i - k : i + 1]) for s in sents for i in range(k, len(s)) if s[i] != "<s>") for k in range(3)]
    used = [Counter(), Counter(), raw[2]]
    for k in (0, 1):
        for g in raw[k + 1]:
            used[k][g[1:]] += 1
        for g in list(used[k]) if k else []:
            if g[0] == "<s>":
                used[k][g] = 0
        if k:
            used[k].update({g: n for g, n in raw[k].items() if g[0] == "<s>"})
    ds, stats = [], []
    for k in range(3):
        n = [sum(c == j for c in used[k].values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        ds.append([0, *(min(j, max(0, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3))])
        by = {}
        for g, c in used[k].items():
            t = by.setdefault(g[:-1], [0, 0.0])
            t[0] += c
            t[1] += ds[k][min(c, 3)]
        stats.append(by)
    words = len(raw[0])

    def prob(g):
        p = 1 / words
        for k in range(len(g)):
            own = g[len(g) - 1 - k :]
            if own[:-1] in stats[k]:
                total, off = stats[k][own[:-1]]
                c = used[k].get(own, 0)
                p = (max(c - ds[k][min(c, 3)], 0) if c else 0) / total + off / total * p
        return p

    logprob = sum(c * math.log10(prob(g)) for g, c in raw[2].items()) + sum(c * math.log10(prob(g)) for g, c in raw[1].items() if g[0] == "<s>")
    assert QUERIES["kn_perplexity"](spark, DATA).first()["logprob"] == pytest.approx(logprob, rel=1e-9)
