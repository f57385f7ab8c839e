"""How counts and back-off probabilities are made, on odd sentences and against plain loops."""

from collections import Counter

from thicket.operators import counts, lifecycle, smoothing
from thicket.plans import queries
from thicket.plans.queries import QUERIES
from thicket.sources import corpus, tables

DATA = "/root/testdata/sf0.001"
SENTENCES = [["<s>", "a", "b", "a", "b", "</s>"], ["<s>", None, "a", "</s>"], ["<s>", "</s>"], ["<s>", "a b", "</s>"], ["<s>", "<s>", "a", "</s>"]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def by_hand(sentences, order):
    return Counter((k, tuple(reversed(w[i - k + 1 : i])), w[i]) for w in sentences for i in range(len(w)) for k in range(1, order + 1) if i >= k - 1)


def test_lower_orders_sum_the_shuffle_of_the_next_one(spark):
    """Tokens are counted once, for the top order; the old code counted each order from tokens by way of nested arrays."""
    df = spark.createDataFrame([(s,) for s in SENTENCES], "words array<string>")
    for order in (1, 2, 3, 4):
        found = counts.ngram_counts(df, order)
        assert {(r["ord"], tuple(r["ctx"]), r["w0"]): r["cnt"] for r in found.collect()} == by_hand(SENTENCES, order)
    seen = final_plan(counts.ngram_counts(df, 3))
    assert "flatten" not in seen and "ReusedExchange" in seen


def test_counts_of_counts_read_the_text_once(spark):
    for name in ("counts_of_counts_all_words", "kn_discounts_all_words", "good_turing_discounts_all_words", "counts_of_counts", "kn_discounts", "good_turing_discounts"):
        seen = final_plan(QUERIES[name](spark, DATA))
        assert "flatten" not in seen and "ReusedExchange" in seen, name


def test_a_line_is_cut_once(spark):
    """No filter asks for the words of a line a second time."""
    df = spark.createDataFrame([("a  b\n \t\n\nc",), (None,), ("",)], "text string")
    cut = corpus.text_sentences(df)
    assert sorted(r[0] for r in cut.collect()) == [["<s>", "a", "b", "</s>"], ["<s>", "c", "</s>"]]
    assert plan(counts.ngram_counts(cut, 1).filter("ord = 1")).count("split(line") == 1


def test_both_probabilities_of_held_out_ngrams_come_from_one_pass(spark):
    """p_short is what the order below gives on the way; each distinct shorter n-gram is looked up once, the empty context by no shuffle."""
    text = [["<s>", *x.split(), "</s>"] for x in ("a b c", "a b d", "b c", "c c a", "d a b c a")]
    raw = counts.ngram_counts(spark.createDataFrame([(s,) for s in text], "words array<string>"), 3)
    model = smoothing.train(raw, 3)
    asked = spark.createDataFrame([(c, w) for c in ([], ["a"], ["b", "a"], ["z", "a"], ["b", "z"], ["a", "d"]) for w in ("a", "c", "</s>", "new")], "ctx array<string>, w0 string")
    got = {(tuple(r["ctx"]), r["w0"]): (r["p_full"], r["p_short"]) for r in lifecycle.backed_off(asked, model, 3).collect()}
    used = {(r["ord"], tuple(r["ctx"]), r["w0"]): r["cnt"] for r in model.counts.collect()}

    def p(ctx, w, k):
        if k == 0:
            return 1 / model.n_words
        own = [n for (o, c, _), n in used.items() if o == k and c == ctx[: k - 1]]
        low = p(ctx, w, k - 1)
        if len(ctx) < k - 1 or not own:
            return low
        d, n = model.discounts[k].d, used.get((k, ctx[: k - 1], w), 0)
        return (n - d[min(n, 3) - 1] if n else 0) / sum(own) + sum(d[min(x, 3) - 1] for x in own) / sum(own) * low

    assert len(got) == 24
    for (ctx, w), (full, short) in got.items():
        assert abs(full - p(ctx, w, 3)) < 1e-12 and abs(short - p(ctx[:1], w, 2)) < 1e-12, (ctx, w)
    seen = plan(lifecycle.backed_off(asked, model, 3))
    assert seen.count("BroadcastNestedLoopJoin") == 1 and "transform" not in seen


def test_continuation_counts_by_hand(spark):
    """One aggregation; an n-gram from <s> stays raw even where the text itself has the mark as a word."""
    raw = counts.ngram_counts(spark.createDataFrame([(s,) for s in SENTENCES if None not in s], "words array<string>"), 3)
    made = counts.continuation(raw, 3)
    all_raw = by_hand([s for s in SENTENCES if None not in s], 3)
    want = {g: n for g, n in all_raw.items() if g[0] == 3}
    for k in (1, 2):
        want |= Counter((k, c[: k - 1], w) for o, c, w in all_raw if o == k + 1)
    want |= {g: n for g, n in all_raw.items() if g[0] == 2 and g[1][-1] == "<s>"}
    assert {(r["ord"], tuple(r["ctx"]), r["w0"]): r["cnt"] for r in made.collect()} == want
    assert "Anti" not in plan(made)


def test_event_sentences_are_sorted_once_for_all_parts(spark):
    """The ids and the three parts read a written table; before, each sorted the events anew."""
    with tables.recorded() as made:
        queries._apart(spark, DATA)
    assert [t.columns for t in made].count(["words", "part"]) == 1


def test_discount_files_count_once(spark):
    """Continuation counts read written n-grams; before, their three sources counted the text anew."""
    with tables.recorded() as made:
        QUERIES["discount_files"](spark, DATA)
    assert [t.columns for t in made].count(["ord", "ctx", "w0", "cnt"]) == 1
