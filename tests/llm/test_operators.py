import base64
import functools
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

from thicket.llm import byte_bpe, components, fingerprint, license_scan, line_dedup, memo, minhash, mixing, quality_rules, span_dedup, storage, token_counts, warc_zstd

RANKS, MODEL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, source string, n_words string, score string, h string"
ODD = ["", " ", "\n\n\n", "  a  b\n\n c\t\td \n", "don't 's\x1c\x1d x", "\x85　a   b", "日本語 한국어 🎉", "ab" * 2000, " " * 300 + "x", "▁a ▁▁b", "<s> </s> <0x0A>", "\x00"]


def docs(spark, texts, ids=None, source="s"):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, source, "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def noise(n, seed=0):
    r = random.Random(seed)
    return [" ".join(r.choices(["alpha", "beta", "Gamma.", "de\nta", "eta"], k=r.randint(1, 80))) for _ in range(n)]


# 1
def test_licenses(spark):
    texts = ["All Rights-Reserved! all rights reserved", "Licensed CC-BY 4.0", "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 x", None, "", "general public\nlicense", "SPDX-License-Identifier: nonsense"]
    got = by_id(license_scan.scan_licenses(docs(spark, texts)))
    assert [got[i]["n_base"] for i in range(7)] == [2, 1, 0, 0, 0, 1, 0]
    assert (got[0]["first_word"], got[0]["last_word"], got[0]["n_words"]) == (0, 3, 6)
    assert got[2]["labels"] == "apache-2.0,gpl-3.0-only,mit" and got[2]["verdict"] == "permissive" and got[2]["base_labels"] == ""
    assert got[3]["score"] == 0 and got[3]["first_word"] is None and (got[6]["expressions"], got[6]["verdict"]) == ("nonsense", "unknown")
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, postfix, worst",
    [
        ("mit or gpl-2.0 and isc", "mit gpl-2.0 isc and or", 0),
        ("(mit or gpl-2.0) and mpl-2.0", "mit gpl-2.0 or mpl-2.0 and", 1),
        ("gpl-2.0 with classpath-exception-2.0", "gpl-2.0 classpath-exception-2.0 with", 1),
        ("cc-by-sa-4.0 with classpath-exception-2.0", "cc-by-sa-4.0 classpath-exception-2.0 with", 2),
        ("mit and sspl-1.0", "mit sspl-1.0 and", 4),
        ("mit and gpl-1.0", "mit gpl-1.0 and", 2),
        ("mit and (isc or bsd-4-clause) */", "mit isc bsd-4-clause or and", 0),
        ("artistic-2.0 or mit", "artistic-2.0 mit or", 0),
        ("(mit and sspl-1.0)", "mit sspl-1.0 and", 4),
        ("mit and beerware", "mit beerware and", 5),
        ("mit or beerware then", "mit beerware or", 0),
        ("agpl-3.0-or-later and mit)", "agpl-3.0-or-later mit and", 3),
        ("licenseref-acme.", "licenseref-acme", 4),
    ],
)
def test_expressions(text, postfix, worst):
    found = license_scan.parse_expression(text)
    assert " ".join(found) == postfix and license_scan.evaluate(found) == worst


@pytest.mark.parametrize("text", ["(mit", "or mit", "", "mit and", "mit and ?", "(mit or isc", "(mit or isc) with x", "mit or or isc", "()"])
def test_broken_expressions(text):
    """None is cut short: what stands before the break may be freer than the whole."""
    assert license_scan.parse_expression(text) is None
    assert license_scan.scan(f"SPDX-License-Identifier: {text}")[-2:] == ("unresolved", "unknown")


def test_expressions_against_python():
    """Random expressions mean what Python's own `and` and `or` mean: the same precedence, sides picked by class."""
    r = random.Random(3)
    ids = ["mit", "mpl-2.0", "gpl-3.0", "agpl-3.0", "sspl-1.0", "foo-1.0"]

    class Rank(int):
        def __and__(self, other):
            return Rank(max(self, other))

        def __or__(self, other):
            return Rank(min(self, other))

    def some(depth):
        if depth == 0 or r.random() < 0.3:
            k = r.randrange(6)
            return ids[k], f"Rank({k})"
        (a, x), (b, y) = some(depth - 1), some(depth - 1)
        op, sign = r.choice([("and", "&"), ("or", "|")])
        return (f"{a} {op} {b}", f"{x} {sign} {y}") if r.random() < 0.5 else (f"({a} {op} {b})", f"({x} {sign} {y})")

    for _ in range(500):
        text, python = some(4)
        assert license_scan.evaluate(license_scan.parse_expression(text)) == eval(python, {"Rank": Rank}), text


def test_base_phrases_of_long_texts(spark):
    """By hand, over whole texts: places in words, overlaps, and texts of a million characters."""
    r = random.Random(9)
    words = ["cc", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "é", "x1"]
    texts = [r.choice([" ", "-", "\n", "\x7f"]).join(r.choices(words, k=r.randint(0, 400))) for _ in range(60)] + ["cc by " * 150_000, " " * 1_000_000, None]
    got = by_id(license_scan.scan_licenses(docs(spark, texts)))
    for i, t in enumerate(texts):
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [k for k in range(len(own)) for p in license_scan.BASE if own[k : k + len(p.split())] == p.split()]
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(own), len(places), min(places, default=None), max(places, default=None))


# 2
def test_warc(spark, tmp_path):
    big, other = "x<p>é" * 400, "y" * 1500
    pages = [(1, "http://a/ b\r\n", big), (5, None, big), (3, "http://c", big), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", other), (None, "u", other), (None, "u", "")]
    path = f"file://{tmp_path}/w"
    warc_zstd.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = sorted((tuple(r) for r in warc_zstd.read_archives(spark, path).collect()), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    role = lambda i, t: ("revisit", 5) if t == big and i != 5 else ("revisit", 10) if t == other and i is None else ("response", None)
    assert got == sorted(((i, len((t or "").encode()), sha(t), *role(i, t)) for i, _, t in pages), key=repr)
    one = next(tmp_path.rglob("part-*")).read_bytes()
    assert one[:4] == warc_zstd.DICTIONARY_MAGIC
    warc_zstd.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{path}0")
    assert warc_zstd.read_archives(spark, f"{path}0").count() == 0


def test_cut_archive():
    data = warc_zstd.dictionary_frame(b"abc" * 10) + zstandard.compress(b"r" * 100)
    assert list(warc_zstd.read_archive(data)) == [b"r" * 100]
    with pytest.raises(ValueError):
        list(warc_zstd.read_archive(data[:-3]))


# 3
def brute_counts(text):
    words = (text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    lines = [x for x in (text or "").split("\n") if x.strip("\t\n\x0b\f\r ")]
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def brute_quality(texts, good):
    """(counts, score, base_failed, kept) of each text, by the definition; `good`: ids of trusted ones."""
    hashed = lambda *w: functools.reduce(lambda h, x: xxhash.xxh64_intdigest(x.encode(), seed=h), w, 42)
    signed = lambda h: h - (1 << 64) * (h >> 63)
    bucket = lambda *w: signed(hashed(*w)) % quality_rules.BUCKETS
    held = {i for i in good if signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=hashed("held"))) % quality_rules.HOLD_OUT == 0}
    grams = []
    for t in texts:
        words = [w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        grams.append([bucket(w) for w in words] + [bucket(w, words[k - 1] if k else "") for k, w in enumerate(words)])
    raw, target = Counter(k for g in grams for k in g), Counter(k for i in good - held for k in grams[i])
    size = quality_rules.BUCKETS
    ratio = lambda k: math.log((target[k] + 1) / (sum(target.values()) + size)) - math.log((raw[k] + 1) / (sum(raw.values()) + size))
    ratios = {k: ratio(k) for k in raw}
    counts = [brute_counts(t) for t in texts]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    scores = [math.fsum(ratios[k] for k in g) / len(g) if g else 0.0 for g in grams]
    known = sorted(scores[i] for i in held if not failed[i])
    at = (len(known) - 1) * quality_rules.LOST_PERCENT / 100
    least = known[int(at)] + (at % 1) * (known[min(int(at) + 1, len(known) - 1)] - known[int(at)]) if known else -math.inf
    return [(c, s, f, not f and s >= least - 1e-12) for c, s, f in zip(counts, scores, failed)]


def test_quality(spark):
    r = random.Random(12)
    texts = [" ".join(f"w{r.randint(0, 200)}" for _ in range(r.randint(40, 120))) for _ in range(35)]
    texts += [*noise(5), *ODD[:7], None, "a b c " * 200, "w# $ |<>& * % " * 20, "word and " * 60_000]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(31, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = by_id(quality_rules.judge_documents(docs(spark, texts), labels))
    want = brute_quality(texts, set(range(1, 30, 2)))
    for i, (counts, score, failed, kept) in enumerate(want):
        x = rows[i]
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts, repr(texts[i])
        assert (x["score"], x["base_failed"], x["kept"]) == (pytest.approx(score, abs=1e-9), failed, kept)
    assert 0 < sum(k for *_, k in want) < sum(not f for _, _, f, _ in want)
    kept = quality_rules.keep_good(docs(spark, texts), labels)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in rows.items() if x["kept"]} and kept.columns == docs(spark, []).columns
    assert quality_rules.judge_documents(docs(spark, []), labels).count() == 0
    assert by_id(quality_rules.judge_documents(docs(spark, texts), labels.limit(0)))[0]["score"] == 0


def test_quality_is_fitted_on_all_trusted(spark):
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary[: r.choice([200, 400])], k=60 if i % 8 == 0 else 3)) for i in range(25_000)]
    good = {i for i in range(25_000) if i % 16}
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = by_id(quality_rules.judge_documents(frame, labels))
    want = brute_quality(texts, good)
    assert len(good) > 20_000 and len(rows) == len(texts)
    assert all(abs(rows[i]["score"] - score) < 1e-9 for i, (_, score, *_) in enumerate(want))
    assert {i for i, x in rows.items() if x["kept"]} == {i for i, (*_, kept) in enumerate(want) if kept}
    assert 0 < sum(not f and not k for _, _, f, k in want)


def test_quality_joins_many_trusted_by_shuffle(spark, monkeypatch):
    texts = [*noise(60, 3), None, "eta " * 60]
    ids = [*range(50), *range(6), *[None] * 6]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 50, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    judged = lambda: sorted(quality_rules.judge_documents(docs(spark, texts, ids), labels).collect(), key=repr)
    sent_out = judged()
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert judged() == sent_out and len(sent_out) == 62
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("values", [[], [None], [0.5], [1.0, 1.0, 1.0], [0.0, 5e-324, 1.0, None], [-3.0, 1e-17, 2e-17, 3e-17, 1e9], [random.Random(5).gauss(0, 1) for _ in range(9000)]])
@pytest.mark.parametrize("percent", [0, 1, 37.5, 100])
def test_percentile(spark, values, percent):
    table = storage.written(spark.createDataFrame([(v,) for v in values], "s double"))
    known = [v for v in values if v is not None]
    got = quality_rules.percentile(table, percent)
    assert got == (pytest.approx(float(np.percentile(known, percent)), rel=1e-9, abs=1e-30) if known else None)


# 4
def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, *noise(20), None]
    rows = by_id(byte_bpe.encode_and_decode(docs(spark, texts), RANKS, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == want
    assert byte_bpe.encode_documents(docs(spark, ["a b"]), RANKS, public_tokenizers.PATTERN).first()["ids"] == library.encode_ordinary("a b")


# 5
def brute_near(texts, size, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    for _ in root:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return sets, root


def test_near_duplicates(spark):
    base = noise(12, 3)
    r = random.Random(1)
    texts = [*base, *base[:3], "A B", "a b", "", " ", None]
    long = [f"w{r.randint(0, 999)}" for _ in range(120)]
    for _ in range(25):
        texts.append(" ".join("edit" if r.random() < 0.025 else w for w in long))
    sets, root = brute_near(texts, 4, 80)
    rows = by_id(minhash.near_duplicates(docs(spark, texts), 4, 80))
    assert [rows[i]["component_id"] for i in range(len(texts))] == root and [rows[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    left = minhash.keep_one_of_each(docs(spark, texts), 4, 80)
    assert sorted(x["doc_id"] for x in left.collect()) == sorted(set(root))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    odd = minhash.near_duplicates(docs(spark, ["a b c", "a b c", "x", "x"], [None, 4, 7, 7])).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in odd) == [(-1, 4, False), (4, 4, True), (7, 7, True), (7, 7, True)]


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 9), (1, 2), (2, 3), (5, 5), (3, 40), (40, 41)]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, 6) for x in (6, 7, 8, 9)} | {(x, 1) for x in (1, 2, 3, 40, 41)} | {(5, 5)}


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_components_of_random_links(spark, monkeypatch, rows):
    """Against union-find: hubs at either end of the order, paths and repeated links, with minima sent out and joined by shuffle."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", rows)
    r = random.Random(7)
    edges = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 240)]
    edges += [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(110)]
    edges += edges[:20]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {x: new if y == old else y for x, y in root.items()}
    assert dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())) == root


# 6
def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)) or None, r.choice(["a", "b", "b", "b", "c", None])) for i in range(400)] + [(400, "only", "tiny")]
    got = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(total.values()))
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for i, _, s in rows:
        x = got[i]
        assert (x["size"], x["source_size"]) == (size[i], total[s]) and x["target"] == pytest.approx(target[s]) and x["taken"] <= 3 * size[i]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in order)
    assert got == by_id(mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)))
    assert mixing.mix(docs(spark, [])).count() == 0


# 7 and 8
def brute_lines(text):
    """Lines with the blank ones behind them, and windows of three."""
    out = []
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            out.append([line])
        elif out:
            out[-1].append(line)
    own = [x[0].strip(" \t\x0b\x0c\r") for x in out]
    return own, {(i, i + 3) for i in range(len(own) - 2)}


def brute_sentences(text):
    """Sentences, long ones cut before the greatest word of any 16, and all runs by their definition."""
    units, sentence = [], []
    for line in text.split("\n"):
        words, current = line.split(), []
        for k, w in enumerate(words):
            current.append(w)
            if w[-1] in ".!?" or k == len(words) - 1:
                greatest = {max(range(i, i + 16), key=lambda j: (current[j], j)) for i in range(len(current) - 15)}
                cuts = sorted({0, len(current)} | greatest)
                sentence.append(len(units))
                units += [current[x:y] for x, y in zip(cuts, cuts[1:])]
                current = []
    ends = [*sentence[1:], len(units)]
    runs = {(sentence[i], ends[i + 2]) for i in range(len(sentence) - 2)}
    size = lambda a, b: sum(map(len, units[a:b]))
    for a in range(len(units)):
        for b in range(a + 2, len(units) + 1):
            if size(a, b) >= 16 and (b - a == 2 or size(a, b - 1) < 16 or size(a + 1, b) < 16):
                runs.add((a, b))
    return [" ".join(u) for u in units], runs


def brute_removed(rows, cut):
    """Units left and number of units removed, in the order of places: ids, null last, then hashes of texts."""
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest((t or "").encode(), seed=42), "big", signed=True) if t is not None else 42
    first, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))
    for r in order:
        units, runs = cut(r[1] or "")
        for a, b in sorted(runs):
            first.setdefault(tuple(units[a:b]), (r, a))
    for r in order:
        units, runs = cut(r[1] or "")
        gone = {k for a, b in runs if first[tuple(units[a:b])] != (r, a) for k in range(a, b)}
        out[r] = [u for k, u in enumerate(units) if k not in gone]
    return out


@pytest.mark.parametrize("run, cut", [(line_dedup.dedup_lines, brute_lines), (span_dedup.dedup_spans, brute_sentences)])
def test_dedup(spark, run, cut):
    r = random.Random(4)
    line = [f"line {k} has some words of its own." for k in range(12)] + ["Short.", "No. Yes!", " ".join(f"w{r.randint(0, 99)}" for _ in range(70))]
    texts = [r.choice(["\n", "\n\n \n"]).join(r.choices(line, k=r.randint(0, 15))) for _ in range(40)] + ["\n\n\n", None, "", "x" * 5000]
    rows = [(i if i % 5 else None if i % 2 else 7, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    want, got = brute_removed(rows, cut), run(df).collect()
    form = lambda i, units: (i, tuple(units) if cut is brute_lines else tuple(" ".join(units).split()))
    assert Counter(form(x["doc_id"], cut(x["text"] or "")[0]) for x in got) == Counter(form(i, want[i, t]) for i, t in rows)
    assert sum(x["n_removed"] for x in got) > 500
    assert run(docs(spark, [])).count() == 0
    same = run(docs(spark, ["\n".join(line[:12])] * 3, [2, 2, None])).collect()
    assert sorted((x["doc_id"] or 9, x["text"]) for x in same) == [(2, "\n".join(line[:12]))] * 2 + [(9, "")]


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, span_dedup.dedup_spans])
def test_many_rows_without_an_id(spark, run):
    """A hundred thousand null ids, all sharing a passage: one place keeps it, and no group is gathered."""
    text = F.concat(F.lit("The first line here.\nThe second line here.\nThe third line here.\n"), F.col("id").cast("string"))
    df = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    got = run(df).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in got} == {0: 1, len("The first line here.The second line here.The third line here.") + 3: 99_999}


@pytest.mark.parametrize("blank", [" ", "\n", " \n", "!", "\t.", "a "])
def test_cutters_take_linear_time(blank):
    text = blank * (1_000_000 // len(blank))
    for cut in (line_dedup.cut_lines, span_dedup.cut_sentences):
        began = time.process_time()
        cut(text)
        assert time.process_time() - began < 20


def test_spans_without_sentence_ends():
    """Passages of 50 words are found in texts of one sentence, between other words, and in whole copies of one sentence."""
    r = random.Random(8)
    word = lambda: f"{r.choice('abcdefgh')}{r.randint(0, 40)}"
    for k in range(300):
        passage = [word() + r.choice(["", "", "", ". "][: 3 + k % 2]) for _ in range(50)]
        a, b = (" ".join([word() for _ in range(r.randint(0, 30))] + passage + [word() for _ in range(r.randint(0, 30))]) for _ in range(2))
        assert {h for h, _, _ in span_dedup.cut_sentences(a)[1]} & {h for h, _, _ in span_dedup.cut_sentences(b)[1]}
        units, _ = span_dedup.cut_sentences(a)
        assert [w for x, y in units for w in a[x:y].split()] == a.split() and all(len(a[x:y].split()) <= 16 for x, y in units)
    one = " ".join(word() for _ in range(128))
    for text in (one, f"Other words before. {one}"):
        units, runs = span_dedup.cut_sentences(text)
        shared = {h for h, _, _ in span_dedup.cut_sentences(one)[1]}
        gone = {i for h, a, b in runs if h in shared for i in range(a, b + 1)}
        assert [i for i in range(len(units)) if i not in gone] == ([] if text == one else [0])


def test_dedup_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", "s", 7), (2, "x\na\nb\nc", "s", 7), (2, "x\na\nb\nc", "t", 7)], "doc_id long, text string, source string, n_chars long")
    got = sorted(tuple(r) for r in line_dedup.dedup_lines_keeping_columns(df).collect())
    assert got == [(1, "a\nb\nc\nd", "s", 7), (2, "x", "s", 1), (2, "x", "t", 1)]


# 9
def test_token_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, *noise(20), None]
    rows = by_id(token_counts.count_tokens(docs(spark, texts), MODEL, limit=10))
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        fit = rows[i]["fit_chars"]
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 10), repr(t)
        assert len(library.encode((t or "")[:fit])) <= 10 and (fit == len(t or "") or n > 10)
    pieces = token_counts.counter(MODEL)
    text = "The  quick bröwn\nfox 🎉 jumps"
    assert pieces.table(text) == [len(library.encode(text[:i])) for i in range(len(text) + 1)]


# 10
def brute_digest(data):
    """Triplets counted one by one; quarters of all buckets by sorted counts."""
    shuffled = np.random.RandomState(7).permutation(1 << 15) % 128
    counts = [0] * 128
    for a, b, c in zip(data, data[1:], data[2:]):
        t = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % (1 << 32)
        counts[shuffled[((t ^ (t >> 13)) * 0x27D4EB2F) % (1 << 32) >> 17]] += 1
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(c > x for x in q) for c in counts]
    head = [min(255, round(math.log(len(data), 1.1))) if data else 0, *(16 * x // q[2] if q[2] else 0 for x in q[:2])]
    return head, codes, bytes(head) + bytes(sum(codes[k + j] << (6 - 2 * j) for j in range(4)) for k in range(0, 128, 4))


def brute_likeness(a, b):
    (x, p, _), (y, q, _) = a, b
    far = sum(w * max(0, abs(x[k] - y[k]) - 1) for k, w in enumerate((1, 2, 2))) + sum(abs(i - j) for i, j in zip(p, q))
    return 1 - min(160, far) / 160


def test_fingerprints(spark):
    r = random.Random(5)
    texts = [*noise(30, 6), "", None, "é", "same text here " * 9, "same text here " * 9, "long " * 40_000]
    ids = r.sample(range(10_000), len(texts))
    rows = by_id(fingerprint.fingerprint_documents(docs(spark, texts, ids)))
    order = sorted(zip(ids, texts))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        x = rows[i]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (brute_digest(y.encode()) for y in (t, edited, after))
        assert (x["fingerprint"], x["edited_fingerprint"]) == (a[2].hex(), b[2].hex())
        assert (x["near_edited"], x["near_next"]) == pytest.approx((brute_likeness(a, b), brute_likeness(a, c))) and 0 <= x["near_next"] <= 1
    assert fingerprint.fingerprint_documents(docs(spark, [])).count() == 0
    assert fingerprint.fingerprint_documents(docs(spark, ["abcd"])).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprint_documents(docs(spark, ["ab", "ab", "cd"], [None, 3, 3])).count() == 3


def test_fingerprints_of_many_rows_with_one_id_or_none(spark):
    """Null ids and one id hold a third each: they fill several ranges, and each row is followed by the next by hash."""
    key = F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(5))
    df = spark.range(6000).select(key.alias("doc_id"), F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    rows = df.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(a["text"]) // 2
        want[a["doc_id"], hashlib.sha256((a["text"][: len(a["text"]) - half] + b["text"][:half]).encode()).hexdigest()] += 1
    got = fingerprint.fingerprint_documents(df)
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == want
    dealt = fingerprint.ranged(df.withColumn("text_hash", F.xxhash64("text")), 30).groupBy("range").count().collect()
    assert max(r["count"] for r in dealt) < 600


def test_names_cannot_clash(spark):
    """Columns with the names that operators use inside stay as they are."""
    names = ["__s", "__id", "__text", "__words", "row", "place", "s", "whole", "gone_id", "_id", "_spans", "copies"]
    df = spark.createDataFrame([(1, "a b c d", "x", 7, *names), (2, "a b c d", None, 7, *names)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = [minhash.keep_one_of_each(df), line_dedup.dedup_lines_keeping_columns(df), mixing.mixed_documents(df), quality_rules.keep_good(df, labels)]
    assert [x.columns for x in kept] == [df.columns] * 4 and [x.count() for x in kept] == [1, 2, 2, 0]
    assert all(tuple(r)[4:] == tuple(names) for x in kept for r in x.collect())


def test_memos_hold_a_bounded_number_of_bytes():
    made = []
    m = memo.Memo(lambda k: made.append(k) or k * 2, 100_000)
    for k in range(20_000):
        assert m[f"key {k}"] == f"key {k}" * 2 and m["often"] == "often" * 2
    assert len(m) + len(m.old) < 500 and made.count("often") == 1
    assert m["x" * 1000] == "x" * 2000 and "x" * 1000 not in m


def test_mixed_documents_repeats_the_rows_that_mix_takes(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(1, 30)), r.choice("aabbbbc")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {i: x["taken"] // x["size"] for i, x in by_id(mixing.mix(df)).items()}
    assert Counter(x["doc_id"] for x in mixing.mixed_documents(df).collect()) == Counter({i: n for i, n in taken.items() if n})


def test_near_duplicates_of_a_crowd_cut_into_blocks(spark, monkeypatch):
    """Texts just above and just below the similarity, more than a block holds: as by comparing all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SET_BLOCK", 5)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(160)]
    texts = [" ".join(w if rng.random() > 0.018 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(60)]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(157)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), 4, 80).collect()}
    ids = sorted(found)
    assert 1 < len(set(root)) < len(texts)
    assert [found[i] for i in ids] == [ids[r] for r in root]


def test_keep_one_of_each_with_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, go or stay each by its own text, as in near_duplicates."""
    rows = [(1, "one a b c d"), (5, "one a b c d"), (5, "two e f g h"), (None, "one A b c d"), (None, "three i j"), (None, ""), (None, None), (None, "four"), (None, "four"), (7, "")]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    left = Counter((x["doc_id"], x["text"]) for x in minhash.keep_one_of_each(df, 4, 80).collect())
    assert left == Counter(rows) - Counter([(5, "one a b c d"), (None, "one A b c d")])
    assert Counter(i for i, _ in left.elements()) == Counter(x["doc_id"] for x in minhash.near_duplicates(df, 4, 80).collect() if x["kept"])
