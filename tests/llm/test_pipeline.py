import base64
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import tiktoken
from test_operators import RANKS, brute_lines, brute_near, brute_quality

import corpus_pipeline
from thicket.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def lines_left(rows):
    """Texts by id without later copies of three lines; ids ascend."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        own, windows = brute_lines(t)
        gone = set()
        for a, b in sorted(windows):
            gone |= set(range(a, b)) if tuple(own[a:b]) in seen else set()
            seen.add(tuple(own[a:b]))
        k, kept = -1, []
        for line in t.split("\n"):
            k += bool(line.strip(" \t\x0b\x0c\r"))
            kept += [line] if k not in gone else []
        out[i] = "\n".join(kept)
    return out


def copies_taken(rows, source):
    """How often each document is taken: sources filled in order of hashed ids, the last one if it brings the sum nearer."""
    size = {i: len(t.split()) for i, t in rows.items()}
    total = defaultdict(int)
    for i in rows:
        total[source[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, rest = {}, float(sum(total.values()))
    while True:
        level = rest / sum(weight[s] for s in order if s not in target)
        over = [s for s in order if s not in target and level * weight[s] > 3 * total[s]]
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        rest -= sum(target[s] for s in over)
    target |= {s: level * weight[s] for s in order if s not in target}
    taken = {}
    for s in order:
        whole = min(3, int(target[s] // total[s]))
        budget = target[s] - whole * total[s] if whole < 3 else 0.0
        used = 0
        for i in sorted((i for i in rows if source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:9]):
            fits = used + size[i] <= budget or used < budget and used + size[i] - budget < budget - used
            taken[i] = whole + (used <= budget and fits)
            used += size[i] if taken[i] > whole else 10**9
    return taken


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(21)
    line = lambda: " ".join(f"w{r.randint(0, 250)}" for _ in range(r.randint(4, 9)))
    texts = ["\n".join(line() for _ in range(r.randint(6, 30))) for _ in range(90)]
    shared = [line() for _ in range(5)]
    for k in range(0, 90, 6):  # passages that many share, near and exact copies, and what the rules reject
        texts[k] = "\n".join([*texts[k].split("\n")[:9], *shared, *texts[k].split("\n")[9:]])
    # in one line, so that no window of lines takes them away
    texts += [" ".join("edit" if r.random() < 0.008 else w for w in texts[k].split()) for k in range(1, 40, 2)]
    texts += [texts[2], texts[3], "too short", "", None, "a b c " * 60]
    source = {i: r.choice(["a", "b", "b", "b", None]) for i in range(len(texts))}
    good = {i for i in range(90) if i % 2}
    spark.createDataFrame([(i, t, "en", source[i], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    rows = {i: texts[i] for i, (*_, kept) in enumerate(brute_quality(texts, good)) if kept}
    assert 60 < len(rows) < len(texts) - 4
    rows = lines_left(rows)
    assert any(rows[i] != texts[i] for i in rows)
    ids = sorted(rows)
    root = brute_near([rows[i] for i in ids], 5, 80)[1]
    rows = {i: rows[i] for k, i in enumerate(ids) if root[k] == k}
    assert len(rows) < len(ids) - 5
    taken = copies_taken(rows, source)
    assert len(set(taken.values())) > 1
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    want = Counter()
    for i, n in taken.items():
        tokens = library.encode_ordinary(rows[i])
        if n:
            want[i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest()] = n
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_stages(spark):
    read = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == read.columns
        docs = corpus_pipeline.written(out)
        assert 0 < docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count()


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(sql).df()
        norm = lambda d: sorted(repr([None if v != v else v for v in r]) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
        plain = lambda d: norm(d.assign(**{c: d[c].astype("float64") for c in d.columns if d[c].dtype.kind in "iuf"}))
        assert plain(a) == plain(b), name
