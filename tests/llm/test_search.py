"""Ranked search, fill-in-middle and nearest neighbours against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import fim, lexical, vantage

# ------------------------------------------------------------------ ranked search


def brute(docs, items, k=10):
    """The contract word for word: (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(lexical.terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in lexical.terms_of(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "of"]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 20, 62])]) for _ in range(rng.randint(1, 40))) + " the" * rng.randint(0, 9) for _ in range(n)]
    return texts + [texts[0]] * (n // 3)  # a third of all rows are copies


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = "item_id long, text string"


@pytest.mark.parametrize("first_tier, growth", [(2, 3), (5, 16), (1000, 16)])
def test_search_equals_brute_force(spark, docs, first_tier, growth):
    texts = corpus(240)
    items = [(1, "w1 w2 w3 the THE"), (2, "w50 w51 w52 w53"), (3, "the of"), (4, "nothing here"), (5, ""), (6, None), (7, texts[7]), (8, texts[0]), (9, "the")]
    got = found(lexical.search(docs(texts), spark.createDataFrame(items, ITEMS), first_tier=first_tier, growth=growth))
    assert got == brute(list(enumerate(texts)), items)


def test_search_falls_through_tiers_and_reads_no_more(spark, docs):
    """Items that the first tier proves stay there; common words need the lower tiers."""
    texts = [f"the of and {'the ' * (k % 7)} {'rare' + str(k // 3)} {'x ' * k}" for k in range(300)]
    vocabulary = sorted({b"the", b"of", b"rare5"})
    index = lexical.build(docs(texts), vocabulary, first_tier=8, growth=4)
    assert index.tiers > 2 and index.rows.select("code0").schema["code0"].dataType.simpleString() == "array<int>"
    code = {t: i for i, t in enumerate(vocabulary)}
    make = lambda term: lexical.Asked(np.array([0]), np.array([code[term]]), np.array([index.w[code[term]]]), np.array([0]), np.array([index.w[code[term]] * index.residual[0, code[term]]]), np.array([0]))
    assert lexical.prove(index, make(b"rare5")).depth[0] == 0
    assert lexical.prove(index, make(b"of")).depth[0] > 0


def test_search_in_blocks(spark, docs):
    texts = corpus(60, 2)
    items = [(k, f"w{k} w{k + 1} the") for k in range(9)]
    table = spark.createDataFrame(items, ITEMS)
    whole = found(lexical.search(docs(texts), table))
    assert found(lexical.search(docs(texts), table, most_items=4)) == found(lexical.search(docs(texts), table, most_terms=20)) == whole == brute(list(enumerate(texts)), items)


def test_search_on_odd_rows(spark):
    """Nulls, repeated ids and rows, non-ASCII terms, long texts, clashing names, ties by id with nulls last."""
    rows = [(1, "Ä ä b", 1), (1, "Ä ä b", 1), (None, "Ä ä b", 2), (2, None, 3), (3, "", 4), (4, "İ-b ÄB", 5), (5, "x" * 3000 + " b" * 20000, 6), (None, "zz", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    items = [(1, "ä Ä B"), (1, "ä Ä B"), (1, "zz"), (None, "b"), (2, "x" * 3000)]
    got = found(lexical.search(docs, spark.createDataFrame(items, ITEMS)))
    assert got == brute([r[:2] for r in rows], [items[0], *items[2:]])
    none = lexical.search(docs.limit(0), spark.createDataFrame(items, ITEMS))
    assert none.count() == 0 and lexical.search(docs, spark.createDataFrame([], ITEMS)).count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms():
    assert [t.decode() for t in lexical.terms_of("Aa_B-c9\x7fÉÉ \x00z中文。x")] == ["aa", "b", "c9", "ÉÉ", "z中文。x"] and lexical.terms_of(None) == []


# ------------------------------------------------------------------ fill-in-middle


def plain_fim(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units, blank, at = [], " \t\n\x0b\x0c\r", 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in blank:
            end += 1
        while end < len(text) and text[end] not in blank:
            end += 1
        units.append(text[at:end])
        at = end
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_a_plain_version_and_comes_back(spark):
    rng = random.Random(3)
    texts = ["", None, "one", "  ", " a", "a ", "a b c d", "ä\t\nß\x0bz\x0c\r", "<P> x", "a <S>b", "<M", "<<P", "S> < P >", "a" * 50_000, " x" * 50_000]
    texts += ["".join(rng.choice(["a", "é", "中", " ", "\n", "<", "P", ">", "S"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(k if k % 50 else None, t, "clash") for k, t in enumerate(texts)] + [(3, "again and again", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    made = fim.transform(df)
    want = sorted([(i, *plain_fim(i, t)) for i, t, _ in rows], key=str)
    assert sorted([tuple(r) for r in made.collect()], key=str) == want
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    d = fim.digests(made).where("doc_id = 3").first()
    assert d.restored_sha256 == hashlib.sha256((texts[3] if d.n == 1 else "again and again").encode()).hexdigest()
    assert fim.transform(df.limit(0)).count() == 0


def test_fim_parameters(spark, docs):
    made = fim.transform(docs(["a b c d"] * 200), rate=100, spm_rate=0)
    assert {r.form for r in made.collect()} == {"psm"}
    assert {r.form for r in fim.transform(docs(["a b c d"] * 50), rate=0).collect()} == {"plain"}


# ------------------------------------------------------------------ nearest neighbours

VECTORS = "vec_id long, embedding array<float>, rank string"


def neighbours(rows, queries, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, v in ok:
        if queries(q):
            scored = sorted((-float((v * x).sum()), i) for i, x in ok if i != q and len(x) == len(v))
            out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return sorted(out)


def answered(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


@pytest.mark.parametrize("unit", [True, False])
def test_factor_one_is_exact(spark, unit):
    """Whatever the lengths, and with groups of near and exact copies over several shards."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)) * (1 if unit else rng.uniform(0.1, 9, size=(1500, 1)))
    x[:400] = x[0] + rng.normal(size=(400, 8)) * 0.01
    x[400:700] = x[400]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    rows = [(i, [float(c) for c in v], "r") for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vantage.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_floats=150 * 9, block_floats=20 * 9)
    assert answered(got) == neighbours(rows, lambda i: i % 20 == 0)
    s = got.where("query_id = 20 and rank = 1").first()
    assert s.score == pytest.approx(float((x[20].astype(np.float32).astype(float) * x[s.vec_id].astype(np.float32).astype(float)).sum()), abs=1e-12)


def test_recall_of_the_default_factor(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r)[:2] for r in table.collect()]
    want = set(x[::2] for x in neighbours(rows, lambda i: i % 20 == 0))
    got = set(x[::2] for x in answered(vantage.nearest(table, F.col("vec_id") % 20 == 0, shard_floats=100 * 65)))
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)


def test_a_greater_factor_visits_less():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 4)) * 0.1 + c for c in rng.normal(size=(6, 4)) * 3])
    length = float(np.linalg.norm(x, axis=1).max())
    tree = vantage.Tree(vantage.lifted(x, length), 32)
    q = vantage.as_queries(x[::50])
    least, d = tree.least(tree.seen(q)), vantage.distances(q, vantage.lifted(x, length))
    for k, rows in enumerate(tree.leaves):
        assert (least[:, k] <= d[:, rows].min(1) + 1e-9).all()
    kth = np.sort(d, axis=1)[:, 20]
    assert (4 * least <= kth[:, None]).sum() < 0.5 * (least <= kth[:, None]).sum() < 0.5 * least.size


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, None, "a"), (2, [0.0, 0.0], "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [None, 1.0], "a"), (6, [], "a"), (7, [1.0, 2.0], "a"), (7, [1.0, 2.0], "a"), (8, [2.0, -1.0], "a"), (None, [1.0, 1.0], "a"), (20, [1.0, 0.0, 0.0], "a"), (40, [-0.0, 1.0], "a"), (60, [0.0, 1.0], "a")]
    df = spark.createDataFrame(rows, VECTORS)
    got = answered(vantage.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0))
    # Repeated rows are a candidate each; equal scores go by id; the vector of another length has no candidate.
    assert got == sorted([(0, 1, 8), (0, 2, 7), (0, 3, 7), (0, 4, 40), (0, 5, 60), (40, 1, 7), (40, 2, 7), (40, 3, 60), (40, 4, 0), (40, 5, 8), (60, 1, 7), (60, 2, 7), (60, 3, 40), (60, 4, 0), (60, 5, 8)])
    assert vantage.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vantage.nearest(df, F.lit(False)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], "a")], VECTORS)
    assert vantage.nearest(alone, F.lit(True)).count() == 0
