"""Operators over documents against brute force on small tables, with nulls, empty, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievelake.llm import bpe, components, packing, quality_model, quality_rules, simhash, span_dedup

ODD = [None, "", " ", "\n\n", "one", "One two", "a b c d e f", "a b c d e f", "  lead  double \n\n x\t y\x1c z  ", "it's  I'LL\n  foo ", "a b　c ½² İstanbul ΣΑΣ 日本 😀", "w " * 30_000, "<|endoftext|> </w> 12'S"]


def least(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (7, 8), (7, 8)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = least(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_links_all_within_three_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 3, 4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    pairs = [(a, b) for a in set(signed) for b in set(signed) if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= 3 for r in got)
    assert least([(r.u, r.v) for r in got], set(signed)) == least(pairs, set(signed))


def test_simhash_documents(spark, docs, sample):
    texts = [r.text for r in sample.limit(60).collect()] + ODD
    df = docs(texts).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(df.drop("fp", "component_id")).collect()
    slow = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        import xxhash

        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        slow[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert {r.doc_id: r.fp & ((1 << 64) - 1) for r in got} == slow
    pairs = [(a, b) for a in slow for b in slow if a < b and (slow[a] ^ slow[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in got} == least(pairs, slow)
    kept = simhash.first_of_each_group(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least(pairs, slow).values()))
    assert simhash.near_duplicates(docs([])).count() == 0
    twice = docs(["a b c d"] * 3, [4, 4, 9])
    assert [r.doc_id for r in simhash.first_of_each_group(twice).collect()] == [4]


def test_first_of_each_group_with_null_and_repeated_ids(docs):
    rows = [(None, "only this text has no id"), (None, "another one without"), (4, "one text of the four"), (4, "quite other words here"), (9, "quite other words here"), (None, "one text of the four"), (7, None), (None, "")]
    got = simhash.first_of_each_group(docs([t for _, t in rows], [i for i, _ in rows])).collect()
    want = {(None, "only this text has no id"), (None, "another one without"), (4, "one text of the four"), (4, "quite other words here"), (7, None)}
    assert len(got) == len(want) and {(r.doc_id, r.text) for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1.3)) + 1) for _ in range(5000))
    rows = packing.plan(dict(counts))
    bins: dict[int, list] = {}
    placed = Counter()
    for s, _, n, first, per, offset in rows:
        placed[s] += n
        for k in range(n):
            bins.setdefault(first + k // per, []).append((offset + k % per * s, s))
    assert placed == counts
    for b in bins.values():
        at = 0
        for offset, s in sorted(b):
            assert offset == at
            at += s
        assert at <= 4096
        assert sum(3 * s > 4096 for _, s in b) <= 2
    assert len(bins) <= 1.02 * sum(s * c for s, c in counts.items()) / 4096 + 2
    assert packing.plan({}) == [] and packing.plan({4096: 3})[0][2] == 3


def test_packing_documents(docs, sample):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text for r in sample.limit(40).collect()] + ODD
    df = docs(texts + ["a"], [*range(len(texts)), 0]).withColumn("length", F.lit("x")).withColumn("piece", F.lit(2))
    got = packing.pack_documents(df).collect()
    assert len([r for r in got if r.doc_id == 0]) >= 2
    for i, t in enumerate(texts[1:], 1):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert [r.start for r in mine] == list(range(0, len(ids), 4096))
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        assert [o for o, _ in sorted(b)] == list(np.cumsum([0] + [n for _, n in sorted(b)])[:-1])
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.packed_digests(docs(texts)).collect()}
    assert all(crc[r.doc_id, r.piece] == zlib.crc32(r.ids) for r in got if r.doc_id)
    assert packing.packed_digests(docs([])).count() == 0
    plain = packing.tokenize_pieces(docs(["<|endoftext|>"]), special_as_text=True).first()
    tok.encode_special_tokens = True
    assert np.frombuffer(plain.ids, "<u4").tolist() == [*tok.encode("<|endoftext|>", add_special_tokens=False).ids, 1]
    assert np.frombuffer(packing.tokenize_pieces(docs(["<|endoftext|>"])).first().ids, "<u4").tolist() == [49407, 1]


def test_pack_with_clashing_columns_and_null_ids(docs):
    df = packing.tokenize_pieces(docs(["one two", "three", None, None], [1, None, None, 4])).select("*", *[F.lit(9).alias(c) for c in ("_salt", "_nth", "_rank", "_n", "_before", "sequence_id")])
    got = packing.pack(df).collect()
    assert len(got) == 4 and all(r._salt == r._nth == r._rank == 9 for r in got)
    assert {(r.sequence_id, r.offset) for r in got} == {(0, 0), (0, 3), (0, 5), (0, 6)}


def test_kept_words_stay_within_their_bytes():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.most = encoder.parts.most = 20_000
    whole = " ".join(f"w{k} x{k * 7}y" for k in range(3000))
    assert np.frombuffer(encoder.encode(whole), "<u4").tolist() == encoder.tok.encode(whole, add_special_tokens=False).ids
    assert len(encoder) < 100 and len(encoder.parts) < 100


def test_words_asked_for_again_are_not_made_again(monkeypatch):
    """When the store is full, words still in use come back from its old half."""
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.most = 20_000
    made, make = Counter(), packing.WordEncoder.made
    monkeypatch.setattr(packing.WordEncoder, "made", lambda self, w: made.update([w]) or make(self, w))
    text = " ".join(f"often rare{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}." for k in range(600))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tok.encode(text, add_special_tokens=False).ids
    assert made["often"] == 1 and len(encoder) + len(encoder.old) < 100


def test_a_hundred_thousand_words_are_made_once_and_in_one_case(monkeypatch):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    made, make = Counter(), packing.WordEncoder.made
    monkeypatch.setattr(packing.WordEncoder, "made", lambda self, w: made.update([w]) or make(self, w))
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(100_000)]
    for x in (words, words, [w.capitalize() for w in words]):
        encoder.encode(" ".join(x))
    assert len(made) == sum(made.values()) == 100_000
    for text in ("ÉCOLE École GROẞ ÀÖß µ ÿŸ", "É Œuvre ŒUVRE", "İÉ ΣΑΣ É", "\xa0A\x85B\x1cC ÷×Þ"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tok.encode(text, add_special_tokens=False).ids


def counts_of(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_rules(docs, sample):
    texts = [r.text for r in sample.limit(80).collect()] + ODD + ["x y z v w\nx y z v w\n\nx", "a#b | <c>"]
    df = docs(texts).withColumn("_votes", F.lit("?")).withColumn("n_words", F.lit(-1))
    for r in quality_rules.rule_report(df).collect():
        n = counts_of(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.rule_report(df).where("kept").collect()}
    assert quality_rules.rule_report(docs([])).count() == 0 and quality_rules.keep_good(docs([])).count() == 0
    plan = kept._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_em_finds_the_accuracies():
    rng = random.Random(1)
    patterns, n = Counter(), 20_000
    rates = [(0.97, 0.5), (0.9, 0.3), (0.6, 0.4)]
    for _ in range(n):
        good = rng.random() < 0.8
        patterns["".join("0" if rng.random() < 0.2 else "+" if rng.random() < (a if good else 1 - b) else "-" for a, b in rates)] += 1
    _, weights = quality_rules.fit(patterns)
    assert [yes - no for yes, no in weights] == sorted([yes - no for yes, no in weights], reverse=True)
    assert all(yes > 0 > no for yes, no in weights[:2]) and abs(weights[2][0]) < 0.3


def test_rules_beat_all_must_pass(spark):
    at = "/root/testdata/sf0.01"
    rows = quality_rules.rule_report(spark.read.parquet(f"{at}/documents.parquet")).where("not base_failed").collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in rows if r.doc_id in truth]
    right = np.mean([r.kept == truth[r.doc_id] for r in rows])
    assert right > np.mean([("-" not in r.votes) == truth[r.doc_id] for r in rows]) and right > 0.98
    assert any(r.kept and "-" in r.votes for r in rows)
    model = quality_rules.fit(Counter(r.votes for r in rows))
    assert quality_rules._p_good("-++++++++", *model) > 0.5 > quality_rules._p_good("+--++++++", *model)


def test_quality_rules_equal_their_sql(spark):
    at = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}'")
    want = con.sql(quality_rules.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.rule_report(spark.read.parquet(at)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    for c in got.columns:
        assert (got[c].values == want[c].values).all(), c


def test_quality_model(spark, sample, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_model.train(full, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_model.score(full, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in unseen]) > 0.95
    odd = quality_model.score(docs(ODD).withColumn("score", F.lit(1)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    kept = quality_model.keep_predicted(full, model)
    assert kept.schema == full.schema and kept.count() == sum(r.predicted for r in rows)
    none = quality_model.train(full, labels.limit(0))
    assert {r.predicted for r in quality_model.score(docs(ODD), none).collect()} == {1}
    assert quality_model.score(docs([]), model).count() == 0


def test_span_dedup(docs, sample):
    passage = " ".join(f"P{k} speaks of things and more things." for k in range(9))
    texts = [r.text for r in sample.limit(60).collect()] + ODD + ["Start here. " + passage + " End of it.", "Another opening line.\n" + passage + "\nAnd a close.", passage, "no repeat at all. " * 2, "half " * 40 + ". " + passage]
    df = docs(texts).withColumns({c: F.lit(1) for c in ("_positions", "h", "_id", "digest", "_digest", "pos", "a.b")})
    rows = span_dedup.dedup_spans(df)
    assert rows.columns == df.columns
    got = {r.doc_id: r for r in rows.collect()}
    seen, gone = set(), {i: set() for i in range(len(texts))}
    for i, t in enumerate(texts):
        for k, n, h in span_dedup.runs(t):
            if h in seen:
                gone[i].update(range(k, k + n))
            seen.add(h)
    for i, t in enumerate(texts):
        assert got[i].text == (span_dedup.without(t, gone[i]) if gone[i] else t)
        assert got[i].n_chars == len(got[i].text or "")
    first = texts.index("Start here. " + passage + " End of it.")
    assert got[first].text == texts[first]
    assert got[first + 1].text == "Another opening line.\nAnd a close."
    assert got[first + 2].text == ""
    assert span_dedup.dedup_spans(docs([])).count() == 0


def test_span_dedup_with_null_and_repeated_ids(docs):
    rng = random.Random(5)
    passages = [" ".join(f"q{rng.getrandbits(30)}" + ("." if k % 9 == 8 else "") for k in range(45)) for _ in range(4)]
    p, q, r, s = passages
    rows = [(1, p), (2, p), (2, "Other words here. " + q), (2, None), (None, q), (None, r), (None, r), (5, ""), (6, r), (7, s + " " + s), (7, s + " " + s), (8, s)]
    got = span_dedup.dedup_spans(docs([t for _, t in rows], [i for i, _ in rows])).collect()
    left = Counter((x.doc_id, x.text) for x in got)
    assert left == Counter([(1, p), (2, ""), (2, "Other words here. " + q), (2, None), (None, ""), (None, ""), (None, ""), (5, ""), (6, r), (7, s), (7, s), (8, "")])
    assert all(x.n_chars == len(x.text or "") for x in got)


def test_span_dedup_finds_51_words_at_all_offsets(docs):
    rng = random.Random(8)
    word = lambda: f"x{rng.getrandbits(40)}"
    texts = []
    for stops in (0, 0.08, 0.2):
        passage = [word() + ("." if rng.random() < stops else "") for _ in range(51)]
        for lead in range(26):
            before = [word() for _ in range(lead)]
            after = [word() + ("." if rng.random() < 0.2 else "") for _ in range(rng.randint(0, 20))]
            texts.append("Of its own. " + " ".join(before + passage + after))
    seen = set()
    got = {r.doc_id: r.text for r in span_dedup.dedup_spans(docs(texts)).collect()}
    for i in range(len(texts)):
        words = got[i].split()
        mine = {tuple(words[k : k + 51]) for k in range(len(words) - 50)}
        assert not mine & seen
        seen |= mine


def test_units_cover_all_words():
    for t in [x for x in ODD if x]:
        found = span_dedup.units(t)
        assert " ".join(u[3] for u in found).split() == t.split()
        assert all(t[s:e].split() == c.split() for s, e, _, c in found)


@pytest.mark.parametrize("hot", [300_000, 5])
def test_bpe_blobs(hot):
    rng = random.Random(hot)
    numbers = [rng.choice([0, 159, 160, 223, 224, 16543, 16544, 65535, 65536, 600_000, (1 << 21) - 2, bpe._HOLE, rng.randrange(1 << 20)]) for _ in range(300)]
    words = ["é" * k for k in range(sum(n == bpe._HOLE for n in numbers))]
    got, names = bpe._unpack(bpe._pack(np.array(numbers, np.uint32).tobytes(), words))
    assert got.tolist() == numbers and names == words
    assert bpe._unpack(bpe._pack(b"", []))[0].tolist() == []


@pytest.mark.parametrize("hot", [300_000, 5])
def test_bpe(docs, sample, hot):
    texts = [r.text for r in sample.limit(40).collect()] + ODD
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = [enc.encode_ordinary(t or "") for t in texts]
    some = bpe.encode(docs(["rare wørds", "other wörds", "rare wørds", None], [None, None, None, None]), hot=hot).collect()
    assert sorted(bytes(r.ids) for r in some) == sorted(np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in ("rare wørds", "other wörds", "rare wørds", ""))
    df = docs(texts + texts[:3], [*range(len(texts)), 0, 1, 2]).withColumn("ids", F.lit(1)).withColumn("word", F.lit("w"))
    got = bpe.encode(df, hot=hot)
    rows = got.collect()
    assert len(rows) == len(texts) + 3
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] for r in rows)
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in bpe.decode(got).collect())
    r = next(r for r in bpe.encode(docs(texts), hot=hot, digest=True).collect() if r.doc_id == 0)
    assert (r.n_tokens, r.decoded_sha256) == (len(want[0]), hashlib.sha256((texts[0] or "").encode()).hexdigest())
    assert bpe.encode(docs([])).count() == 0
