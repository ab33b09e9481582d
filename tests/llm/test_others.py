"""Licences, images, pages, conversations and the pipeline."""

import html
import itertools
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sievelake.llm import chat, html_main, images, licenses
from sievelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_notice_finds_itself(spark):
    rows = [(f"d/{k}", t.upper()) for k, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    ids = [s for s, ts in licenses.TEMPLATES.items() for _ in ts]
    got = {r.path: (r.spdx, r.similarity) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[p] for p, _ in rows] == [(i, 1.0) for i in ids]


def test_scan_equals_brute_force(spark):
    """Every unit is compared here, with or without a required term."""
    idf, other, vectors = licenses.weights()
    rng = random.Random(7)
    words = [t for ts in licenses.TEMPLATES.values() for t in ts[0].split()] + ["the", "of", "license", "free", "words", "Foo"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["Released under the MIT License.\nwords", "x\nLicensed under the Apache License, Version 2.0, see the file", "license to sail the seven seas", "All rights reserved", None, "", "GNU General Public\nLicense, version 3 or later"]
    texts += ["# Copyright 2020 Foo\n# " + licenses._MIT.replace("to ", "to\n# ") + "\n\nimport x\n", "a\n\nb\n", *made, *["words\n\n" + x[: len(x) * 3 // 4] + "\n\nmore" for ts in licenses.TEMPLATES.values() for x in ts[-2:]], "\n".join(made[:20])]

    def best(path, t):
        text = (t or "").lower()
        lines = text.split("\n")
        some = {(" ".join(lines[i : i + k]), False) for i in range(len(lines)) for k in (1, 2, 3)}
        some |= {(x, True) for x in re.split(r"\n\s*\n", text)} | ({(text, True)} if "LICENSE" in path else set())
        found = []
        for unit, block in some:
            terms = licenses._terms(unit)
            v = {x: (1 + math.log(terms.count(x))) * idf.get(x, other) for x in set(terms)}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            found += [(-round(sum(v[x] * w for x, w in u.items() if x in v) / norm, 6), s) for s, u in vectors if block or len(u) <= licenses._SHORT]
        return min([x for x in found if -x[0] >= licenses.THRESHOLD], default=None)

    rows = [(f"p{k}" + "/LICENSE" * (k % 3 == 0), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("?") for c in ("lines", "content", "term", "block")})
    scanned = licenses.scan(df)
    got = {r.path: (-r.similarity, r.spdx) for r in scanned.collect()}
    want = {p: best(p, t) for p, t in rows if best(p, t)}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[p][1] == want[p][1] and abs(got[p][0] - want[p][0]) < 2e-6 for p in want)
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", QUERIES["op2_license_scan"](spark, SF)._jdf.queryExecution().toString())


def test_license_scan_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(licenses.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op2_license_scan"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and (got.license.notna().sum() > 3)
    for c in got.columns:
        assert (got[c].fillna(0).values == want[c].fillna(0).values).all(), c


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("a/LICENSE", mit), ("a/b/x.py", "code"), ("a/b/c/COPYING.txt", gpl), ("a/b/c/d/y.py", None), ("a/b/c/z.py", mit), ("q/w.py", ""), ("top.py", "x"), (None, mit)]
    got = {r.path: (r.license, r.origin, r.from_path) for r in licenses.scan_tree(spark.createDataFrame(files, "path string, text string").withColumn("dir", F.lit("?"))).collect()}
    assert got["a/b/x.py"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/c/d/y.py"] == ("GPL-3.0", "inherited", "a/b/c/COPYING.txt")
    assert got["a/b/c/z.py"] == ("MIT", "own", "a/b/c/z.py")
    assert got["q/w.py"][1] == got["top.py"][1] == "none" and len(got) == len(files)
    assert licenses.scan_tree(spark.createDataFrame([], "path string, text string")).count() == 0


def test_image_copies(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(30)
    drawn = [(r.image_id, bytes(r.image)) for r in images.render(vectors).collect()]
    rng = np.random.default_rng(1)
    rows = list(drawn)
    for k, (i, data) in enumerate(drawn[:8]):
        x = images.read_png(data)
        rows += [(1000 + i, images.png(x[7:, 9:])), (2000 + i, images.png(np.clip(1.1 * x + 4 + rng.normal(0, 2, x.shape), 0, 255))), (3000 + i, images.png(np.rot90(x))), (4000 + i, data)]
    rows += [(9001, None), (9002, b"junk"), (9003, images.png(np.zeros((40, 40))))]
    got = {r.image_id: r.component_id for r in images.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert len(got) == len(rows)
    for i, _ in drawn[:8]:
        assert all(got[b + i] == got[i] for b in (1000, 2000, 3000, 4000))
    assert len({got[i] for i, _ in drawn}) == len(drawn)
    assert [got[i] for i in (9001, 9002, 9003)] == [9001, 9002, 9003]
    assert images.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def _turned(x, degrees):
    """The picture turned about its middle, between pixels, its edges repeated."""
    h, w = x.shape
    t = np.deg2rad(degrees)
    dy, dx = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    at_x = np.clip(np.cos(t) * dx + np.sin(t) * dy + (w - 1) / 2, 0, w - 1.001)
    at_y = np.clip(np.cos(t) * dy - np.sin(t) * dx + (h - 1) / 2, 0, h - 1.001)
    x0, y0 = at_x.astype(int), at_y.astype(int)
    fx, fy = at_x - x0, at_y - y0
    return (1 - fy) * ((1 - fx) * x[y0, x0] + fx * x[y0, x0 + 1]) + fy * ((1 - fx) * x[y0 + 1, x0] + fx * x[y0 + 1, x0 + 1])


def test_image_recall_for_each_edit(spark):
    """300 pictures, each edited in one of several ways: at least 0.9 of each kind are found, and no two different pictures are linked."""
    rng = np.random.default_rng(4)
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(300)
    drawn = {r.image_id: images.read_png(bytes(r.image)) for r in images.render(vectors).collect()}
    edits = {
        "crop": lambda x: x[9:, 7:], "crop to the half": lambda x: x[:54, 10:64], "noise": lambda x: 1.1 * x + 4 + rng.normal(0, 4, x.shape), "quarter turn": np.rot90,
        "turn": lambda x: _turned(x, 15), "0.9": lambda x: images._shrunk(x, 1 / 0.9), "0.85": lambda x: images._shrunk(x, 1 / 0.85), "0.8": lambda x: images._shrunk(x, 1.25),
    }
    rows, kinds = [], {}
    for (i, x), kind in zip(sorted(drawn.items()), list(edits) * 40):
        rows += [(i, images.png(x)), (10_000 + i, images.png(np.clip(np.rint(edits[kind](x)), 0, 255)))]
        kinds[i] = kind
    got = {r.image_id: r.component_id for r in images.copies(spark.createDataFrame(rows, "image_id long, image binary").withColumn("digest", F.lit(1))).collect()}
    for kind in edits:
        assert np.mean([got[i] == got[10_000 + i] for i, k in kinds.items() if k == kind]) >= 0.9, kind
    plain = {r.image_id: r.component_id for r in images.copies(spark.createDataFrame(rows[::2], "image_id long, image binary")).collect()}
    apart = sum(a == b for a, b in plain.items())
    assert len(set(got.values())) >= 0.97 * apart


def test_crops_of_large_pictures():
    rng = np.random.default_rng(9)
    x = images._box(rng.standard_normal((400, 500)), 2)
    x = np.clip(128 + 45 * x / x.std(), 0, 255).round()
    whole = images.describe(x)
    for part in (x[60:190, 300:460], x[100:300, 50:250], images._shrunk(images._box(x, 1) / 9, 2.0), np.rot90(x[60:190, 300:460])):
        some = images.describe(np.rint(part))
        assert images.linked(*(v.tobytes() for v in (some[1], some[0], whole[1], whole[0])))
    other = images.describe(images._box(rng.standard_normal((200, 200)), 2) * 100)
    assert not images.linked(*(v.tobytes() for v in (other[1], other[0], whole[1], whole[0])))


def test_png_filters_and_odd_files():
    rng = np.random.default_rng(2)
    for channels, colour in ((1, 0), (3, 2), (4, 6)):
        px = rng.integers(0, 256, (11, 7, channels)).astype(int)
        raw = b""
        for y in range(11):
            kind = y % 5
            raw += bytes([kind])
            for x in range(7):
                for c in range(channels):
                    a, b, d = (px[y, x - 1, c] if x else 0), (px[y - 1, x, c] if y else 0), (px[y - 1, x - 1, c] if x and y else 0)
                    q = int(a + b - d)
                    near = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - d), 2, d))[2]
                    raw += bytes([int(px[y, x, c] - [0, a, b, (a + b) // 2, near][kind]) % 256])
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
        head = struct.pack(">IIBBBBB", 7, 11, 8, colour, 0, 0, 0)
        file = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        want = px[..., 0] if channels == 1 else px[..., :3] @ (0.299, 0.587, 0.114)
        assert np.allclose(images.read_png(file), want)
        assert images.read_png(file[:60]) is None
    huge = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2**31 - 1, 2**31 - 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(10**6)))
    assert images.read_png(huge) is None


def test_image_meetings_are_all_pairs(spark):
    rng = random.Random(6)
    rows = [(a, k, rng.choice([1, 1, 1, rng.randrange(2, 9)])) for a in range(60) for k in range(3)]
    group = lambda a: a if a % 7 else 0
    want = sorted((a, b, k, q) for a, k, x in rows for b, q, y in rows if x == y and a < b and group(a) != group(b))
    for block in (7, 1000):
        shared = images.shared_entries(spark.createDataFrame(rows, "a long, k int, key long"), block)
        classed = shared.withColumn("c", F.when(F.col("a") % 7 == 0, 0).otherwise(F.col("a")))
        got = images.meetings(classed).collect()
        assert sorted((r.u, r.v, r.ku, r.kv) for r in got) == want
        first = images.first_meetings(shared).collect()
        every = {(a, b, k, q) for a, k, x in rows for b, q, y in rows if x == y and a < b}
        assert {tuple(r) for r in first} <= every and len(first) <= 4 * len(rows)


def test_image_pairs_in_rounds(spark, monkeypatch):
    """Meetings are counted and corners sent in rounds, which together give every pair, none twice."""
    rng = np.random.default_rng(8)
    rows = [(a, k, rng.integers(1, 9).item()) for a in range(30) for k in range(3)]
    groups = images.block_pairs(images.shared_entries(spark.createDataFrame(rows, "a long, k int, key long"), 7).withColumn("c", F.col("a")))
    whole = sorted(map(tuple, images.part_of_meetings(groups, 0, 1).collect()))
    assert whole and sorted(tuple(r) for k in range(4) for r in images.part_of_meetings(groups, k, 4).collect()) == whole

    x = [images._box(rng.standard_normal((60, 60)), 2) for _ in range(6)]
    seen = [images.describe(np.clip(128 + 60 * y / y.std(), 0, 255)) for y in x for y in (y, y[3:, 2:])]
    classes = spark.createDataFrame([(a, bytearray(d.tobytes()), bytearray(p.tobytes())) for a, (p, d) in enumerate(seen)], "a long, bits binary, places binary").cache()
    every = [(u, v) for v in range(len(seen)) for u in range(v)]
    sent, links = [], images._links

    def counted(pairs, us, vs):
        sent.append(pairs.count())
        return links(pairs, us, vs)

    monkeypatch.setattr(images, "_links", counted)
    monkeypatch.setattr(images, "ROUND_BYTES", 1)
    got = images._verified(spark.createDataFrame(every, "u long, v long"), classes).collect()
    assert sorted(map(tuple, got)) == [(u, v) for u, v in sorted(every) if images.linked(*(z.tobytes() for w in (u, v) for z in (seen[w][1], seen[w][0])))]
    assert len(got) >= 6 and len(sent) >= 4 and sum(sent) == len(every) and max(sent) <= 3 * len(seen)


def test_images_described_and_verified_together(spark, monkeypatch):
    """Stacks of one size give what single images give, pairs verified together what consensus() says of each, and tables of meetings don't stay on disk."""
    rng = np.random.default_rng(4)
    smooth = lambda h, w: np.rint(np.clip(128 + 60 * (x := images._box(rng.standard_normal((h, w)), 2)) / x.std(), 0, 255))
    made = [smooth(60, 60) for _ in range(7)] + [None, np.zeros((40, 40)), smooth(50, 70), smooth(3, 5), smooth(200, 150)]
    made += [made[0][3:, 2:], np.rot90(made[1]), made[2], made[11][20:150, 10:130]]
    monkeypatch.setattr(images, "STACK_PIXELS", 11_000)
    seen = images.describe_each(made)
    for x, (places, bits) in zip(made, seen):
        want = images.describe(x) if x is not None else (np.zeros((0, 4)), np.zeros((0, 30)))
        assert np.array_equal(places, want[0]) and np.array_equal(bits, want[1])
    full = [images._corners(d.tobytes(), p.tobytes()) for p, d in seen]
    pairs, want = [(u, v) for u in range(len(made)) for v in range(u + 1, len(made)) if len(seen[u][0]) and len(seen[v][0])], []
    for u, v in pairs:
        distance = np.unpackbits(seen[u][1][:, None] ^ seen[v][1], axis=2).sum(2)
        ours = np.flatnonzero(distance.min(1) <= images.MATCH_BITS)
        want.append(len(ours) >= images.INLIERS and images.consensus(full[u][1][ours], full[v][1][distance.argmin(1)[ours]]) >= images.INLIERS)
    assert images.linked_each([(full[u], full[v]) for u, v in pairs]) == want and 4 <= sum(want) < len(want)

    kept, drop = [], images.materialize
    monkeypatch.setattr(images, "materialize", lambda df, name: kept.append((name, drop(df, name))) or kept[-1][1])
    images.copies(spark.createDataFrame([(i, images.png(x)) for i, x in enumerate(made) if x is not None], "image_id long, image binary")).collect()
    there = [name for name, df in kept for at in df.inputFiles()[:1] if os.path.exists(at.removeprefix("file:").replace("///", "/"))]
    assert "image-links" in there and not {"corners", "members", "block-pairs"} & set(there)


def test_image_pairs_are_verified_part_by_part(spark, monkeypatch):
    """Pairs that meet grow with the square of the table, so those of one part are on disk at a time; here stars and chains find nothing, and all parts together find every copy."""
    rng = np.random.default_rng(12)
    x = images._box(rng.standard_normal((70, 70)), 2)
    x = np.rint(np.clip(128 + 60 * x / x.std(), 0, 255))
    rows = spark.createDataFrame([(i, images.png(x[i % 4 :, i // 4 :])) for i in range(12)], "image_id long, image binary").cache()
    kept, there, sent, make, links = [], [], [], images.materialize, images._links

    def counted(df, name):
        out = make(df, name)
        kept.extend([out.inputFiles()[0].removeprefix("file:").replace("///", "/")] if name == "image-pairs" else [])
        there.append(sum(os.path.exists(at) for at in kept))
        return out

    def after_first(pairs, us, vs):
        sent.append(pairs.count())
        return links(pairs, us, vs).where(F.lit(len(sent) > 1))

    monkeypatch.setattr(images, "materialize", counted)
    monkeypatch.setattr(images, "_links", after_first)
    monkeypatch.setattr(images, "ROUND_MEETINGS", 1)
    assert sorted(tuple(r) for r in images.copies(rows).select("image_id", "component_id").collect()) == [(i, 0) for i in range(12)]
    assert len(kept) >= 4 and len(kept) == len(sent) and sum(sent[1:]) <= 66
    assert max(there) == 1 and not any(os.path.exists(at) for at in kept)


def test_image_links_equal_brute_force(spark):
    """A large group of edited copies, and a hot entry: the same mark in pictures that are no copies."""
    rng = np.random.default_rng(3)
    smooth = lambda: np.clip(128 + 60 * (x := images._box(rng.standard_normal((72, 72)), 2)) / x.std(), 0, 255)
    base, mark = smooth(), rng.integers(0, 255, (26, 26))
    made = [np.clip(base + rng.normal(0, 1.5, base.shape), 0, 255) for _ in range(25)]
    for _ in range(20):
        x = smooth()
        x[20:46, 20:46] = mark
        made += [x, np.clip(x[3:, 2:] * 0.98 + 2, 0, 255)]
    made = [made[k] for k in rng.permutation(len(made))]
    seen = [images.describe(images.read_png(images.png(x))) for x in made]
    width = images.BITS // 8 // images.TABLES
    tables = [{(t, k, bytes(d[k, width * t : width * t + width])) for t in range(images.TABLES) for k in range(len(d))} for _, d in seen]
    links = []
    for u, v in ((u, v) for u in range(len(made)) for v in range(u)):
        u, v = v, u
        at = {}
        for t, k, x in tables[v]:
            at.setdefault((t, x), []).append(k)
        hits = {(k, q) for t, k, x in tables[u] for q in at.get((t, x), [])}
        if len(hits) >= images.MEETINGS and images.linked(*(x.tobytes() for w in (u, v) for x in (seen[w][1], seen[w][0]))):
            links.append((u, v))
    reach = list(range(len(made)))
    for _ in made:
        for u, v in links:
            reach[u] = reach[v] = min(reach[u], reach[v])
    want = [(i, reach[i]) for i in range(len(made))]
    rows = spark.createDataFrame([(i, images.png(x)) for i, x in enumerate(made)], "image_id long, image binary")
    got = images.copies(rows).select("image_id", "component_id").collect()
    assert len(links) >= 300 and max(Counter(reach).values()) >= 25
    assert sorted(map(tuple, got)) == want


def test_main_text_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_main.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|br|h1)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_main_text_of_other_layouts(spark):
    weights = html_main.default_weights()
    body = "<h2>Title</h2><p>" + "good words here " * 9 + "&amp; more</p><div class='ad'>buy now</div><p>a <i>b</i>c\n d&nbsp;e</p>"
    page = f"<html><body><nav><a href=/>Home</a></nav><div class='content'>{body}</div><form>your mail</form><section class='comments'><p>first!</p></section><footer>legal</footer></body></html>"
    assert html_main.main_text(page, weights) == "Title " + "good words here " * 9 + "& more a bc d e"
    for odd in (None, "", "<", "<<p", "<p", "text only", "<script>x", "<!-- x", "&lt;p&gt;", "</p></p>", "</a></b>" * 50):
        html_main.main_text(odd, weights)
    assert html_main.main_text("text only", weights) == "text only"
    fitted = [set(html_main.main_text(p, weights).split()) for p, _ in html_main.labelled_pages(60, seed=99)]
    wanted = [mine for _, mine in html_main.labelled_pages(60, seed=99)]
    hit = sum(len(a & b) for a, b in zip(fitted, wanted))
    assert hit / sum(map(len, wanted)) > 0.95 and hit / sum(map(len, fitted)) > 0.95
    frame = spark.createDataFrame([(1, None, None), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [(r.text, r.n_chars) for r in html_main.extract(frame).collect()] == [("", 0), ("", 0)]


def test_best_region_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([rng.uniform(-3, 3), 0.0, -1.0, 1.0]) for _ in range(rng.randint(0, 25))]
        lo, hi = html_main.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert abs(sum(scores[lo:hi]) - max([0.0, *sums])) < 1e-9
        assert hi == 0 or sum(scores[lo:hi]) > 0


def test_the_scan_decides():
    """The region ends where the weights say, not where an element does, and other weights give another text."""
    page = "<body><div><p>one two three four</p><p>five six</p></div></body>"
    weights = html_main.default_weights()
    assert html_main.main_text(page, weights) == "one two three four five six"
    assert html_main.main_text(page, {**weights, "cost:p": -20.0}) == "one two three four"
    assert html_main.main_text(page, {"bias": -1.0}) == ""


def test_main_text_keeps_what_names_like_noise_hold():
    weights = html_main.default_weights()
    words = "good words here " * 20
    for part in ("<div class='discussion'><p>they differ in this</p></div>", "<section id='related-work'><h2>Related work</h2><p>others did it too</p></section>", "<p><a href='/x'>a linked paragraph of some words</a></p>" * 60):
        inner = " ".join(re.sub("<[^>]*>", " ", part).split())
        assert html_main.main_text(f"<body><article><p>{words}</p>{part}<p>the closing paragraph</p></article></body>", weights) == words + inner + " the closing paragraph"
    assert html_main.main_text(f"<body><div class='share price'><article><p>{words}</p></article></div></body>", weights) == words.strip()
    assert html_main.main_text(f"<body><header><h1>The title of it</h1></header><div><p>{words}</p></div></body>", weights) == "The title of it " + words.strip()


def test_main_text_of_deep_and_long_pages():
    weights = html_main.default_weights()
    assert html_main.main_text("<div>" * 20_000 + "some words" + "</div>" * 10_000, weights) in ("some words", "")
    long = "<article>" + "<p>" + "word " * 10 + "</p>" * 1 + ("<p>" + "word " * 10 + "</p>") * 20_000 + "</article>"
    assert len(html_main.main_text(long, weights).split()) == 200_010


def test_main_text_in_wrappers_named_like_noise():
    weights = html_main.default_weights()
    words = "good words here " * 20
    small = "<div class='ad'>buy now</div>"
    rest = "<nav><a href=/>Home</a></nav>", "<section class='comments'><p>first!</p></section><aside>more of us</aside><footer>legal</footer>"
    wraps = ["form", "label", "object", "div class='has-sidebar'", "div id='page-with-menu'", "div class='social'", "div class='search'", "div class='no-comments'"]
    for wrap in [*wraps, "form><div class='has-sidebar'", "div class='no-comments'><form"]:
        for tag in ("article", "main", "div"):
            body = f"<{tag}><p>{words}</p>{small}<p>and the end of it</p></{tag}>"
            for page in (f"<body><{wrap}>{rest[0]}{body}{rest[1]}</body>", f"<body>{rest[0]}<{wrap}>{body}</{wrap.split()[0].split('>')[0]}>{rest[1]}</body>"):
                assert html_main.main_text(page, weights) == words + "and the end of it", page
    talk = "<div class='comments'>" + f"<article><p>{'my view ' * 12}</p></article>" * 2 + "</div>"
    assert html_main.main_text(f"<body><article><p>{words}</p></article>{talk}</body>", weights) == words.strip()
    assert html_main.main_text("<body><nav>go here</nav><footer>legal words only</footer></body>", weights) == ""


def test_chat_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(chat.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    got = QUERIES["op8_chat_formatting"](spark, SF)
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", got._jdf.queryExecution().toString())
    got = got.toPandas().sort_values("conv_id").reset_index(drop=True)
    for c in got.columns:
        assert (got[c].values == want[c].values).all(), c


def test_chat_round_trip(spark):
    rng = random.Random(2)
    pieces = ["\\", "#", "<", "### ", "</turn>\n", ": ", "\\b", "\\l", "é", "\n", "x", "\\Q", "$1"]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b#", "", None]), rng.choice([text(), None])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(99, None, "user", "n"), (99, 0, "user", "b"), (99, 0, "user", "a"), (99, 0, "user", "a")]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(3)).withColumn("segments", F.lit(3))
    done = chat.format_conversations(df, block=16)
    out = done.withColumn("turns", chat.read_turns(F.array_join(F.transform("segments", lambda s: s["text"]), ""))).collect()
    for r in out:
        mine = sorted(((-1 if t is None else t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [(role, x) for _, role, x in mine]
        assert r.n_turns == len(mine)
        assert [s.loss for s in r.segments[1::3]] == [role == "assistant" for _, role, _ in mine]
        state = "start"
        for _, role, _ in mine:
            state = chat.MOVES.get((state, role), "dead")
        assert r.in_order == (state in chat.ACCEPT)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from sievelake.llm import quality_model, quality_rules, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert good.columns == docs.columns
    score = {r.doc_id: r.predicted for r in quality_model.score(docs, quality_model.train(docs, labels)).collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == {i for i, p in score.items() if p}
    kept = quality_rules.keep_good(good)
    firsts = simhash.first_of_each_group(kept)
    ids = {r.doc_id for r in firsts.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids


def test_pipeline_texts_and_packing(spark, tmp_path):
    """The rows of run(): the tokens of the texts that remain, packed without gaps; a passage that an earlier document has is gone from them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    tokens = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in tokens.items()}
    pieces, bins = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(pieces[i]) == [(k, 4096 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    texts = [" ".join(t.split()) for t in tokens.values() if t]
    runs = [" ".join(w[k : k + 55]) for w in (t.split() for t in texts) for k in range(0, len(w) - 54, 55)]
    assert all(sum(run in t for t in texts) == 1 for run in runs[:200])


def test_pipeline_stages_with_odd_rows(spark):
    """Null and repeated rows, empty and null texts, and columns named like those that stages make, in each stage that takes documents."""
    import corpus_pipeline

    good = "We met by the old river in spring and talked about the long road home while birds were singing."
    rows = [(1, good, "en", "s", 5, 1, 2), (1, good, "en", "s", 5, 1, 2), (None, good + " Then we left again.", None, None, None, None, None), (2, None, "en", "s", 0, 1, 1), (3, "", "en", "s", 0, 1, 1), (4, "x" * 5000, "en", "s", 1, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _nth int, _kept_id int").withColumns({c: F.lit(1) for c in ("kept_id", "kept_hash", "_kept_hash", "nth", "score", "predicted", "fp")})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns and got.count() <= len(rows)
        assert stage(spark, df.limit(0), SF).count() == 0
    kept = corpus_pipeline.near_dedup(spark, df, SF).collect()
    # Null and empty texts are one group, the two equal rows another.
    assert sorted(r.doc_id is None or r.doc_id for r in kept) == sorted([1, 2, 4, True])
    assert corpus_pipeline.packed(spark, df, SF).count() >= len(rows)
    assert corpus_pipeline.packed(spark, df.limit(0), SF).count() == 0
