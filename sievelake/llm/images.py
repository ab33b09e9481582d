"""Edited and cropped copies of images by local descriptors.

Corners are found on every level of a scale pyramid, the strongest of each cell of CELL by CELL pixels, so their number grows with the picture's area;
around each, a patch turned to its main direction gives 240 binary tests. The tests are cut into five parts of 48 bits, the Hamming tables: descriptors at four
bits or fewer agree in one of them. All images that share an entry are paired, frequent entries block by block, so that no task holds a whole
one. A pair of which two corners meet is verified: each corner's nearest descriptor in the other image counts if it is near enough, and the pair is a link if INLIERS of
these agree on one shift, turn and scale. Images with equal pixels are one class before that.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.components import connected_components
from sievelake.llm.shared import drop_table, materialize, release_shuffles, small_batches

STEP = 1.08  # between two levels of the pyramid
CELL = 11
RADIUS = 9
BITS = 240
TABLES = 5
MATCH_BITS = 42
MEETINGS = 2  # _often_met() counts to two
INLIERS = 5
TURN, GROW = 0.35, 0.3  # how far turns, and logarithms of scales, of matches that agree may lie apart
SLACK, SLACK_GROWTH = 3, 0.12  # and their places: so many pixels, and this share of their distance
BLOCK = 256  # members of an entry paired at once
#: Pairs of corners counted, and bytes of corners sent to pairs, in a round; a round of a large table has as many pairs as the table has members, and two thirds of its bytes. All rounds together do the whole job.
ROUND_MEETINGS, ROUND_BYTES = 8_000_000, 128_000_000
#: Bytes of corners, and images, in a part of the table that a task has at once.
PART_BYTES, PART_IMAGES = 40_000_000, 10_000
#: The most pixels that a picture may have; larger ones count as unreadable, so that a small file can't fill a task's memory.
MOST_PIXELS = 100_000_000
#: Images described at once have so many pixels together.
STACK_PIXELS = 80_000
_TESTS = np.random.default_rng(11).integers(-RADIUS + 1, RADIUS, (BITS, 4))


def png(gray: np.ndarray) -> bytes:
    """A grey image as PNG."""
    h, w = gray.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def read_png(data: bytes | None) -> np.ndarray | None:
    """The grey values of an 8-bit PNG without interlacing; None for anything else."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    try:
        at, parts, head = 8, [], b""
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            head = body if kind == b"IHDR" else head
            parts += [body] if kind == b"IDAT" else []
            at += n + 12
        w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
        c = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or laced or not c:
            return None
        if not 0 < w * h <= MOST_PIXELS:
            return None
        raw = zlib.decompressobj().decompress(b"".join(parts), h * (w * c + 1))
        rows = np.frombuffer(raw, np.uint8).reshape(h, w * c + 1)
    except (struct.error, zlib.error, ValueError):
        return None
    out = np.zeros((h + 1, w + 1, c), np.uint8)  # with a row above and a column before
    for y in range(h):
        kind, line, up, now = rows[y, 0], rows[y, 1:].reshape(w, c), out[y], out[y + 1]
        if kind == 0:
            now[1:] = line
        elif kind == 1:
            now[1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            now[1:] = line + up[1:]
        elif kind in (3, 4):
            _unfilter(kind, line.tolist(), up.tolist(), now)
        else:
            return None
    px = out[1:, 1:].astype(np.float64)
    return px[..., 0] if c < 3 else px[..., :3] @ (0.299, 0.587, 0.114)


def _unfilter(kind: int, line: list, above: list, now: np.ndarray) -> None:
    """One row of the PNG filters that need the pixel before: 3, the mean of before and above, or 4, whichever of before, above and above-before is nearest to their plane."""
    before = [0] * len(above[0])
    for x, px in enumerate(line, 1):
        if kind == 3:
            before = [(v + (a + u) // 2) & 255 for v, a, u in zip(px, before, above[x])]
        else:
            corner = above[x - 1]
            before = [(v + min((abs(u - d), 0, a), (abs(a - d), 1, u), (abs(a + u - 2 * d), 2, d))[2]) & 255 for v, a, u, d in zip(px, before, above[x], corner)]
        now[x] = before


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r+1 of the last two axes, edges repeated."""
    h, w = x.shape[-2:]
    c = np.empty((*x.shape[:-2], h + 2 * r + 1, w + 2 * r + 1), x.dtype)
    a, b = slice(r + 1, r + 1 + h), slice(r + 1, r + 1 + w)
    c[..., a, b] = x
    c[..., a, : r + 1], c[..., a, r + 1 + w :] = x[..., :1], x[..., -1:]
    c[..., : r + 1, :], c[..., r + 1 + h :, :] = c[..., r + 1 : r + 2, :], c[..., r + h : r + h + 1, :]
    c = c.cumsum(-2).cumsum(-1)
    k = 2 * r + 1
    return c[..., k:, k:] - c[..., :-k, k:] - c[..., k:, :-k] + c[..., :-k, :-k]


def _shrunk(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = int(x.shape[-2] / scale), int(x.shape[-1] / scale)
    ys, xs = np.minimum((np.arange(h) * scale), x.shape[-2] - 1.001), np.minimum(np.arange(w) * scale, x.shape[-1] - 1.001)
    y0, x0 = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, x.shape[-2] - 1), np.minimum(x0 + 1, x.shape[-1] - 1)
    above, below = x[..., y0, :], x[..., y1, :]
    return (1 - fy) * ((1 - fx) * above[..., x0] + fx * above[..., x1]) + fy * ((1 - fx) * below[..., x0] + fx * below[..., x1])


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) as float32 rows and their tests as rows of BITS / 8 bytes."""
    return describe_all(image[None])[0]


def describe_all(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What describe() gives for each of a stack of images of one size; small images cost half as much together."""
    places, bits, owner = [np.zeros((0, 4), np.float32)], [np.zeros((0, BITS // 8), np.uint8)], [np.zeros(0, np.int64)]
    m = RADIUS + 3
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = yy * yy + xx * xx <= RADIUS * RADIUS
    scale = 1.0
    while min(stack.shape[1:]) / scale >= 2 * m + 3:
        r = max(0, round((scale - 1) / 2))
        img = _shrunk(_box(stack, r) / (2 * r + 1) ** 2 if r else stack, scale)
        img = _box(img, 1) / 9
        soft = _box(img, 2) / 25
        gy, gx = np.gradient(img, axis=(1, 2))
        a, b, c = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        core = strength[:, m:-m, m:-m]
        peak = core > 1e-6
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= core > strength[:, m + dy : strength.shape[1] - m + dy, m + dx : strength.shape[2] - m + dx]
        ns, ys, xs = np.nonzero(peak)
        cell = (ns * (core.shape[1] // CELL + 1) + ys // CELL) * (core.shape[2] // CELL + 1) + xs // CELL
        order = np.lexsort((xs, ys, -core[ns, ys, xs], cell))
        best = np.sort(order[np.unique(cell[order], return_index=True)[1]])
        ns, ys, xs = ns[best], ys[best] + m, xs[best] + m
        flat, width = soft.ravel(), soft.shape[2]
        corner = (ns * soft.shape[1] + ys) * width + xs
        for at in range(0, len(ys), 512):
            y, x, k0 = ys[at : at + 512], xs[at : at + 512], corner[at : at + 512]
            patch = flat[k0[:, None, None] + (yy * width + xx)] * disc
            angle = np.arctan2((patch * yy).sum((1, 2)), (patch * xx).sum((1, 2)))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            turned = []
            for tx, ty in (_TESTS[:, :2].T, _TESTS[:, 2:].T):
                fx, fy = cos * tx - sin * ty, sin * tx + cos * ty
                x0, y0 = np.floor(fx), np.floor(fy)
                fx, fy = fx - x0, fy - y0
                k = (y0 * width + x0).astype(np.int64) + k0[:, None]
                below = k + width
                turned.append((1 - fy) * ((1 - fx) * flat[k] + fx * flat[k + 1]) + fy * ((1 - fx) * flat[below] + fx * flat[below + 1]))
            bits.append(np.packbits(turned[0] < turned[1], axis=1))
            places.append(np.stack([x * scale, y * scale, np.full(len(x), scale), angle], 1).astype(np.float32))
        owner.append(ns)
        scale *= STEP
    owner = np.concatenate(owner)
    order, cuts = np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(stack)))[:-1]
    return list(zip(np.split(np.concatenate(places)[order], cuts), np.split(np.concatenate(bits)[order], cuts)))


def describe_each(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What describe() gives for each image, nothing for None; images of one size go in stacks of at most STACK_PIXELS."""
    out = [(np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8))] * len(images)
    by_size: dict[tuple, list[int]] = {}
    for k, x in enumerate(images):
        if x is not None:
            by_size.setdefault(x.shape, []).append(k)
    for (h, w), ks in by_size.items():
        n = max(1, STACK_PIXELS // (h * w))
        for at in range(0, len(ks), n):
            part = ks[at : at + n]
            for k, found in zip(part, describe_all(np.stack([images[k] for k in part]))):
                out[k] = found
    return out


def consensus(pa_: np.ndarray, pb: np.ndarray) -> int:
    """The most matches that agree with the shift, turn and scale of one of them; a corner of the second image counts once."""
    best = 0
    turn, grow = pb[:, 3] - pa_[:, 3], pb[:, 2] / pa_[:, 2]
    za, zb = pa_[:, 0] + 1j * pa_[:, 1], pb[:, 0] + 1j * pb[:, 1]
    f = grow * np.exp(1j * turn)
    for at in range(0, len(za), 256):
        part = slice(at, at + 256)
        guess = f[part, None] * za[None, :] + (zb - f * za)[part, None]
        # What a guess may be off grows with the distance from its corner, as its turn and scale are inexact.
        slack = SLACK + SLACK_GROWTH * np.abs(f[part, None] * (za[None, :] - za[part, None]))
        near = np.abs(guess - zb[None, :]) <= slack
        near &= np.abs(np.angle(np.exp(1j * (turn[part, None] - turn[None, :])))) <= TURN
        near &= np.abs(np.log(grow[part, None] / grow[None, :])) <= GROW
        for row in near[near.sum(1) >= max(best + 1, INLIERS)]:
            best = max(best, len(np.unique(zb[row])))
    return best


def _words(bits: bytes) -> np.ndarray:
    """Rows of BITS / 8 bytes as rows of 64-bit words, filled up with zeros."""
    rows = np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64)


def linked(bu: bytes, pu: bytes, bv: bytes, pv: bytes) -> bool:
    """Whether enough corners of the first image have a match in the second that agrees with the others; bits and places as describe() has them."""
    return linked_each([(_corners(bu, pu), _corners(bv, pv))])[0]


def _corners(bits: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(_words(bits).T), np.frombuffer(places, np.float32).reshape(-1, 4).astype(np.float64)


def linked_each(pairs: list[tuple]) -> list[bool]:
    """linked() of each pair of _corners(). Matches are screened together for INLIERS that agree, a trace more widely than by consensus(), which has the word on what is left."""
    out, few, wide, many = [False] * len(pairs), [], [], []
    for k, ((du, xu), (dv, xv)) in enumerate(pairs):
        ours, theirs = _matches(du, dv)
        if len(ours) >= INLIERS:
            (few if len(ours) <= 16 else wide if len(ours) <= 64 else many).append((k, xu[ours], xv[theirs]))
    for group in (few, wide):
        if group:
            turn = np.full((len(group), max(len(x) for _, x, _ in group)), np.nan)
            grow = turn.copy()
            for r, (_, x, y) in enumerate(group):
                turn[r, : len(x)], grow[r, : len(x)] = y[:, 3] - x[:, 3], y[:, 2] / x[:, 2]
            grow = np.log(grow)
            off = turn[:, :, None] - turn[:, None, :]
            off -= 2 * np.pi * np.rint(off / (2 * np.pi))
            agree = (np.abs(off) <= TURN + 1e-6) & (np.abs(grow[:, :, None] - grow[:, None, :]) <= GROW + 1e-6)
            left = np.flatnonzero(agree.sum(2).max(1) >= INLIERS)
            za, zb = np.full((2, len(left), turn.shape[1]), np.nan, complex)
            for r, k in enumerate(left):
                _, x, y = group[k]
                za[r, : len(x)], zb[r, : len(x)] = x[:, 0] + 1j * x[:, 1], y[:, 0] + 1j * y[:, 1]
            way = (np.exp(grow[left] + 1j * turn[left]))[:, :, None] * (za[:, None, :] - za[:, :, None])
            agree = agree[left] & (np.abs(way - (zb[:, None, :] - zb[:, :, None])) <= SLACK + SLACK_GROWTH * np.abs(way) + 1e-6)
            many += [group[k] for k in left[agree.sum(2).max(1, initial=0) >= INLIERS]]
    for k, x, y in many:
        out[k] = consensus(x, y) >= INLIERS
    return out


def _matches(du: np.ndarray, dv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the first image whose nearest in the second is within MATCH_BITS, and that nearest, the first of equals."""
    ours, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, du.shape[1], 256):
        distance = reduce(np.add, (np.bitwise_count(a[at : at + 256, None] ^ b) for a, b in zip(du, dv))).ravel()  # at most BITS, so a byte holds it
        near = np.flatnonzero(distance <= MATCH_BITS)
        i, j = np.divmod(near, dv.shape[1])
        order = np.lexsort((distance[near], i))  # keeps the order of j among equals
        i = i[order]
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        ours.append(i[first] + at)
        theirs.append(j[order][first])
    return np.concatenate(ours), np.concatenate(theirs)


def shared_entries(entry: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, a, k, blocks, s) of the members (a, k) of entries that have two or more, s being the block of the member: an entry of more than block members is cut into blocks by hash."""
    shared = entry.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    shared = materialize(shared, "entries")
    release_shuffles(entry.sparkSession)
    return entry.join(shared, "key").withColumn("s", F.pmod(F.xxhash64("a", "k"), F.col("blocks")).cast("int"))


def first_meetings(rows: DataFrame) -> DataFrame:
    """(u, v, ku, kv): each member of shared_entries() with the least and with the one before it in its block, and the least of each block with those of the other blocks before it and the first."""
    within = Window.partitionBy("key", "s").orderBy("a", "k")
    one = F.struct("a", "k")
    met = rows.select("key", one.alias("y"), F.first(one).over(within).alias("first"), F.lag(one).over(within).alias("before"))
    heads = rows.where("blocks > 1").groupBy("key", "s").agg(F.min(one).alias("y"))
    among = Window.partitionBy("key").orderBy("y")
    met = met.union(heads.select("key", "y", F.first("y").over(among).alias("first"), F.lag("y").over(among).alias("before")))
    return _ordered(met.select("y", F.explode(F.array_distinct(F.array("first", "before"))).alias("x")).where("x.a <> y.a"))


def _ordered(met: DataFrame) -> DataFrame:
    u, v = F.least("x", "y"), F.greatest("x", "y")
    return met.select(u["a"].alias("u"), v["a"].alias("v"), u["k"].alias("ku"), v["k"].alias("kv"))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(i, j, m) of shared_entries() with classes c: m are the members (a, k, c, s) of two blocks of an entry, or of one if i = j, if they are of several classes."""
    rows = rows.select("key", "a", "k", "c", "s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"))
    groups = rows.groupBy("key", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j")).agg(F.collect_list(F.struct("a", "k", "c", "s")).alias("m"))
    return groups.where(F.size(F.array_distinct(F.transform("m", lambda x: x["c"]))) > 1)


def meetings(rows: DataFrame) -> DataFrame:
    """(u, v, ku, kv) for every two members of the same of shared_entries() with different classes c, u < v; each pair of blocks is a group of its own."""
    return part_of_meetings(block_pairs(rows), 0, 1)


def part_of_meetings(groups: DataFrame, part: int, of: int) -> DataFrame:
    """What meetings() gives, from block_pairs(), in parts by hash of the member with the smaller number."""
    member = F.filter("m", lambda x: F.pmod(F.xxhash64(x["a"]), F.lit(of)) == part) if of > 1 else F.col("m")
    met = groups.select("i", "j", "m", F.explode(member).alias("x"))
    others = F.filter("m", lambda y: (y["a"] > F.col("x.a")) & (y["c"] != F.col("x.c")) & ((F.col("i") == F.col("j")) | (y["s"] != F.col("x.s"))))
    return _ordered(met.select("x", F.explode(others).alias("y")))


def copies(images: DataFrame) -> DataFrame:
    """(image_id, n_corners int, component_id) for every row of images (image_id long, image binary PNG).

    component_id is the least image_id that equal pixels and links reach, as if all pairs that meet were verified. Null, unreadable and featureless images are linked by equal bytes alone. Empty tables give no rows.
    """
    small_batches(images.sparkSession)

    def run(batches):
        for b in batches:
            digest, places, bits, held = [], [], [], []
            for k, data in enumerate(b.column(1).to_pylist(), 1):
                gray = read_png(data)
                whole = repr(gray.shape).encode() + gray.tobytes() if gray is not None else b"?" + (data or b"")
                digest.append(hashlib.sha1(whole).hexdigest())
                held.append(gray)
                if k == b.num_rows or sum(x.size for x in held if x is not None) >= STACK_PIXELS:
                    for p, d in describe_each(held):
                        places.append(p.tobytes())
                        bits.append(d.tobytes())
                    held = []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest), pa.array(places, pa.binary()), pa.array(bits, pa.binary())], names=["image_id", "digest", "places", "bits"])

    spark = images.sparkSession
    found = images.select(F.col("image_id").cast("long"), "image").mapInArrow(run, "image_id long, digest string, places binary, bits binary")
    found = materialize(found, "corners")
    least = found.groupBy("digest").agg(F.min("image_id").alias("a"))
    classes = found.join(least.select("a", F.col("digest").alias("of")), (F.col("digest") == F.col("of")) & F.col("image_id").eqNullSafe(F.col("a")))
    classes = materialize(classes.select("a", "bits", "places", "digest").dropDuplicates(["digest"]), "classes")
    n = F.expr(f"octet_length(bits) div {BITS // 8}")
    slim = materialize(found.select("image_id", n.cast("int").alias("n_corners"), "digest"), "images")
    release_shuffles(spark)
    drop_table(found)

    width = BITS // 8 // TABLES
    corner = classes.where(n > 0).select("a", "bits", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    entry = corner.select("a", "k", "bits", F.explode(F.array(*[F.lit(t) for t in range(TABLES)])).alias("t"))
    key = F.xxhash64("t", F.substring("bits", F.col("k") * (BITS // 8) + F.col("t") * width + 1, F.lit(width)))
    rows = materialize(shared_entries(entry.select("a", "k", key.alias("key"))), "members")
    release_shuffles(spark)

    # First the pairs that hold a group of copies together, then all that meet across the classes so far: what is within one class needs no more links.
    met = _often_met(first_meetings(rows))
    first = _verified(met, classes)
    drop_table(met)
    reach = materialize(connected_components(first), "first-classes")
    classed = rows.join(reach.withColumnsRenamed({"node": "a", "component": "c"}), "a", "left").withColumn("c", F.coalesce("c", "a"))
    groups = materialize(block_pairs(classed), "block-pairs")
    release_shuffles(spark)
    total = groups.agg(F.sum(F.size("m").cast("long") * (F.size("m") - 1) / 2)).first()[0] or 0
    parts = max(1, math.ceil(total / max(ROUND_MEETINGS, rows.count())))
    drop_table(rows)
    # Pairs that meet by chance grow with the square of the table, so those of a part are verified and gone before the next part is made.
    links = [first]
    for k in range(parts):
        met = _often_met(part_of_meetings(groups, k, parts))
        if k == parts - 1:
            drop_table(groups)
        links.append(_verified(met, classes, k, parts))
        drop_table(met)
    reach = connected_components(reduce(DataFrame.union, links))
    of = classes.select("a", "digest").join(reach, F.col("a") == F.col("node"), "left").select("digest", F.coalesce("component", "a").alias("component_id"))
    return slim.join(of, "digest").select("image_id", "n_corners", "component_id")


def _often_met(met: DataFrame) -> DataFrame:
    """(u, v) of the pairs that meet in MEETINGS = 2 different pairs of corners or more, as a table."""
    corners = F.shiftleft(F.col("ku").cast("long"), 32).bitwiseOR(F.col("kv").cast("long"))  # a number, so that Spark counts by hash and sorts nothing
    pairs = materialize(met.groupBy("u", "v").agg(F.min(corners).alias("a"), F.max(corners).alias("b")).where("a <> b").select("u", "v"), "image-pairs")
    release_shuffles(met.sparkSession)
    return pairs


def _verified(pairs: DataFrame, classes: DataFrame, k: int = 0, of: int = 1) -> DataFrame:
    """(u, v) of the pairs that are links, pairs being those of part k of part_of_meetings(). Corners go to parts of u by parts of v, once to each, and not with every pair; rounds by u hold no more copies of the first side at once than ROUND_BYTES or two thirds of classes, and classes as the second."""
    n, held = classes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bits") + F.octet_length("places")), F.lit(0))).first()
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    parts = cores * math.ceil(max(6, held / PART_BYTES, n / PART_IMAGES) / cores)
    rounds = of * max(1, math.ceil(parts * held / max(ROUND_BYTES, held * 2 / 3) / of))  # a multiple of the parts of meetings, which go by the same hash
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    vs = classes.select(part("a", parts).alias("part", metadata={"of": parts}), "a", "bits", "places")
    links = []
    for r in range(k, rounds, of):
        us = classes.where(part("a", rounds) == r).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "a", "bits", "places")
        links.append(_links(pairs.where(part("u", rounds) == r).select(part("v", parts).alias("part"), "u", "v"), us, vs))
    return reduce(DataFrame.union, links)


def _links(pairs: DataFrame, us: DataFrame, vs: DataFrame) -> DataFrame:
    """(u, v) of the pairs that are links, as a table; us and vs hold the corners of either side, and each part of the three is a task."""
    none = F.lit(None)
    rows = us.union(vs).select("part", F.col("a").alias("u"), none.cast("long").alias("v"), "bits", "places")
    rows = rows.union(pairs.select("part", "u", "v", none.cast("binary"), none.cast("binary")))

    def verify(batches):
        seen, met = {}, [np.zeros((0, 2), np.int64)]
        for b in batches:
            _, u, v, bits, places = b.columns
            pair = v.is_valid()
            met.append(np.stack([x.filter(pair).to_numpy() for x in (u, v)], 1))
            for k in np.flatnonzero(~pair.to_numpy(zero_copy_only=False)).tolist():
                seen[u[k].as_py()] = _corners(bits[k].as_py(), places[k].as_py())
        met = np.concatenate(met)
        for at in range(0, len(met), 256):
            u, v = met[at : at + 256].T
            good = np.array(linked_each([(seen[x], seen[y]) for x, y in zip(u.tolist(), v.tolist())]))
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], names=["u", "v"])

    links = materialize(rows.repartitionById(vs.schema["part"].metadata["of"], "part").mapInArrow(verify, "u long, v long"), "image-links")
    release_shuffles(pairs.sparkSession)
    return links


_SIDE = 72


def render(embeddings: DataFrame) -> DataFrame:
    """(image_id, image): a vector as a picture, for tables without pictures. Each value scales a fixed smooth pattern; close vectors look alike."""
    small_batches(embeddings.sparkSession)

    def run(batches):
        rng = np.random.default_rng(5)
        base: list[np.ndarray] = []
        stacks: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                v = np.array([x or 0.0 for x in v or []])
                while len(base) < len(v):
                    noise = _box(_box(rng.standard_normal((_SIDE, _SIDE)), 2), 1)
                    base.append(noise / noise.std())
                if len(v) and len(v) not in stacks:
                    stacks.clear()
                    stacks[len(v)] = np.stack(base[: len(v)])
                img = np.tensordot(v, stacks[len(v)], 1) if len(v) else np.zeros((_SIDE, _SIDE))
                out.append(png(np.clip(128 + 45 * img, 0, 255)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "image_id long, image binary")
