"""Nearest neighbours by inner product with vantage-point trees per shard.

Vectors get one more component that makes all as long as the longest, queries a zero there; then the largest inner product is
the least Euclidean distance, for which the triangle inequality holds. A small tree fitted on a bounded sample parts all vectors into
regions; a region with more rows than a shard holds is dealt into several shards, so a dense group fills no single task. Each shard
has a tree of its own, whose leaves are ranges of distance from the vantage points above them.

A query first searches a shard of its own region, which bounds how far its nearest may be; then it goes to all shards of those regions that
the bound does not rule out. A region or leaf is left out if factor times the least distance the triangle inequality allows is
beyond the query's bound: factor 1 is exact, a greater one leaves out more.

Equal vectors are searched as one, with the least ids of its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.shared import materialize, n_partitions

#: At 4 a random 64-number table still has 0.999 of its 20 nearest found; tables with denser groups allow more.
K, FACTOR = 20, 4.0
#: Numbers in a shard and in a block of queries, so that what a task holds is bounded whatever the vectors' length.
SHARD_FLOATS, BLOCK_FLOATS = 1 << 22, 1 << 21
#: Rows that the tree of regions is fitted on, at most; also bounded by SAMPLE_FLOATS.
SAMPLE_ROWS, SAMPLE_FLOATS, MAX_REGIONS = 20_000, 1 << 23, 1024
LEAF, LEAST_SHARD = 128, 512
#: Distances are compared with this much room for rounding, relative to the longest vector.
ROUNDING = 1e-7


class Tree:
    """A vantage-point tree over points (n, d): leaves, and for each the ranges of distance from the vantage points on its way."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, leaves: int | None = None):
        self.vantage: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.ways: list[list[tuple[int, float, float]]] = []
        self.nodes: list[tuple] = []
        depth = max(0, (leaves - 1).bit_length()) if leaves else 64
        self.root = self._grow(points, np.arange(len(points)), [], leaf, depth)

    def _grow(self, points, rows, way, leaf, depth) -> int:
        own = points[rows]
        if len(rows) > leaf and depth:
            # The point farthest from the mean sees the others under the widest range of distances.
            at = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            d = distances(own, at[None])[:, 0]
            middle = float(np.median(d))
            inside = d <= middle
            if inside.any() and not inside.all():
                v = len(self.vantage)
                self.vantage.append(at)
                node = len(self.nodes)
                self.nodes.append(())
                low = self._grow(points, rows[inside], [*way, (v, float(d[inside].min()), float(d[inside].max()))], leaf, depth - 1)
                high = self._grow(points, rows[~inside], [*way, (v, float(d[~inside].min()), float(d[~inside].max()))], leaf, depth - 1)
                self.nodes[node] = (v, middle, low, high)
                return node
        self.leaves.append(rows)
        self.ways.append(way)
        self.nodes.append((len(self.leaves) - 1,))
        return len(self.nodes) - 1

    def seen(self, points: np.ndarray) -> np.ndarray:
        """Distances (n, vantage points)."""
        return distances(points, np.array(self.vantage)) if self.vantage else np.zeros((len(points), 0))

    def home(self, seen: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        out = np.zeros(len(seen), np.int64)
        todo = [(self.root, np.arange(len(seen)))]
        while todo:
            node, rows = todo.pop()
            if len(self.nodes[node]) == 1:
                out[rows] = self.nodes[node][0]
            else:
                v, middle, low, high = self.nodes[node]
                inside = seen[rows, v] <= middle
                todo += [(low, rows[inside]), (high, rows[~inside])]
        return out

    def least(self, seen: np.ndarray, ways=None) -> np.ndarray:
        """(n, leaves): no point of the leaf is nearer than that, by the triangle inequality."""
        ways = self.ways if ways is None else ways
        out = np.zeros((len(seen), len(ways)))
        for k, way in enumerate(ways):
            for v, low, high in way:
                np.maximum(out[:, k], np.maximum(seen[:, v] - high, low - seen[:, v]), out=out[:, k])
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, (len(a), len(b))."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """Candidates with the component that makes each as long as length."""
    rest = np.maximum(length * length - (vectors * vectors).sum(1), 0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def as_queries(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors, np.zeros((len(vectors), 1))])


def search_shard(vectors: np.ndarray, names: np.ndarray, queries: np.ndarray, bounds: np.ndarray, length: float, k: int, factor: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a shard for each query that are within its bound, as (query number, row number, inner product).

    bounds are distances that the k nearest of all are known to lie within (infinite: unknown). Ties go to smaller names.
    """
    tree = Tree(lifted(vectors, length), leaf)
    seen = tree.seen(as_queries(queries))
    least, home = tree.least(seen), tree.home(seen)
    size2 = (queries * queries).sum(1) + length * length
    room = ROUNDING * max(length, 1e-300)
    best = np.full((len(queries), k), -np.inf)
    place = np.full((len(queries), k), -1)
    bound = bounds.copy()

    def visit(number: int, who: np.ndarray) -> None:
        rows = tree.leaves[number]
        rows = rows[np.argsort(names[rows], kind="stable")]
        product = queries[who] @ vectors[rows].T
        # Only what may be among the k so far, with room for the order of summation.
        floor = best[who, -1] - 1e-9 * length * np.sqrt(size2[who])
        some, column = np.nonzero(product >= floor[:, None])
        if not len(some):
            return
        exact = (queries[who[some]] * vectors[rows[column]]).sum(1)
        for q in np.unique(some):
            hit = slice(*np.searchsorted(some, [q, q + 1]))
            value = np.concatenate([best[who[q]], exact[hit]])
            at = np.concatenate([place[who[q]], rows[column[hit]]])
            order = np.lexsort((names[at], -value))[:k]
            best[who[q]], place[who[q]] = value[order], at[order]
        kth = best[who, -1]
        bound[who] = np.where(np.isfinite(kth), np.minimum(bound[who], np.sqrt(np.maximum(size2[who] - 2 * np.where(np.isfinite(kth), kth, 0), 0))), bound[who])

    for number in range(len(tree.leaves)):
        if len(who := np.flatnonzero(home == number)):
            visit(number, who)
    for number in range(len(tree.leaves)):
        if len(who := np.flatnonzero((home != number) & (factor * least[:, number] <= bound + room))):
            visit(number, who)
    found = place >= 0
    return np.nonzero(found)[0], place[found], best[found]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all its numbers finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, shard_floats: int = SHARD_FLOATS, block_floats: int = BLOCK_FLOATS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query its k nearest other rows by inner product, ties to the smaller id.

    factor 1 finds exactly those; a greater factor is faster and may miss some. Vectors that are null, zero or hold null or non-finite numbers take no
    part, vectors of another length than the query's are none of its candidates, rows without id take no part. Rows that share an id are
    one candidate each, but none of a query of that id; a query id is answered once for each distinct vector that it has. An empty
    table, and queries without candidates, give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))
    rows = rows.withColumn("hash", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit("b"), "v"))))
    # The k + 1 least ids of each distinct vector are enough, as a query leaves out its own.
    least = F.row_number().over(Window.partitionBy("hash").orderBy("id"))
    classes = rows.select("hash", "id", "v", "d").withColumn("nth", least).where(F.col("nth") <= k + 1).groupBy("hash").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"), F.first("d").alias("d"))
    classes = materialize(classes.withColumn("name", F.element_at("ids", 1)).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "vectors")
    asked = rows.where("asks").groupBy("hash", "id").agg(F.first("v").alias("v"), F.first("d").alias("d"))
    asked = materialize(asked.select(F.col("id").alias("query_id"), "v", "d").repartition(n_partitions(spark)), "queries")

    parts = []
    # One group for each length of vectors; all of one length in any usual table.
    for d, n, length in classes.groupBy("d").agg(F.count("*"), F.max("norm")).collect():
        parts.append(_of_one_length(classes.where(F.col("d") == d), asked.where(F.col("d") == d), d, n, length, k + 1, factor, shard_floats, block_floats))
    id_type = classes.schema["name"].dataType.simpleString()
    if not parts:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    each = found.select("query_id", "asked", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(classes: DataFrame, asked: DataFrame, d: int, n: int, length: float, k: int, factor: float, shard_floats: int, block_floats: int) -> DataFrame:
    """(query_id, asked, ids, score) of the k nearest distinct vectors; all vectors have d numbers, the longest is length long."""
    spark = classes.sparkSession
    sample_rows = min(SAMPLE_ROWS, max(64, SAMPLE_FLOATS // (d + 1)))
    # The order of hashes is a sample that any run draws alike.
    drawn = classes.select("hash", "v").orderBy("hash").limit(sample_rows) if n > sample_rows else classes.select("v")
    sample = lifted(np.array([r["v"] for r in drawn.select("v").collect()], float), length)
    per_shard = max(1, min(shard_floats // (d + 1), max(LEAST_SHARD, -(-n // n_partitions(spark)))))
    regions = min(MAX_REGIONS, max(1, -(-n // per_shard)))
    top = Tree(sample, leaf=8, leaves=regions)

    to_region = _region_of(top, length)
    with_region = materialize(classes.select("hash", "name", "v", to_region("v").alias("r")), "regions").withColumn("region", F.col("r.region"))
    # What a region's rows really reach, seen from each vantage point: the sample's ranges would be too narrow.
    sizes = {r["region"]: r["n"] for r in with_region.groupBy("region").agg(F.count("*").alias("n")).collect()}
    reach = with_region.select("region", F.posexplode("r.seen").alias("at", "s")).groupBy("region", "at").agg(F.min("s").alias("low"), F.max("s").alias("high")).collect()
    ways: dict[int, list] = {region: [] for region in sizes}
    for r in reach:
        ways[r["region"]].append((r["at"], r["low"], r["high"]))
    numbers = sorted(sizes)
    split = {region: -(-sizes[region] // per_shard) for region in numbers}
    first = dict(zip(numbers, np.cumsum([0, *[split[r] for r in numbers]]).tolist()))
    shards = sum(split.values())

    number_of = F.create_map(*[F.lit(x) for r in numbers for x in (r, first[r])])
    split_of = F.create_map(*[F.lit(x) for r in numbers for x in (r, split[r])])
    shard = number_of[F.col("region")] + F.pmod(F.xxhash64("hash"), split_of[F.col("region")].cast("long"))
    stored = with_region.select(shard.cast("int").alias("shard"), "name", "hash", "v")
    blocks = max(1, -(-asked.count() * (d + 1) // block_floats))
    asked = asked.withColumn("asked", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("query_id", "asked"), F.lit(blocks)).cast("int"))

    route = _routes(top, [ways[r] for r in numbers], [list(range(first[r], first[r] + split[r])) for r in numbers], factor, length)
    id_type = classes.schema["name"].dataType.simpleString()
    at_home = asked.withColumn("bound", F.lit(float("inf"))).withColumn("shard", F.explode(route("v", F.lit(None).cast("double"), F.col("asked"))))
    one = materialize(_search(stored, at_home, blocks, id_type, length, k, factor), "nearest-home")
    # The k-th distance at home bounds where the rest of the search has to go.
    kth = one.groupBy("query_id", "asked").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    bounded = asked.join(kth, ["query_id", "asked"], "left")
    size2 = F.aggregate("v", F.lit(length * length), lambda s, x: s + x * x)
    bounded = bounded.withColumn("bound", F.coalesce(F.sqrt(F.greatest(size2 - 2 * F.col("kth"), F.lit(0.0))), F.lit(float("inf"))))
    away = bounded.withColumn("shard", F.explode(route("v", F.col("bound"), F.col("asked"))))
    two = _search(stored, away.drop("kth"), blocks, id_type, length, k, factor) if shards > 1 else one.limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "name"))
    best = one.union(two).withColumn("rank", rank).where(F.col("rank") <= k)
    # A class is read back by its hash for the ids that it stands for.
    return best.join(classes.select("hash", "ids"), "hash").select("query_id", "asked", "ids", "score")


def _region_of(top: Tree, length: float):
    @F.pandas_udf("region int, seen array<double>")
    def region(vectors: pd.Series) -> pd.DataFrame:
        seen = top.seen(lifted(np.array(vectors.tolist(), float).reshape(len(vectors), -1), length)) if len(vectors) else np.zeros((0, 0))
        return pd.DataFrame({"region": top.home(seen), "seen": list(seen)})

    return region


def _routes(top: Tree, ways: list, shards: list[list[int]], factor: float, length: float):
    """For each query the shards to search: without a bound one of its nearest region, with a bound all others that it does not rule out."""
    room = ROUNDING * max(length, 1e-300)

    @F.pandas_udf("array<int>")
    def route(vectors: pd.Series, bounds: pd.Series, hashes: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        least = top.least(top.seen(as_queries(np.array(vectors.tolist(), float))), ways)
        own = least.argmin(1)
        out = []
        for q, (bound, h) in enumerate(zip(bounds, hashes)):
            home = shards[own[q]][h % len(shards[own[q]])]
            if bound is None or np.isnan(bound):
                out.append([home])
            else:
                out.append([s for r in np.flatnonzero(factor * least[q] <= bound + room) for s in shards[r] if s != home])
        return pd.Series(out)

    return route


def _search(stored: DataFrame, asked: DataFrame, blocks: int, id_type: str, length: float, k: int, factor: float) -> DataFrame:
    """(query_id, asked, name, hash, score): every query against the shard it is sent to; a task holds one shard and one block of queries."""
    spread = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "asked", "name", "hash", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        vectors, queries = np.array(left["v"].tolist(), float), np.array(right["v"].tolist(), float)
        q, row, score = search_shard(vectors, left["name"].to_numpy(), queries, right["bound"].to_numpy(float), length, k, factor)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[q], "asked": right["asked"].to_numpy()[q], "name": left["name"].to_numpy()[row], "hash": left["hash"].to_numpy()[row], "score": score})

    by = ["shard", "block"]
    pairs = spread.groupBy(*by).cogroup(asked.select("shard", "block", "query_id", "asked", "v", "bound").groupBy(*by))
    return pairs.applyInPandas(run, f"query_id {id_type}, asked long, name {id_type}, hash string, score double")
