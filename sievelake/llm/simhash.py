"""Near-duplicates by 64-bit SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in three bits or fewer share a variant: one of them reaches it by flipping at most one
bit, the other by at most two. An odd distance means that one fingerprint has an even number of set bits and the other
an odd number, so only fingerprints of odd parity need the variants at two flips; and as two of any three bits lie in
the same half of the word, only pairs of flips within one half are needed. That is 65 variants for even and 1,057 for
odd fingerprints, and no link is lost. Only distinct fingerprints emit them, and of those only the ones that meet another in a
cheaper ball first: each half of the word with up to one bit flipped, 66 values for each.

A variant that some fingerprint reaches with at most one flip is within three bits of everything else that reaches it,
so the fingerprints of a variant are linked as a star around the one with the fewest flips: as many links as members,
never all pairs. A variant is reached by at most 2,081 distinct fingerprints, however large a group of copies is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.components import connected_components
from sievelake.llm.shared import materialize, n_partitions, small_batches, unused

RADIUS = 3
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(whole[s:e], SEED) for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())],
        np.uint64,
    )
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192])
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a null text counts as empty."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _array(values: list[int]) -> F.Column:
    """A literal array of longs; the least long can't be written as one number."""
    return F.expr("array(" + ",".join(f"{m}L" if m != -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)" for m in values) + ")")


#: Masks in the order of their flips: none, one (64), two within a half (992).
_ONE = [1 << i for i in range(64)]
_TWO = [1 << a | 1 << b for half in (range(32), range(32, 64)) for a, b in combinations(half, 2)]
_MASKS = [_signed(m) for m in (0, *_ONE, *_TWO)]


def with_company(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints that agree with another one in a half of the word, but for one bit of that half.

    Of three differing bits at most one lies in one of the halves, so none that has a link is left out.
    """
    # Each half within one flip: 33 values a half.
    flips = _array([0, *(1 << i for i in range(32))])
    halves = F.array(F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32) | 4294967296L * 2"))
    near = fps.select("fp", F.explode(halves).alias("half")).select("fp", F.explode(F.transform(flips, lambda m: F.col("half").bitwiseXOR(m))).alias("half"))
    first = F.first("fp").over(Window.partitionBy("half").orderBy("fp"))
    met = near.withColumn("first", first).where("fp <> first")
    return met.select(F.explode(F.array("fp", "first")).alias("fp")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """(u, v) over distinct fingerprints fp: stars that connect exactly what chains of distances <= 3 connect."""
    n = n_partitions(fps.sparkSession)
    some = with_company(fps.select("fp").distinct().repartition(n)).repartition(n)
    codes = F.sequence(F.lit(0), F.when(F.bit_count("fp") % 2 == 0, len(_ONE)).otherwise(len(_MASKS) - 1))
    mask = lambda code: F.get(_array(_MASKS), F.col(code))
    # The number of the mask stands for the fingerprint, so that a row is a variant and a short number.
    variants = some.select("fp", F.explode(codes).alias("code")).select(F.col("fp").bitwiseXOR(mask("code")).alias("variant"), F.col("code").cast("short").alias("code"))
    by = Window.partitionBy("variant").orderBy("code")
    star = variants.withColumn("first", F.first("code").over(by)).where(f"code <> first and first <= {len(_ONE)}")
    pairs = star.select(F.col("variant").bitwiseXOR(mask("first")).alias("u"), F.col("variant").bitwiseXOR(mask("code")).alias("v"))
    return pairs.where(F.expr(f"bit_count(u ^ v) <= {RADIUS}")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    Fingerprints at RADIUS or fewer differing bits are linked; component_id is the least doc_id that links reach, the
    row's own included. Null and wordless texts have fingerprint 0 and are linked like any other. Rows that repeat a
    doc_id are so many rows of the result. An empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    pairs = links(nodes)
    # From here on a fingerprint is named by the least document that has it.
    named = pairs.join(nodes.withColumnsRenamed({"fp": "u", "node": "un"}), "u").join(nodes.withColumnsRenamed({"fp": "v", "node": "vn"}), "v")
    found = connected_components(named.select(F.col("un").alias("u"), F.col("vn").alias("v")))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near-duplicate texts, all columns kept: that of the least doc_id, nulls last, then of the least hash of the text.

    Groups are made of fingerprints, so rows that share a doc_id or have none are judged by their texts alone.
    """
    kept_id, kept_hash, nth = unused(docs, "kept_id", "kept_hash", "nth")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash.alias("hash")).alias("key"), "text")
    fps = materialize(fingerprints(keyed, "key"), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("key"))
    found = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    kept = nodes.join(found, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("key").alias("key"))
    kept = kept.select(F.col("key.doc_id").alias(kept_id), F.col("key.hash").alias(kept_hash)).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[kept_id]) & (text_hash == kept[kept_hash]))
    once = Window.partitionBy(kept_id, kept_hash).orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))
    return rows.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*[docs[c] for c in docs.columns])
