"""Ranked lexical search over a tiered index.

A posting's weight within its term depends on the document alone, so the postings of a term are cut into tiers by it: the first tier holds
about the FIRST_TIER best of each term, each further one GROWTH times as many, the last one all the rest. For each tier the index knows
the residual bound of a term: the most that a posting in the tiers below can weigh. A document's postings stand in one row, each tier in
columns of its own, so that a scan of the upper tiers reads no others and scores need no shuffle.

An item is first scored from the first tier. Its tenth score so far is a floor, and the bounds say what a document that was not seen can
still reach. Where that lies below the floor, only documents that were seen can be among the ten; those whose score and bounds reach the
floor are scored exactly. Items without that proof fall through to the next tier, with those terms whose bounds together could
still lift an unseen document to the floor; the last tier has no residue, so every item ends with a proof.

Documents with the same terms and length have equal scores for any item, so they are indexed as one, with the least ids among them: as many as
a result can hold. A group of copies, however large, is one row of the index.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.shared import drop_table, materialize, small_batches

K = 10
#: Documents in the first tier of a term, and how many times as many each further one holds.
FIRST_TIER, GROWTH = 1024, 16
#: Weights are counted by steps of this many, to find where tiers end.
STEP = 256
#: Items, and terms of items with repeats, that are searched for at once: what driver and workers hold. More items go in further blocks.
MOST_ITEMS, MOST_TERMS = 4096, 500_000

#: ASCII letters and digits and everything beyond ASCII; on UTF-8 bytes that is the same as on code points.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, A to Z in lower case; null has none."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Index:
    """rows (copies, ids, code<t> and c<t> for each tier t), and for each code its weight and, by tier, its residual bound."""

    rows: DataFrame
    vocabulary: list[bytes]
    w: np.ndarray
    residual: np.ndarray
    n_docs: int
    n_terms: int
    k: int

    @property
    def tiers(self) -> int:
        return len(self.residual)


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, codes, tfs): the length of each text with a term, and which terms of the vocabulary it has how often."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        code = shared.value.get
        for b in batches:
            at, sizes, codes, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(b.column(1)):
                words = terms_of(text.as_py())
                if words:
                    counts = Counter(map(code, words))
                    counts.pop(None, None)
                    at.append(i)
                    sizes.append(len(words))
                    codes += (found := sorted(counts))
                    tfs += [counts[x] for x in found]
                    ends.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (codes, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "codes", "tfs"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, codes array<int>, tfs array<int>")


def build(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", k: int = K, first_tier: int = FIRST_TIER, growth: int = GROWTH) -> Index:
    """The index of all documents, for results of at most k, with postings of the terms of a vocabulary.

    Every row is a document, whatever ids repeat; null and termless texts are in no count.
    """
    counted = materialize(count_terms(docs, id_col, text_col, vocabulary), "term-counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        df[r["code"]] = r["count"]
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    # One row for each distinct content, with the least ids.
    content = F.struct("n", F.xxhash64("codes", "tfs").alias("a"), F.xxhash64(F.lit("b"), "codes", "tfs").alias("b"))
    nth = F.row_number().over(Window.partitionBy("content").orderBy(F.col("doc_id").asc_nulls_last()))
    met = counted.where(F.size("codes") > 0).withColumn("content", content).withColumn("nth", nth).where(F.col("nth") <= k)
    least = F.sort_array(F.collect_list(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")))
    met = met.groupBy("content").agg(least["doc_id"].alias("ids"), F.first(F.struct("codes", "tfs")).alias("has"))
    m = F.expr(f"25 + ((75 * content.n * {n_docs}L) div {max(n_terms, 1)}L)")
    c = F.expr("transform(has.tfs, tf -> cast((1000000000L * tf) div (1000L * tf + 8L * m) AS int))")
    classes = materialize(met.withColumn("m", m).select("ids", F.col("has.codes").alias("codes"), c.alias("cs")), "classes")

    # How many rows stand in each step of a term's weights, and how many in it and above: what tier the step is in follows from that.
    each = classes.select(F.inline(F.arrays_zip("codes", "cs"))).toDF("code", "c")
    steps = each.groupBy("code", F.expr(f"c div {STEP}").alias("step")).agg(F.count("*").alias("count"), F.max("c").alias("most"))
    steps = materialize(steps.withColumn("so_far", F.sum("count").over(Window.partitionBy("code").orderBy(F.desc("step")))), "steps")
    longest = steps.agg(F.max("so_far")).first()[0] or 0
    ends = []
    while first_tier * growth ** len(ends) < longest:
        ends.append(first_tier * growth ** len(ends))
    tier = sum(((F.col("so_far") > end).cast("int") for end in ends), F.lit(0))
    below = [F.coalesce(F.max(F.when(F.col("tier") > t, F.col("most"))), F.lit(0)).alias(f"r{t}") for t in range(len(ends) + 1)]
    starts = [F.coalesce(F.min(F.when(F.col("tier") <= t, F.col("step"))), F.lit(1 << 30)).alias(f"s{t}") for t in range(len(ends))]
    residual, start = np.zeros((len(ends) + 1, len(vocabulary)), np.int64), np.zeros((len(ends), len(vocabulary)), np.int64)
    for r in steps.withColumn("tier", tier).groupBy("code").agg(*below, *starts).collect():
        residual[:, r["code"]] = [r[f"r{t}"] for t in range(len(ends) + 1)]
        start[:, r["code"]] = [r[f"s{t}"] for t in range(len(ends))]
    rows = materialize(_tiered(classes, start), "index")
    for used in (counted, classes, steps):
        drop_table(used)
    return Index(rows, vocabulary, w, residual, n_docs, n_terms, k)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements) of an Arrow list column."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _tiered(classes: DataFrame, start: np.ndarray) -> DataFrame:
    """Each row's postings dealt into the columns of their tiers; start: the least step of each tier but the last, by code."""
    kind = classes.schema["ids"].dataType.simpleString()
    tiers = len(start) + 1
    shared = classes.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        first = shared.value
        for b in batches:
            row, codes = _flat(b.column(1))
            cs = _flat(b.column(2))[1]
            level = ((cs // STEP)[None] < first[:, codes]).sum(0) if len(first) else np.zeros(len(codes), int)
            out = [b.column(0)]
            for t in range(tiers):
                mine = level == t
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=b.num_rows))]).astype(np.int32))
                out += [pa.ListArray.from_arrays(ends, pa.array(x[mine].astype(np.int32))) for x in (codes, cs)]
            yield pa.RecordBatch.from_arrays(out, names=["ids", *names])

    names = [f"{x}{t}" for t in range(tiers) for x in ("code", "c")]
    return classes.mapInArrow(run, f"ids {kind}, " + ", ".join(f"{x} array<int>" for x in names))


@dataclass
class Asked:
    """What items ask: one entry for each item and term, in the order of codes; depth: the tier down to which the term is read."""

    item: np.ndarray
    code: np.ndarray
    qw: np.ndarray
    depth: np.ndarray
    rest: np.ndarray
    floor: np.ndarray

    @property
    def unseen(self) -> np.ndarray:
        """What a document without any posting read so far can reach, by item."""
        out = np.zeros(len(self.floor), np.int64)
        np.add.at(out, self.item, self.rest)
        return out

    def of(self, items: np.ndarray) -> "Asked":
        """The entries of some items, the items' numbers kept."""
        some = items[self.item]
        return Asked(self.item[some], self.code[some], self.qw[some], self.depth[some], self.rest[some], self.floor)


def _meet(batch, asked: Asked, spans: np.ndarray, tier: int):
    """For all postings of a tier and the entries that ask for them: (row, entry, c)."""
    row, codes = _flat(batch.column(f"code{tier}"))
    c = _flat(batch.column(f"c{tier}"))[1].astype(np.int64)
    many = spans[codes + 1] - spans[codes]
    first = np.repeat(spans[codes] - np.cumsum(many) + many, many)
    return np.repeat(row, many), first + np.arange(many.sum()), np.repeat(c, many)


def _sums(batch, asked: Asked, spans: np.ndarray, tiers: int) -> tuple[np.ndarray, np.ndarray]:
    """(score from what is read, bounds of the terms that were met), each (rows, items)."""
    n = len(asked.floor)
    low, met = np.zeros(batch.num_rows * n, np.int64), np.zeros(batch.num_rows * n, np.int64)
    for tier in range(tiers):
        row, entry, c = _meet(batch, asked, spans, tier)
        read = asked.depth[entry] >= tier
        row, entry, c = row[read], entry[read], c[read]
        key = row * n + asked.item[entry]
        np.add.at(low, key, asked.qw[entry] * c)
        np.add.at(met, key, asked.rest[entry])
    return low.reshape(-1, n), met.reshape(-1, n)


def _spans(asked: Asked, terms: int) -> np.ndarray:
    return np.searchsorted(asked.code, np.arange(terms + 1))


def floors(index: Index, asked: Asked) -> np.ndarray:
    """The k-th best score of each item from the tiers read so far, 0 if there are fewer documents."""
    k, tiers, terms = index.k, int(asked.depth.max(initial=-1)) + 1, len(index.vocabulary)
    shared = index.rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        asked = shared.value
        spans = _spans(asked, terms)
        best = np.zeros((3, 0), np.int64)  # item, score, copies
        for b in batches:
            copies = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            low, _ = _sums(b, asked, spans, tiers)
            row, item = np.nonzero(low)
            best = np.hstack([best, [item, low[row, item], copies[row]]])
            best = best[:, np.lexsort((-best[1], best[0]))]
            starts = np.searchsorted(best[0], best[0])
            best = best[:, np.arange(best.shape[1]) - starts < k]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["item", "low", "copies"])

    some = index.rows.select("ids", *[f"{x}{t}" for t in range(tiers) for x in ("code", "c")])
    each = some.mapInArrow(run, "item long, low long, copies long")
    order = Window.partitionBy("item").orderBy(F.desc("low"))
    first = each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    so_far = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = np.zeros(len(asked.floor), np.int64)
    for r in first.withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy("item").agg(F.max("low").alias("floor")).collect():
        out[r["item"]] = r["floor"]
    return out


def _exact(index: Index, asked: Asked) -> DataFrame:
    """(item, ids, score) of all documents that reach their item's floor, for items that are proven.

    Rows whose score so far and bounds can't reach the floor are left at that; the others get the postings of all lower tiers.
    """
    terms, tiers = len(index.vocabulary), index.tiers
    shared = index.rows.sparkSession.sparkContext.broadcast(asked)
    kind = index.rows.schema["ids"].dataType.simpleString()

    def run(batches):
        asked = shared.value
        spans, unseen, n = _spans(asked, terms), asked.unseen, len(asked.floor)
        for b in batches:
            low, met = _sums(b, asked, spans, tiers)
            can = ((low + unseen - met >= asked.floor) & (low + unseen - met > 0)).ravel()
            score = np.where(can, low.ravel(), 0)
            for tier in range(tiers):
                row, entry, c = _meet(b, asked, spans, tier)
                key = row * n + asked.item[entry]
                more = can[key] & (asked.depth[entry] < tier)
                np.add.at(score, key[more], asked.qw[entry[more]] * c[more])
            score = score.reshape(-1, n)
            row, item = np.nonzero((score >= asked.floor) & (score > 0))
            yield pa.RecordBatch.from_arrays([pa.array(item), b.column("ids").take(pa.array(row)), pa.array(score[row, item])], names=["item", "ids", "score"])

    return index.rows.mapInArrow(run, f"item long, ids {kind}, score long")


def prove(index: Index, asked: Asked) -> Asked:
    """Read items tier by tier until what they have read proves which documents can be among their best."""
    open_ = np.ones(len(asked.floor), bool)
    for tier in range(index.tiers):
        found = floors(index, asked.of(open_))
        asked.floor[open_] = found[open_]
        unseen = asked.unseen
        open_ = open_ & ~((unseen < asked.floor) | (unseen == 0))
        if not open_.any():
            break
        # The terms with the least bounds stay out as long as an unseen document that has them all can't reach the floor.
        order = np.lexsort((asked.rest, asked.item))
        so_far = np.cumsum(asked.rest[order])
        starts = np.searchsorted(asked.item[order], asked.item[order])
        so_far = so_far - np.where(starts > 0, so_far[starts - 1], 0)
        needed = order[(so_far >= asked.floor[asked.item[order]]) & (asked.rest[order] > 0) & open_[asked.item[order]]]
        asked.depth[needed] = tier + 1
        asked.rest[needed] = asked.qw[needed] * index.residual[tier + 1, asked.code[needed]]
    return asked


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = K, most_items: int = MOST_ITEMS, most_terms: int = MOST_TERMS, first_tier: int = FIRST_TIER, growth: int = GROWTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by ascending doc_id, nulls last.

    Items are searched for in blocks of some most_items items and most_terms terms, against all documents. Rows of items that repeat id and text count once; rows
    that share an id alone are items of their own, each with ranks from 1. Items without terms, or with terms that no document has, give no
    rows; nor do empty tables. Every row of docs is a document, whatever ids repeat or are null; other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    # A term has at least one letter and stands apart from the next one.
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0))).first()
    blocks = max(1, math.ceil(size / most_terms), math.ceil(n / most_items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    item_type, id_type = items.schema[item_id_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for b in range(blocks):
        some = wanted.where(block == b).orderBy("item_id", "text").collect()
        out = out.unionByName(_search_block(docs, [(r["item_id"], Counter(terms_of(r["text"]))) for r in some], item_type, id_col, text_col, k, first_tier, growth))
    return out


def _search_block(docs: DataFrame, items: list, item_type: str, id_col: str, text_col: str, k: int, first_tier: int, growth: int) -> DataFrame:
    spark = docs.sparkSession
    index = build(docs, sorted({t for _, terms in items for t in terms}), id_col, text_col, k, first_tier, growth)
    code = {t: i for i, t in enumerate(index.vocabulary)}
    entries = sorted((code[t], i, q) for i, (_, terms) in enumerate(items) for t, q in terms.items())
    codes, item, q = (np.array(x, np.int64) for x in zip(*entries)) if entries else (np.zeros(0, np.int64),) * 3
    qw = q * index.w[codes]
    asked = Asked(item, codes, qw, np.zeros(len(codes), np.int64), qw * index.residual[0, codes], np.zeros(len(items), np.int64))
    found = _exact(index, prove(index, asked))
    # The best rows of each item hold its best documents, as equal scores go by the least id of a row.
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.element_at("ids", 1).asc_nulls_last())
    top = found.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).select("item", F.explode("ids").alias("doc_id"), "score")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = top.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item long, item_id {item_type}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH doc_terms AS (
    SELECT doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce("text", ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents)
), tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2.0 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term),
lens AS (SELECT doc_id, 25 + ((75 * n * big_n) // big_l) AS m FROM lengths, totals),
asked AS (
    SELECT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS q
    FROM (SELECT item_id, unnest(regexp_extract_all(coalesce("text", ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
), scored AS (
    SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lens USING (doc_id) GROUP BY ALL
), ranked AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
