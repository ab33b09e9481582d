"""Substring dedup by sliding sentence spans.

A text is cut into units: sentences, ended by a full stop, question or exclamation mark before white space, or by a line feed; a
sentence of more than UNIT_WORDS words is cut by its content: after the word of the least hash of every REACH words in a row. From every unit the shortest run of
at least SPAN units and LEAST_WORDS words is hashed, so that lone short lines which many documents share are no passage. Runs are joined over all documents, and units that
a repeated run covers are removed, save where the run comes first: in the least document, at the least position there.

Two copies of a passage with the same line feeds are cut at the same words, wherever in a sentence they begin and end, but for some words at both ends. If the
sentence that an end of the passage lies in is long in both documents, all cuts from 2 * REACH - 1 words on agree; if it is short in one of them, at most
UNIT_WORDS words of the passage belong to it. So of 51 words at least 51 - 2 * 13 = 25 lie between cuts that agree, and as units have 12 words at most, these are
3 units or more and hold a run.

Texts are cut and hashed once, into a table of runs; a run that a text holds several times is one row there, and its later places in that text are marked for removal at once.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sievelake.llm.shared import drop_table, materialize, release_shuffles, small_batches, unused

SPAN = 3
UNIT_WORDS = 12
REACH = 7
LEAST_WORDS = 16

_PARTS = re.compile(r"(?<=[.!?])(?=\s)|(?<=\n)")
_WORDS = re.compile(r"\S+")


def cuts(words: list[str]) -> list[int]:
    """The numbers of words before each cut of a long sentence, its end included; the last of equal words counts as the least."""
    top = (1 << 32) - 1
    keys = [(xxhash.xxh32_intdigest(w) << 32) + top - k for k, w in enumerate(words)]
    least = set(map(min, *[keys[k:] for k in range(REACH)]))
    return sorted({len(words), *(top - (key & top) + 1 for key in least)})


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, content) of each unit: content is its words with single spaces, white space belongs to no unit."""
    out = []
    at = 0
    for part in _PARTS.split(text):
        words = part.split()
        n = len(words)
        if n and n <= UNIT_WORDS:
            lead = len(part) - len(part.lstrip())
            out.append((at + lead, at + len(part.rstrip()), n, " ".join(words)))
        elif n:
            found = [m.span() for m in _WORDS.finditer(part)]
            k = 0
            for end in cuts(words):
                out.append((at + found[k][0], at + found[end - 1][1], end - k, " ".join(words[k:end])))
                k = end
        at += len(part)
    return out


def runs(text: str | None, span: int = SPAN, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(position of its first unit, number of units, signed 64-bit hash) of the run from each unit, if the text is long enough for it."""
    found = units(text or "")
    out = []
    end = words = 0  # the run so far is found[k:end]
    for k in range(len(found)):
        while end < len(found) and (end < k + span or words < least):
            words += found[end][2]
            end += 1
        if end < k + span or words < least:
            break
        h = xxhash.xxh64_intdigest("\n".join([u[3] for u in found[k:end]]))
        out.append((k, end - k, h - (1 << 64) if h >> 63 else h))
        words -= found[k][2]
    return out


def without(text: str, positions: set[int]) -> str:
    """The text without those units; white space after a removed unit goes too, the rest stays as it is."""
    found = units(text)
    out, at = [], 0
    for k, (start, end, _, _) in enumerate(found):
        if k in positions:
            out.append(text[at:start])
            at = found[k + 1][0] if k + 1 < len(found) else len(text)
    out.append(text[at:])
    return "".join(out).rstrip() if found and len(found) - 1 in positions else "".join(out)


def span_hashes(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """(h long, doc_id, digest long, pos int, n int, again array<int>) of every distinct run of every row; null and empty texts have none.

    pos is the run's first place in the text, n its number of units, digest a hash of the text; again has the units that the run's later places in
    the same text cover, or null.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, pos, n, h, again = [], [], [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                first: dict[int, int] = {}
                for k, m, x in runs(text, span, least):
                    if (place := first.setdefault(x, len(h))) == len(h):
                        at.append(row)
                        pos.append(k)
                        n.append(m)
                        h.append(x)
                        again.append(None)
                    else:
                        seen = again[place] = again[place] or []
                        seen.extend(range(max(k, seen[-1] + 1) if seen else k, k + m))
            rows = pa.array(at, pa.int32())
            columns = [pa.array(h, pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(again, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "doc_id", "digest", "pos", "n", "again"])

    return docs.select("doc_id", _digest(), "text").mapInArrow(run, f"h long, doc_id {kind}, digest long, pos int, n int, again array<int>")


def _digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")


def repeated_units(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, digest, positions array<int>): the units to remove, for each document that has any.

    Documents are ordered by doc_id, nulls last, then by the hash of the text. Runs are counted with partial sums before the shuffle. Both sides of
    the join are tables, so that Spark splits the partition of a very common run, which meets one row on the other side.
    """
    spark = docs.sparkSession
    hashes = materialize(span_hashes(docs, span, least), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    repeated = hashes.groupBy("h").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    repeated = materialize(repeated.select("h", "first"), "repeated-runs")
    release_shuffles(spark)
    later = hashes.select("h", "doc_id", "digest", "pos", "n").join(repeated, "h").where("not (doc_id <=> first.doc_id and digest = first.digest)")
    covered = later.select("doc_id", "digest", F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1).alias("some"))
    covered = covered.union(hashes.where("again is not null").select("doc_id", "digest", "again"))
    covered = covered.groupBy("doc_id", "digest").agg(F.collect_set("some").alias("all"))
    covered = materialize(covered.select("doc_id", "digest", F.array_distinct(F.flatten("all")).alias("positions")), "covered")
    release_shuffles(spark)
    drop_table(hashes)
    drop_table(repeated)
    return covered


def dedup_spans(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """Every row of docs with its text less the units that repeat an earlier run; all columns stay, n_chars follows the text if there is one.

    A text that loses nothing is unchanged to the byte, a null text stays null, a text all of whose units go becomes empty. Rows alike in doc_id
    and text are one document and get the same text; rows that share a doc_id and differ in text are two documents, and so are rows without
    doc_id, which come after all others. An empty table gives an empty one. Columns of any other name pass through.
    """
    id_, digest, positions = unused(docs, "_id", "_digest", "_positions")
    gone = repeated_units(docs.select("doc_id", "text"), span, least).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.col("positions").alias(positions))
    marked = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (_digest() == F.col(digest)), "left")
    at = docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    marked = marked.select(*[F.col(f"`{c}`") for c in docs.columns], positions)

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            gone = columns.pop()
            if gone.null_count < len(gone):
                texts = columns[at].to_pylist()
                changed = {}
                for k, p in enumerate(gone.to_pylist()):
                    if p and texts[k]:
                        changed[k] = texts[k] = without(texts[k], set(p))
                columns[at] = pa.array(texts, columns[at].type)
                if n_at is not None:
                    lengths = columns[n_at].to_pylist()
                    for k, t in changed.items():
                        lengths[k] = len(t)
                    columns[n_at] = pa.array(lengths, columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    # By number, as mapInArrow() can't pass columns whose names hold dots.
    plain = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])
    return marked.toDF(*plain.names, "positions").mapInArrow(run, plain).toDF(*docs.columns)
