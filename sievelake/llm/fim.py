"""Fill-in-middle: texts become prefix, suffix and middle behind sentinels, in an order that their id decides.

An Arrow-batched pandas UDF cuts each whole text: finditer() of the regex library walks over its units and only their end
offsets are kept, four bytes each; two look-ups there say where the text is cut. The seeds are groups of the SHA-256 of seed
and id, so a row gives the same output in every run, whatever partition it lies in.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.shared import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80

#: A unit: a word with the blanks before it, or the blanks at the end.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

_KIND = "n long, form string, prefix_chars long, middle_chars long, output string"


def seeds(seed: int, doc_id: str | None) -> list[int]:
    """Four unsigned 32-bit numbers; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def transformed(doc_id: str | None, text: str | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; null counts as empty."""
    text = text or ""
    ends = array("I", (m.end() for m in UNIT.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = seeds(seed, doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    cuts = h1 % (n + 1), h2 % (n + 1)
    a, b = (ends[cut - 1] if cut else 0 for cut in sorted(cuts))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    rate percent of the texts are cut, spm_rate percent of those begin with the suffix. A null text is empty; empty texts and those
    that hold a sentinel stay plain. A null id seeds like an empty one. Repeated rows are so many rows, equal ids cut equal texts alike, other
    columns are ignored and an empty table gives no rows. A worker holds one batch of rows and the offsets of one text.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(_KIND)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(i, t, seed, rate, spm_rate) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = docs.select(F.col(id_col).alias("doc_id"), cut(F.col(id_col).cast("string"), F.col(text_col)).alias("cut"))
    return made.select("doc_id", "cut.*")


def restored(output: Column, form: Column) -> Column:
    """The exact text that transform() made output from. No cut text holds a sentinel, so each stands there once and parts it."""
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """What transform() gives, with digests of the output and of the text read back from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE = r"""
WITH units AS (
    SELECT doc_id, coalesce("text", '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce("text", ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), seeded AS (
    SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM units
), cut AS (
    SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS p,
           array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS m, array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS s
    FROM seeded
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
