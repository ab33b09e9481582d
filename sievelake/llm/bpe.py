"""Byte-level BPE over a distributed table of distinct words.

1. Texts are exploded into pre-tokens with positions. The most frequent ones, a table of bounded size, are encoded once and joined by
   broadcast where the texts are read; they leave their number at their position.
2. All other pre-tokens are shuffled on the word, so that each distinct one lies in one task and is encoded there once. No word
   that is frequent gets here, so none gathers in one task.
3. Their ids are shuffled back to the document and put in at their positions. Decoding joins ids to the table of token bytes, which
   the ranks bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.shared import WHITE, materialize, release_shuffles, small_batches

#: Bounds on the words that are joined by broadcast: their number and the sum of their bytes.
HOT_WORDS, HOT_BYTES = 600_000, 32_000_000  # numbers must stay below 2^21 - 1 + _TWO
#: Distinct stretches of text that a Python worker keeps at once.
KEPT = 400_000

_HOLE = 0xFFFFFFFF
_encoders: dict[str, "object"] = {}
#: The table of hot words last used in this process, and the stretches encoded with it.
_kept: list = []
_near_blank = re.compile(r"\s |^ ")
_cut = re.compile(r"(?<=\S)(?= )")


def encoder(path: str):
    """tiktoken's encoder for a file of ranks; one for each process and file."""
    import tiktoken

    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(k, b"") for k in range(max(ranks) + 1)]


def pattern():
    """The pre-tokens' pattern, its white space spelt out."""
    import regex

    spelt = public_tokenizers.PATTERN.replace("[^\\s", "[^" + WHITE).replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
    return regex.compile(spelt)


def stretches(text: str) -> list[str]:
    """The text cut before each space that follows no white space. No pre-token reaches across such a cut."""
    if _near_blank.search(text):
        return _cut.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the pre-tokens seen twice or more among some hundred thousand stretches of text.

    It serves to find the frequent ones; a word that it lacks or counts short is encoded all the same, in the shuffle on the word.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        find = pattern().findall
        seen: Counter = Counter()

        def words():
            out: dict[str, int] = {}
            for s, n in seen.items():
                for w in find(s):
                    out[w] = out.get(w, 0) + n
            seen.clear()
            often = [(w, n) for w, n in out.items() if n > 1]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(stretches(text))
            if len(seen) > KEPT:
                yield words()
        yield words()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hot_words(docs: DataFrame, path: str, most: int = HOT_WORDS, most_bytes: int = HOT_BYTES) -> pa.Table:
    """word, ids of the most frequent words within both bounds, the most frequent first. An Arrow table, as that is small on the driver.

    The threshold comes from a histogram of the counts by eighths of a power of two, of at most some 500 rows.
    """
    counts = materialize(word_counts(docs), "words")
    release_shuffles(docs.sparkSession)
    level = F.floor(F.log2("n") * 8)
    hist = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    words = size = 0
    least = None
    for r in sorted(hist.collect(), key=lambda r: -r.level):
        words, size = words + r.words, size + r.bytes
        if words > most or size > most_bytes:
            break
        least = r.level
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = [array("I", enc.encode_ordinary(w)).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    rows = counts.where(level >= least).mapInArrow(run, "word string, n long, ids binary").toArrow()  # within the bounds
    return rows.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"]).combine_chunks()


class _Stretches(dict):
    """stretch of text -> the numbers of its words as bytes; with holes, a pair of those bytes and the words that belong there."""

    def __init__(self, index: dict[str, int]):
        self.index, self.find = index, pattern().findall

    def __missing__(self, s: str):
        words = self.find(s)
        got = array("I", [self.index.get(w, _HOLE) for w in words])
        cold = tuple(w for w, k in zip(words, got) if k == _HOLE)
        value = self[s] = (got.tobytes(), cold) if cold else got.tobytes()
        return value


#: Numbers below the first bound take one byte of a blob, those below the second two, all others three.
_ONE, _TWO = 160, 160 + (64 << 8)


def _pack(numbers: bytes, cold: list[str]) -> bytes:
    """Numbers below 2^21 or holes, and the words of the holes, small: frequent words have small numbers, and first, second and third bytes lie together."""
    a = np.frombuffer(numbers, np.uint32)
    one, two = a < _ONE, a < _TWO
    third = np.where(a == _HOLE, (1 << 21) - 1, a - _TWO)
    first = np.where(one, a, np.where(two, _ONE + ((a - _ONE) >> 8), 224 + (third >> 16))).astype(np.uint8)
    second = np.where(two, a - _ONE, third >> 8)[~one].astype(np.uint8)
    names = b"".join(len(w).to_bytes(4, "little") + w for w in (x.encode() for x in cold))
    raw = first.tobytes() + second.tobytes() + third[~two].astype(np.uint8).tobytes() + names
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[str]]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    a = np.frombuffer(raw, np.uint8, n).astype(np.uint32)
    one, two = a < _ONE, a < 224
    many, few = n - int(one.sum()), n - int(two.sum())
    second = np.zeros(n, np.uint32)
    second[~one] = np.frombuffer(raw, np.uint8, many, n)
    third = np.zeros(n, np.uint32)
    third[~two] = np.frombuffer(raw, np.uint8, few, n + many)
    far = (a - 224) << 16 | second << 8 | third
    out = np.where(one, a, np.where(two, ((a - _ONE) << 8 | second) + _ONE, np.where(far == (1 << 21) - 1, _HOLE, far + _TWO))).astype(np.uint32)
    names, at = [], n + many + few
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        names.append(raw[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out, names


def _numbered(docs: DataFrame, hot) -> DataFrame:
    """(doc_id, key, sub, blob): per row the numbers of its hot words, with holes and the words that belong there. key and sub are two hashes, 96 bits, of doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = hot.value
        if not _kept or _kept[0] is not words:
            _kept[:] = words, _Stretches({w: k for k, w in enumerate(words.column("word").to_pylist())})
        kept = _kept[1]
        for b in batches:
            blobs = []
            for text in b.column(1).to_pylist():
                found = [kept[s] for s in stretches(text)] if text else []
                cold = [w for v in found if type(v) is tuple for w in v[1]]
                blobs.append(_pack(b"".join([v[0] if type(v) is tuple else v for v in found]), cold))
                if len(kept) > KEPT:
                    kept.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(blobs, pa.binary())], names=["doc_id", "key", "sub", "blob"])

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.hash("text", "doc_id").alias("sub"))
    return rows.mapInArrow(run, f"doc_id {kind}, key long, sub int, blob binary")


def encode(docs: DataFrame, ranks_path: str | None = None, hot: int = HOT_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, ids binary) of every row's whole text; null and empty texts have no ids.

    ids are those of tiktoken without special tokens, as little-endian unsigned 32-bit integers. With digest: (doc_id, n_tokens,
    ids_sha256, decoded_sha256), the ids decoded again, made where the ids are put together. Rows that repeat are encoded each.
    """
    spark = docs.sparkSession
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = spark.sparkContext.broadcast(hot_words(docs, path, hot))  # within HOT_WORDS and HOT_BYTES
    # Both uses of numbered read all its columns, so that Spark deals it out once.
    numbered = _numbered(docs, known).repartition("key", "sub")

    def explode(batches):
        for b in batches:
            keys, subs, pos, words = [], [], [], []
            for key, sub, blob in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)]):
                names = _unpack(blob)[1]
                keys += [key] * len(names)
                subs += [sub] * len(names)
                pos += range(len(names))
                words += names
            columns = [pa.array(keys, pa.int64()), pa.array(subs, pa.int32()), pa.array(pos, pa.int32()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "sub", "pos", "word"])

    def encode_each(batches):
        enc = encoder(path)
        unit = "H" if enc.n_vocab <= 1 << 16 else "I"
        last, ids = None, b""
        for b in batches:
            out = []
            for w, k in zip(b.column(3).to_pylist(), b.column(2).to_pylist()):  # sorted, so each distinct word comes once
                if w != last:
                    last, ids = w, array(unit, enc.encode_ordinary(w)).tobytes()
                out.append(k.to_bytes(4, "big") + ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["key", "sub", "entry"])

    cold = numbered.mapInArrow(explode, "key long, sub int, pos int, word string")
    found = cold.repartition("word").sortWithinPartitions("word").mapInArrow(encode_each, "key long, sub int, entry binary")
    # An entry is a position and the ids there, in one short value. Rows alike in id and text share their entries.
    fills = found.groupBy("key", "sub").agg(F.collect_set("entry").alias("fills"))
    whole = numbered.join(fills, ["key", "sub"], "left").select("doc_id", "blob", "fills")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hot_ids = known.value.column("ids").to_pylist()
        unit = np.dtype("<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4")
        tokens = token_bytes(path) if digest else []
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = []
            for blob, fill in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rest = iter([np.frombuffer(x, unit, offset=4).astype("<u4").tobytes() for x in sorted(fill or ())])
                ids.append(b"".join([hot_ids[k] if k != _HOLE else next(rest) for k in _unpack(blob)[0].tolist()]))
            if digest:
                decoded = [sha(b"".join([tokens[k] for k in np.frombuffer(x, "<u4").tolist()])) for x in ids]
                columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary"
    return whole.mapInArrow(run, f"doc_id {kind}, {out}")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids binary) with decoded binary added: the bytes of its ids. Null ids give null."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    small_batches(encoded.sparkSession)

    def run(batches):
        known = token_bytes(path)
        for b in batches:
            out = [None if x is None else b"".join([known[k] for k in np.frombuffer(x, "<u4").tolist()]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
