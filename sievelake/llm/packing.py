"""Best-fit packing of token sequences with large-item matching.

Lengths are whole numbers up to the capacity, so the plan depends on one bounded table alone: how many pieces there are
of each length. plan() works on that histogram. Pieces longer than a third of the capacity go at most two to a
sequence: the longest takes the longest partner that fits. The smaller ones then go, longest first, each into the
tightest gap that takes it. Equal sequences are handled as one run, so the plan's size depends on the capacity
and not on the number of documents. Every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.shared import WHITE, materialize, n_partitions, small_batches, unused

CAPACITY = 4096
END_ID = 1

#: Bytes that a Python worker may keep of words with their ids, and of parts of words; beyond that it starts afresh. What is forgotten is encoded again, which costs
#: twenty times a look-up: texts of 100,000s of rare words take twice the time with a quarter of this.
WORD_BYTES, PART_BYTES = 140_000_000, 70_000_000
#: What an entry costs beside its letters and ids: two objects and a place in a table.
_ENTRY = 200
_encoders: dict[tuple, "WordEncoder"] = {}

# How the tokenizer parts words, and how byte-level models write a byte as a character.
_PARTS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Below this, lower case is one character for one and texts are composed already; the one exception is named.
_PLAIN, _NOT_PLAIN = "\u0250", "\u0130"


class _Kept(dict):
    """word -> its ids as bytes, made when first asked for; it never holds more than so many bytes.

    When half of that is full it becomes the old half, from which words that are asked for again come back; the rest of them goes at the next time.
    """

    def __init__(self, most: int):
        self.most, self.size, self.old = most, 0, {}

    def made(self, word: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, word: str) -> bytes:
        got = self.old.pop(word, None)
        if got is None:
            got = self.made(word)
        self.size += len(word) + len(got) + _ENTRY
        if 2 * self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = len(word) + len(got) + _ENTRY
        self[word] = got
        return got


class _Parts(_Kept):
    def __init__(self, model):
        super().__init__(PART_BYTES)
        self.model = model

    def made(self, part: str) -> bytes:
        chars = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_AS_CHAR)
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()


class WordEncoder(_Kept):
    """word -> its ids as little-endian unsigned 32-bit integers, by a lower-casing word tokenizer, made when first asked for.

    The tokenizer drops white space and no token reaches across it, so texts are encoded word by word. Words of plain Latin
    characters are parted as the tokenizer would and their parts given to its model; all others go to the tokenizer whole, and so
    do texts that hold the string of a special token, unless special_as_text is set: then such strings are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        super().__init__(WORD_BYTES)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.parts = _Parts(self.tok.model)

    def made(self, word: str) -> bytes:
        if word.isascii() or (max(word) < _PLAIN and _NOT_PLAIN not in word):
            low = word.lower()
            # Most words are letters, or letters and one more character: these need no pattern.
            if low.isalpha():
                return self.parts[low]
            if low[:-1].isalpha() and "!" <= low[-1] <= "~":
                return self.parts[low[:-1]] + self.parts[low[-1]]
            return b"".join([self.parts[p] for p in _PARTS.findall(low)])
        return self.whole(word)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.whole(text)
        try:
            text.encode("latin-1")
            text = text.lower()  # one character for one here, so that a word and its capital form are kept once
        except UnicodeEncodeError:
            pass
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join([self[w] for w in words])


def word_encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One encoder for each process, file and way of reading special tokens."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = WordEncoder(path, special_as_text)
    return _encoders[path, special_as_text]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids binary) of every row's text with end_id appended.

    The string of a special token in a text gives that token's id, as the tokenizer's default is; with special_as_text it is ordinary text.

    Null and empty texts are the end id alone. Longer documents are cut into pieces of exactly capacity ids, the last one excepted.
    ids holds little-endian unsigned 32-bit integers. Other columns are ignored, repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = word_encoder(path, special_as_text)
        for b in batches:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, x in zip(out.values(), (doc_id, k, at // 4, len(part) // 4, part)):
                        c.append(x)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds)], names=list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, first_rank, n, first_sequence, per_sequence, offset).

    Pieces of a length with ranks first_rank .. first_rank + n - 1 go, per_sequence to each, into the sequences from first_sequence on,
    at offset and then side by side. The sequences are numbered from 0.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, number of sequences)
    n_sequences = 0

    def place(s: int, n: int, first: int, per: int, offset: int) -> None:
        rows.append((s, rank[s], n, first, per, offset))
        rank[s] += n
        left[s] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        # The longest partner that fits, s itself included if there are two.
        k = bisect.bisect_right(large, capacity - s) - 1
        t = large[k] if k >= 0 else None
        if t == s:
            n = left[s] // 2
            if n:
                place(s, 2 * n, n_sequences, 2, 0)
                gaps[capacity - 2 * s].append((n_sequences, n))
                n_sequences += n
            elif k:
                t = large[k - 1]
            else:
                t = None
        if left[s] and t != s:
            n = min(left[s], left[t]) if t else left[s]
            place(s, n, n_sequences, 1, 0)
            if t:
                place(t, n, n_sequences, 1, s)
            gaps[capacity - s - (t or 0)].append((n_sequences, n))
            n_sequences += n
        large = [x for x in large if left[x]]

    open_gaps = sorted(g for g in gaps if g)
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            k = bisect.bisect_left(open_gaps, s)
            if k == len(open_gaps):
                n = -(-left[s] // (capacity // s))  # new sequences
                gaps[capacity].append((n_sequences, n))
                n_sequences += n
                open_gaps.append(capacity)
                continue
            g = open_gaps[k]
            first, n = gaps[g].pop()
            per = g // s  # a sequence that just took one is the tightest as long as it takes another
            if left[s] >= n * per:
                used = n
            elif left[s] >= per:
                used = left[s] // per
            else:
                used, per = 1, left[s]
            if used < n:
                gaps[g].append((first + used, n - used))
            if not gaps[g]:
                del gaps[g], open_gaps[k]
            place(s, used * per, first, per, capacity - g)
            if (rest := g - per * s) > 0:
                if not gaps.get(rest):
                    bisect.insort(open_gaps, rest)
                gaps[rest].append((first, used))
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset long added; every row is placed once.

    The driver sees a histogram of at most capacity rows, whatever the input. Ranks within a length come from salted
    windows and the sums of the salts before, so a length that a third of all pieces share is dealt to many tasks.
    Repeated rows are packed as so many pieces. An empty table gives an empty one. Columns of pieces that are named
    sequence_id or offset are replaced; null ids are like any other.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salts = max(64, n_partitions(spark))
    salt, nth_, rank_, n_, before_ = unused(pieces, "_salt", "_nth", "_rank", "_n", "_before")
    keyed = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    keyed = materialize(keyed, "pieces")
    cells = keyed.groupBy("length", salt).agg(F.count("*").alias(n_))
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum(n_).alias("n")).collect()}
    by = defaultdict(list)
    for row in plan(counts, capacity):
        by[row[0]].append(row[1:])
    tables = {s: np.array(sorted(r), np.int64).T for s, r in by.items()}
    placed = spark.sparkContext.broadcast(tables)  # bounded by the capacity, see plan()

    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn(before_, F.coalesce(F.sum(n_).over(before), F.lit(0))).drop(n_)
    nth = Window.partitionBy("length", salt).orderBy("doc_id", "piece")
    ranked = keyed.withColumn(nth_, F.row_number().over(nth)).join(starts, ["length", salt])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col(nth_) - 1 + F.col(before_)).cast("long").alias(rank_))

    columns = pieces.columns

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column(rank_).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                mine = length == s
                first_rank, _, first, per, offset = placed.value[int(s)]
                k = np.searchsorted(first_rank, rank[mine], "right") - 1
                nth = rank[mine] - first_rank[k]
                seq[mine] = first[k] + nth // per[k]
                off[mine] = offset[k] + nth % per[k] * s
            keep = b.select(columns)
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack every document: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(tokenize_pieces(docs, tokenizer_path))


def packed_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """As pack_documents, with the CRC-32 of ids for the ids, so that only slim rows are shuffled."""
    pieces = tokenize_pieces(docs, tokenizer_path)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)
