"""Best-fit packing of tokenised documents with certified bin counts.

Documents become pieces of at most `capacity` tokens. Pieces are dealt evenly to partitions of a bounded number of
rows, and each runs best-fit decreasing. A lower bound from dual feasible functions certifies a partition's bin count when the two
meet. Partitions are then joined into groups of FAN, these into groups of FAN groups, and so on: at each level a group is certified when its bins
together meet the bound of all its pieces. A group with a gap exchanges documents: the pieces of its loose bins (those not well
filled) go to one task, best-fit decreasing runs again over them, and the new packing stays if it has fewer bins. Certified groups are left alone. It
ends when the whole meets its bound, or when the last group, which is the whole, has exchanged all that is not full.

Bounds come from counts of lengths, which add up from level to level, so the pieces themselves are read once, and afterwards the
loose ones only. No task holds more than POOL_ROWS rows of a few numbers each: larger pools are dealt, whole bins at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.common import at_work, by_bytes, discard, materialize

CAPACITY = 4096
END_ID = 1
ROWS_A_PARTITION = 20_000
POOL_ROWS = 1_000_000
FAN = 16
WELL_FILLED = 0.995
WORDS_KEPT = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, part long, fill long"

_encoders: dict[str, "WordEncoder"] = {}


#: Characters for which Python and the tokenizer agree on letters, digits, white space and lower case, and that are in
#: composed form already: ASCII without U+001C to U+001F, Latin-1 and Latin Extended-A, Cyrillic, general punctuation.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff\u0101-\u017f\u0430-\u045f"
_PLAIN = re.compile("[\x00-\x1b\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0132-\u0148\u014a-\u0177\u017a-\u017e\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: The tokenizer's own way to cut a text into words.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


#: The part of a tokenizer's description that _WORDS and _PLAIN stand for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}

#: The byte-level alphabet: bytes that print stand for themselves, the others for the characters from U+0100 on.
_PRINT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}


class Memory:
    """Two generations of a mapping: what was not met while the younger one filled up is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, met: set[str]) -> set[str]:
        """Those of `met` that are not known; afterwards the others are in `young`."""
        new = met.difference(self.young)
        if new and len(self.young) + len(new) > self.most:
            self.old, self.young, new = self.young, {}, met
        if new and self.old:
            old = self.old
            kept = [w for w in new if w in old]
            self.young.update((w, old[w]) for w in kept)
            new = new.difference(kept)
        return new


class WordEncoder:
    """Ids of a text as little-endian bytes, with a memory of the words met lately.

    The tokenizer never joins characters over white space, and cuts what lies between into words (letters, a digit, other characters)
    within which it merges, so a text's ids are those of its words in turn. New words are encoded together by the merges
    alone; each word's last id, and no other, carries the end-of-word mark, which tells them apart. A text with other
    characters than _PLAIN, or with the start of a special token, is encoded by the tokenizer as a whole, and so is every text where
    the tokenizer is described in another way than this rests on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.known = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and all(told["model"].get(k) == v for k, v in _MODEL.items()) and told["post_processor"] is None and all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.runs, self.words = Memory(WORDS_KEPT), Memory(WORDS_KEPT)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            plain = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_ALPHABET) for w in some]
            ids = np.array(self.merges.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            raw = ids.tobytes()
            self.words.young.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _learn_runs(self, runs: list[str]) -> None:
        """Encode what lies between white space, a bounded number at a time."""
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            cut = [_WORDS.findall(r) for r in some]
            if new := self.words.missing({w for c in cut for w in c}):
                self._learn_words(list(new))
            get = self.words.young.__getitem__
            self.runs.young.update((r, b"".join(map(get, c))) for r, c in zip(some, cut, strict=True))

    def ids(self, text: str) -> bytes:
        if not self.known or "<|" in text or not _PLAIN.fullmatch(text):
            return self._encode(text).tobytes()
        runs = text.lower().split()
        if new := self.runs.missing(set(runs)):
            self._learn_runs(list(new))
        return b"".join(map(self.runs.young.__getitem__, runs))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    step = 4 * capacity
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        at_work("packing", _encoders.clear)
        enc = encoder(tokenizer)
        for batch in batches:
            rows = [(d, *p) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in cut(enc.ids(t or "") + end, capacity)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_bytes(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that pieces need at least; counts[x]: pieces of length x. The best of two families of dual feasible functions."""
    x = np.nonzero(counts)[0].astype(np.int64)
    n = counts[x].astype(np.int64)
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // capacity)
    for eps in np.unique(np.minimum(x, capacity - x)):
        if 0 < eps <= capacity // 2:
            f = np.where(x > capacity - eps, capacity, np.where(x < eps, 0, x))
            best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 33):
        up = (k + 1) * x
        f = np.where(up % capacity == 0, k * x, up // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit for lengths in the order given: each piece's bin and offset, and each bin's fill."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, fill = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        if fits := some >> x:
            left = x + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += x
        left -= x
        if not room[left]:
            some |= 1 << left
        room[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _repacked(pdf: pd.DataFrame, capacity: int) -> tuple[pd.DataFrame, np.ndarray, int]:
    """Pieces in the order of best-fit decreasing, with offset and fill set, their bins, and the number of bins."""
    pdf = pdf.sort_values(["length", "ids_crc32", "start"], ascending=[False, True, True], kind="stable")
    bins, offsets, fill = best_fit(pdf["length"].to_numpy(), capacity)
    pdf["offset"], pdf["fill"] = offsets, fill[bins]
    return pdf, bins, len(fill)


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(pdf), 10_000):
        yield pdf.iloc[at : at + 10_000]


def _packed(rows: DataFrame, number: int, capacity: int) -> DataFrame:
    """Best-fit decreasing within `number` even partitions."""

    def run(batches):
        got = [b for b in batches if len(b)]
        if got:
            pdf, bins, _ = _repacked(pd.concat(got, ignore_index=True), capacity)
            part = TaskContext.get().partitionId()
            pdf["sequence_id"], pdf["part"] = (part << 32) + bins, part
            yield from _slices(pdf[[c.split()[0] for c in PACKED.split(", ")]])

    return rows.repartition(number).mapInPandas(run, PACKED)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of rows ordered by it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for _, rows in b.groupby(keys, sort=False):
            if held and any(held[0][k].iloc[0] != rows[k].iloc[0] for k in keys):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def _bounds(lengths: DataFrame, capacity: int) -> DataFrame:
    """team and bound, from team, length and n."""

    def run(batches):
        for rows in _runs(batches, ["team"]):
            counts = np.bincount(rows["length"], rows["n"], capacity + 1).astype(np.int64)
            yield pd.DataFrame({"team": [rows["team"].iloc[0]], "bound": [lower_bound(counts, capacity)]})

    return lengths.repartition("team").sortWithinPartitions("team").mapInPandas(run, "team long, bound long")


def _exchanged(pool: DataFrame, teams: DataFrame, capacity: int) -> DataFrame:
    """The pool's pieces packed anew within each team (team, tasks), where that takes fewer bins. Whole bins are dealt to the tasks of a team."""
    columns = [c.split()[0] for c in PACKED.split(", ")]
    rows = pool.join(teams, "team").withColumn("task", F.pmod(F.xxhash64("sequence_id"), F.col("tasks")))

    def run(batches):
        for held in _runs(batches, ["team", "task"]):
            old = np.unique(held["sequence_id"])
            fresh, bins, n = _repacked(held, capacity)
            if n < len(old):
                fresh["sequence_id"] = old[:n][bins]
                yield from _slices(fresh[columns])
            else:
                yield from _slices(held[columns])

    return rows.repartition("team", "task").sortWithinPartitions("team", "task").mapInPandas(run, PACKED)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences of a packing, the least number that its pieces need by the bound, and the gap between the two."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    n, bound = packed.where("offset = 0").count(), lower_bound(counts, capacity)
    return {"sequences": n, "bound": bound, "gap": n - bound}


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rows_a_partition: int = ROWS_A_PARTITION, fan: int = FAN, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Pack every document; returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end id only. Repeated rows are packed as often as they occur. A
    null doc_id stays null. An empty table gives no rows. Other columns are ignored. Texts of any length are encoded
    whole and cut into full pieces, of which only the last may be shorter.
    """
    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    cutted = materialize(spark, pieces(docs, tokenizer, capacity), "pieces")
    number = max(1, -(-cutted.count() // rows_a_partition))
    packed = materialize(spark, _packed(cutted, number, capacity), "packed")
    discard(spark, cutted)
    state = certificate(packed, capacity)
    if not state["gap"]:
        return packed.select(*result)
    loose = F.col("fill") < WELL_FILLED * capacity
    settled, pool = packed.where(~loose), packed.where(loose)
    lengths = materialize(spark, packed.groupBy(F.col("part").alias("team"), "length").agg(F.count("*").alias("n")), "lengths")
    full = materialize(spark, settled.where("offset = 0").groupBy(F.col("part").alias("team")).agg(F.count("*").alias("bins")), "full-bins")
    total, teams = state["sequences"], number

    def exchange(pool: DataFrame, lengths: DataFrame, full: DataFrame, size: int) -> tuple[DataFrame, int]:
        """The pool after an exchange in the teams of `size` partitions that have a gap, and how many bins that saved."""
        own = pool.withColumn("team", F.floor(F.col("part") / size).cast("long"))
        open_ = own.groupBy("team").agg(F.count_if(F.col("offset") == 0).alias("open"), F.count("*").alias("rows")).join(full, "team", "left")
        gaps = open_.join(_bounds(lengths, capacity), "team").where(F.col("open") + F.coalesce("bins", F.lit(0)) > F.col("bound"))
        gaps = materialize(spark, gaps.select("team", F.ceil(F.col("rows") / pool_rows).cast("long").alias("tasks")), "gaps")
        fresh = _exchanged(own, gaps, capacity).unionByName(own.join(gaps, "team", "left_anti").drop("team"))
        fresh = materialize(spark, fresh, "exchanged")
        return fresh, pool.where("offset = 0").count() - fresh.where("offset = 0").count()

    size = 1
    while total > state["bound"] and teams > 1:
        size, teams = size * fan, -(-teams // fan)
        merge = lambda df, n: materialize(spark, df.groupBy(F.floor(F.col("team") / fan).cast("long").alias("team"), *([] if n == "bins" else ["length"])).agg(F.sum(n).alias(n)), n)
        lengths, full = merge(lengths, "n"), merge(full, "bins")
        pool, saved = exchange(pool, lengths, full, size)
        total -= saved
    if total > state["bound"]:
        # The whole has a gap: once more with every bin that is not full.
        every = settled.unionByName(pool)
        settled, pool = every.where(F.col("fill") >= capacity), every.where(F.col("fill") < capacity)
        full = settled.where("offset = 0").groupBy(F.lit(0).cast("long").alias("team")).agg(F.count("*").alias("bins"))
        pool, saved = exchange(pool, lengths.groupBy(F.lit(0).cast("long").alias("team"), "length").agg(F.sum("n").alias("n")), full, size)
    return settled.unionByName(pool).select(*result)
