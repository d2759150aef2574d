"""Jaccard self-join on word n-grams by counts in blocks, and the components of its links.

Two documents link when 100 * |A and B| >= percent * |A or B|. The join is exact up to 64-bit hashing of n-grams:

1. Documents with equal sets are one class; classes are numbered, and all that follows is about classes.
2. Sets are partitioned. Linked sets differ in few n-grams, fewer than the number of parts that their size class is hashed
   into, so some part is equal in both; classes that share a part fall into one block, named after the smallest
   class with that part, its representative. A part has about ten n-grams, so a passage or line that many documents share does not
   bring them together, as single n-grams would.
3. In a block, sizes of intersections are counted exactly for many documents at once: n-grams that one in FREQUENT holds by a
   product of 0-1 matrices, rarer ones along lists of their documents; n-grams of one document count for nothing. Only documents
   whose sizes allow a link are met.
4. A block larger than TILE_NGRAMS is cut into shards, and the representative goes to each: members that link with
   it, or with one that does, need not meet across shards any more. Only the rest of a block, those outside its largest component, then
   meets others, of all blocks with a rest at once: sets that link share one of their rarest n-grams (see _far_links), so pairs
   that share one, and could still link by what is left of both, are compared. A large group of near copies costs in proportion to its
   size, whether they link or not, but for those that differ from most others in hardly more than a link allows.
5. The links found span the components; alternating large-star and small-star steps join them.

Joins on keys that many rows may share (a part, a block, a class) are plain sort-merge joins, whose skewed partitions adaptive execution
splits. Parts that very many classes share are told from a sample of classes and met by partial aggregation and a
broadcast instead of a shuffle; the sample steers where rows go, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.common import DOCUMENT, at_work, by_bytes, discard, document_key, materialize

TILE_NGRAMS = 300_000
#: Rows of n-grams that leave Python at once.
GRAM_ROWS = 1 << 17
#: Bytes of text hashed at once; cells counted at once; an n-gram of one document in FREQUENT goes to the matrix product.
CHUNK, CELLS, FREQUENT = 1 << 18, 1 << 22, 32
#: In classes of so few parts, documents with an empty part are hashed into EXTRA more partitions: the part that a link has
#: in common might be the empty one, which is not used.
FEW_PARTS, EXTRA = 32, 6
GROWTH = 1.5
#: A part is common when it is in 1/COMMON of a sample of one class in SAMPLED, or in 1/COMMON of LEAST_SAMPLE classes of it.
COMMON, SAMPLED, LEAST_SAMPLE = 512, 64, 8192

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _places(at: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a word."""
    return _mix((at.astype(np.uint64) + np.uint64(1)) * _GOLDEN) | np.uint64(1)


_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
#: A value for each byte: A-Z have those of a-z, white space none.
_BYTES = _mix(np.arange(1000, 1256, dtype=np.uint64) * _GOLDEN)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[_SPACE] = 0
_PLACES = _places(np.arange(256))


def _ends(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, and where the last one ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... in each run of these lengths."""
    ends = _ends(lengths)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word, from its start to the next one's; white space in between counts for nothing."""
    bounds = np.append(starts, len(data))
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        lengths = np.diff(bounds[i : j + 1])
        at = _within(lengths)
        values = _BYTES[data[bounds[i] : bounds[j]]]
        values *= _PLACES[at] if lengths.max() <= len(_PLACES) else _places(at)
        out[i:j] = np.add.reduceat(values, bounds[i:j] - bounds[i])
        i = j
    return _mix(out)


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct n-grams of each text's words (A-Z in lower case, cut at ASCII white space), one text after the other, and their bounds.

    With fewer than n words the whole sequence is one n-gram; without words there is none.
    """
    none = np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    if not len(texts):
        return none
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return none
    data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[1:] = space[:-1]
    first[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    del space, first
    words = np.searchsorted(starts, at)
    h, lengths = _word_hashes(data, starts), np.diff(words)
    k = np.minimum(n, lengths)
    counts = np.where(lengths > 0, lengths - k + 1, 0)
    ends = _ends(counts)
    at, k = _within(counts) + np.repeat(words[:-1], counts), np.repeat(k, counts)
    total = k.astype(np.uint64)
    for i in range(n):
        more = _mix(total * _GOLDEN + h[np.minimum(at + i, len(h) - 1)])
        total = np.where(k > i, more, total)
    fresh = np.ones(len(total) + 1, bool)
    for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        total[x:y].sort()
    fresh[1:-1] = total[1:] != total[:-1]
    fresh[ends] = True
    fresh = fresh[:-1]
    return total[fresh], _ends(fresh)[ends]


def ngrams(text: str | None, n: int) -> np.ndarray:
    """The n-grams of one text; see ngram_sets."""
    return ngram_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()), n)[0]


def classes(percent: int, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """Upper sizes of the size classes, and the number of parts of each: more than linked sets can differ in."""
    tops = [max(1, percent // (100 - percent) if percent < 100 else 1)]
    while tops[-1] < most:
        tops.append(int(tops[-1] * GROWTH) + 1)
    tops = np.array(tops, np.int64)
    return tops, tops * (100 - percent) // percent + 1


def signature_sets(flat: np.ndarray, ends: np.ndarray, percent: int, tops: np.ndarray, parts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the non-empty parts of these rows' sets, each in its own class and in the one below where links may reach, and the row of each hash, in order."""
    sizes = np.diff(ends)
    own = np.searchsorted(tops, sizes)
    rows = rows[sizes[rows] > 0]
    low = rows[own[rows] > 0]
    low = low[-(-sizes[low] * percent // 100) <= tops[own[low] - 1]]
    found, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for rows, at in ((rows, own[rows]), (low, own[low] - 1)):  # noqa: B020, PLR1704
        for seed in range(1 + EXTRA):
            if not len(rows):
                break
            m, lengths = parts[at], sizes[rows]
            salt = ((at << 8) | seed).astype(np.uint64) * _GOLDEN
            s, salts = flat[_within(lengths) + np.repeat(ends[rows], lengths)], np.repeat(salt, lengths)
            base = _ends(m)
            slot = ((_mix(s + salts) >> np.uint64(32)) * np.repeat(m, lengths).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], lengths)
            sums, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
            np.add.at(sums, slot, _mix(s ^ salts))
            filled[slot] = True
            found.append(_mix(sums + _mix(_within(m).astype(np.uint64) + np.repeat(salt, m)))[filled])
            of.append(np.repeat(rows, m)[filled])
            again = (m <= FEW_PARTS) & (np.add.reduceat(filled.astype(np.int64), base[:-1]) < m)
            rows, at = rows[again], at[again]
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], of[order]


def signatures(s: np.ndarray, percent: int, tops: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The signatures of one set; see signature_sets."""
    return signature_sets(s, np.array([0, len(s)]), percent, tops, parts, np.zeros(1, np.int64))[0]


def prepared(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """DOCUMENT, n_shingles, digest (null for an empty set) and parts of every row."""
    tops, counts = classes(percent)

    def run(batches):
        import hashlib

        at_work("ngrams", lambda: None)
        for b in batches:
            flat, ends = ngram_sets(b.column(3), n)
            sizes = np.diff(ends)
            # A set that a single n-gram more takes too far from itself links with no other; it needs no parts.
            rows = np.flatnonzero(100 * sizes >= percent * (sizes + 1))
            values, of = signature_sets(flat, ends, percent, tops, counts, rows)
            digests = [hashlib.blake2b(flat[x:y], digest_size=16).digest() if x < y else None for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            found = _ends(np.bincount(of, minlength=b.num_rows)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(found), pa.array(values.view(np.int64)))], [*DOCUMENT, "n_shingles", "digest", "parts"])

    return by_bytes(docs.select(*document_key(), "text")).mapInArrow(run, "nameless boolean, id long, text_key binary, n_shingles long, digest binary, parts array<long>")


class _Shared:
    """Sizes of the intersections of a block's sets, which come in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        sizes = np.fromiter(map(len, sets), np.int64, self.n)
        flat, of = np.concatenate(sets), np.repeat(np.arange(self.n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        new = np.flatnonzero(np.concatenate([np.ones(1, bool), flat[1:] != flat[:-1]]))
        held = np.diff(np.append(new, len(flat)))
        # The matrix takes what it counts faster than lists do, and no more than four times CELLS.
        most = max(1, 4 * CELLS // self.n)
        often = np.flatnonzero((held > 1) & (held * FREQUENT >= self.n))
        often = often[np.argsort(-held[often], kind="stable")[:most]]
        column = np.full(len(held), -1)
        column[often] = np.arange(len(often))
        column = np.repeat(column, held)
        self.matrix = np.zeros((self.n, len(often)), np.float32)
        self.matrix[of[column >= 0], column[column >= 0]] = 1
        few = np.repeat(held > 1, held) & (column < 0)
        # Each document's rarer n-grams, as the lists of documents that hold them: where a list begins and how long it is.
        self.lists = of
        entry = np.flatnonzero(few)
        entry = entry[np.argsort(of[entry], kind="stable")]
        self.begin, self.long = np.repeat(new, held)[entry], np.repeat(held, held)[entry]
        self.ends = np.searchsorted(of[entry], np.arange(self.n + 1))

    def rows(self, a: int, b: int, low: int) -> np.ndarray:
        """Of documents a to b with documents low to b."""
        width = b - low
        out = (self.matrix[a:b] @ self.matrix[low:b].T).astype(np.int32) if self.matrix.shape[1] else np.zeros((b - a, width), np.int32)
        x, stop = self.ends[a], self.ends[b]
        total = _ends(self.long[x:stop])
        own = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))
        i = 0
        while i < stop - x:
            j = max(i + 1, int(np.searchsorted(total, total[i] + CELLS, "right")) - 1)
            lengths = self.long[x + i : x + j]
            other = self.lists[_within(lengths) + np.repeat(self.begin[x + i : x + j], lengths)] - low
            cell = np.repeat(own[i:j], lengths) * width + other
            out += np.bincount(cell[(other >= 0) & (other < width)], minlength=out.size).reshape(out.shape).astype(np.int32)
            i = j
        return out


def block_links(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None, guests: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the documents of a block. `known`: components that they are in already; with `guests`, only pairs of a guest and another are met."""
    n = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[order], [sets[i] for i in order]
    label = np.unique(np.asarray(known)[order], return_inverse=True)[1] if known else np.arange(n)
    guest = np.asarray(guests)[order] if guests else None
    shared = _Shared(sets)
    # Sizes that are too far apart need not be met.
    lows = np.searchsorted(100 * sizes, percent * sizes)
    links, a = [], 0
    while a < n:
        low = int(lows[a])
        b = min(n, a + max(1, min(CELLS // (n - low), max(256, (a - low) // 4))))
        both = shared.rows(a, b, low)
        near = 100 * both >= percent * (sizes[a:b, None] + sizes[None, low:b] - both)
        if guest is not None:
            near &= guest[a:b, None] != guest[None, low:b]
        x, y = np.nonzero(near)
        x, y = x + a, y + low
        # Rounds of hooking each component to a lesser one that it links with.
        while True:
            apart = (label[x] != label[y]) & (y < x)
            x, y = x[apart], y[apart]
            if not len(x):
                break
            p, q = label[x], label[y]
            high, at = np.unique(np.maximum(p, q), return_index=True)
            links += [(ids[i], ids[j]) for i, j in zip(order[x[at]].tolist(), order[y[at]].tolist(), strict=True)]
            up = np.arange(n)
            up[high] = np.minimum(p, q)[at]
            while (up != (far := up[up])).any():
                up = far
            label = up[label]
        a = b
    return links


def _streamed_links(n: int, percent: int):
    """For mapInArrow over block, shard, member and text, ordered by block and shard: the links of one shard after the other."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        at_work("ngrams", lambda: None)

        def out():
            found = block_links(ids, sets, percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for batch in batches:
            flat, ends = ngram_sets(batch.column(3), n)
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            for block, shard, member, x, y in rows:
                if (block, shard) != key:
                    if len(ids) > 1:
                        yield out()
                    key, ids, sets = (block, shard), [], []
                ids.append(member)
                sets.append(flat[x:y])
        if len(ids) > 1:
            yield out()

    return run


def components(spark: SparkSession, links: DataFrame, limit: int = 50) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node that has a link (a, b)."""
    edges = materialize(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    signed = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = signed(edges)
    for _ in range(limit):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(spark, small, "edges")
        after = signed(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _blocks(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """block and member of every class that shares a part with another."""
    rows = sets.select("key", F.explode("parts").alias("part"))
    part = lambda df: df.groupBy("part").agg(F.min("key").alias("block"), F.max("key").alias("last")).where("block <> last").drop("last")
    least = max(2, max(LEAST_SAMPLE, sets.count() // SAMPLED) // COMMON)
    common = rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0).groupBy("part").count().where(F.col("count") >= least).select("part")
    common = materialize(spark, common, "common-parts")
    # At most COMMON of them for each part that a class has on average: 8 MB are broadcast at most, more are shuffled like the others.
    few = 0 < common.count() <= 1 << 20
    # Dealt by part once: the aggregation and the join below both read this one exchange.
    rare = (rows.join(F.broadcast(common), "part", "left_anti") if few else rows).repartition("part")
    found = rare.join(part(rare).hint("merge"), "part").select("block", F.col("key").alias("member"))
    if few:
        met = rows.join(F.broadcast(common), "part", "left_semi")
        found = found.union(met.join(F.broadcast(materialize(spark, part(met), "common-blocks")), "part").select("block", F.col("key").alias("member")))
    return materialize(spark, found.distinct(), "blocks")


def _member_ngrams(n: int):
    """For mapInArrow over member and text: a row for each n-gram, with the number of the member's."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        at_work("ngrams", lambda: None)
        for batch in batches:
            flat, ends = ngram_sets(batch.column(1), n)
            sizes = np.diff(ends)
            columns = [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), flat.view(np.int64)]
            for i in range(0, len(flat), GRAM_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + GRAM_ROWS], pa.int64()) for c in columns], ["member", "n", "gram"])

    return run


def _checked_pairs(n: int, percent: int):
    """For mapInArrow over (first, member, text) ordered by first, where its own text comes before the others: those that link with it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        at_work("ngrams", lambda: None)
        own = np.empty(0, np.uint64)
        for batch in batches:
            flat, ends = ngram_sets(batch.column(2), n)
            first, member, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(ends)
            cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y and member[x] == first[x]:
                    own, x = flat[ends[x] : ends[x + 1]].copy(), x + 1  # noqa: PLW2901
                if x < y:
                    others = flat[ends[x] : ends[y]]
                    hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
                    both = np.diff(_ends(hit)[ends[x : y + 1] - ends[x]])
                    found.append(np.flatnonzero(100 * both >= percent * (len(own) + sizes[x:y] - both)) + x)
            if found:
                at = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(first[at], pa.int64()), pa.array(member[at], pa.int64())], ["a", "b"])

    return run


def _far_links(spark: SparkSession, split: DataFrame, rest: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between the rest of blocks and members of other components.

    N-grams are ordered by the number of members that hold them. Of two sets that link, the first n-gram that they share leaves at least the
    intersection that a link takes in both, so only pairs that share such an n-gram are looked at; those of one member are passed over.
    """
    members = split.join(rest.select("block").distinct(), "block").select("member", "component").distinct()
    members = members.join(rest.select("member", F.lit(True).alias("guest")).distinct(), "member", "left").withColumn("guest", F.coalesce("guest", F.lit(False)))
    members = materialize(spark, members, "far-members")
    grams = by_bytes(texts.join(members.select("member"), "member").select("member", "text")).mapInArrow(_member_ngrams(n), "member long, n long, gram long")
    grams = materialize(spark, grams, "far-ngrams")
    held = grams.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    shared = grams.join(held.hint("merge"), "gram").groupBy("member", "n").agg(F.collect_list(F.struct("held", "gram")).alias("grams"))
    most = F.expr(f"size(grams) - cast(ceil(n * {percent}L / 100) as int) + 1")
    shared = shared.where(most > 0).select("member", "n", (F.col("n") - F.size("grams")).alias("alone"), F.posexplode(F.slice(F.sort_array("grams"), F.lit(1), most)))
    postings = materialize(spark, shared.select("member", "n", F.col("col.gram").alias("gram"), (F.col("n") - F.col("alone") - F.col("pos")).alias("left")), "postings")
    discard(spark, grams)

    def met(members: DataFrame, new: str, name: str) -> DataFrame:
        rows = postings.join(members, "member")
        # An n-gram in one component, or that no guest has so early, brings nothing together.
        useful = rows.groupBy("gram").agg(F.max("guest").alias("some"), F.min("component").alias("low"), F.max("component").alias("high")).where("some and low <> high").select("gram")
        rows = rows.join(useful.hint("merge"), "gram", "left_semi")
        x, y = rows.where("guest").alias("x"), rows.alias("y")
        enough = " and ".join(f"{100 + percent}L * {s}.left >= {percent}L * (x.n + y.n)" for s in "xy")
        pairs = x.join(y.hint("merge"), F.expr(f"x.gram = y.gram and x.component <> y.component and {new} and {enough}"))
        pairs = materialize(spark, pairs.select(F.least("x.member", "y.member").alias("first"), F.greatest("x.member", "y.member").alias("member")).distinct(), "pairs")
        both = pairs.union(pairs.select("first", F.col("first").alias("member")).distinct()).join(texts.hint("merge"), "member").select("first", "member", "text")
        order = ["first", F.col("member") != F.col("first")]
        return materialize(spark, by_bytes(both.repartition("first").sortWithinPartitions(*order)).mapInArrow(_checked_pairs(n, percent), "a long, b long"), name)

    # One of each component first: shards may hold parts of one large component, whose members then need not be met in pairs.
    delegates = members.groupBy("component").agg(F.min(F.struct(~F.col("guest"), "member"))["member"].alias("member")).select("member", F.lit(True).alias("delegate"))
    members = materialize(spark, members.join(delegates, "member", "left").withColumn("delegate", F.coalesce("delegate", F.lit(False))), "delegates")
    links = met(members.where("delegate"), "true", "far-links")
    if not links.isEmpty():
        of = members.select("member", "component")
        merged = links.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
        merged = components(spark, merged).toDF("component", "merged")
        members = materialize(spark, members.join(merged, "component", "left").withColumn("component", F.coalesce("merged", "component")).drop("merged"), "merged")
    return links.union(met(members, "not (x.delegate and y.delegate)", "more-links"))


def _links(spark: SparkSession, docs: DataFrame, sets: DataFrame, members: DataFrame, n: int, percent: int, tile: int) -> DataFrame:
    """Links (a, b) that span the components of the classes."""
    key = F.col("member")
    cut = members.join(sets.select(F.col("key").alias("member"), "n_shingles"), "member")
    shards = cut.groupBy("block").agg(F.ceil(F.sum("n_shingles") / tile).cast("int").alias("shards"))
    dealt = cut.join(shards, "block").select("block", F.pmod(F.xxhash64(key), F.col("shards")).cast("int").alias("shard"), "member", "n_shingles", "shards")
    dealt = materialize(spark, dealt, "dealt")
    names = sets.join(members.select(F.col("member").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("member"), *DOCUMENT)
    texts = docs.select(*document_key(), "text").join(names.hint("merge"), DOCUMENT).groupBy("member").agg(F.first("text").alias("text"))
    texts = materialize(spark, texts, "texts")
    home = F.pmod(F.xxhash64("block"), F.col("shards")).cast("int")
    envoys = dealt.where("shards > 1").select("block", "shards").distinct().select("block", home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    envoys = envoys.where("shard <> home").select("block", "shard", F.col("block").alias("member"))
    groups = dealt.select("block", "shard", "member").union(envoys).join(texts, "member").select("block", "shard", "member", "text")
    groups = by_bytes(groups.repartition("block", "shard").sortWithinPartitions("block", "shard"))
    links = materialize(spark, groups.mapInArrow(_streamed_links(n, percent), "a long, b long"), "links")

    split = dealt.where("shards > 1")
    if split.isEmpty():
        return links
    found = components(spark, links).withColumnRenamed("node", "member")
    split = materialize(spark, split.join(found, "member", "left").withColumn("component", F.coalesce("component", "member")), "split")
    sizes = split.groupBy("block", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("block").agg(F.max(F.struct("size", (-F.col("component")).alias("c")))["c"].alias("c")).select("block", (-F.col("c")).alias("main"))
    rest = materialize(spark, split.join(main, "block").where("component <> main").drop("main"), "rest")
    if rest.isEmpty():
        return links
    return links.union(_far_links(spark, split, rest, texts, n, percent))


def _joined(spark: SparkSession, docs: DataFrame, n: int, percent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Rows of `prepared`, and for each digest: DOCUMENT of its least document, and the key of its component."""
    if not 67 <= percent <= 100:
        raise ValueError("sets that differ by more than a third of their sizes are not met: percent must be from 67 to 100")
    whole = materialize(spark, prepared(docs, n, percent), "ngrams")
    first = whole.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(*DOCUMENT)).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("parts").alias("parts"))
    # Numbers are of a written table, as they depend on how it is dealt.
    sets = materialize(spark, first.select("digest", "least.*", "n_shingles", "parts", F.monotonically_increasing_id().alias("key")), "sets")
    base = materialize(spark, whole.drop("parts"), "rows")
    discard(spark, whole)
    members = _blocks(spark, sets)
    found = components(spark, _links(spark, docs, sets, members, n, percent, tile))
    named = sets.join(found, sets["key"] == found["node"], "left").select("digest", *DOCUMENT, F.coalesce("component", "key").alias("component"))
    return base, materialize(spark, named, "named")


def join_documents(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, tile: int = TILE_NGRAMS) -> DataFrame:
    """Components of the similarity join; returns doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included).

    A null or empty text, or one without words, has no n-gram and links with nothing. Every row is a document: rows that share a
    doc_id may have different texts, and a row with a null doc_id links like any other; component_id is null only where
    no document of the component has an id. Repeated rows are returned as often as they occur. An empty table gives no rows. Other
    columns are ignored. Texts are read whole.
    """
    base, named = _joined(spark, docs, n, percent, tile)
    least = named.groupBy("component").agg(F.min(F.struct("nameless", "id")).alias("least"))
    ids = named.join(least, "component").select("digest", F.when(~F.col("least.nameless"), F.col("least.id")).alias("component_id"))
    own = F.when(~F.col("nameless"), F.col("id"))
    # Rows without a set are kept off the join, where their null digests would meet in one task.
    some = base.where("digest IS NOT NULL").select(own.alias("doc_id"), "n_shingles", "digest").join(ids, "digest").drop("digest")
    return some.unionByName(base.where("digest IS NULL").select(own.alias("doc_id"), "n_shingles", own.alias("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, tile: int = TILE_NGRAMS) -> DataFrame:
    """The least document of each component, by doc_id and then by a digest of the text, with all columns; documents without n-grams stay.

    Rows of one doc_id are repeats only if their texts are equal, else each is a document. Documents without an id come after the
    others. Of rows that repeat a document one stays. Null and empty texts have no n-grams; an empty table gives an empty one.
    """
    # The white space at which ngrams cuts.
    blank = F.coalesce(F.col("text").rlike(r"\A[\x09-\x0d\x20]*\z"), F.lit(True))
    _, named = _joined(spark, docs, n, percent, tile)
    stay = named.groupBy("component").agg(F.min(F.struct(*DOCUMENT)).alias("least")).select("least.*")
    keyed = docs.where(~blank).withColumns({f"_{c}": k for c, k in zip(DOCUMENT, document_key(), strict=True)})
    own = [f"_{c}" for c in DOCUMENT]
    kept = keyed.join(stay.toDF(*own).hint("merge"), own, "left_semi").dropDuplicates(own)
    return kept.select(*docs.columns).unionByName(docs.where(blank))
