"""Each operator against a plain version on small tables that hold nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from treeledger.llm import decontam, ngram_join, packing, pii, sharding, toxicity

ODD = "doc_id long, text string, group string, part long, tokens string"  # with names that operators use inside


def table(spark, texts, schema=ODD):
    """Rows of (id, text), with extra columns; the last id is null and the first row comes twice."""
    rows = [(i, t, "g", 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, schema)


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(r.randint(0, 30)) for _ in range(n))


EDGE = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "Two words"), (4, "Two words"), (5, "x" * 50_000), (6, "é ß 😀 a@b.cd")]


def test_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(12)
    a, b, c, d = (words(r, 40) for _ in range(4))
    docs = [(1, a), (1, b), (1, b), (2, b + " more"), (3, c), (None, c), (None, d), (None, d), (None, ""), (None, None)]
    kept = ngram_join.keep_one(spark, table(spark, docs))
    assert kept.columns == ["doc_id", "text", "group", "part", "tokens"]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted([(1, a), (1, b), (3, c), (None, d), (None, ""), (None, None)], key=repr)


# Sharding


def plain_longest_first(sizes, shards):
    """Loads after each item, largest first, went to the least-loaded shard."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def test_longest_first_against_one_by_one():
    r = random.Random(20)
    for _ in range(200):
        runs = {r.choice((1, 2, 3, 7, 50, 1000, r.randint(1, 5000))): r.choice((1, 2, 5, 40, 300)) for _ in range(r.randint(1, 8))}
        shards = r.randint(1, 9)
        taken = sharding.longest_first(list(runs.items()), shards)
        assert {s: sum(t) for s, t in taken.items()} == runs
        loads = [sum(s * t[k] for s, t in taken.items()) for k in range(shards)]
        assert loads == plain_longest_first([s for s, n in runs.items() for _ in range(n)], shards)


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 7, "most_sent": 0}])
def test_shards_are_those_of_longest_first(spark, settings):
    r = random.Random(21)
    docs = [(k if k % 5 else None, "w" * r.choice((1, 2, 3, 3, 3, 40)) + str(r.randint(0, 300))) for k in range(500)] + EDGE + [(7, "the same")] * 60
    rows = sharding.shard_documents(spark, table(spark, docs), 5, **settings).collect()
    groups = {}
    for _, t in docs:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    loads = [sum(x.size for x in rows if x.shard == s) for s in range(5)]
    assert loads == plain_longest_first(groups.values(), 5) and len(rows) == len(docs)
    for s in range(5):
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(sum(x.shard == s for x in rows)))
    assert len({(x.text_crc32, x.shard) for x in rows}) == len({x.text_crc32 for x in rows})


def test_shards(spark):
    r = random.Random(1)
    docs = EDGE + [(10 + i, words(r, r.randint(1, 60))) for i in range(400)] + [(1000 + i, "the same text") for i in range(150)]
    rows = sharding.shard_documents(spark, table(spark, docs), 8).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = dict(docs)[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.doc_id >= 1000}) == 1 and len({r.shard for r in rows if r.doc_id in (0, 1)}) == 1
    even = sharding.shard_documents(spark, table(spark, docs[8:408]), 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert max(r.n for r in even) < 1.1 * min(r.n for r in even)
    assert sharding.shard_documents(spark, table(spark, []), 8).count() == 0


# Packing


TOKENS = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_encoder_is_the_tokenizer():
    e, r = packing.WordEncoder(TOKENS), random.Random(2)
    texts = [t or "" for _, t in EDGE] + ["Don't STOP'S 12 '' ''s a\x07b É ŁÓDŹ Привет “x” <|endoftext|> a", "a\x1cb\xa0c", "İX ﬁ ½ é"]
    texts += ["".join(r.choice("aB 1'sSé%\n“ж") for _ in range(r.randint(0, 30))) for _ in range(500)]
    for t in texts + texts:
        assert e.ids(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_memory_forgets_and_relearns(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 5)
    e = packing.WordEncoder(TOKENS)
    for t in ("a b c d", "d e f g", "a h i", "a b c d e"):
        assert e.ids(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark):
    r = random.Random(3)
    docs = EDGE + [(10 + i, words(r, r.choice((3, 40, 300, 900)))) for i in range(60)] + [(99, words(r, 6000))]
    rows = packing.pack_documents(spark, table(spark, docs), TOKENS, rows_a_partition=20).collect()
    e = packing.WordEncoder(TOKENS)
    want = sorted((d, p, s, n, c) for d, t in docs for p, s, n, c in packing.cut(e.ids(t or "") + struct.pack("<I", 1)))
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    bins = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    lengths = np.array(sorted((x.length for x in rows), reverse=True))
    assert packing.lower_bound(np.bincount(lengths, minlength=4097)) <= len(bins) <= len(packing.best_fit(lengths)[2]) + 1
    assert packing.pack_documents(spark, table(spark, []), TOKENS).count() == 0


def numbered(spark, lengths):
    """Pieces of these lengths, packed in partitions of 10."""
    rows = [(k, 0, 0, n, k) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, packing.PIECES)


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"pool_rows": 30}), (3, {"fan": 2})])
def test_exchange_until_certified(spark, monkeypatch, seed, settings):
    """Partitions of ten pieces, which exchange until the whole is certified or has nothing left to exchange."""
    r = random.Random(seed)
    lengths = [r.choice((r.randint(1, 4096), r.randint(1, 300), 2048, 1365)) for _ in range(400)]
    monkeypatch.setattr(packing, "pieces", lambda docs, tokenizer, capacity: numbered(spark, lengths))
    packed = packing.pack_documents(spark, spark.range(1), "", rows_a_partition=10, **settings)
    rows = packed.collect()
    assert sorted(x.length for x in rows) == sorted(lengths)
    bins = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for held in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:])) and sum(n for _, n in held) <= 4096 and min(held)[0] == 0
    found = packing.certificate(packed)
    assert found["sequences"] == len(bins) and found["gap"] >= 0
    whole = len(packing.best_fit(np.array(sorted(lengths, reverse=True)))[2])
    assert found["gap"] == 0 or len(bins) <= whole + (3 if settings.get("pool_rows") else 0)


def test_certified_partitions_are_left_alone(spark, monkeypatch):
    """Pieces over half of a sequence fill one each: bounds say so, and nothing is exchanged."""
    monkeypatch.setattr(packing, "pieces", lambda docs, tokenizer, capacity: numbered(spark, [3000] * 50))
    monkeypatch.setattr(packing, "_exchanged", None)
    packed = packing.pack_documents(spark, spark.range(1), "", rows_a_partition=10)
    assert packing.certificate(packed) == {"sequences": 50, "bound": 50, "gap": 0}


def test_other_tokenizers_are_not_imitated(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "ab": 2, "b</w>": 3}, merges=[("a", "b")]))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "t.json"))
    e = packing.WordEncoder(str(tmp_path / "t.json"))
    assert not e.known and e.ids("ab a") == np.array(made.encode("ab a").ids, "<u4").tobytes() and packing.WordEncoder(TOKENS).known


def test_bounds_are_bounds():
    r = random.Random(4)
    for _ in range(200):
        lengths = np.array(sorted((r.randint(1, 20) for _ in range(r.randint(1, 14))), reverse=True))
        bins, offsets, fill = packing.best_fit(lengths, 20)
        assert fill.max() <= 20 and fill.sum() == lengths.sum()
        assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= len(fill)


# Similarity join


def plain_components(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = [x for x in re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join_against_all_pairs(spark, n, percent):
    r = random.Random(n)
    docs = dict(EDGE)
    for base in range(12):
        w = words(r, r.choice((5, 9, 12, 20, 60, 200))).split()
        for k in range(8):
            v = list(w)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                v[r.randrange(len(v))] = f"new{r.randint(0, 5)}"
            docs[100 + base * 10 + k] = (" ".join(v)).upper() if k == 7 else "  ".join(v)
    rows = [*docs.items(), (4, docs[4])]
    got = ngram_join.join_documents(spark, table(spark, rows), n, percent, tile=400).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain_components(list(docs.items()), n, percent)
    kept = ngram_join.keep_one(spark, table(spark, rows + [(None, "no id")]), n, percent)
    assert kept.columns == ["doc_id", "text", "group", "part", "tokens"]
    assert sorted(x.doc_id for x in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for _, c in plain_components(list(docs.items()), n, percent).values()})
    assert ngram_join.join_documents(spark, table(spark, [])).count() == 0


def plain_rows(docs, n, percent):
    """Like plain_components, but every row is a document, whatever its id: sorted (doc_id, n_shingles, component_id)."""
    found = plain_components(list(enumerate(t for _, t in docs)), n, percent)
    least = {}
    for k, (i, _) in enumerate(docs):
        c = found[k][1]
        least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
    return sorted(((i, found[k][0], None if least[found[k][1]][0] else least[found[k][1]][1]) for k, (i, _) in enumerate(docs)), key=repr)


def test_join_of_rows_without_ids_and_with_shared_ones(spark):
    r = random.Random(14)
    a, b, c, d = (words(r, 60) for _ in range(4))
    near = lambda t, k: " ".join([*t.split()[:-1], f"other{k}"])
    # A row without an id joins two that have one and are too far apart by themselves.
    bridge = " ".join(a.split()[3:] + ["p", "q", "r"])
    docs = [(1, a), (1, b), (2, near(b, 1)), (None, bridge), (7, " ".join(bridge.split()[3:] + ["s", "t", "u"])), (None, c), (None, near(c, 1)), (None, None), (None, ""), (3, " "), (4, d), (4, d), (None, d)]
    got = ngram_join.join_documents(spark, table(spark, docs), 3, 90).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == plain_rows(docs, 3, 90)
    with pytest.raises(ValueError, match="percent"):
        ngram_join.join_documents(spark, table(spark, docs), 3, 50)


@pytest.mark.parametrize("common", [512, 1 << 40])
def test_a_large_group_of_near_copies(spark, monkeypatch, common):
    """One block in many shards, whose members link in chains, apart and not at all."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "SAMPLED", 1)
    monkeypatch.setattr(ngram_join, "LEAST_SAMPLE", 1024)
    r = random.Random(15)
    base = words(r, 80).split()
    docs = []
    for k in range(250):
        v = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            v[r.randrange(30, len(v))] = f"x{r.randint(0, 400)}"
        docs.append((k, " ".join(v)))
    # A second group that shares the first part of the text only.
    tail = words(r, 30).split()
    for k in range(40):
        v = base[:50] + tail
        v[r.randrange(50, len(v))] = f"y{k}"
        docs.append((1000 + k, " ".join(v)))
    got = ngram_join.join_documents(spark, table(spark, docs), 3, 90, tile=1500).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain_components(docs, 3, 90)


def test_a_large_group_whose_members_mostly_do_not_link(spark, monkeypatch):
    """Near copies too far from each other to link cost in proportion to their number; a few that link across shards are found."""
    r = random.Random(18)
    base = words(r, 80).split()
    docs = []
    for k in range(0, 300, 2):
        v = list(base)
        for _ in range(r.choice((0, 1, 4, 5, 8, 12, 16))):
            v[r.randrange(len(v))] = f"x{r.randint(0, 10**6)}"
        docs += [(k, " ".join(v)), (k + 1, " ".join([*v[:-1], f"z{k}"] if k % 3 else v[: 80 - k % 30]))]
    rows, by_bytes = [], ngram_join.by_bytes
    monkeypatch.setattr(ngram_join, "by_bytes", lambda df: (rows.append(df.count()), by_bytes(df))[1])
    for percent in (80, 90):
        rows.clear()
        got = ngram_join.join_documents(spark, table(spark, docs), 3, percent, tile=1500).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain_components(docs, 3, percent)
        # All documents, members of shards, and what is read again to meet other shards.
        assert len(rows) > 2 and sum(rows[2:]) < 10 * len(docs), rows


def test_block_of_near_copies_that_do_not_link():
    """Sets that share most n-grams and still are apart must all be met: 3,000 of them in seconds, and links as by comparing pairs."""
    r = np.random.default_rng(16)
    base = np.unique(r.integers(0, 1 << 63, 400).astype(np.uint64))

    def copy(most):
        keep = np.ones(len(base), bool)
        for at in r.integers(0, len(base) - 3, r.integers(1, most)):
            keep[at : at + 3] = False
        return np.unique(np.concatenate([base[keep], r.integers(0, 1 << 63, int((~keep).sum())).astype(np.uint64)]))

    began = time.process_time()
    ngram_join.block_links(list(range(3000)), [copy(20) for _ in range(3000)], 90)
    assert time.process_time() - began < 20

    sets = [copy(12) for _ in range(80)]
    plain = [set(s.tolist()) for s in sets]
    guests, known = (r.random(80) < 0.3).tolist(), r.integers(0, 60, 80).tolist()
    for guest, have in ((None, None), (guests, known)):
        want = {(i, j) for i in range(80) for j in range(i) if 100 * len(plain[i] & plain[j]) >= 90 * len(plain[i] | plain[j]) and (guest is None or guest[i] != guest[j])}
        found = ngram_join.block_links(list(range(80)), sets, 90, have, guest)
        assert want and {(max(x), min(x)) for x in found} <= want
        label = list(have or range(80))
        for links in (found, want):
            for a, b in links:
                if label[a] != label[b]:
                    assert links is found
                    label = [label[b] if x == label[a] else x for x in label]


def test_ngram_sets_of_a_batch():
    texts = ["", None, "a", " a", "A  b", "a b c", "a b c d", "é É x\x0by\tz\x1cq", " " * 10, "x" * 1000 + " y", "a b c a b c"] * 2
    flat, ends = ngram_join.ngram_sets(pa.array(texts).slice(1), 3)
    seen = {}
    for text, x, y in zip(texts[1:], ends[:-1], ends[1:], strict=True):
        w = (text or "").encode().lower().split()
        k = min(3, len(w))
        want = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
        got = flat[x:y].tolist()
        assert got == sorted(set(got)) == ngram_join.ngrams(text, 3).tolist() and len(got) == len(want)
        assert seen.setdefault(frozenset(got), want) == want


def test_signatures_are_shared_by_linked_sets():
    r = np.random.default_rng(5)
    for percent in (80, 90):
        tops, parts = ngram_join.classes(percent)
        for size in [*range(1, 60), 100, 150, 151, 500, 1000]:
            for _ in range(6):
                a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
                drop = len(a) * (100 - percent) // 100
                b = a[drop:]
                assert set(ngram_join.signatures(a, percent, tops, parts)) & set(ngram_join.signatures(b, percent, tops, parts))


# Decontamination


def plain_overlaps(docs, items):
    """{(document, item): best (window, matches, -start)} over every alignment."""
    unspaced = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
    cut = lambda t: regex.findall(r"[\p{L}\p{N}]+", regex.sub(unspaced, r" \1 ", (t or "").lower()))
    found = {}
    for d, t in docs:
        w = cut(t)
        for i, x in items:
            v = cut(x)
            size = min(13, len(v))
            need = 11 if len(v) >= 13 else len(v) - 1 if len(v) >= 8 else len(v)
            if len(v) < 5:
                continue
            for s in range(1 - len(v), len(w)):
                agree = [0 <= s + k < len(w) and w[s + k] == v[k] for k in range(len(v))]
                best = max(sum(agree[k : k + size]) for k in range(len(v) - size + 1))
                if best >= need:
                    found[d, i] = max(found.get((d, i), (0,)), (best, sum(agree), -s))
    return found


@pytest.mark.parametrize("settings", [{}, {"chunk": 20, "most_sent": 0}])
def test_overlaps_against_every_alignment(spark, settings):
    r = random.Random(6)
    items = [(1, words(r, 30)), (2, words(r, 13)), (3, "six short words to be found"), (4, "too short"), (5, None), (6, words(r, 30)), (7, words(r, 9)), (8, words(r, 12)), (9, "the same same same same same same same same same same same same same"), (10, "東京都は日本の首都です。人口"), (None, words(r, 14))]
    docs = list(EDGE)
    for k in range(160):
        i, x = items[r.choice((0, 1, 2, 5, 6, 6, 7, 7, 8, 9, 10))]
        v = list(x) if i == 10 else x.split()[r.choice((0, 0, 1, 3)) :][: r.choice((99, 99, -1))]
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            v[r.randrange(len(v))] = "changed" if i != 10 else "変"
        docs.append((100 + k, " ".join([*words(r, r.choice((0, 0, 9, 20))).split(), ("" if i == 10 else " ").join(v), *words(r, r.choice((0, 0, 9, 20))).split()])))
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = plain_overlaps(docs, items)
    got = decontam.overlaps(spark, table(spark, docs), bench, **settings).collect()
    assert {(x.doc_id, x.item_id): (x.best_window, x.matched, -x.doc_start) for x in got} == want and len(got) == len(want)
    kept = decontam.clean(spark, table(spark, docs + [(None, items[0][1]), (None, "fine"), (100, "another text of this id")]), bench)
    gone = {d for d, _ in want}
    stay = [(d, t) for d, t in docs if d not in gone] + [(None, "fine"), (100, "another text of this id")]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted(stay, key=repr)


def test_overlaps_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words of an item to look for in texts")], "item_id long, text string")
    assert decontam.overlaps(spark, table(spark, EDGE), bench.limit(0)).count() == 0 and decontam.overlaps(spark, table(spark, []), bench).count() == 0
    assert decontam.clean(spark, table(spark, EDGE), bench.limit(0)).count() == len(EDGE)


def test_a_very_long_item(spark):
    r = random.Random(16)
    text = " ".join(f"w{r.randint(0, 5000)}" for _ in range(50_000))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = decontam.overlaps(spark, table(spark, [(1, "before " + text), (2, "other words")]), bench).collect()
    assert [(x.doc_id, x.doc_start, x.matched) for x in got] == [(1, 1, 50_000)]


# Personal data


def luhn(d):
    return sum((v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0


def plain_base(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_against_plain_patterns(spark):
    r = random.Random(7)
    texts = [t for _, t in EDGE] + ["a@b.c+d@e.f", "a@b.c.@d.e x..@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (017) 555-7713 +49 30 12345678", "a." * 3000 + "@", "a@" + "b." * 2000 + "c", "1" * 3000]
    texts += ["".join(r.choice("a1@.+- ()25\U0001f600") for _ in range(r.randint(0, 60))) for _ in range(800)]
    docs = list(enumerate(texts))
    rows = {x.doc_id: x for x in pii.report(table(spark, docs)).collect()}
    for i, t in docs:
        want = plain_base(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, rows[i].spans.split(",")))
        assert [rows[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s.startswith(k + ":") for s in want) for k in pii.BASE_KINDS]


def test_spans_apart_against_plain_versions(spark, monkeypatch):
    """Walks in blocks of three against all pairs and all subsets."""
    monkeypatch.setattr(pii, "BLOCK", 3)
    r = random.Random(17)
    rows = []
    for k in range(60):
        span = lambda kinds: [(kind, a, a + r.randint(1, 6), float(r.randint(0, 9))) for kind in range(kinds) for a in range(r.randint(0, 8), 40, 9) if r.random() < 0.6]
        rows.append((k, span(2), span(3)))
    span = "array<struct<kind:int,start:int,stop:int,margin:double>>"
    df = spark.createDataFrame(rows, f"k int, fixed {span}, found {span}")
    over = lambda a, b: a[1] < b[2] and b[1] < a[2]
    for x in df.select("k", "fixed", "found", pii.apart_from(F.col("found"), F.col("fixed")).alias("free"), pii.best_apart(F.col("found")).alias("best")).collect():
        fixed, found = [tuple(c) for c in x.fixed], [tuple(c) for c in x.found]
        assert sorted(tuple(c) for c in x.free) == sorted(c for c in found if not any(over(c, f) for f in fixed))
        best = [(c.kind, c.start, c.stop, c.margin) for c in x.best]
        assert set(best) <= set(found) and not any(over(a, b) for i, a in enumerate(best) for b in best[:i])
        by_end = sorted(found, key=lambda c: c[2])
        sums = [0.0]
        for i, c in enumerate(by_end):
            sums.append(max(sums[-1], c[3] + max(sums[j] for j in range(i + 1) if j == 0 or by_end[j - 1][2] <= c[1])))
        assert sum(c[3] for c in best) == sums[-1]


def test_a_text_of_very_many_spans(spark):
    n, began = 60_000, time.monotonic()
    text = "a@b.cd 12 " * n
    docs = table(spark, [(1, text), (2, "x (at) y.org " * 20_000)])
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    assert got[1].n_email == n and got[1].base_sha256 == hashlib.sha256(",".join(f"email:{10 * k}:{10 * k + 6}" for k in range(n)).encode()).hexdigest()
    out = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert out[1] == "<EMAIL> 12 " * n and out[2] == "<EMAIL> " * 20_000
    assert time.monotonic() - began < 90


def test_redaction_cuts_at_any_place(spark, monkeypatch):
    monkeypatch.setattr(pii, "TEXT_BLOCK", 4)
    r = random.Random(19)
    texts = ["".join(r.choice(("a@b.cd", "\U0001f600", "é", " word ", "+1 (017) 555-7713", "x", " ")) for _ in range(r.randint(0, 12))) for _ in range(120)]
    for x in pii.redact(table(spark, list(enumerate(texts)))).collect():
        found, at, want = plain_base(texts[x.doc_id]), 0, ""
        for kind, a, b in (s.split(":") for s in found):
            if int(a) >= at:
                want += texts[x.doc_id][at : int(a)] + f"<{kind.upper()}>"
            at = max(at, int(b))
        assert x.text == want + texts[x.doc_id][at:]


def test_judged_spans_and_redaction(spark):
    docs = table(spark, [(0, "john (at) mail (dot) com, call me (555) 123-4567"), (1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (2, "at 12:34:56:12:34:56:12:34, version 123 456 7890"), (3, None), (4, "plain words only")])
    assert [x.spans for x in pii.report(docs).orderBy("doc_id").collect()] == ["email:0:24,phone:34:48", "secret:0:49", "", "", ""]
    out = pii.redact(docs).orderBy("doc_id")
    assert out.columns == docs.columns
    assert [x.text for x in out.collect()][:1] == ["<EMAIL>, call me <PHONE>"] and out.collect()[3].text is None
    assert pii.report(table(spark, [])).count() == 0


# Toxicity


def test_folding_and_exceptions():
    terms = tuple(toxicity.TERMS) + ("lowei*",)
    found = lambda t: [terms[i] for i in toxicity.matches(toxicity.fold(t), terms)]
    for t in ("You 1d10t", "ІDІОT", "id​iot", "Idiots!", "idiot$$$", "ï̈diót"):
        assert "idiot*" in found(t), t
    assert found("trash can") == [] and found("trash can trash") == ["trash"]
    assert found("loweiisch") == ["lowei*"] and found("blowei") == [] and found("") == [] and found("a 42 losersyncrasy") == []


def plain_matches(folded, terms):
    """Every term at every place, whole words or beginnings, unless some exception phrase around it holds it."""
    same = lambda piece, form: len(piece) == len(form) and all(a == b or a == "1" and b in "il" for a, b in zip(piece, form))
    at = lambda form: [k for k in range(len(folded)) if same(folded[k : k + len(form)], form)]
    spared = [(k, k + len(p) + 2) for e in toxicity.EXCEPTIONS for p in (e, e + "s") for k in at(f" {p} ")]
    out = []
    for i, t in enumerate(terms):
        for form in [f" {t[:-1]}"] if t[-1] == "*" else [f" {t} ", f" {t}s ", f" {t}es "]:
            out += [i for k in at(form) if not any(a <= k and k + len(form) <= b for a, b in spared)]
    return sorted(out)


def test_matches_against_every_place():
    terms = (*toxicity.TERMS, "lowei*")
    r = random.Random(18)
    bits = ["trash", "can", "tr4sh", "kill", "ki11", "time", "sick", "pay", "leave", "idiots", "1d10t", "loweix", "guinea", "pig", "fool", "s", "gold", "proof", "word", "hijo", "de", "puta", "class", "clown", "clowns", "fucking"]
    for _ in range(150):
        folded = toxicity.fold(" ".join(r.choice(bits) for _ in range(r.randint(0, 14))))
        assert sorted(toxicity.matches(folded, terms)) == plain_matches(folded, terms), folded
    began = time.monotonic()
    assert len(toxicity.matches(toxicity.fold("trash can idiot " * 100_000), terms)) == 100_000 and time.monotonic() - began < 30


def test_plain_insults_in_several_languages():
    terms = tuple(toxicity.TERMS)
    for t in ("you fucking bastard", "what an a s s h o l e", "du Arschloch", "espèce de connard", "eres un gilipollas", "che stronzo", "st\u00fapid!", "hijo de puta", "f.u.c.k"):
        assert toxicity.matches(toxicity.fold(t), terms), t
    for t in ("a normal sentence about trash cans and class", "I like it", "a b c d e f g", "the assistant passed the class"):
        assert not [i for i in toxicity.matches(toxicity.fold(t), terms) if terms[i] not in toxicity.MILD], t


def test_chances_are_binomial():
    for n, share in ((5, 0.25), (30, 0.1), (200, 0.4)):
        whole = [math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
        for k in range(n + 1):
            if k > n * share:
                assert abs(toxicity.chance(k, n, share) - sum(whole[k:])) < 1e-9


def test_signs_that_stand_for_two_letters():
    terms = tuple(toxicity.TERMS)
    found = lambda t: [terms[i] for i in toxicity.matches(toxicity.fold(t), terms)]
    assert set(found("a 1oser and |ame, 1mbeci1e, imbec|le")) == {"loser", "lame", "imbecile"}
    assert found("iame k1lled ki11") == ["kill"]


def test_terms_of_small_samples_are_learned(spark):
    r = random.Random(9)
    rows = [(words(r, 30) + (f" {words(r, 1)} zorgify" if i % 9 == 0 and i < 13 * 9 else "") + " common", i % 9 == 0) for i in range(900)]
    found = toxicity.found_terms(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert len(found) == 1 and "zorgify".startswith(found[0].rstrip("*"))


def test_toxicity_held_out(spark):
    r = random.Random(8)
    bad = ("idiot", "moron", "zorgify", "zorgable", "zorgen")
    docs, labels = [], []
    for i in range(900):
        w = words(r, r.randint(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows = table(spark, docs + EDGE[:0] + [(5000, None), (5001, ""), (5002, "x" * 50_000)])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark, rows, known).collect()
    assert len(got) == 903 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert sum(x.predicted == int(x.doc_id % 4 == 0) for x in held) >= 0.95 * len(held)
    kept = toxicity.reject(spark, rows, known)
    assert kept.columns == rows.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if not x.predicted}
    assert toxicity.toxicity(spark, rows.limit(0), known).count() == 0 and toxicity.toxicity(spark, rows, known.limit(0)).count() == 903
