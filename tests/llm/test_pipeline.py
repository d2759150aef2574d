"""The pipeline's stages, each on its own input, against plain versions, and the whole."""

import random
import struct
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_text_operators import TOKENS, plain_components, plain_overlaps, words

from treeledger.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(spark, folder):
    r = random.Random(11)
    items = [(k, words(r, 25)) for k in range(3)]
    docs, labels = [], []
    for i in range(240):
        w = words(r, r.randint(20, 60)).split()
        if i % 6 == 0:
            w.insert(r.randrange(len(w)), r.choice(("idiot", "moron")))
        labels.append((i, 1, int(i % 6 == 0)))
        docs.append((i, " ".join(w)))
    for i in range(240, 280):
        w = docs[r.choice((1, 2, 3, 4))][1].split()
        if i % 2:
            w[-1] = f"changed{i}"
        docs.append((i, " ".join(w)))
    docs += [(300 + k, f"before {t} after") for k, t in items] + [(400, "mail me at a.b@example.com or +1 (017) 555-7713"), (401, ""), (402, None), (403, words(r, 3000)), (404, "clean"), (404, "clean")]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages_and_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, items = fixture(spark, folder)
    df, stage = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert len(stage) == 5
    texts = lambda d: sorted((x.doc_id, x.text) for x in d.collect())
    order = lambda rows: sorted(rows, key=repr)

    kept = corpus_pipeline.materialize(spark, stage["toxicity"](spark, df, folder), "t")
    assert kept.columns == COLUMNS
    assert order((x.doc_id, x.text) for x in kept.collect()) == order((i, t) for i, t in docs if not any(w in (t or "").split() for w in ("idiot", "moron")))

    before = {x.doc_id: x.text for x in kept.collect()}
    kept = corpus_pipeline.materialize(spark, stage["ngram_jaccard_join"](spark, kept, folder), "t")
    want = {c for _, c in plain_components(list(before.items()), 5, 80).values()}
    assert kept.columns == COLUMNS and sorted(x.doc_id for x in kept.collect()) == sorted(want)

    before = {x.doc_id: x.text for x in kept.collect()}
    kept = corpus_pipeline.materialize(spark, stage["benchmark_decontamination"](spark, kept, folder), "t")
    gone = {d for d, _ in plain_overlaps(list(before.items()), items)}
    assert gone >= {300, 301, 302} and {x.doc_id for x in kept.collect()} == set(before) - gone and kept.columns == COLUMNS

    kept = corpus_pipeline.materialize(spark, stage["pii"](spark, kept, folder), "t")
    after = {x.doc_id: x for x in kept.collect()}
    assert set(after) == set(before) - gone and after[400].text == "mail me at <EMAIL> or <PHONE>" and after[400].n_chars == 29
    assert all(after[i].text == before[i] for i in after if i != 400)

    e = packing.WordEncoder(TOKENS)
    want = sorted((i, p, s, n, c) for i, x in after.items() for p, s, n, c in packing.cut(e.ids(x.text or "") + struct.pack("<I", 1)))
    result = lambda d: sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in d.collect())
    assert result(stage["best_fit_packing"](spark, kept, folder)) == want
    assert result(corpus_pipeline.run(spark, folder)) == want
