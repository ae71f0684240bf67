"""The stages one by one on the smallest table, against SQL and brute force."""

import random

import duckdb
import numpy as np
from llm_helpers import SF_SMALL, frame
from test_simhash import classes_by_hand, fingerprint_by_hand

import corpus_pipeline
from tilequarry.llm.common import table, written
from tilequarry.llm.oracle import ORACLE


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), name)
        after[name] = docs.collect()
        assert name == "bpe_encode_decode" or docs.columns == columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op7_quality_rules']}) WHERE kept").fetchall()}
    assert {r.doc_id for r in after["quality_rules"]} == kept
    texts = [r.text for r in after["simhash_near_dedup"]]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in after["quality_rules"]} & set(texts)
    # Every string of 400 bytes that stood twice is gone, and nothing else.
    count = {}
    for t in texts:
        b = t.encode()
        for i in range(len(b) - 399):
            count[b[i:i + 400]] = count.get(b[i:i + 400], 0) + 1
    want = {}
    for r in after["simhash_near_dedup"]:
        b, gone = r.text.encode(), bytearray(len(r.text.encode()))
        for i in range(len(b) - 399):
            if count[b[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        want[r.doc_id] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in after["suffix_array_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in after["suffix_array_dedup"])
    assert {(r.doc_id, r.text) for r in after["mixing_to_weights"]} <= set(want.items())
    assert len(after["bpe_encode_decode"]) == len(after["mixing_to_weights"]) and all(r.round_trip for r in after["bpe_encode_decode"])


def test_near_dedup_is_by_fingerprints(spark):
    """The stage keeps the document that names each class of op10, whatever the shingles of the others share."""
    rng = random.Random(12)
    docs = []
    for k in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(200 + 10 * k)]
        docs.append((100 * k, " ".join(base)))
        for j in range(1, 10):  # from one word changed to a sixth of them
            edited = list(base)
            for at in rng.sample(range(len(base)), 1 + (j - 1) * len(base) // 48):
                edited[at] = f"v{j}"
            docs.append((100 * k + j, " ".join(edited)))
    docs += [(5000, docs[0][1]), (5001, None), (5002, " \n"), (5003, ""), (None, docs[0][1]), (None, "a b c d"), (0, docs[0][1])]
    ids = sorted({d for d, _ in docs if d is not None})
    fps = {d: fingerprint_by_hand(t) for d, t in docs if d is not None}
    label = classes_by_hand(np.array([fps[i] for i in ids], np.uint64), 3)
    want = sorted(ids[x] for x in set(label.tolist()))
    given = frame(spark, docs)
    kept = corpus_pipeline.simhash_near_dedup(spark, given, "")
    got = kept.collect()
    assert kept.columns == given.columns and 30 < len(want) < 300
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert [r.text for r in got if r.doc_id is None] == ["a b c d"]
    assert corpus_pipeline.simhash_near_dedup(spark, given.limit(0), "").count() == 0
