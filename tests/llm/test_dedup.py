"""Exact dedup by words and by bytes, against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from llm_helpers import SF_SMALL, awkward, by_value, frame, same_as_sql
from pyspark.sql import functions as F

from tilequarry.llm import substring, suffix
from tilequarry.llm.queries import QUERIES


def words_by_hand(docs, size):
    order = lambda d: -(1 << 63) if d is None else d
    first, all_ = {}, []
    for k, (d, t) in enumerate(docs):
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            first[key] = min(first.get(key, (1 << 70, 0)), (order(d), i))
            all_.append((k, i, key))
    gone = [set() for _ in docs]
    for k, i, key in all_:
        if first[key] < (order(docs[k][0]), i):
            gone[k].update(range(i, i + size))
    out = []
    for k, (d, t) in enumerate(docs):
        w = (t or "").encode().split()
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone[k])
        out.append((d, len(w), len(gone[k]), hashlib.sha256(kept).hexdigest()))
    return out


def bytes_by_hand(docs, size):
    count = {}
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            count[b[i:i + size]] = count.get(b[i:i + size], 0) + 1
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i:i + size]] > 1:
                gone[i:i + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) > 0).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def test_word_query(spark):
    assert by_value(QUERIES["op1_substring_dedup"](spark, SF_SMALL).collect()) == by_value(words_by_hand(documents(spark), 20))


@pytest.mark.parametrize("window", [5, 20])
def test_word_windows_of_awkward_texts(spark, window):
    docs = awkward(window)
    got = substring.dedup(frame(spark, docs), window, bucket_bytes=1000).select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert by_value(got.collect()) == by_value(words_by_hand(docs, window))
    assert substring.dedup(frame(spark, docs).limit(0), window).count() == 0


def test_byte_query(spark):
    assert by_value(QUERIES["op2_suffix_array_dedup"](spark, SF_SMALL).collect()) == by_value(bytes_by_hand(documents(spark), 400))


@pytest.mark.parametrize("length,hot", [(40, 4 << 20), (33, 300)])
def test_byte_strings_of_awkward_texts(spark, length, hot):
    docs = awkward(length)
    got = suffix.dedup(frame(spark, docs), length, bucket_bytes=3000, hot_bytes=hot).select(
        "doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert by_value(got.collect()) == by_value(bytes_by_hand(docs, length))


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        text = bytes(rng.choice(rng.choice([b"ab", b"abcde", b"\x00\xff a"])) for _ in range(rng.randrange(1, 300)))
        text = text[:40] * 4 if rng.random() < 0.3 else text
        order = suffix.suffix_array(text, 2000)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    text = b"abcabcabx"
    order = suffix.suffix_array(text, 100)
    common = suffix.neighbour_prefixes(text, order, 100)
    assert dict(zip(order.tolist(), common.tolist()))[3] == 5  # abcabx follows abcabcabx


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_suffix_array_dedup"])
def test_queries_equal_their_sql(spark, name):
    same_as_sql(spark, name)


def test_anchors_take_little_memory():
    """A task that looks for anchors, in texts together or in a long one, needs a fraction of 100 bytes for each byte it holds."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in [3000] * 700 + [3 << 20, 399, 400, 0]]
    suffix._powers(1 << 21)
    rows = pd.DataFrame({"oid": range(len(texts)), "tk": 0, "text": texts})
    tracemalloc.start()
    for _ in suffix._probes(iter([rows]), 400, 4):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6
    windows = np.zeros(len(texts), int)
    for _, _, _, row, parts, text, lo, pos, n, at, h in suffix._stretches(iter([rows]), 400):
        np.add.at(windows, row, n)
        assert all(lo[k] <= at[k] <= lo[k] + 368 for k in range(len(lo)))
        assert all(parts[text[k]][lo[k]:lo[k] + 9] == texts[row[k]][pos[k]:pos[k] + 9] for k in range(len(lo)))
    assert windows.tolist() == [max(0, len(t) - 399) for t in texts]
