"""Token counts against the library."""

import random

from llm_helpers import SF_SMALL, awkward, frame
from test_tokens import odd_texts

from tilequarry.llm import token_counts
from tilequarry.llm.common import tokenizer_path
from tilequarry.llm.queries import QUERIES
from tilequarry.llm.tokens import load

BYTES = tokenizer_path("byte_bpe_50k.json")


def test_merging_is_the_library():
    tok, counts, rng = load(BYTES), token_counts.PieceCounts(BYTES), random.Random(5)
    for _ in range(400):
        letters = rng.choice(["ab", "aaab", "etaoinshrdlu", "!?.", "0123456789", "éàüa", "  \n", ["<|endoftext|>", "x", " "]])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 400)))
        assert counts.of(text) == len(tok.encode(text, add_special_tokens=False).ids)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counts = token_counts.PieceCounts(BYTES)
    tok, text = load(BYTES), "one two three four five six<|endoftext|> seven one two"
    assert counts.of(text) == len(tok.encode(text, add_special_tokens=False).ids) and len(counts) <= 6
    assert counts.of("<|endoftext|>") == 1


def test_awkward_documents(spark):
    tok = load(BYTES)
    docs = [*awkward(7), *enumerate(odd_texts()), (9, "ab!?" * 60000), (None, "x" * 300000)]
    want = sorted((len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for _, t in docs)
    found = token_counts.count(frame(spark, docs), BYTES)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
    assert found.select("doc.*").columns == frame(spark, docs).columns
    assert token_counts.count(frame(spark, docs).limit(0), BYTES).count() == 0


def test_query(spark):
    tok = load(BYTES)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op13_token_counts"](spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = len(tok.encode(d.text or "", add_special_tokens=False).ids)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 1024)
