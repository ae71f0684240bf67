"""Token files and BPE, against the library."""

import random
import zlib

import numpy as np
from llm_helpers import SF_SMALL, awkward, frame

from tilequarry.llm import bpe, token_files, tokens
from tilequarry.llm.common import new_folder, tokenizer_path
from tilequarry.llm.queries import QUERIES
from tilequarry.llm.tokens import load, word_encoder

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(2)
    mixed = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000)])) for _ in range(4000))
    return ["", "  ", "a  b", "x\n\n y", "don't  we'll<|endoftext|>  yes", "<|endoftext|> a<|startoftext|>b", "՘abc", "日本 テスト",
            "a b　c", "\x1c\x1f a", "'sa'''s !'s", "é" * 50, "ΟΔΥΣΣΕΥΣ ΣΑΣ.", "İx İ",
            "á ́b é", "a" * 20000, " " * 9999 + "b", "ab" * 7000, "!?" * 8000, "1" * 9000 + " x", mixed]


def test_words_in_a_row_are_the_text():
    tok, texts = load(WORDS), odd_texts()
    ids, counts = word_encoder(WORDS)([t.encode() for t in texts])
    ends = np.cumsum(counts)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_share_their_pieces(monkeypatch):
    """Words in capitals, with signs or with digits are encoded from pieces that all of them share, as the library does."""
    stems, ends, asked = [f"st{chr(97 + k)}mñ" for k in range(20)], ["", "%%", ".", "é", "7", "99", "×", "'ll", "<|", "Ω", "\x1c", "\u0301"], []
    table = tokens.Remembering.table
    monkeypatch.setattr(tokens.Remembering, "table", lambda self, pieces: asked.extend(pieces) or table(self, pieces))
    encode, tok = tokens.word_encoder.__wrapped__(WORDS), load(WORDS)
    texts = [" ".join(w for e in ends[:6] for w in (s + e, (s + e).upper(), e + s + e)) for s in stems]
    odd = [" ".join((s + e, (s + e).upper(), e + s.title())) + "\t" for s in stems for e in ends] + ["", " "]
    rng = random.Random(9)
    odd += ["".join(rng.choice([*ends, "a", "Ñ", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    ids, counts = encode([t.encode() for t in texts])
    assert len(asked) == len(set(asked)) <= 3 * len(stems) + 10
    more, n = encode([t.encode() for t in odd])
    ids, stop = np.concatenate((ids, more)).tolist(), np.cumsum(np.concatenate((counts, n))).tolist()
    for t, a, b in zip(texts + odd, [0, *stop], stop):
        assert ids[a:b] == tok.encode(t, add_special_tokens=False).ids


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 256, 257, 5000, 256 * 4097 + 3):
        for high in (1, 2, 300, 49408, 2**32 - 1):
            x = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            x[:n // 200] = 2**32 - 1
            built = token_files.FileBuilder()
            built.add([None], np.array([n // 3]), x[:n // 3])
            built.add([5], np.array([n - n // 3]), x[n // 3:])
            f = token_files.TokenFile(built.bytes(3))
            assert f.tokens == n and (f.ids(0, n) == x).all() and (f.ids(n // 2, n) == x[n // 2:]).all()


def test_token_file_query(spark):
    tok, start = load(WORDS), 0
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, SF_SMALL).collect()}
    for d, t in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_awkward_token_files(spark):
    docs, tok = awkward(3), load(WORDS)
    folder = new_folder(spark, "tokens")
    token_files.write(frame(spark, docs), folder, WORDS, file_bytes_of_text=500)
    rows = token_files.read(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert len(rows) == len(docs) and ids == sorted(ids, key=lambda d: (d is not None, d))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in docs)
    assert sorted(bytes(r.ids) for r in rows) == want
    empty = new_folder(spark, "tokens")
    token_files.write(frame(spark, docs).limit(0), empty, WORDS)
    assert token_files.read(spark, empty).count() == 0


def test_bpe_is_the_library(spark):
    v, texts = bpe.vocabulary(BYTES), odd_texts()
    want = [v.tok.encode(t, add_special_tokens=False).ids for t in texts]
    docs = [*enumerate(texts), (0, texts[0]), (None, None), (15, texts[15])]
    for leaf in (16, 4096):
        for r in bpe.encode(frame(spark, docs), BYTES, leaf=leaf, decoded=True).select("doc.doc_id", "ids", "decoded").collect():
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert ids == (want[r.doc_id] if r.doc_id is not None else [])
            assert r.decoded.decode() == (v.tok.decode(ids, skip_special_tokens=False) if ids else "")
    assert bpe.encode(frame(spark, docs).limit(0), BYTES).count() == 0


def test_tree_is_the_plain_merge():
    v, rng = bpe.vocabulary(BYTES), random.Random(5)
    for _ in range(150):
        letters = rng.choice(["ab", "aaab", "etaoinshrdlu", "!?.", "0123456789", "éàüa", "  \n"])
        piece = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))).encode()
        assert v.merge_long(piece, rng.choice([1, 2, 3, 7, 16, 50])) == v.merge(piece)


def test_plain_characters_are_classified_alike():
    v = bpe.vocabulary(BYTES)
    for cp in range(0x3100):
        c = chr(cp)
        if v.plain.fullmatch(c):
            s = f"a{c}a1{c}1{c}!{c}? {c} "
            assert [s[a:b] for _, (a, b) in v.tok.pre_tokenizer.pre_tokenize_str(s)] == v.pattern.findall(s), hex(cp)


def test_invalid_ids_decode_like_the_library():
    v, rng = bpe.vocabulary(BYTES), random.Random(6)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert v.decode(np.array(ids)).decode() == v.tok.decode(ids, skip_special_tokens=False)
