"""Byte-level BPE encoding and decoding by tree concatenation.

Encoding follows the library: special strings first, then the pre-tokenizer's pieces.
Pieces are independent, so each distinct one is encoded once per task.  A piece longer
than `leaf` characters (a run the pre-tokenizer does not split) is cut into leaves that are encoded in
parallel, as rows of their own, then joined pairwise up a tree: around each join a
window of the last and first tokens is encoded again and grows until it ends on both sides in
the tokens already there.  Adjacent tokens then all belong together, which for
byte-pair merges makes the sequence the encoding of the whole.

Defined results: null and empty texts have no ids and decode to an empty text; doc_id and
all other columns are carried in `doc`, whatever their names; repeated rows each get
their result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.common import released, row_struct, written
from tilequarry.llm.tokens import Remembering, arrow_slices, byte_characters, load, ragged

#: Characters of an unsplit piece from which on it is cut, and of a leaf at most.
LEAF = 4096
#: Tokens of either side in the first window around a join, and how many must come out unchanged.
WINDOW, AGREE = 8, 2
#: Bytes of text encoded at a time, and pieces remembered.
SLICE, REMEMBERED = 1 << 20, 100_000

#: The published byte-level pre-tokenizer pattern (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the regex module classifies as the library does; texts with others go through the library.
PLAIN = r"[\x00-՗֐-ࢎऀ-౛ -₎　-ꟍ가-힣]*+"


class Bpe:
    """One vocabulary file, loaded once per task."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.pattern = regex.compile(PIECES)
        self.plain = regex.compile(PLAIN)
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.added = added
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        chars = byte_characters()
        self.to_chars = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        strings = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            strings[i] = s.encode() if s in added else bytes(back[c] for c in s)
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.strings = strings
        self.pieces = Remembering(lambda new: [[self.added[p]] if p in self.added else self.merge(p.encode()) for p in new], REMEMBERED)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of bytes that the pre-tokenizer does not split."""
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.to_chars))]

    def cut(self, text: str) -> list[str]:
        """Special strings and pre-tokenizer pieces of a text, in order; joined they are the text."""
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif self.plain.fullmatch(part):
                out.extend(self.pattern.findall(part))
            else:
                out.extend(part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ids per text."""
        cut = [self.cut(t) for t in texts]
        ids, per_piece = self.pieces([p for c in cut for p in c])
        ends = np.concatenate(([0], np.cumsum(per_piece)))[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8; what is no UTF-8 becomes replacement characters, as in the library."""
        raw = self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring stretches of one piece from the ids of either."""
        k = WINDOW
        while True:
            head, tail = left[-k:], right[:k]
            again = self.merge(b"".join(self.strings[i] for i in [*head, *tail]))
            whole_left, whole_right = k >= len(left), k >= len(right)
            if (whole_left or again[:AGREE] == head[:AGREE]) and (whole_right or again[-AGREE:] == tail[-AGREE:]):
                return [*left[:-k], *again, *right[k:]]
            k *= 2

    def join_all(self, leaves: list[list[int]]) -> list[int]:
        """Neighbours joined pairwise, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k:k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def merge_long(self, piece: bytes, leaf: int = LEAF) -> list[int]:
        """merge() by the tree, in one place."""
        return self.join_all([self.merge(piece[a:a + leaf]) for a in range(0, len(piece), leaf)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _packed(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
    return [raw[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]


def _leaves(batches: Iterator[pd.DataFrame], path: str, leaf: int) -> Iterator[pd.DataFrame]:
    """digest, seq, leaf, whole, part: stretches of short pieces as they are, long pieces leaf by leaf."""
    v = vocabulary(path)
    for b in batches:
        for digest, text in zip(b["digest"], b["t"]):
            rows, held, seq = [], [], 0
            for p in [*v.cut(text), ""]:
                if (len(p) > leaf or not p) and held:
                    rows.append((digest, seq, 0, True, "".join(held).encode()))
                    held, seq = [], seq + 1
                if len(p) > leaf:
                    raw = p.encode()
                    rows += [(digest, seq, a // leaf, False, raw[a:a + leaf]) for a in range(0, len(raw), leaf)]
                    seq += 1
                elif p:
                    held.append(p)
            yield pd.DataFrame(rows, columns=["digest", "seq", "leaf", "whole", "part"])


def _encode_leaves(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    v = vocabulary(path)
    for b in batches:
        ids = [v.encode([p.decode()])[0] if whole else v.merge(p) for p, whole in zip(b["part"], b["whole"])]
        yield b[["digest", "seq", "leaf"]].assign(ids=[np.asarray(i, "<u4").tobytes() for i in ids])


def _join_leaves(rows: pd.DataFrame, path: str) -> pd.DataFrame:
    """One text: the leaves of each long piece up the tree, then the stretches in order."""
    v = vocabulary(path)
    out = []
    for _, part in rows.sort_values(["seq", "leaf"]).groupby("seq"):
        out.append(np.asarray(v.join_all([np.frombuffer(i, "<u4").tolist() for i in part["ids"]]), "<u4"))
    return pd.DataFrame({"digest": [rows["digest"].iloc[0]], "ids": [np.concatenate(out).tobytes()]})


def unsplit(text: Column, leaf: int = LEAF) -> Column:
    """Whether a text may hold a piece of over `leaf` characters; decides the route only, never the ids."""
    return (F.length(text) > leaf) & text.rlike(rf"(?<!\S)\S{{{leaf}}}|\s{{{leaf}}}")


def encode(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """doc (all input columns), ids (binary, little-endian unsigned 32-bit); with `decoded` also what they decode to.

    Decoding looks at the ids only; doing it in the same pass spares moving them twice.
    """
    typed = docs.withColumn(text, docs[text].cast("string"))
    rows = typed.select(row_struct(typed))
    body = F.coalesce(F.col("doc").getField(text), F.lit(""))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, ids binary" + ", decoded binary" * decoded

    @released
    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for part, texts in arrow_slices(b, b.column(0).field(text), SLICE):
                ids, counts = v.encode(texts)
                out = {"doc": part.column(0), "ids": pa.array(_packed(ids, counts), pa.binary())}
                if decoded:
                    each = np.split(ids, np.cumsum(counts)[:-1])
                    out["decoded"] = pa.array([v.decode(x) for x in each], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    long = unsplit(body, leaf)
    short = rows.where(~long).mapInArrow(beside, schema)
    longer = written(rows.where(long).withColumn("digest", F.sha2(body, 256)), "unsplit")
    leaves = longer.select("digest", body.alias("t")).dropDuplicates(["digest"]).mapInPandas(
        partial(_leaves, path=path, leaf=leaf), "digest string, seq long, leaf long, whole boolean, part binary")
    # Leaves are small rows now, so the shuffle deals even one text over all tasks.
    done = leaves.repartition("digest", "seq", "leaf").mapInPandas(
        partial(_encode_leaves, path=path), "digest string, seq long, leaf long, ids binary")
    whole = done.groupBy("digest").applyInPandas(lambda rows: _join_leaves(rows, path), "digest string, ids binary")
    if decoded:
        whole = whole.withColumn("decoded", decode(F.col("ids"), path))
    return short.unionByName(longer.join(whole, "digest").select(short.columns))


def decode(ids: Column, path: str) -> Column:
    """The text (UTF-8) of a binary column of ids."""

    @F.pandas_udf("binary")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for packed in batches:
            yield pd.Series([v.decode(np.frombuffer(p, "<u4")) for p in packed], dtype=object)

    return text_of(ids)
