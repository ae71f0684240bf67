"""Encoding whole columns of texts with public tokenizers: each distinct piece of a batch is encoded once."""

from __future__ import annotations

import os
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by one worker, over its tasks; beyond that it starts anew.
REMEMBERED = 300_000
#: Pieces of the word vocabulary remembered likewise; they are short.
PIECES = 400_000
#: Bytes of text handled at a time, so that arrays stay small whatever the batch.
SLICE_BYTES = 4 << 20


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... for all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Remembering:
    """Encodes pieces through `encode_all`, each distinct one once."""

    def __init__(self, encode_all: Callable[[list], Iterable[Sequence[int]]], most: int = REMEMBERED):
        self.encode_all, self.most = encode_all, most
        self.clear()

    def clear(self) -> None:
        self.at: dict = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def table(self, pieces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each of these different pieces begins in them and how many it has."""
        if len(self.at) > self.most:
            self.clear()
        rows = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            found = list(self.encode_all(new))
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
            rows[missing] = np.arange(len(self.at), len(self.at) + len(new))
            self.at.update(zip(new, rows[missing].tolist()))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(size) - size))
            self.lengths, self.flat = np.concatenate((self.lengths, size)), np.concatenate((self.flat, ids))
        return self.flat, self.starts[rows], self.lengths[rows]

    def __call__(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        place: dict = {}
        rows = np.fromiter((place.setdefault(p, len(place)) for p in pieces), np.int64, len(pieces))
        flat, starts, lengths = self.table(list(place))
        per_piece = lengths[rows]
        return flat[ragged(starts[rows], per_piece)], per_piece


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a list that hold about `most` bytes each, one text at least."""
    a, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def arrow_slices(batch: pa.RecordBatch, texts: pa.Array, most: int = SLICE_BYTES // 2) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in parts with about `most` bytes of text each, and the texts of each part (null: empty)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // most
    cut = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
    for a, b in zip(cut, cut[1:]):
        if a < b:
            part = texts.slice(a, b - a)
            yield batch.slice(a, b - a), pc.fill_null(part, b"" if pa.types.is_binary(part.type) else "").to_pylist()


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies, by the published rule."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


#: Words whose lower case, normal form and pieces Python and the library see alike: Latin letters,
#: digits and signs, without the dotted capital I and special strings.  Others go through the library.
_SIMPLE = regex.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u024f]++")
#: The published pattern of the lower-case word vocabulary (fixed value).
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
#: Class of each byte; those beyond ASCII are odd unless two of them make a letter, as is the apostrophe of endings.
_CLASS = np.array([_SPACE if b in b" \t\n\v\f\r" else _ODD if not 33 <= b <= 126 or b == 39 else
                   _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Second bytes of U+00C0 to U+00FF that make letters, of those the capitals, and pieces without any.
_SECOND = np.array([128 <= b < 192 and b not in (0x97, 0xb7) for b in range(256)])
_CAPITAL = np.array([128 <= b <= 0x9e and b != 0x97 for b in range(256)])
_LETTERS = regex.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that are no white space, in lower case, where the pieces in them begin, and where they began in `data`.

    A piece is a run of ASCII and Latin-1 letters, a digit, or a run of signs; a word with anything else, or with
    the beginning of a special string, is one piece and keeps its case.
    """
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, low = _CLASS[data], _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xc3)
    at = at[_SECOND[data[at + 1]]]
    kind[at] = kind[at + 1] = _LETTER
    low[at[_CAPITAL[data[at + 1]]] + 1] += 32
    odd = np.flatnonzero(kind == _ODD)
    odd = np.concatenate((odd, (mark := np.flatnonzero(data[:-1] == ord("<")))[data[mark + 1] == ord("|")]))
    if len(odd):
        space = np.concatenate(([-1], np.flatnonzero(kind == _SPACE), [len(data)]))
        word = np.unique(np.searchsorted(space, odd))
        whole = ragged(space[word - 1] + 1, space[word] - space[word - 1] - 1)
        kind[whole], low[whole] = _ODD, data[whole]
    new = kind[1:] != kind[:-1]
    new |= kind[1:] == _DIGIT
    first = np.concatenate(([0], np.flatnonzero(new) + 1))
    length = np.diff(np.append(first, len(data)))
    piece = kind[first] != _SPACE
    first, length = first[piece], length[piece]
    return low[kind != _SPACE], np.cumsum(length) - length, first


@lru_cache(maxsize=1)
def word_encoder(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Texts (UTF-8) -> all ids, ids per text, for a tokenizer that drops white space and never looks across it.

    Such a tokenizer's ids of a text are those of its words in a row, and of a plain word those of its pieces;
    test_tokens holds that against the library on whole texts.
    """
    tok = load(path)
    merge, chars = tok.model.tokenize, "".join(byte_characters())

    def encode_pieces(new: list[bytes]) -> Iterator[Sequence[int]]:
        for raw in new:
            if raw.isalpha():  # of bytes: ASCII letters only
                yield [t.id for t in merge(raw.decode())]
            elif _LETTERS.fullmatch(raw):
                yield [t.id for t in merge(charmap_decode(raw, "strict", chars)[0])]
            else:
                word = raw.decode("utf-8", "replace")
                if _SIMPLE.fullmatch(word) and "<|" not in word:
                    shown = [charmap_decode(p.encode(), "strict", chars)[0] for p in _WORD_PIECES.findall(word.lower())]
                    yield [t.id for p in shown for t in merge(p)]
                else:
                    yield tok.encode(word, add_special_tokens=False).ids

    pieces = Remembering(encode_pieces, PIECES)

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join((*texts, b"")), np.uint8)
        low, starts, first = _runs(data)
        offsets = np.append(starts, len(low)).astype(np.int32)
        counted = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        rows = counted.indices.to_numpy()
        flat, starts, lengths = pieces.table(counted.dictionary.to_pylist())
        per_piece = lengths.astype(np.int32)[rows]
        ends = np.concatenate(([0], np.cumsum(per_piece, dtype=np.int32)), dtype=np.int32)
        at = np.repeat(starts.astype(np.int32)[rows] - ends[:-1], per_piece)
        at += np.arange(len(at), dtype=np.int32)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return flat[at], np.diff(ends[np.searchsorted(first, text_ends)].astype(np.int64), prepend=0)

    return encode
