"""Phrase collocations by set-oriented relational mining (SETM).

Level by level there is a relation of occurrences, sorted by piece and position and kept in stored
tables: level 1 has every word of every piece, level k every place where a frequent phrase of k words stands.  The
next level is a merge join of the relation with itself on the piece and the adjacent position, a count
by group (first k words, last k words), and a semi-join with the groups that are frequent; only those are
extended.  Phrases are numbers from the first level on, unique per language, so no hash stands for a phrase.

How the work is dealt: a piece lies within one text, so the relation is kept in chunks of a few megabytes of text (one row
each) and the merge join needs no exchange.  What leaves a chunk is each of its different groups once, with a
count, packed into one row per bucket of groups; a bucket sums its groups, numbers the frequent ones and answers every chunk
with the numbers of those it sent.  The number of buckets follows the bytes of text, so neither a chunk nor a bucket grows with
the input, and a word in a third of all places reaches its bucket once per chunk.  Tables of frequent phrases are
joined, never gathered.

Defined results: null and empty texts have no pieces; a null language is `und`; a null doc_id plays no part;
repeated rows count each; an empty table gives an empty result; further columns play no part.  Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm import packed, wordhash
from tilequarry.llm.common import Scratch, released
from tilequarry.llm.tokens import arrow_slices

#: Longest phrase, least number of occurrences, and phrases reported for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Of a candidate's occurrences, the percentage that a longer one must have to displace it.
COVER = 100
#: Bytes of text of a chunk, and for each bucket of groups.
CHUNK_BYTES, BUCKET_BYTES = 5 << 20, 16 << 20

#: Classes of bytes: part of a word, between words, between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: A chunk's relation (codes of its occurrences and their places), or the groups it sends to a bucket: codes from `start` on,
#: the gaps of a, and b (at level 1 the words and their lengths) and their counts.
STORED = "chunk long, codes binary, place binary, bucket long, lang string, start long, a binary, b binary, n binary"
#: A bucket's answer to a chunk (codes and ids), a frequent phrase, or the number of words of a language.
ANSWERS = "chunk long, codes binary, ids binary, id long, lang string, phrase binary, a long, b long, n long"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 0 or more: as many bytes each as the largest needs, byte by byte one after the other, compressed."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed_: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed_[:8], "little"), packed_[8]
    planes = np.frombuffer(pa.decompress(packed_[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([_unpack(x) for x in column.to_pylist()])


def _rows(schema: str, names: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows with the named columns of a schema, the others null."""
    at, given = {c: k for k, c in enumerate(names.split())}, list(zip(*rows))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(given[at[c]], _ARROW[t]) if c in at else pa.nulls(len(rows), _ARROW[t]) for c, t in fields], [c for c, _ in fields])


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the text of each, and whether each is the first of its piece."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _CLASS[data]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    found = _strings(offsets, data[inside])
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return found, np.searchsorted(borders, starts, "right") - 1, np.diff(piece, prepend=-1) != 0


def _strings(offsets: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _dealt(bucket: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Groups in the order of their bucket (and more): that order, the new code of each, and the ranges of equal ones."""
    order = np.lexsort((bucket, *more))
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    first, size = packed.runs(bucket[order], *(m[order] for m in more))
    return order, code, list(zip(first.tolist(), (first + size).tolist()))


def _mixed(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    x = wordhash.mix(a.astype(np.uint64)) ^ b.astype(np.uint64)
    return (wordhash.mix(x) >> np.uint64(16)) % np.uint64(buckets)


@released
def _first_relation(batches: Iterator[pa.RecordBatch], chunk_bytes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks of text as the relation of level 1 (codes of words, firsts of pieces) and the words of each bucket."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, texts in arrow_slices(batch, batch.column(1), chunk_bytes):
            found, text, first = _words(texts)
            if not len(found):
                continue
            counted, langs = found.dictionary_encode(), part.column(0).dictionary_encode()
            spelled, names = counted.dictionary, langs.dictionary.to_pylist()
            word = counted.indices.to_numpy().astype(np.int64)
            lang = langs.indices.to_numpy().astype(np.int64)[text]
            known, codes, n = np.unique(lang * len(spelled) + word, return_inverse=True, return_counts=True)
            hashes, _ = wordhash.words([b" ".join(spelled.to_pylist())])
            lang, word = known // len(spelled), known % len(spelled)
            order, code, ranges = _dealt(hashes[word] % np.uint64(buckets), lang)
            ordered = spelled.take(pa.array(word[order]))
            ends, data = np.frombuffer(ordered.buffers()[1], np.int64)[:len(ordered) + 1], ordered.buffers()[2]
            yield _rows(STORED, "chunk codes place", [(chunk, _pack(code[codes]), _pack(np.packbits(first)))])
            yield _rows(STORED, "chunk bucket lang start a b n", [
                (chunk, int(hashes[word[order[a]]] % np.uint64(buckets)), names[lang[order[a]]], a,
                 pa.compress(data[ends[a]:ends[b]], "zstd", asbytes=True), _pack(np.diff(ends[a:b + 1])), _pack(n[order[a:b]]))
                for a, b in ranges])
            chunk += 1


def _answered(rows: pa.Table, group: np.ndarray, sizes: list[int], ids: np.ndarray) -> list[tuple]:
    """To each row's chunk: the codes whose group has a number, and the numbers."""
    out, at = [], 0
    for chunk, start, size in zip(rows.column("chunk").to_pylist(), rows.column("start").to_pylist(), sizes):
        own = ids[group[at:at + size]]
        hit = np.flatnonzero(own >= 0)
        if len(hit):
            out.append((chunk, _pack(start + hit), _pack(own[hit])))
        at += size
    return out


def _numbered(total: np.ndarray, least: int, bucket: int, buckets: int, before: int) -> np.ndarray:
    """The id of each frequent group of a bucket, -1 for the others."""
    ids = np.full(len(total), -1, np.int64)
    often = np.flatnonzero(total >= least)
    ids[often] = (before + np.arange(len(often))) * buckets + bucket
    return ids


def _frequent_words(rows: pa.Table, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket, before = rows.column("bucket")[0].as_py(), 0
    for lang in sorted(set(rows.column("lang").to_pylist())):
        own = rows.filter(pc.equal(rows.column("lang"), lang))
        lengths, n = [_unpack(x) for x in own.column("b").to_pylist()], _joined(own.column("n"))
        ends = np.cumsum(np.concatenate(([0], *lengths)))
        spelled = [pa.decompress(x, int(w.sum()), "zstd", asbytes=True) for x, w in zip(own.column("a").to_pylist(), lengths)]
        counted = _strings(ends, b"".join(spelled)).dictionary_encode()
        group = counted.indices.to_numpy()
        total = np.zeros(len(counted.dictionary), np.int64)
        np.add.at(total, group, n)
        ids = _numbered(total, least, bucket, buckets, before)
        often = np.flatnonzero(ids >= 0)
        before += len(often)
        yield _rows(ANSWERS, "lang n", [(lang, int(total.sum()))])
        if len(often):
            yield _rows(ANSWERS, "chunk codes ids", _answered(own, group, [len(x) for x in lengths], ids))
            spelled = counted.dictionary.take(pa.array(often)).to_pylist()
            yield _rows(ANSWERS, "id lang phrase n", list(zip(ids[often].tolist(), [lang] * len(often), spelled, total[often].tolist())))


def _frequent_groups(rows: pa.Table, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = [_unpack(x) for x in rows.column("n").to_pylist()]
    a, b = np.concatenate([np.cumsum(_unpack(x)) for x in rows.column("a").to_pylist()]), _joined(rows.column("b"))
    order = np.lexsort((b, a))
    first, size = packed.runs(a[order], b[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), size)
    total = np.add.reduceat(np.concatenate(counts)[order], first)
    ids = _numbered(total, least, rows.column("bucket")[0].as_py(), buckets, 0)
    often = np.flatnonzero(ids >= 0)
    if len(often):
        yield _rows(ANSWERS, "chunk codes ids", _answered(rows, group, [len(x) for x in counts], ids))
        at = order[first[often]]
        yield _rows(ANSWERS, "id a b n", list(zip(ids[often].tolist(), a[at].tolist(), b[at].tolist(), total[often].tolist())))


def _adjacent(chunk: int, ids: np.ndarray, at: np.ndarray, joined: np.ndarray, names: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The relation one word longer: `joined` are the rows that the next row follows, `ids` numbers into `names` (ascending)."""
    if not len(joined):
        return
    m = np.int64(len(names))
    known, codes, n = np.unique(ids[joined] * m + ids[joined + 1], return_inverse=True, return_counts=True)
    a, b = names[known // m], names[known % m]
    bucket = _mixed(a, b, buckets)
    order, code, ranges = _dealt(bucket)
    yield _rows(STORED, "chunk codes place", [(chunk, _pack(code[codes]), _pack(np.diff(at[joined], prepend=0)))])
    yield _rows(STORED, "chunk bucket start a b n", [
        (chunk, int(bucket[order[s]]), s, _pack(np.diff(a[order[s:e]], prepend=0)), _pack(b[order[s:e]]), _pack(n[order[s:e]]))
        for s, e in ranges])


def _next_relation(rows: pa.Table, level: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's relation and the answers to it -> its frequent part, merge-joined to the relation of the next level."""
    relation = rows.filter(pc.is_valid(rows.column("place")))
    if not relation.num_rows or relation.num_rows == rows.num_rows:
        return
    answers = rows.filter(pc.is_null(rows.column("place")))
    code, names = _joined(answers.column("codes")), _joined(answers.column("ids"))
    order = np.argsort(names)
    code, names = code[order], names[order]
    codes, place = _unpack(relation.column("codes")[0].as_py()), _unpack(relation.column("place")[0].as_py())
    number = np.full(int(max(codes.max(), code.max())) + 1, -1, np.int64)
    number[code] = np.arange(len(code))
    ids, chunk = number[codes], relation.column("chunk")[0].as_py()
    if level == 1:
        first = np.unpackbits(place.astype(np.uint8), count=len(codes)).astype(bool)
        joined = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & ~first[1:])
        yield from _adjacent(chunk, ids, np.arange(len(codes)), joined, names, buckets)
    else:
        kept = np.flatnonzero(ids >= 0)
        at = np.cumsum(place)[kept]
        yield from _adjacent(chunk, ids[kept], at, np.flatnonzero(at[1:] == at[:-1] + 1), names, buckets)


def _by_group(rows: DataFrame, key: str, task: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """task() of all rows of each key."""
    empty = _rows(schema, "", []).schema

    @released
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(pa.Table.from_batches(list(group)))

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(table.to_batches()))), empty)

    return rows.groupBy(key).applyInArrow(whole, schema)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, lang: str = "lang",
                     text: str = "text", chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, total), and a table for each number of words from 1 on of the phrases with `least`
    occurrences: id, lang, phrase, last (word), n, pre and suf (occurrences of its first and last 1, 2, ... words), a and b
    (ids of its first and last words but one)."""
    typed = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("t"))
    if buckets is None:
        buckets = 1 + (typed.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BUCKET_BYTES
    stored = scratch.written(typed.mapInArrow(partial(_first_relation, chunk_bytes=chunk_bytes, buckets=buckets), STORED), "occurrences")
    totals, tables = None, []
    for k in range(1, longest + 1):
        groups = stored.where("bucket IS NOT NULL").select("chunk", "bucket", "lang", "start", "a", "b", "n")
        task = partial(_frequent_words if k == 1 else _frequent_groups, least=least, buckets=buckets)
        answers = scratch.written(_by_group(groups, "bucket", task, ANSWERS), "answers")
        found = answers.where("id IS NOT NULL")
        if k == 1:
            totals = scratch.written(answers.where("lang IS NOT NULL AND id IS NULL").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
            one = F.array("n")
            named = found.select("id", "lang", F.col("phrase").cast("string").alias("phrase"), F.col("phrase").cast("string").alias("last"),
                                 "n", one.alias("pre"), one.alias("suf"), "a", "b")
        else:
            left = tables[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), "pre")
            right = tables[-1].select(F.col("id").alias("b"), "last", "suf")
            named = found.select("id", "a", "b", "n").join(left, "a").join(right, "b").select(
                "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "n",
                F.concat("pre", F.array("n")).alias("pre"), F.concat("suf", F.array("n")).alias("suf"), "a", "b")
        tables.append(scratch.written(named, "phrases"))
        if k < longest:
            relation = stored.where("place IS NOT NULL").select("chunk", "codes", "place", F.lit(None).cast("binary").alias("ids"))
            replies = answers.where("ids IS NOT NULL").select("chunk", "codes", F.lit(None).cast("binary").alias("place"), "ids")
            longer = _by_group(relation.unionAll(replies), "chunk", partial(_next_relation, level=k, buckets=buckets), STORED)
            before, stored = stored, scratch.written(longer, "occurrences")
            scratch.drop(before)
        scratch.drop(answers)
    scratch.drop(stored)
    return totals, tables


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER,
                 lang: str = "lang", text: str = "text", chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each language.

    A phrase is scored at its weakest cut in two.  It gives way to a longer one around it that has
    `cover` percent of its occurrences; since a phrase between the two has at least as many as the longer one,
    those one word longer decide.
    """
    scratch = Scratch(docs.sparkSession)
    totals, tables = frequent_phrases(docs, scratch, longest, least, lang, text, chunk_bytes, buckets)
    kept = None
    for k in range(2, longest + 1):
        own = tables[k - 1]
        if k < longest:
            longer = tables[k]
            around = longer.select(F.col("a").alias("id"), "n").unionAll(longer.select(F.col("b").alias("id"), "n"))
            most = around.groupBy("id").agg(F.max("n").alias("most"))
            own = own.join(most, "id", "left").where(f"most IS NULL OR 100 * most < {int(cover)} * n")
        own = own.select("lang", "phrase", "n", "pre", "suf")
        kept = own if kept is None else kept.unionAll(own)
    a, words_, n = F.col("n"), F.size("pre"), F.col("total")
    cuts = F.transform(F.sequence(F.lit(1), words_ - 1), lambda j: F.struct(
        _score(a, n, F.get("pre", j - 1), F.get("suf", words_ - j - 1)).alias("score"), j.alias("j"),
        F.get("pre", j - 1).alias("l"), F.get("suf", words_ - j - 1).alias("r")))
    scored = kept.join(totals, "lang").select("lang", "phrase", "n", "total", F.array_min(cuts).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("n"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"),
                         F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
