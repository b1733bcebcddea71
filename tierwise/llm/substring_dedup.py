"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words. With a difference cover D modulo the period v, any two
positions i and j have a shift below v that brings both into D. So when a window repeats, the two places
share a run of window - v + 1 words that begins at cover positions of both: an anchor. Only anchors
(6 of 31 positions for the default) are hashed and exchanged. Anchors found in two documents are then
extended: the whole windows around them, and only these, are hashed in full and matched by 96 bits of hash, and
each is charged to the smallest document that holds it.

Both exchanges settle what they can before: a task compares its own rows first, and of a hash that several of
its documents have it sends on what one of them has, so a passage that a third of all documents share is
sent once by a task. No group is gathered; the rows of a hash stream by in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, Stored, WordHash, binary_texts, filtered, ids_of, keyed, letting_through, mix, prepare, releasing, texts_with_key, to_batch

#: Perfect difference covers: (period, positions). Fixed values.
COVERS = ((31, (1, 5, 11, 24, 25, 27)), (21, (3, 6, 7, 12, 14)), (13, (0, 1, 3, 9)), (7, (1, 2, 4)), (3, (0, 1)), (1, (0,)))

_PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_base, _other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_hashes = WordHash(7)


def _forget() -> None:
    _hashes.clear()


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period for which anchors keep at least two fifths of the window."""
    return next(c for c in COVERS if 5 * (window - c[0] + 1) >= 2 * window or c[0] == 1)


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int, at: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of the ``length`` words that begin at each position."""
    n = 1 << max(10, int(len(words)).bit_length())
    up, down = _powers(int(base), n)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return (sums[at + length] - sums[at]) * down[at]


#: Rows of hashes: k deals them out; state is one of the three below. Rows that a task holds until it settles them.
_SCHEMA = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int32()), ("pos", pa.int32()), ("state", pa.int8())])
_DDL = "k long, h long, g int, doc_id long, row int, pos int, state byte"
#: Only other tasks can tell; another document of this task has the hash as well; settled, to be returned.
ASK, KNOWN, SETTLED = 0, 1, 2
HELD, OUT_ROWS = 1 << 18, 1 << 16


def groups_of(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal (h, g), and the number of the run of each row."""
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def settled_here(rows: dict[str, np.ndarray], later: bool) -> dict[str, np.ndarray]:
    """Settles a task's rows as far as they tell.

    later: wanted are the rows of hashes that a smaller document has; else those of hashes that another document has.
    """
    order = np.lexsort((rows["doc_id"], rows["g"], rows["h"]))
    r = {k: v[order] for k, v in rows.items()}
    first, run = groups_of(r["h"], r["g"])
    low = r["doc_id"][first]
    if later:
        sure, known = r["doc_id"] > low[run], np.empty(0, np.int64)
    else:
        many = low < np.maximum.reduceat(r["doc_id"], first) if len(first) else np.empty(0, bool)
        sure, known = many[run], first[many]
    r["state"] = np.where(sure, SETTLED, ASK).astype(np.int8)
    r["k"] = np.where(sure, mix(r["doc_id"].view(np.uint64)).view(np.int64), r["h"])
    more = {k: v[known] for k, v in r.items()}
    more["state"], more["k"] = np.full(len(known), KNOWN, np.int8), more["h"].copy()
    r["h"][sure], r["g"][sure] = 0, 0  # needed no more
    return {k: np.concatenate([r[k], more[k]]) for k in _SCHEMA.names}


def settling(found, later: bool):
    """An Arrow function from one that yields arrays of rows: gathers them, settles them and hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = settled_here({k: np.concatenate([x[k] for x in held]) for k in held[0]}, later)
                for i in range(0, len(rows["h"]), OUT_ROWS):
                    yield to_batch({k: v[i : i + OUT_ROWS] for k, v in rows.items()}, _SCHEMA)

        for rows in found(batches):
            held.append(rows)
            n += len(rows["h"])
            if n >= HELD:
                yield from done()
                held, n = [], 0
        yield from done()

    return run


def _settle(rows: DataFrame, later: bool) -> DataFrame:
    """(doc_id, row, pos) of the rows that are wanted; rows are dealt out by k and stream by in order of (k, h, g, doc_id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int32()), ("pos", pa.int32())])

    def wanted(r: dict[str, np.ndarray]) -> np.ndarray:
        first, run = groups_of(r["h"], r["g"])
        if not len(first):
            return np.empty(0, bool)
        low = np.minimum.reduceat(r["doc_id"], first)
        if later:
            return r["doc_id"] > low[run]
        many = (low < np.maximum.reduceat(r["doc_id"], first)) | np.maximum.reduceat(r["state"] == KNOWN, first)
        return many[run] & (r["state"] == ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.empty(0, _SCHEMA.field(k).type.to_pandas_dtype()) for k in _SCHEMA.names}

        def out(r: dict[str, np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
            if at.any():
                yield to_batch({k: r[k][at] for k in schema.names}, schema)

        for b in batches:
            new = {k: b.column(i).to_numpy() for i, k in enumerate(_SCHEMA.names)}
            sure = new["state"] == SETTLED
            yield from out(new, sure)
            r = {k: np.concatenate([held[k], new[k][~sure]]) for k in _SCHEMA.names}
            first, _ = groups_of(r["h"], r["g"])
            cut = first[-1] if len(first) else 0  # the last run may go on
            done, held = {k: v[:cut] for k, v in r.items()}, {k: v[cut:] for k, v in r.items()}
            yield from out(done, wanted(done))
        yield from out(held, wanted(held))

    dealt = rows.repartition("k").sortWithinPartitions("k", "h", "g", "doc_id")
    return dealt.select(*_SCHEMA.names).mapInArrow(run, "doc_id long, row int, pos int")


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    period, cover = cover_for(window)
    length = window - period + 1
    marks = np.zeros(period, bool)
    marks[list(cover)] = True

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            for d, t in zip(ids_of(b), binary_texts(b), strict=True):
                words = t.split()
                if d is None or len(words) < window:
                    continue
                at = np.arange(len(words) - length + 1)
                at = at[marks[at % period]]
                none = np.zeros(len(at), np.int32)
                yield {"h": run_hashes(_hashes.of(words), length, at, _base).view(np.int64), "g": none, "doc_id": np.full(len(at), d, np.int64), "row": none, "pos": at.astype(np.int32)}
            _hashes.trim()

    return texts_with_key(docs).mapInArrow(releasing(settling(found, later=False), _forget), _DDL)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Full hashes of the windows that hold a repeated anchor. docs: doc_id, text, anchors."""
    period, _ = cover_for(window)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            for d, t, a in zip(ids_of(b), binary_texts(b), arrays_of(b, "anchors"), strict=True):
                words = t.split()
                n = len(words) - window + 1
                if n < 1:
                    continue
                diff = np.zeros(n + 1, np.int64)
                a = a[a - period + 1 < n]
                np.add.at(diff, np.maximum(a - period + 1, 0), 1)
                np.add.at(diff, np.minimum(a + 1, n), -1)
                at = np.flatnonzero(np.cumsum(diff[:-1]) > 0)
                w = _hashes.of(words)
                g = (run_hashes(w ^ (w >> np.uint64(29)), window, at, _other) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield {"h": run_hashes(w, window, at, _base).view(np.int64), "g": g, "doc_id": np.full(len(at), d, np.int64), "row": np.full(len(at), _row(t), np.int32), "pos": at.astype(np.int32)}
            _hashes.trim()

    return docs.mapInArrow(releasing(settling(found, later=True), _forget), _DDL)


def arrays_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray | None]:
    """A list column as numpy arrays, without an object for each element; null is None."""
    column = batch.column(batch.schema.get_field_index(name))
    flat, ends, there = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_pylist()
    return [flat[a:z] if ok else None for a, z, ok in zip(ends[:-1], ends[1:], there, strict=True)]


def _row(text: bytes) -> int:
    """Tells rows apart that share an id."""
    return int(np.uint32(xxhash.xxh32_intdigest(text)).view(np.int32))


def _cut(docs: DataFrame, window: int, passthrough: list[str], keep: IdFilter, outside: bool) -> DataFrame:
    """Applies removals to the rows inside or outside a filter. docs: doc_id, text, starts (row << 32 | pos, as an array of long; null: none), passthrough."""
    out_schema = docs.select("doc_id", "text", *passthrough).schema
    ddl = f"doc_id long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out_schema.fields if f.name != 'doc_id')}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"

    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in letting_through(batches, shared.value, outside):
            texts, n_words, n_removed, sha, spans = [], [], [], [], []
            raw = binary_texts(b)
            for t, starts in zip(raw, arrays_of(b, "starts"), strict=True):
                words = t.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if starts is not None:
                    at = starts[starts >> 32 == _row(t)] & 0xFFFFFFFF
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + window, len(words)), -1)
                gone = np.cumsum(gone)[: len(words)] > 0
                left = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans.append([{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)])
                if gone.any():
                    pieces = _PIECE.findall(t)
                    lead = t[: len(t) - sum(map(len, pieces))]
                    texts.append((lead + b"".join(p for p, g in zip(pieces, gone, strict=True) if not g)).decode())
                else:
                    texts.append(None)  # unchanged
            at = b.schema.get_field_index("text")
            before = b.column(at)
            same = pa.array([x is None for x in texts])
            text = pc.if_else(same, before.cast(pa.string()), pa.array(texts, pa.string()))
            arrays = [b.column(b.schema.get_field_index("doc_id")), text, *[b.column(b.schema.get_field_index(c)) for c in passthrough]]
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", *passthrough, "n_words", "n_removed", "kept_sha256", "spans"])

    return keyed(docs.select("doc_id", "text", *passthrough, "starts")).mapInArrow(releasing(run, _forget), ddl)


def substring_dedup(docs: DataFrame, window: int = 50, passthrough: list[str] | None = None) -> DataFrame:
    """Removes words covered by a window that also starts in a document with a smaller doc_id.

    docs: doc_id, text, and the columns named in passthrough, returned as they are; others are ignored.
    Returns doc_id, text (the kept words with their own white space), passthrough, n_words, n_removed,
    kept_sha256 (kept words joined by one space) and spans (word ranges removed), one row per input row.

    Windows are judged on the input. Null, empty and short texts keep all words; an unchanged null text
    stays null. Null doc_id: nothing is removed and nothing is matched. Rows that share an id never
    remove words from each other; each is judged by its own text. Empty table: empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    stored = Stored(spark)
    passthrough = passthrough or []
    hits = stored.keep(_settle(_anchors(docs, window), later=False).groupBy("doc_id").agg(F.collect_set("pos").alias("anchors")))

    near = filtered(texts_with_key(docs.where("doc_id is not null")), IdFilter(hits.select("doc_id")))
    again = _settle(_windows(near.join(hits, "doc_id"), window), later=True)
    place = F.shiftleft(F.col("row").cast("long"), 32) + F.col("pos")
    starts = stored.keep(again.groupBy("doc_id").agg(F.collect_list(place).alias("starts")))
    stored.drop(hits)

    none = F.lit(None).cast("array<long>").alias("starts")
    touched = IdFilter(starts.select("doc_id"))
    rows = docs.select("doc_id", "text", *passthrough)
    clean = _cut(rows.select("*", none), window, passthrough, touched, outside=True)
    changed = _cut(filtered(rows, touched).join(starts, "doc_id", "left"), window, passthrough, touched, outside=False)
    return clean.unionByName(changed)
