"""Grouped prefix join of documents by the Jaccard index of their word n-gram sets.

1. One pass hashes each text to its set of word n-grams and counts all elements in a sketch of CELLS
   counters, whatever the size of the table. Texts with equal sets form one class, represented by the
   smallest id.
2. The sketch gives a total order of the elements: what is frequent comes last, ties go by hash. Any
   order common to all sets is exact; this one keeps passages that many documents share out of prefixes.
   Each class has a prefix: as many first elements as two linked sets cannot both differ in.
3. Classes with the same prefix and size collapse into a group. Only groups post their prefix elements,
   (element, group, size, position). Posts sorted by element stream through tasks, which pair groups that
   pass the bounds on sizes and on positions. Of an element with over FEW groups, each group is paired
   with one pivot of its size at first; a second round pairs what is left apart, so a large cluster of
   near copies costs a star instead of all its pairs. Pairs are filtered once more by parity bitmaps of
   the sets: the bits in which two bitmaps differ are no more than the elements in which the sets differ. A
   group is judged by one member's bitmap, less the bits in which any other member differs from it.
4. Pairs that pass all filters, nearly all of them links, make blocks. Each block's classes send their
   texts; inside, groups are formed again, group pairs without a common prefix element are skipped, and
   the others are expanded to members and verified by exact intersection counts. A block over TILE_DOCS
   members or TILE_ITEMS elements is cut into slices, and pairs of slices go to tasks of their own.
5. Tasks emit one edge per member, to the smallest id it was found linked with, and its number of links;
   components of these verified edges are the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, Stored, WordHash, binary_texts, components, filtered, ids_of, keyed, letting_through, mix, prepare, releasing, texts_with_key, to_batch

#: Members and elements of a slice of a large block.
TILE_DOCS, TILE_ITEMS = 2048, 1_000_000
#: Counters of the sketch, and the parts in which tasks hand it on.
CELLS, PARTS = 1 << 20, 64
#: Groups of an element that are paired at once; posts of an element that a task holds at a time.
FEW, CHUNK = 16, 1 << 16
#: Words that a task remembers.
WORDS = 1 << 17

_hashes = WordHash()


def _forget() -> None:
    _hashes.clear()


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z lower-cased; fewer words: one for all of them."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = _hashes.of(words)
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m])
    return np.unique(h)


def prefix_length(size: int, threshold: int) -> int:
    return size - -(-threshold * size // 100) + 1


def cells_of(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Level of each cell: 0 up to about its share of all elements, then one more for each doubling of what is above."""
    mean = int(counts.sum()) // len(counts)
    above = np.maximum(counts - mean, 0) // (2 * isqrt(mean) + 1)
    return np.frexp(above.astype(np.float64))[1].astype(np.uint8)


def prefix_of(items: np.ndarray, levels: np.ndarray, threshold: int) -> np.ndarray:
    """The first elements of a set (sorted by hash) in the common order."""
    order = np.argsort(levels[cells_of(items)], kind="stable")
    return items[order[: prefix_length(len(items), threshold)]]


def parity(items: np.ndarray) -> bytes:
    """Bitmap of as many bits as the set has elements or more: whether an odd number of elements falls on each."""
    bits = 1 << max(6, (len(items) - 1).bit_length())
    at = ((items >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, once the larger one is folded to the size of the smaller."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def may_link(n: int, a: bytes, m: int, b: bytes, threshold: int, spread: int = 0) -> bool:
    """False only where the bitmaps prove that sets of n and m elements differ in too many.

    For two groups these are the bitmaps of one member each; all others differ from them in ``spread`` bits together at most.
    """
    return apart(a, b) - spread <= (100 - threshold) * (n + m) // (100 + threshold)


def compatible(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of n and m elements can be linked when the first element they share stands at i and j."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    need = -(-threshold * (n + m) // (100 + threshold))
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= need)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (doc_id, n, fp), and each task's sketch in rows (part, cells)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("part", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        for b in batches:
            got = [shingle_set(t, n) for t in binary_texts(b)]
            _hashes.trim(WORDS)
            if any(map(len, got)):
                counts += np.bincount(cells_of(np.concatenate(got)), minlength=CELLS).astype(np.int32)
            none = [None] * len(got)
            yield to_batch({"doc_id": ids_of(b), "n": [len(s) for s in got], "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in got], "part": none, "cells": none}, schema)
        step, none = CELLS // PARTS, [None] * PARTS
        cells = [zlib.compress(counts[k * step : (k + 1) * step].tobytes(), 1) for k in range(PARTS)]
        yield to_batch({"doc_id": none, "n": none, "fp": none, "part": list(range(PARTS)), "cells": cells}, schema)

    return texts_with_key(docs).mapInArrow(releasing(run, _forget), "doc_id long, n long, fp binary, part int, cells binary")


def _levels(sets: DataFrame) -> np.ndarray:
    """Sums up the tasks' sketches, a part at a time; CELLS counters reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(cells), np.int32).astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "cells"])

    counts = np.zeros(CELLS, np.int64)
    step = CELLS // PARTS
    for r in sets.where("part is not null").select("part", "cells").repartition("part").mapInArrow(run, "part int, cells binary").collect():
        counts[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["cells"], np.int64)
    return levels_of(counts)


def _prefixes(docs: DataFrame, keep: IdFilter, levels: np.ndarray, n: int, threshold: int) -> DataFrame:
    """doc_id, n, gfp (digest of prefix and size), prefix and bitmap of the documents that the filter passes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("gfp", pa.binary()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])
    shared, passed = docs.sparkSession.sparkContext.broadcast(levels), docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in letting_through(batches, passed.value):
            got = [(d, s) for d, t in zip(ids_of(b), binary_texts(b), strict=True) if len(s := shingle_set(t, n))]
            _hashes.trim(WORDS)
            prefixes = [prefix_of(s, shared.value, threshold) for _, s in got]
            digests = [xxhash.xxh3_128_digest(p.tobytes() + len(s).to_bytes(8)) for p, (_, s) in zip(prefixes, got, strict=True)]
            yield to_batch({"doc_id": [d for d, _ in got], "n": [len(s) for _, s in got], "gfp": digests, "prefix": [p.view(np.int64) for p in prefixes], "bits": [parity(s) for _, s in got]}, schema)

    return keyed(texts_with_key(docs)).mapInArrow(releasing(run, _forget), "doc_id long, n int, gfp binary, prefix array<long>, bits binary")


_POST = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("chunk", pa.int32())])
_POST_DDL = "key long, a long, b long, n int, pos int, chunk int"


def few_pairs(key: np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray, threshold: int) -> np.ndarray:
    """All compatible pairs of groups with the same element; rows sorted by element."""
    out = [np.empty((0, 2), np.int64)]
    for d in range(1, len(key)):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            break
        i = i[compatible(n[i], pos[i], n[i + d], pos[i + d], threshold)]
        out.append(np.stack([np.minimum(g[i], g[i + d]), np.maximum(g[i], g[i + d])], 1))
    return np.unique(np.concatenate(out), axis=0)


def star_pairs(g: np.ndarray, n: np.ndarray, pos: np.ndarray, threshold: int) -> np.ndarray:
    """Compatible pairs of each group with a pivot of about its size; rows of one element, sorted by size.

    The pivot of a run of sizes is the smallest id of the median size, so that it is mostly the same for all
    elements that a cluster shares.
    """
    out, at = [np.empty((0, 2), np.int64)], 0
    while at < len(g):
        end = at + int(np.searchsorted(n[at:], 100 * int(n[at]) // threshold, "right"))
        same = at + np.flatnonzero(n[at:end] == n[(at + end) // 2])
        pivot = same[np.argmin(g[same])]
        i = np.arange(at, end)
        i = i[(i != pivot) & compatible(n[i], pos[i], n[pivot], pos[pivot], threshold)]
        out.append(np.stack([np.minimum(g[i], g[pivot]), np.maximum(g[i], g[pivot])], 1))
        at = end
    return np.concatenate(out)


def _pairs(posts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of groups from posts sorted by key, n and g; elements with over FEW groups come back too, in chunks."""

    def pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(pairs), pa.int32())
        return to_batch({"key": pa.nulls(len(pairs), pa.int64()), "a": pairs[:, 0], "b": pairs[:, 1], "n": none, "pos": none, "chunk": none}, _POST)

    def many(rows: tuple, chunk: int) -> Iterator[pa.RecordBatch]:
        key, g, n, pos = rows
        if len(pairs := star_pairs(g, n, pos, threshold)):
            yield pair_batch(pairs)
        yield to_batch({"key": key, "a": g, "b": pa.nulls(len(g), pa.int64()), "n": n, "pos": pos, "chunk": np.full(len(g), chunk, np.int32)}, _POST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        chunk = 0  # of the element whose posts are held

        def work(rows: tuple, last: bool) -> Iterator[pa.RecordBatch]:
            """Works off all elements but the last one, which may go on in the next batch."""
            nonlocal held, chunk
            key = rows[0]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            if last or not len(key):
                done, held = len(first), ()
            else:
                done, held = len(first) - 1, tuple(c[first[-1] :] for c in rows)
            few = np.repeat((size > 1) & (size <= FEW) & (np.arange(len(size)) < done), size)
            if done and chunk:
                few[: size[0]] = False
            if few.any() and len(pairs := few_pairs(*[c[few] for c in rows], threshold)):
                yield pair_batch(pairs)
            for k in range(done):
                if size[k] > FEW or (chunk and k == 0):
                    yield from many(tuple(c[first[k] : first[k] + size[k]] for c in rows), chunk)
                chunk = 0 if k == 0 else chunk
            while held and len(held[0]) >= CHUNK:
                yield from many(tuple(c[:CHUNK] for c in held), chunk)
                held, chunk = tuple(c[CHUNK:] for c in held), chunk + 1

        for b in batches:
            new = tuple(b.column(i).to_numpy() for i in range(4))
            yield from work(tuple(map(np.concatenate, zip(held, new, strict=True))) if held else new, False)
        if held:
            yield from work(held, True)

    return posts.mapInArrow(run, _POST_DDL)


def _cross_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Compatible pairs (a, b) of different blocks that share an element.

    rows: (key, i, j, side, n, g, pos, root), a tile (key, i, j) after the other. Only the groups outside a tile's largest block are
    paired with the others, so a cluster that is one block already costs nothing.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tile(t: dict[str, np.ndarray], cross: bool) -> np.ndarray:
        out = [np.empty((0, 2), np.int64)]
        roots, block, count = np.unique(t["root"], return_inverse=True, return_counts=True)
        outside = block != np.argmax(count)
        for x in np.flatnonzero(outside):
            ok = (block != block[x]) & (~outside | (np.arange(len(block)) < x))
            if cross:
                ok &= t["side"] != t["side"][x]
            i = np.flatnonzero(ok)
            i = i[compatible(t["n"][i], t["pos"][i], t["n"][x], t["pos"][x], threshold)]
            if len(i):
                out.append(np.stack([np.minimum(t["g"][i], t["g"][x]), np.maximum(t["g"][i], t["g"][x])], 1))
        return np.unique(np.concatenate(out), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                names = ("side", "n", "g", "pos", "root")
                pairs = tile({k: np.concatenate([h[k] for h in held]) for k in names}, key[1] != key[2])
                if len(pairs):
                    yield to_batch({"a": pairs[:, 0], "b": pairs[:, 1]}, schema)

        for b in batches:
            c = {name: b.column(i).to_numpy() for i, name in enumerate(b.schema.names)}
            cut = np.flatnonzero((np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)) + 1
            for a, z in zip(np.r_[0, cut], np.r_[cut, b.num_rows], strict=True):
                here = int(c["key"][a]), int(c["i"][a]), int(c["j"][a])
                if here != key:
                    yield from done()
                    key, held = here, []
                held.append({k: v[a:z] for k, v in c.items()})
        yield from done()

    return rows.mapInArrow(run, "a long, b long")


def _edges(pairs: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Of the distinct pairs (a, b) of groups those that the bitmaps do not rule out. known: doc_id, n, bits, spread."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(i).to_pylist() for i in range(8)], strict=True)
            got = [(x, y) for x, y, n, p, r, m, q, s in rows if may_link(n, p, m, q, threshold, r + s)]
            if got:
                yield to_batch({"a": [x for x, _ in got], "b": [y for _, y in got]}, schema)

    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"), F.col("spread").alias(f"spread_{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "bits_a", "spread_a", "n_b", "bits_b", "spread_b").mapInArrow(run, "a long, b long")


def _spreads(collapsed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, spread): of each group of several members, the most bits in which one differs from the smallest id's."""
    schema = pa.schema([("doc_id", pa.int64()), ("spread", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield to_batch({"doc_id": b.column(0), "spread": [apart(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]}, schema)

    bits = lambda c: prefixes.select(F.col("doc_id").alias(c), F.col("bits").alias(f"bits_{c}"))
    both = collapsed.where("a <> b").join(bits("a"), "a").join(bits("b"), "b").select("b", "bits_a", "bits_b")
    return both.mapInArrow(run, "doc_id long, spread int").groupBy("doc_id").agg(F.max("spread").alias("spread"))


def _blocks(prefixes: DataFrame, classes: DataFrame, stored: Stored, threshold: int) -> DataFrame:
    """(id, root): blocks of classes that no link crosses. prefixes may hold documents that stand for no class."""
    members = prefixes.select("doc_id", "gfp").join(classes.select(F.col("class_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    groups = members.groupBy("gfp").agg(F.min("doc_id").alias("g"), F.count("*").alias("members"))
    groups = stored.keep(groups)
    leads = prefixes.join(groups.select(F.col("g").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    posts = leads.select(F.posexplode("prefix").alias("pos", "key"), F.col("doc_id").alias("g"), "n").select("key", "g", "n", "pos")
    found = stored.keep(_pairs(posts.repartition("key").sortWithinPartitions("key", "n", "g"), threshold))
    collapsed = stored.keep(members.join(groups.where("members > 1"), "gfp").select(F.col("doc_id").alias("a"), F.col("g").alias("b")))
    known = prefixes.select("doc_id", "n", "bits").join(_spreads(collapsed, prefixes), "doc_id", "left").na.fill(0, ["spread"])
    edges = _edges(found.where("key is null"), known, threshold).union(collapsed)
    roots = components(edges, stored)

    # Elements of many groups whose groups are not one block yet.
    hot = found.where("key is not null").select("key", F.col("a").alias("g"), "n", "pos", "chunk").join(roots.withColumnRenamed("id", "g"), "g", "left")
    hot = stored.keep(hot.withColumn("root", F.coalesce("root", "g")))
    mixed = hot.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("chunk").alias("chunks")).where("low < high").select("key", "chunks")
    tiles = hot.join(mixed, "key").withColumn("k", F.explode(F.sequence(F.lit(0), "chunks")))
    tiles = tiles.select("key", F.least("k", "chunk").alias("i"), F.greatest("k", "chunk").alias("j"), F.col("chunk").alias("side"), "n", "g", "pos", "root")
    cross = stored.keep(_cross_pairs(tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), threshold))
    more = stored.keep(_edges(cross, known, threshold))
    if not more.isEmpty():
        roots = components(more.union(roots.select("id", "root")), stored)
    stored.drop(groups, collapsed, found, hot, cross, more)
    return roots


class Index:
    """Inverted index of some sets of small integers: which sets share an element with one of them."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def sharing(self, items: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.flat, items), np.searchsorted(self.flat, items, "right")
        length = last - first
        at = np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        return np.unique(self.owner[at])


def link_members(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: int, cross: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Exact links among the members of a tile: each member's smallest id linked by a chain, its number of
    links, and how many pairs were verified. cross: only pairs of different sides count.
    """
    m = len(ids)
    if not m:
        return ids, np.zeros(0, np.int64), 0
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    _, local, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    items = np.split(rank[local], ends[:-1])  # numbered by rarity
    # Groups of equal prefix and size, and the pairs of groups that can hold a link.
    prefixes = [np.sort(s)[: prefix_length(len(s), threshold)] for s in items]
    groups: dict[tuple[int, bytes], list[int]] = {}
    for x in range(m):
        groups.setdefault((int(sizes[x]), prefixes[x].tobytes()), []).append(x)
    members = [np.array(v) for v in groups.values()]
    index, size_of = Index([prefixes[v[0]] for v in members]), np.array([s for s, _ in groups])
    parent, links, verified = list(range(m)), np.zeros(m, np.int64), 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = np.zeros(len(often), bool)
    for g, those in enumerate(members):
        near = index.sharing(prefixes[those[0]])
        near = near[(near <= g) & (100 * np.minimum(size_of[near], size_of[g]) >= threshold * np.maximum(size_of[near], size_of[g]))]
        if len(near) == 1 and len(those) == 1:
            continue
        every = np.concatenate([members[k] for k in near])
        own = np.concatenate([np.full(len(members[k]), k == g) for k in near])
        for s in np.unique(side[those]) if cross else [None]:
            other = every if s is None else every[side[every] != s]
            same = own if s is None else own[side[every] != s]
            if not len(other):
                continue
            flat, starts = np.concatenate([items[y] for y in other]), np.r_[0, np.cumsum(sizes[other])[:-1]]
            for x in those if s is None else those[side[those] == s]:
                ask = ~same | (other < x)
                verified += int(ask.sum())
                held[items[x]] = True
                shared = np.add.reduceat(held[flat], starts, dtype=np.int64)
                held[items[x]] = False
                for y in other[ask & (100 * shared >= threshold * (sizes[x] + sizes[other] - shared))]:
                    links[x] += 1
                    links[y] += 1
                    a, b = find(int(x)), find(int(y))
                    if a != b:
                        if ids[a] > ids[b]:
                            a, b = b, a
                        parent[b] = a
    return ids[[find(x) for x in range(m)]], links, verified


def _verify(members: DataFrame, n: int, threshold: int) -> DataFrame:
    """members: (block, i, j, side, doc_id, text), with the rows of a tile next to each other."""
    schema = pa.schema([("doc_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                rows.sort(key=lambda r: r[1])
                ids = np.array([r[1] for r in rows], np.int64)
                root, links, _ = link_members(ids, np.array([r[0] for r in rows]), [r[2] for r in rows], threshold, key[1] != key[2])
                at = links > 0
                if at.any():
                    yield to_batch({"doc_id": ids[at], "root": root[at], "links": links[at]}, schema)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for block, i, j, side, doc, text in zip(*cols, binary_texts(b), strict=True):
                if (block, i, j) != key:
                    yield from done()
                    key, rows = (block, i, j), []
                rows.append((side, doc, shingle_set(text, n)))
            _hashes.trim(WORDS)
        yield from done()

    return members.mapInArrow(releasing(run, _forget), "doc_id long, root long, links long")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """Exact similarity classes of documents by the Jaccard index of their word n-gram sets.

    docs: doc_id long, text string; other columns are ignored. threshold: per cent, 1 to 100.
    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by
    links, itself included), class_id (smallest doc_id with the same set) and n_links (links of
    that class to other classes).

    Null and wordless texts: empty set, linked with nothing. Null doc_id: component, class and links
    are null. Repeated rows: each is returned; rows that share an id stand for one document, whose text
    is the smallest of theirs. Empty table: empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    stored = Stored(spark)
    docs = texts_with_key(docs)
    ids, distinct = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids != distinct:
        nameless = docs.where("doc_id is null")
        once = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        judged = ngram_jaccard_join(stored.keep(once), n, threshold)
        rows = docs.select("doc_id").where("doc_id is not null").join(judged, "doc_id")
        return rows.unionByName(ngram_jaccard_join(nameless, n, threshold))
    sketched = stored.keep(_sets(docs, n))
    sets = sketched.where("part is null").select("doc_id", "n", "fp")
    classes = stored.keep(sets.where("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.min("n").alias("n")))
    # The filter passes few of the copies; members that stand for no class are dropped where groups are made.
    prefixes = stored.keep(_prefixes(docs, IdFilter(classes.select("class_id")), _levels(sketched), n, threshold))
    roots = _blocks(prefixes, classes, stored, threshold)
    stored.drop(prefixes)

    tied = stored.keep(roots.join(classes, roots.id == classes.class_id).select(F.col("class_id").alias("doc_id"), "n", F.col("root").alias("block")))
    slices = F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_ITEMS)).cast("int")
    blocks = stored.keep(tied.groupBy("block").agg(F.count("*").alias("members"), slices.alias("slices")).where("members > 1"))
    placed = tied.join(blocks.select("block", "slices"), "block").select("doc_id", "block", "slices", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int").alias("side"))
    placed = stored.keep(placed)

    texts = filtered(texts_with_key(docs), IdFilter(placed.select("doc_id")))
    whole = texts.join(placed, "doc_id")
    tiles = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "block", F.least("k", "side").alias("i"), F.greatest("k", "side").alias("j"), "side", "doc_id", "text"
    )
    tiles = tiles.repartition(F.col("block"), F.col("i"), F.col("j")).sortWithinPartitions("block", "i", "j")
    found = stored.keep(_verify(tiles, n, threshold))

    counted = found.groupBy("doc_id").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    if (blocks.agg(F.max("slices")).first()[0] or 0) > 1:
        joined = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), stored)
        counted = counted.drop("root").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    counted = counted.withColumnRenamed("doc_id", "class_id")

    out = sets.join(classes.drop("n"), "fp", "left").join(counted, "class_id", "left")
    linked = F.when(F.col("n") > 0, F.coalesce("root", "class_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).alias("n_links"),
    )

