"""Substring dedup: shared seeds, collinear chains, alignment; fuzzy passages that repeat across documents.

1. Seeds are windows of SEED words, of which winnowing keeps the least hash of
   each SPAN neighbours, so that any SEED + SPAN - 1 equal words share a seed.
   Windows of LONG words are seeds as well, the least of LONG_SPAN neighbours:
   a passage made of frequent lines, each of which an earlier document has, has
   windows across its lines that only its own earliest holder shares. A changed
   passage of such lines with no LONG equal words in a row can still be missed.
   Seeds are worked off in SLICES by their hash, which bounds the disk.
   Where documents share a long seed, all windows of LONG words around it are
   seeds in a second turn, so that none of LONG + LONG_SPAN - 1 or more equal
   words in a row is lost, however their parts are spread over earlier documents.
2. A seed's first occurrence, by the least (doc_id, position), is its source: a
   seed found in n documents makes n - 1 matches and no pairs. Seeds and matches
   travel as arrays, a row of bytes a bucket of hashes or texts. A batch of texts
   deals EACH seeds of a hash at most to its bucket; the others meet their
   source in a join, in which Spark splits a hot seed.
3. Matches of a document with one source document are chained: ordered in both
   texts, GAP a word skipped on either side, the best predecessor from a Fenwick
   tree of maxima over source positions. (If the matches are ordered in both
   already, the best predecessor is the one before.)
4. Chains are aligned on the words of both texts, between and around their
   matches, and kept if MATCHED of the longer side's words agree in order; if
   fewer do, the chain is cut at its widest gap and each part aligned. Around
   them the alignment goes on over edits until its score is DROP under its best;
   where the words fetched end before that, more are fetched.
5. Kept spans of a document that touch or overlap, whatever their sources, are
   one passage; a passage has at least PASSAGE words.

The first occurrence itself is no repeat and stays. Only words are compared, so
that line breaks don't matter.

Cases: null and empty texts have no passages, neither have texts shorter than
PASSAGE words. Rows that share a doc_id are versions of one document: what only
they share is no repeat. A document with a null id gets a negative id made of its
text's hash while it is worked on, and null in the result. Very long texts are
cut into nothing: positions are whole words of the whole text. Of equal seeds the
least position counts, so that ties don't hang on partitions. An empty table gives
an empty one. Other columns are kept; names that begin with __ are this module's own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SEED, SPAN = 5, 3
LONG, LONG_SPAN = 16, 8
SLICES = 2
GAP = 0.1
LEAST_CHAIN = 16  # words that a chain covers at least; a frequent line of fewer makes none
MATCHED, PASSAGE = 0.8, 50
DROP = 8
PAD, MORE, GRID = 32, 8, 32  # words fetched around a chain, MORE times as many each time they don't do; fetched spans begin and end on multiples of GRID
EACH = 32  # seeds of one hash that a batch of texts deals to the hash's bucket; a join finds the matches of the others
AT_ONCE = 1 << 18  # entries of whole buckets that are worked on together
_U = np.uint64
_ARRAYS = {"h": (_U, _U), "k": (np.int64, np.int32), "s": (np.int64, np.int32), "x": (np.int32, np.int16), "y": (np.int32, np.int16)}  # hash, text, source, twice the first word (one more: long), first word in the source
_HALVES = ["h", *(c + half for c in "ksxy" for half in ("0", "1"))]  # apart, since upper halves are mostly alike and pack well
_BLOBS = ", ".join(["kind tinyint, bucket int", *(f"{c} binary" for c in _HALVES)])
SEEDS, HOT, FIRST, MATCHES, NEAR = range(5)


def _key() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64("text"), 1))


def winnow(s: np.ndarray, doc: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions in s of the leftmost least hash of each span following windows of a text (of all, if it has fewer)."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    if n >= span:
        # Least over 2, 4, 8, ... neighbours, then over span by two overlapping runs; what meets another text is left out at the end.
        least, at = s, np.zeros(n, np.int8 if span < 128 else np.int64)
        width = 1
        while width < span:
            shift = min(width, span - width)
            later = least[shift:] < least[:-shift]
            at = np.where(later, at[shift:] + at.dtype.type(shift), at[:-shift])
            least, width = np.minimum(least[:-shift], least[shift:]), width + shift
        whole = np.flatnonzero(doc[span - 1 :] == doc[: n - span + 1])
        keep[whole + at[whole]] = True
    edges = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [n]])
    few = np.diff(edges) < span
    for lo, hi in zip(edges[:-1][few].tolist(), edges[1:][few].tolist(), strict=True):
        keep[lo + int(np.argmin(s[lo:hi]))] = True
    return np.flatnonzero(keep)


def _long(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of LONG words, of those of short windows that cover them, and which short windows they begin with."""
    n = max(0, len(s) - (LONG - SEED))
    whole = np.flatnonzero(doc[:n] == doc[len(s) - n :])  # the last of them must be of the same text
    wide = np.zeros(len(whole), _U)
    for t in (*range(0, LONG - SEED, SEED), LONG - SEED):
        wide = C.mix64(wide + s[whole + t])
    return wide, whole


def seeds_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of texts of hashed words: hash, text, first word, and whether it is a long one."""
    s, doc, at = C.shingles(h, first, SEED)
    there = np.diff(first)[doc] >= SEED
    s, doc, at = s[there], doc[there], at[there]
    keep = winnow(s, doc)
    wide, whole = _long(s, doc)
    held = winnow(wide, doc[whole], LONG_SPAN)
    wide, whole = wide[held], whole[held]
    is_long = np.repeat([0, 1], [len(keep), len(whole)])
    return np.concatenate([s[keep], wide]), np.concatenate([doc[keep], doc[whole]]), np.concatenate([at[keep], at[whole]]), is_long


def _packed(kind: int, bucket: np.ndarray, by: np.ndarray | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    """Arrays that are in order of bucket (or by), as a row of bytes for each value of it."""
    by = bucket if by is None else by
    edges = np.append(np.flatnonzero(np.append(True, by[1:] != by[:-1])), len(by))
    n, cols = len(edges) - 1, []
    for name, (dtype, half) in _ARRAYS.items():
        parts = np.dtype(dtype).itemsize // np.dtype(half).itemsize
        if name not in columns:
            cols += [pa.nulls(n, pa.binary())] * parts
            continue
        v, at = np.ascontiguousarray(columns[name], dtype).view(half), pa.py_buffer((edges * np.dtype(half).itemsize).astype(np.int32))
        cols += [pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(np.ascontiguousarray(v[i::parts]))]) for i in range(parts)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(bucket[edges[:-1]].astype(np.int32)), *cols], names=["kind", "bucket", *_HALVES])


def _unpacked(b: pa.RecordBatch, names: str) -> list[np.ndarray]:
    out = []
    for name in names:
        dtype, half = _ARRAYS[name]
        parts = []
        for c in (b.column(i).cast(pa.binary()) for i, column in enumerate(b.schema.names) if column in _HALVES and column[0] == name):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(half))
        out.append(np.stack(parts, axis=1).reshape(-1).view(dtype))
    return out


def _whole(batches: Iterator[pa.RecordBatch], names: str) -> Iterator[list[np.ndarray]]:
    """Arrays of whole buckets, AT_ONCE entries or more together; rows come in order of bucket."""
    held: list[list[np.ndarray]] = []
    size, last = 0, -1
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
        if cut or bucket[0] != last:
            if cut:
                held.append(_unpacked(b.slice(0, cut), names))
                size, b = size + len(held[-1][0]), b.slice(cut)
            if size >= AT_ONCE:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
        held.append(_unpacked(b, names))
        size, last = size + len(held[-1][0]), int(bucket[-1])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets (a power of two, at most 2^16) for each hash, from its first bits; hashes in order are in order of bucket."""
    return (h >> _U(64 - n.bit_length() + 1)).astype(np.uint16) if n > 1 else np.zeros(len(h), np.uint16)


def _repeated(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Marks the places in order, which sorts h, of hashes that occur twice or more."""
    same = h[order[1:]] == h[order[:-1]]
    return np.append(False, same)[: len(h)] | np.append(same, False)[: len(h)]


def _dealt(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    """Seeds (h, k, x) by the bucket of their hash. Of a hash with more than EACH seeds here, EACH stay, its first by (k, x) and its last;
    the first has ~x then. The others, a row a hash, go to buckets from n on by hash and text, so that no bucket grows with the seeds of one hash."""
    h, k, x = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(h):
        return
    order = np.argsort(h)
    twice = np.flatnonzero(_repeated(h, order))
    part = order[twice]
    order[twice] = part[np.lexsort((x[part], k[part], h[part]))]
    h, k, x = h[order], k[order], x[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    much = size > EACH
    if much.any():
        hot = np.zeros(len(h), bool)
        for lo, m in zip(first[much].tolist(), size[much].tolist(), strict=True):
            hot[lo + EACH - 1 : lo + m - 1] = True
        x[first[much]] = ~x[first[much]]
        rest = h[hot], k[hot], x[hot]
        to = _bucket(C.mix64(rest[0] ^ C.mix64(rest[1].view(_U))), n)
        yield _packed(HOT, to.astype(np.int32) + n, rest[0], h=rest[0], k=rest[1], x=rest[2])
        h, k, x = h[~hot], k[~hot], x[~hot]
    yield _packed(SEEDS, _bucket(h, n), h=h, k=k, x=x)


def _by_text(kind: int, n: int, k: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(k):
        to = _bucket(C.mix64(k.view(_U)), n)
        by = np.argsort(to, kind="stable")
        yield _packed(kind, to[by], k=k[by], **{name: c[by] for name, c in columns.items()})


def _seeds(part: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Seeds of a slice; x is twice the first word, one more for a long seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, found = b.column("k").to_numpy(), []
            for c in C.chunks(b.column("text")):
                s, doc, at, is_long = seeds_of(c.hashes(), c.first)
                mine = s % _U(SLICES) == part
                s, doc, at, is_long = s[mine], doc[mine], at[mine], is_long[mine]
                found.append((s, k[c.lo + doc], ((at - c.first[doc]) * 2 + is_long).astype(np.int32)))
            if found:
                yield from _dealt(found, n)

    return run


def _all_long(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All windows of LONG words that begin less than LONG_SPAN words from a position in `near`; x as in _seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, near, found = b.column("k").to_numpy(), b.column("near"), []
            for c in C.chunks(b.column("text")):
                s, doc, at = C.shingles(c.hashes(), c.first, SEED)
                there = np.diff(c.first)[doc] >= SEED
                s, doc, at = s[there], doc[there], at[there]
                wide, whole = _long(s, doc)
                doc, at = doc[whole], at[whole]
                own = near.slice(c.lo, c.hi - c.lo)
                of = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                # One more where a neighbourhood begins and one less behind its end, both inside the text.
                first, last, p = c.first[of], c.first[of + 1], c.first[of] + own.flatten().to_numpy()
                edge = np.bincount(np.clip(p - LONG_SPAN + 1, first, last), minlength=c.first[-1] + 1) - np.bincount(np.clip(p + LONG_SPAN, first, last), minlength=c.first[-1] + 1)
                mine = np.cumsum(edge)[at] > 0
                wide, doc, at = wide[mine], doc[mine], at[mine]
                found.append((wide, k[c.lo + doc], ((at - c.first[doc]) * 2 + 1).astype(np.int32)))
            if found:
                yield from _dealt(found, n)

    return run


def _met(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole buckets of seeds to matches (k, s, x, y) and long shared seeds (k, x) by text, and first occurrences (h, s, y) of hashes with further seeds, which pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: list[pa.RecordBatch] = []

        def seeds() -> Iterator[pa.RecordBatch]:
            for b in batches:
                cut = int(np.searchsorted(b.column("bucket").to_numpy(), n))
                if cut < b.num_rows:
                    aside.append(b.slice(cut))
                yield b.slice(0, cut)

        for h, k, x in _whole(seeds(), "hkx"):
            while aside:
                yield aside.pop()
            order = np.argsort(h)
            order = order[_repeated(h, order)]
            h, k, x = h[order], k[order], x[order]
            more, x = x < 0, np.where(x < 0, ~x, x)
            order = np.lexsort((x, k, h))
            h, k, x, more = h[order], k[order], x[order], more[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            size = np.diff(np.append(first, len(h)))
            shared = k[first + size - 1] != k[first]
            s, y, met = np.repeat(k[first], size), np.repeat(x[first] >> 1, size), np.repeat(shared, size)
            hits, wide = met & (k != s), met & (x & 1 == 1)
            yield from _by_text(MATCHES, n, k[hits], s=s[hits], x=x[hits], y=y[hits])
            yield from _by_text(NEAR, n, k[wide], x=x[wide])
            if more.any():
                asked = first[shared & np.logical_or.reduceat(more, first)]
                if len(asked):
                    yield _packed(FIRST, np.zeros(len(asked), np.uint16), h=h[asked], s=k[asked], y=x[asked] >> 1)
        yield from aside

    return run


def _plain(names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each entry; hashes as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == _U else c) for c in _unpacked(b, names)], names=list(names))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one hash each, with the hash as a signed number."""
    for b in batches:
        if b.num_rows:
            (h,), size = _unpacked(b, "h"), pc.binary_length(b.column("h")).to_numpy() // 8
            rest = ["k0", "k1", "x0", "x1"]
            yield pa.RecordBatch.from_arrays([pa.array(h[np.cumsum(size) - size].view(np.int64)), *(b.column(c) for c in rest)], names=["h", *rest])


def _again(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _rows with their source's s and y, as _met has met seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (k, x), size = _unpacked(b, "kx"), pc.binary_length(b.column("k0")).to_numpy() // 4
                s, y = (np.repeat(b.column(c).to_numpy(), size) for c in ("s", "y"))
                hits, wide = k != s, x & 1 == 1
                yield from _by_text(MATCHES, n, k[hits], s=s[hits], x=x[hits], y=y[hits])
                yield from _by_text(NEAR, n, k[wide], x=x[wide])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First words of a document's long shared seeds, as a list."""
    for k, x in _whole(batches, "kx"):
        order = np.argsort(k, kind="stable")
        k, x = k[order], x[order] >> 1
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(k)).astype(np.int32)), pa.array(x.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(k[first]), lists], names=["__k", "near"])


def chain(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Collinear chains of matches (x ascending), each as its (x, y)."""
    out = []
    if len(x) > 1 and (np.diff(x) > 0).all() and (np.diff(y) > 0).all():
        cost = GAP * (np.diff(x) + np.diff(y))
        score, first = float(SEED), 0
        best, upto = score, 0
        for i, c in enumerate(cost.tolist(), 1):
            if score - c <= 0:
                out.append((x[first : upto + 1], y[first : upto + 1]))
                score, first, best, upto = float(SEED), i, float(SEED), i
            else:
                score += SEED - c
                if score > best:
                    best, upto = score, i
        out.append((x[first : upto + 1], y[first : upto + 1]))
        return out
    # Fenwick tree of prefix maxima over the ranks of y; a key is score + GAP * (x + y), so that the gap's cost comes off at the later match.
    order = np.lexsort((-y, x))  # of equal x, the larger y first: they can't follow one another
    xs, ys = x[order].tolist(), y[order].tolist()
    rank = np.searchsorted(np.unique(y), y[order]).tolist()
    size = max(rank) + 1
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (size + 1)
    score, before = [0.0] * len(xs), [-1] * len(xs)
    for i in range(len(xs)):
        best, j = (-1.0, -1), rank[i]
        while j > 0:
            best = max(best, tree[j])
            j -= j & -j
        gain = best[0] - GAP * (xs[i] + ys[i])
        score[i] = SEED + max(0.0, gain)
        before[i] = best[1] if best[1] >= 0 and gain > 0 else -1
        j, item = rank[i] + 1, (score[i] + GAP * (xs[i] + ys[i]), i)
        while j <= size:
            if item > tree[j]:
                tree[j] = item
            j += j & -j
    used = [False] * len(xs)
    for i in sorted(range(len(xs)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            path.reverse()
            out.append((np.array([xs[p] for p in path]), np.array([ys[p] for p in path])))
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches by text, in any order inside a bucket. A document has a match a seed at most."""

    def short(k: np.ndarray, src: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Matches ordered by document, source and position, those of long seeds made into those of SEED words in them, each match once."""
        wide, x = np.flatnonzero(x & 1), x >> 1
        shift = np.repeat([SEED, LONG - SEED], len(wide)).astype(x.dtype)
        more = np.concatenate([wide, wide])
        k, src, x, y = np.append(k, k[more]), np.append(src, src[more]), np.append(x, x[more] + shift), np.append(y, y[more] + shift)
        order = np.lexsort((y, x, src, k))
        k, src, x, y = k[order], src[order], x[order], y[order]
        new = np.append(True, (k[1:] != k[:-1]) | (src[1:] != src[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        return [k[new], src[new], x[new], y[new]]

    def close(k: np.ndarray, src: np.ndarray, x: np.ndarray, y: np.ndarray) -> list:
        rows: list = []
        if not len(k):
            return rows
        k, src, x, y = short(k, src, x, y)
        edges = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (src[1:] != src[:-1])) + 1, [len(k)]])
        wide = x[edges[1:] - 1] - x[edges[:-1]] + SEED >= LEAST_CHAIN
        for lo, hi in zip(edges[:-1][wide].tolist(), edges[1:][wide].tolist(), strict=True):
            for cx, cy in chain(x[lo:hi], y[lo:hi]):
                if cx[-1] - cx[0] + SEED >= LEAST_CHAIN:
                    rows.append((int(k[lo]), int(src[lo]), cx.astype(np.int32), cy.astype(np.int32)))
        return rows

    def batch(rows: list) -> pa.RecordBatch:
        lists = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (2, 3)]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, *lists], names=["k", "src", "xs", "ys"])

    for cols in _whole(batches, "ksxy"):
        if rows := close(*cols):
            yield batch(rows)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32-bit hashes of the words of the spans asked for (they end with the text)."""
    for b in batches:
        spans = b.column("spans")
        for c in C.chunks(b.column("text")):
            h = (c.hashes() >> _U(32)).astype(np.uint32)
            rows = []
            for i in range(c.lo, c.hi):
                own = h[c.first[i - c.lo] : c.first[i - c.lo + 1]]
                rows += [(i, s["a"], s["b"], own[s["a"] : s["b"]].tobytes()) for s in spans[i].as_py()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), b.column("dig").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], names=["k", "dig", "a", "b", "words"])


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _same_run(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    if not n:
        return 0
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bool, bool]:
    """Words of a and of b in the best alignment from their beginnings that ends on equal words, and whether one within DROP of the best meets the end of a, of b.

    A pair of equal words scores 1, a changed word -1, a word more on one side -1.5: (i + j) / 2 - 2 edits,
    so that for each number of edits the furthest reach on each diagonal is all that counts.
    """
    n = _same_run(a, b)
    end_a, end_b = n == len(a), n == len(b)
    if end_a or end_b:
        return n, n, end_a, end_b
    if min(len(a), len(b)) > n + DROP and not set(a[n : n + DROP + 1].tolist()) & set(b[n : n + DROP + 1].tolist()):
        return n, n, False, False  # without an equal word, DROP words on both sides are as far as it goes
    reach, best, at, edits = {0: n}, float(n), (n, n), 0
    p, q = a.tolist(), b.tolist()
    len_p, len_q = len(p), len(q)
    while reach:
        edits, after, least = edits + 1, {}, best - DROP
        low, high = min(reach) - 1, max(reach) + 1
        under, here = -1, -1  # reaches of the diagonals d - 1 and d, one word on
        for d in range(low, high + 1):
            over = reach.get(d + 1, -2)
            i = max(under, here, over)
            under, here = here, over + 1
            j = i - d
            if i < 0 or j < 0 or i > len_p or j > len_q:
                continue
            start = i
            while i < len_p and j < len_q and p[i] == q[j]:
                i, j = i + 1, j + 1
            score = (i + j) / 2 - 2 * edits
            if score < least:
                continue
            after[d] = i
            end_a, end_b = end_a or i == len_p, end_b or j == len_q
            if i > start and score >= best:
                best, at = score, (i, j)
                least = best - DROP
        reach = after
    return *at, end_a, end_b


def _blocks(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches as (x, y, words); those that touch or overlap on one diagonal are one, unless a match isn't there."""
    words = np.arange(SEED)
    if not np.array_equal(a[xs[:, None] + words], b[ys[:, None] + words]):
        return [(i, j, SEED) for i, j in zip(xs.tolist(), ys.tolist(), strict=True)]
    dx = np.diff(xs)
    new = np.flatnonzero((dx != np.diff(ys)) | (dx > SEED)) + 1
    first, last = np.append(0, new), np.append(new - 1, len(xs) - 1)
    return list(zip(xs[first].tolist(), ys[first].tolist(), (xs[last] - xs[first] + SEED).tolist(), strict=True))


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, float, tuple] | None:
    """Aligns two word sequences along a chain; gives both spans, the share of the longer that agrees, and whether the beginnings and ends of a and b were met, or None if a match isn't there."""
    if xs[-1] + SEED > len(a) or ys[-1] + SEED > len(b) or xs[0] < 0 or ys[0] < 0:
        return None
    same, x, y = 0, int(xs[0]), int(ys[0])
    for i, j, n in _blocks(a, b, xs, ys):
        if i < x or j < y:  # overlaps the words matched before
            skip = max(x - i, y - j)
            if skip >= n:
                continue
            i, j, n = i + skip, j + skip, n - skip
        if i - x == j - y and _same_run(a[x:i], b[y:j]) == i - x:
            same += i - x
        else:
            same += _lcs(a[x:i], b[y:j])
        if _same_run(a[i : i + n], b[j : j + n]) < n:
            return None
        same, x, y = same + n, i + n, j + n
    x0, y0 = int(xs[0]), int(ys[0])
    i, j, *after = extend(a[x:], b[y:])
    m, n, *before = extend(a[:x0][::-1], b[:y0][::-1])
    whole = same + _lcs(a[x : x + i], b[y : y + j]) + _lcs(a[x0 - m : x0], b[y0 - n : y0])
    if whole < MATCHED * max(x + i - x0 + m, y + j - y0 + n):  # the chain may do without the edits around it
        i = j = _same_run(a[x:], b[y:])
        m = n = _same_run(a[:x0][::-1], b[:y0][::-1])
        whole = same + i + m
    x, y, x0, y0 = x + i, y + j, x0 - m, y0 - n
    return x0, x, y0, y, whole / max(x - x0, y - y0), (*before, *after)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans; a chain whose alignment met an end of the words fetched, but not of the text, comes back with its matches instead."""
    for b in batches:
        if not b.num_rows:
            continue
        g = {n: b.column(n).to_pylist() for n in ("k", "dig", "src", "x0", "x1", "y0", "y1", "mine", "theirs")}
        lists = [np.split(b.column(n).flatten().to_numpy(), np.cumsum(b.column(n).value_lengths().to_numpy())[:-1]) for n in ("xs", "ys")]
        rows = []
        for k, dig, src, x0, x1, y0, y1, mine, theirs, xs, ys in zip(*g.values(), *lists, strict=True):
            p, q = np.frombuffer(mine, np.uint32), np.frombuffer(theirs, np.uint32)
            goes_on = (x0 > 0, y0 > 0, len(p) == x1 - x0, len(q) == y1 - y0)
            left = [(xs, ys)]
            while left:
                xs, ys = left.pop()
                got = align(p, q, xs - x0, ys - y0)
                if not got:
                    continue
                if any(met and more for met, more in zip(got[5], goes_on, strict=True)):
                    rows.append((k, dig, src, None, None, None, None, xs, ys))
                elif got[4] >= MATCHED:
                    rows.append((k, dig, src, got[0] + x0, got[1] + x0, got[2] + y0, got[4], None, None))
                elif len(xs) > 1:
                    cut = int(np.argmax(np.diff(xs) + np.diff(ys))) + 1
                    left += [(px, py) for px, py in ((xs[:cut], ys[:cut]), (xs[cut:], ys[cut:])) if px[-1] - px[0] + SEED >= LEAST_CHAIN]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["k", "dig", "src", "a", "b", "src_a", "matched", "xs", "ys"])


def _around(chains: DataFrame, pad: int) -> DataFrame:
    """chains(k, src, xs, ys) with the spans x0..x1 and y0..y1 to fetch."""
    lo = lambda c: F.greatest(F.lit(0), F.floor((F.element_at(c, 1) - pad) / GRID) * GRID).cast("int")
    hi = lambda c: (F.ceil((F.element_at(c, -1) + SEED + pad) / GRID) * GRID).cast("int")
    return chains.select("k", "src", lo("xs").alias("x0"), hi("xs").alias("x1"), lo("ys").alias("y0"), hi("ys").alias("y1"), "xs", "ys")


def buckets(spark: SparkSession) -> int:
    """A power of two, two or more for each task of a shuffle: what one bucket holds is worked on at once."""
    return 1 << min(14, max(8, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def spans(scratch: C.Scratch, docs: DataFrame, hold: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Aligned spans (k, dig, src, a, b, src_a, matched) of docs(__k, __dig, text), as a written table.

    With hold, also docs, written with a column __spans that is null where nothing was aligned: the
    texts are dealt once, and what is done with the spans needs those with spans only.
    """
    save, parts = scratch.save, []
    n = buckets(scratch.spark)

    def whole(blobs: DataFrame) -> DataFrame:
        return blobs.repartition("bucket").sortWithinPartitions("bucket")

    def of(kind: int) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, parts).where(F.col("kind") == kind)

    def meet(seeds: DataFrame, name: str) -> None:
        """Writes what becomes of seeds that documents share: matches, and the long ones among them."""
        met = save(whole(seeds).mapInArrow(_met(n), _BLOBS), f"met{name}")
        # Both sides are read from a table, so that Spark can split a hot hash in their join.
        hot = met.where(F.col("kind") == HOT).mapInArrow(_rows, "h long, k0 binary, k1 binary, x0 binary, x1 binary")
        first = met.where(F.col("kind") == FIRST).mapInArrow(_plain("hsy"), "h long, s long, y int")
        more = save(hot.join(first.hint("shuffle_hash"), "h").drop("h").mapInArrow(_again(n), _BLOBS), f"more{name}")
        scratch.settle()
        parts.extend([met, more])

    for i in range(SLICES):
        meet(docs.select(F.col("__k").alias("k"), "text").mapInArrow(_seeds(i, n), _BLOBS), str(i))
    near = save(whole(of(NEAR)).mapInArrow(_near, "__k long, near array<int>"), "near")
    meet(docs.select("__k", "text").join(near.hint("shuffle_hash"), "__k").select(F.col("__k").alias("k"), "text", "near").mapInArrow(_all_long(n), _BLOBS), "all")
    chains = save(whole(of(MATCHES)).mapInArrow(_chains, "k long, src long, xs array<int>, ys array<int>"), "chains")
    for name in (f"{table}{i}" for i in (*range(SLICES), "all") for table in ("met", "more")):
        C.remove(scratch.spark, f"{scratch.root}/{name}")
    scratch.drop("near")
    out, held, pad, turn = None, docs, PAD, 0
    while turn == 0 or not chains.isEmpty():
        chains = _around(chains, pad)
        # The words of both sides: each span of a document once, however many chains ask for it.
        asked = chains.select("k", F.col("x0").alias("a"), F.col("x1").alias("b")).unionByName(chains.select(F.col("src").alias("k"), F.col("y0").alias("a"), F.col("y1").alias("b")))
        asked = asked.distinct().groupBy(F.col("k").alias("__k")).agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
        if hold and not turn:
            held = texts = save(docs.join(asked.hint("shuffle_hash"), "__k", "left"), "held")
        elif not turn:
            texts = held.select("__k", "__dig", "text").join(asked.hint("shuffle_hash"), "__k")
        else:  # written, so that its size is known: below Spark's threshold it is broadcast and the texts stay where they are
            texts = held.select("__k", "__dig", "text").join(save(asked, f"asked{turn}"), "__k")
        words = save(texts.where("__spans is not null").select(F.col("__k").alias("k"), F.col("__dig").alias("dig"), "text", F.col("__spans").alias("spans")).mapInArrow(_slices, "k long, dig long, a int, b int, words binary"), f"words{turn}")
        mine = words.select("k", "dig", F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("words").alias("mine"))
        theirs = words.select(F.col("k").alias("src"), F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("words").alias("theirs"))
        both = chains.join(mine, ["k", "x0", "x1"]).join(theirs, ["src", "y0", "y1"])
        both = both.select("k", "dig", "src", "x0", "x1", "y0", "y1", "xs", "ys", "mine", "theirs").mapInArrow(_aligned, "k long, dig long, src long, a int, b int, src_a int, matched double, xs array<int>, ys array<int>")
        both = save(both, f"spans{turn}")
        scratch.drop(f"words{turn}")
        done = both.where("xs is null").drop("xs", "ys")
        out = done if out is None else out.unionByName(done)
        chains, pad, turn = both.where("xs is not null").select("k", "src", "xs", "ys").distinct(), pad * MORE, turn + 1
    scratch.drop("chains")
    return out, held if hold else None


def passages(found: DataFrame) -> DataFrame:
    """Spans of a document joined where they touch: (k, dig, a, b, src, src_a, matched), the source that of the longest span."""
    from pyspark.sql import Window

    w = Window.partitionBy("k", "dig").orderBy("a", "b", "src", "src_a")
    upto = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = found.distinct().withColumn("new", F.when(upto.isNull() | (F.col("a") > upto), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    whole = part.groupBy("k", "dig", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.struct((F.col("b") - F.col("a")).alias("n"), -F.col("src"), "src", "src_a", "matched")).alias("best"))
    return whole.where(F.col("b") - F.col("a") >= PASSAGE).select("k", "dig", "a", "b", "best.src", "best.src_a", "best.matched")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").select(_key().alias("__k"), F.xxhash64("text").alias("__dig"), "text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, end_word, src_doc_id, src_start_word, matched: a row for each passage that occurs in an earlier document."""
    found = passages(spans(C.Scratch(spark, "substring"), _keyed(C.table(spark, sf_dir, "documents")))[0])
    plain = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return found.select(plain("k").alias("doc_id"), F.col("a").alias("start_word"), F.col("b").alias("end_word"), plain("src").alias("src_doc_id"), F.col("src_a").alias("src_start_word"), "matched").distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs, at = b.column("__runs"), b.schema.get_field_index("text")
        texts, out = b.column("text"), []
        for i in range(len(texts)):
            spans_, text = runs[i].as_py(), texts[i].as_py()
            if spans_:
                c = next(C.chunks(pa.array([text]), 1 << 62))
                raw, parts, last = text.encode(), [], 0
                for s in sorted(spans_, key=lambda s: s["a"]):
                    parts.append(raw[last : c.starts[s["a"]]])
                    last = int(c.starts[s["b"]]) if s["b"] < len(c.starts) else len(raw)
                text = b"".join([*parts, raw[last:]]).decode()
            out.append(text)
        cols = [pa.array(out, pa.string()) if j == at else b.column(j) for j in range(b.num_columns)]
        keep = [j for j in range(b.num_columns) if b.schema.names[j] != "__runs"]
        yield pa.RecordBatch.from_arrays([cols[j] for j in keep], names=[b.schema.names[j] for j in keep])


def cut_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the passages that an earlier document has; n_chars, if there, is counted anew where a text changed. A document of which nothing remains goes."""
    C.bound_batches(spark)
    scratch = C.Scratch(spark, "cut")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    found, held = spans(scratch, docs.withColumns({"__k": _key(), "__dig": F.xxhash64("text")}), hold=True)
    runs = passages(found).groupBy(F.col("k").alias("__k"), F.col("dig").alias("__dig")).agg(F.collect_list(F.struct("a", "b")).alias("__runs"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    same = held.where("__spans is null").select(*docs.columns)
    joined = held.where("__spans is not null").join(runs, ["__k", "__dig"], "left").select(*docs.columns, "__runs")
    same = same.unionByName(joined.where("__runs is null").drop("__runs"))
    cut = joined.where("__runs is not null").mapInArrow(_cut, schema).where(F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(cut)
