"""Seeds by bucket: rows of arrays, the matches of brute force, and no bucket that grows with the seeds of one hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from appendlake.llm import _common as C
from appendlake.llm import substring_dedup as U

N = 16


def _texts() -> dict[int, str]:
    r = np.random.default_rng(7)
    line = " ".join(f"common{i}" for i in range(9))
    out = {}
    for k in range(240):
        words = [f"w{v}" for v in r.integers(0, 300, 40)]
        out[k - 20] = " ".join([line, *words[:20], line, *words[20:]]) if k % 2 else " ".join(words * (1 + k % 3))
    return out


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).sort_by("bucket").combine_chunks()
    return t.to_batches()[0]


def test_matches_by_bucket_are_those_of_brute_force():
    texts = _texts()
    ks = np.array(list(texts), np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(ks[i::3]), pa.array([texts[k] for k in ks[i::3].tolist()])], names=["k", "text"]) for i in range(3)]
    seeds = []
    for b in batches:
        for c in C.chunks(b.column("text")):
            s, doc, at, is_long = U.seeds_of(c.hashes(), c.first)
            seeds += zip(s.tolist(), b.column("k").to_numpy()[c.lo + doc].tolist(), ((at - c.first[doc]) * 2 + is_long).tolist(), strict=True)
    dealt = [r for part in range(U.SLICES) for b in batches for r in U._seeds(part, N)(iter([b]))]

    assert sum(r.num_rows for r in dealt) <= 2 * N * len(batches) * U.SLICES < len(seeds) / 20
    entries = [[np.concatenate(c) for c in zip(*(U._unpacked(r.slice(i, 1), "hkx") for i in range(r.num_rows)), strict=True)] for r in dealt]
    assert sum(len(e[0]) for e in entries) == len(seeds)
    for r, (h, _, _) in zip(dealt, entries, strict=True):
        if r.column("kind")[0].as_py() == U.SEEDS:
            assert np.unique(h, return_counts=True)[1].max() <= U.EACH
            assert len(np.unique(h)) > r.num_rows
    hot = [r for r in dealt if r.column("kind")[0].as_py() == U.HOT]
    assert hot and all(r.column("bucket").to_numpy().min() >= N for r in hot)
    for r in hot:  # further seeds are a row a hash
        assert r.num_rows == len(np.unique(U._unpacked(r, "h")[0])) < len(U._unpacked(r, "h")[0])

    met = list(U._met(N)(iter([_by_bucket(dealt)])))
    of = lambda kind, names: [np.concatenate(c).tolist() for c in zip(*(U._unpacked(r, names) for r in met if r.column("kind")[0].as_py() == kind), strict=True)]
    first = {h: (s, y) for h, s, y in zip(*of(U.FIRST, "hsy"), strict=True)}
    joined = []
    for r in U._rows(iter([m for m in met if m.column("kind")[0].as_py() == U.HOT])):
        at = [first.get(int(np.int64(h).view(np.uint64))) for h in r.column("h").to_numpy()]
        r = r.filter(pa.array([a is not None for a in at]))
        at = [a for a in at if a]
        joined.append(r.append_column("s", pa.array([a[0] for a in at], pa.int64())).append_column("y", pa.array([a[1] for a in at], pa.int32())))
    met += U._again(N)(iter(joined))

    groups: dict[int, list] = {}
    for h, k, x in seeds:
        groups.setdefault(h, []).append((k, x))
    want, near = [], []
    for g in groups.values():
        src, x0 = min(g)
        if max(g)[0] != src:
            want += [(k, src, x, x0 >> 1) for k, x in g if k != src]
            near += [(k, x) for k, x in g if x & 1]
    assert sorted(zip(*of(U.MATCHES, "ksxy"), strict=True)) == sorted(want)
    assert sorted(zip(*of(U.NEAR, "kx"), strict=True)) == sorted(near)


def test_buckets_stay_whole_across_batches():
    bucket = np.repeat(np.arange(6), 4)
    k = np.arange(24)
    b = _by_bucket([U._packed(U.MATCHES, bucket[i::4], k=k[i::4]) for i in range(4)])
    whole, U.AT_ONCE = U.AT_ONCE, 5
    try:
        got = [c[0] // 4 for c in U._whole((b.slice(i, 3) for i in range(0, b.num_rows, 3)), "k")]
    finally:
        U.AT_ONCE = whole
    assert len(got) > 1 and sum(map(len, got)) == 24
    assert sum(len(np.unique(g)) for g in got) == 6
