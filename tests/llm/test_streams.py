"""What reads sorted streams gives the same however the rows are cut into batches."""

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import paragraphs, simhash, suffix


def cut(batch, size):
    return [batch.slice(k, size) for k in range(0, batch.num_rows, size)]


def rows(batches):
    return sorted(map(str, (r for b in batches for r in b.to_pylist())))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_refine(size):
    rng = np.random.default_rng(size)
    n = 300
    c = np.stack([rng.integers(0, 25, n), rng.integers(0, 3, n), rng.integers(0, 9, n), rng.integers(1, 50, n)])
    c = c[:, np.lexsort(c[::-1])]
    b = pa.RecordBatch.from_arrays([pa.array(x) for x in (*c, np.ones(n, int))], ["bucket", "refined", "row", "start", "count"])
    whole = rows(suffix._refine([b]))
    assert rows(suffix._refine(cut(b, size))) == whole
    want = set()
    keys = list(zip(*c.tolist()))
    for k in keys:
        first = min(x for x in keys if x[:2] == k[:2])
        if k[2:] != first[2:]:
            want.add((0, k[0], k[2], k[3]))
        elif any(x[0] == k[0] and x[1] != k[1] for x in keys):
            want.add((1, k[0], k[2], k[3]))
    got = {tuple(r.values())[:4] for x in suffix._refine([b]) for r in x.to_pylist()}
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_equal_units(size):
    rng = np.random.default_rng(size)
    n = 200
    digest, para, doc, row, start = rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(0, 6, n), np.zeros(n, int), rng.permutation(n)
    digest = digest * 2 + para  # a unit with bands has a digest of its own
    order = np.lexsort((start, row, doc, digest))
    digest, para, doc, row, start = (x[order] for x in (digest, para, doc, row, start))
    i4 = lambda x: pa.array(x, pa.int32())
    more = pa.array([[int(d), 7] if p else [] for d, p in zip(digest, para)], pa.list_(pa.int64()))
    b = pa.RecordBatch.from_arrays([pa.array(digest), pa.array(doc), pa.array(row), i4(start), i4(start + 5), i4(np.full(n, 9)), i4(np.where(para, -1, start)), i4(np.full(n, paragraphs._OPEN)), more], paragraphs._NAMES)
    whole = rows(paragraphs._equal([b]))
    assert rows(paragraphs._equal(cut(b, size))) == whole
    kinds = [r["kind"] for x in paragraphs._equal([b]) for r in x.to_pylist()]
    assert kinds.count(0) == len({d for d, p in zip(digest, para) if p})
    firsts = {d: min(x for e, p, x in zip(digest, para, doc) if e == d and not p) for d, p in zip(digest, para) if not p}
    assert kinds.count(2) == sum(1 for d, p, x in zip(digest, para, doc) if not p and x != firsts[d])
    assert kinds.count(3) == len({d for d, p, x in zip(digest, para, doc) if not p and x != firsts[d]})


@pytest.mark.parametrize("size", [1, 2, 5, 50])
@pytest.mark.parametrize("bucket", [3, 1_000])
def test_buckets(size, bucket, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET", bucket)
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 40, 120), rng.integers(0, 500, 120)]), axis=1)
    b = pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(np.full(pairs.shape[1], 30)), pa.array(pairs[1])], ["key", "shingles", "digest"])
    groups = {}
    for x in paragraphs._buckets(cut(b, size)):
        for r in x.to_pylist():
            groups.setdefault(r["bucket"], set()).add(r["digest"])
    want = {}
    for k, d in pairs.T.tolist():
        want.setdefault(k, set()).add(d)
    found = {tuple(sorted(g)) for g in groups.values()}  # a large one has a name for each of its two classes of sizes
    assert sorted(found) == sorted(tuple(sorted(g)) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("size", [1, 4, 50])
@pytest.mark.parametrize("bucket", [6, 1_000])
def test_buckets_part_by_size_but_lose_no_pair(size, bucket, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET", bucket)
    rng = np.random.default_rng(size)
    key, n, digest = np.sort(rng.integers(-3, 12, 120)), rng.integers(1, 60, 120), rng.permutation(1000)[:120]
    b = pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(digest)], ["key", "shingles", "digest"])
    groups = {}
    for x in paragraphs._buckets(iter(cut(b, size))):
        for r in x.to_pylist():
            groups.setdefault(r["bucket"], set()).add(r["digest"])
    met = {(x, y) for g in groups.values() for x in g for y in g}
    for i in range(120):
        for j in range(i):
            if key[i] == key[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]):
                assert (digest[i], digest[j]) in met


@pytest.mark.parametrize("size", [1, 3, 100])
def test_verify(size):
    rng = np.random.default_rng(size)
    rows_, want = [], {}
    for bucket in range(30):
        base = rng.integers(0, 1 << 60, 20)
        for k in range(int(rng.integers(2, 6))):
            x = base.copy()
            x[: int(rng.integers(0, 5))] += 1
            rows_.append((bucket, 0, 0, bucket * 100 + k, sorted(set(x.tolist()))))
    for _, _, _, a, x in rows_:
        want[a] = min(b for _, _, _, b, y in rows_ if a // 100 == b // 100 and alike(rows_, a, b))
    b = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["bucket", "i", "j", "digest", "set"])
    links = [(r["u"], r["v"]) for x in paragraphs._verify(iter(cut(b, size))) for r in x.to_pylist()]
    up = {a: a for a in want}
    for u, v in links:
        u, v = up[u], up[v]
        up = {a: min(u, v) if r in (u, v) else r for a, r in up.items()}
    assert up == want


def alike(rows_, a, b):
    """Whether b is reached from a over sets that are alike."""
    sets = {r[3]: set(r[4]) for r in rows_ if r[3] // 100 == a // 100}
    seen, queue = {a}, [a]
    while queue:
        x = sets[queue.pop()]
        near = {k for k, y in sets.items() if k not in seen and len(x & y) >= 0.8 * len(x | y)}
        seen |= near
        queue += near
    return b in seen


@pytest.mark.parametrize("size", [1, 2, 5, 50])
@pytest.mark.parametrize("bucket", [3, 1_000])
def test_meet(size, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 16, 60) + (rng.integers(0, 5, 60) << 40))
    made = [(pos, int(x) & simhash._signed(m), int(x)) for pos, (_, m) in enumerate(simhash._KEYS[:6]) for x in fp]
    made.sort()
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int32()), pa.array([r[1] for r in made]), pa.array([r[2] for r in made])], ["pos", "key", "fp"])
    found = [r for x in simhash._meet(cut(b, size)) for r in x.to_pylist()]
    sizes = {}
    for r in made:
        sizes[r[:2]] = sizes.get(r[:2], 0) + 1
    large = sorted(r for r in made if sizes[r[:2]] > bucket)
    assert sorted((r["pos"], r["a"], r["b"]) for r in found if r["kind"] == 1) == large
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for r in found:
        if r["kind"] == 0:
            up[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
    for p, k, x in made:
        for q, j, y in made:
            if (p, k) == (q, j) and sizes[p, k] <= bucket and simhash.linked(np.array([x]).view(np.uint64), np.array([y]).view(np.uint64), simhash._START[p])[0]:
                assert find(x) == find(y)
