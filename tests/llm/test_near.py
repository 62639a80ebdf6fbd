import numpy as np
import pytest
import xxhash

from postlens.llm.ann import search
from postlens.llm.components import connected_components
from postlens.llm.embdedup import near_duplicates
from postlens.llm import simhash
from postlens.llm.simhash import hamming_edges, keep_one, simhash_components


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(400 + k, 401 + k) for k in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union(600, pairs)
    assert got == {x: r for x, r in enumerate(want) if x != r}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "delta", "x", "yy", "Zed"]
    base = [[words[i] for i in rng.integers(0, 8, 60)] for _ in range(6)]
    texts = [None, "", "  \n", "one two", "A b c d", "a B c d\te"]
    for k in range(150):
        w = list(base[k % 6])
        for _ in range(k % 3):
            w[int(rng.integers(0, 60))] = "new"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(None if k == 9 else 1000 - k, t, 5, "z") for k, t in enumerate(texts)], "doc_id long, text string, fp long, root string")
    got = {r.doc_id: r for r in simhash_components(docs).collect()}
    prints = [plain_print(t) for t in texts]
    n = len(texts)
    comp = union(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for k in range(n):
        if k != 9:
            least[comp[k]] = min(least.get(comp[k], 10**9), 1000 - k)
    for k in range(n):
        r = got[None if k == 9 else 1000 - k]
        assert r.fingerprint == f"{prints[k]:016x}"
        assert r.component_id == least[comp[k]]
    assert simhash_components(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("bucket", [4096, 8])
def test_pigeonring_loses_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64)]
    for k in range(150):
        x = fps[k]
        for b in rng.choice(64, k % 6 + 1, replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    hot = fps[0]
    fps += [hot ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(1, 64, 7) if a != b]
    fps = sorted(set(fps))
    signed = [simhash._signed(x) for x in fps]
    roots = {r.node: r.root for r in connected_components(hamming_edges(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    n = len(fps)
    want = union(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups, found = {}, {}
    for k in range(n):
        groups.setdefault(want[k], set()).add(k)
        found.setdefault(roots.get(signed[k], signed[k]), set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def vectors():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 16))
    for k in range(100, 200):
        m[k] = m[k % 7] * (1 + k % 3) + rng.normal(size=16) * 0.1 * (k % 5)
    m[200:230] = m[3]
    rows = [(k, [float(np.float32(x)) for x in v], 1) for k, v in enumerate(m)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0] * 15 + [None], 1), (320, [float("inf")] * 16, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_near_duplicates(spark):
    rows = vectors()
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    ok = [r for r in rows if r[0] < 300]
    m = np.array([r[1] for r in ok], np.float32).astype(float)
    cos = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    pairs = [(i, j) for i in range(300) for j in range(i) if cos[i, j] >= 0.9]
    comp = union(300, pairs)
    for k in range(300):
        assert got[k].n_links == (cos[k] >= 0.9).sum() - 1
        assert got[k].component_id == comp[k]
        assert got[k].kept == (comp[k] == k)
    for k in (300, 301, 302, 303, 304, 320):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search(spark):
    rows = vectors()
    got = {}
    for r in search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append(r)
    m = np.array([r[1] for r in rows if r[0] < 300], np.float32).astype(float)
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21))
        score = m @ m[q]
        want = sorted((k for k in range(300) if k != q), key=lambda k: (-round(score[k], 9), k))[:20]
        hits += len(set(want) & {r.vec_id for r in rs})
        for a, b in zip(rs, rs[1:]):
            assert a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id)
        for r in rs:
            assert abs(r.score - score[r.vec_id]) < 1e-9
    assert hits >= 0.95 * 20 * len(got)
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)).count() == 0
