"""Hot groups, blocks of several tasks, clashing names, empty tables and very long texts."""

import random
import time

import numpy as np
import pytest
from test_texts import brute_substrings, frame, sentence

import corpus_pipeline as cp
from postlens.llm import ann, embdedup, packing
from postlens.llm.ann import search
from postlens.llm.embdedup import near_duplicates
from postlens.llm.html_main import main_text
from postlens.llm.mixing import hypergeometric, lay_out, mix, mix_digest, split_tree
from postlens.llm.packing import pack_documents
from postlens.llm.paragraphs import remove_passages, repeated_passages
from postlens.llm.quality import classify, keep_good
from postlens.llm.simhash import keep_one, simhash_components
from postlens.llm.suffix import dedup_substrings
from postlens.llm.tokens import count_tokens

VECTORS = "vec_id long, embedding array<float>, label int"


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


@pytest.mark.parametrize("doc", [None, 7])
def test_many_texts_under_one_id(spark, doc):
    rng = random.Random(1)
    common = "".join(rng.choice("abcdef ") for _ in range(150))
    texts = sorted({"".join(rng.choice("abcdefgh ") for _ in range(rng.randint(90, 160))) + (common if k % 3 == 0 else "") for k in range(2_000)})
    got = dedup_substrings(frame(spark, [(doc, t) for t in texts]).repartition(4)).collect()
    assert len(got) == len(texts) and {r.doc_id for r in got} == {doc}
    # the texts' order is their own, but every byte of the common part but the first's goes once more than it came
    assert sum(r.n_removed for r in got) == sum(x[1] for x in brute_substrings(list(enumerate(texts)), 100).values())


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "ROWS", 150)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    m = (centres[rng.integers(0, 40, 900)] + 0.4 * rng.normal(size=(900, 24))).astype(np.float32)
    m[300:420] = m[5]
    rows = [(k, x.tolist(), 1) for k, x in enumerate(m)]
    rows += [rows[20], rows[20], rows[40], (60, m[61].tolist(), 1)]  # rows twice, and a vec_id with two vectors
    hits = total = 0
    got = {}
    for r in search(spark.createDataFrame(rows, VECTORS).repartition(3), short=60).collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 900, 20))
    score = m.astype(float) @ m.astype(float).T
    for q, rs in got.items():
        if q == 60:
            assert sorted(r["rank"] for r in rs) == sorted([*range(1, 21)] * 2)
            continue
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and len({r.vec_id for r in rs}) == 20
        best = {k: score[q, k] for k in range(900) if k != q}
        best[60] = max(score[q, 60], score[q, 61]) if q != 60 else best.get(60)
        want = sorted(best, key=lambda k: (-round(best[k], 9), k))[:20]
        for a, b in zip(rs, rs[1:]):
            assert a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id)
        for r in rs:
            assert abs(r.score - best[r.vec_id]) < 1e-9
        hits += len(set(want) & {r.vec_id for r in rs})
        total += 20
    assert hits >= 0.9 * total


def test_near_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(260, 12))
    m[100:200] = m[rng.integers(0, 9, 100)] + 0.22 * rng.normal(size=(100, 12))
    m[200:230] = m[3]
    m = m.astype(np.float32).astype(float)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(m)], VECTORS).repartition(3)).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    comp = union(260, [(i, j) for i in range(260) for j in range(i) if near[i, j]])
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {k: (near[k].sum() - 1, comp[k]) for k in range(260)}


def test_packing_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 8)
    rng = random.Random(4)
    rows = [(k, " w" * rng.choice([0, 3, 50, 90, 400])) for k in range(400)] + [(None, None)] * 60
    got = pack_documents(frame(spark, rows).repartition(5), 512).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    least = max(-(-sum(r.length for r in got) // 512), sum(r.length > 256 for r in got))
    histogram = {int(x): int(n) for x, n in zip(*np.unique([r.length for r in got], return_counts=True))}
    assert len(got) == 460 and len(by) == sum(times for _, times in packing.plan_bins(histogram, 512)) <= 1.03 * least


def test_packing_is_near_the_best_of_all():
    rng = np.random.default_rng(5)
    for _ in range(30):  # cut from full bins, so the best is known
        lengths = []
        for _ in range(60):
            cuts = np.unique(rng.integers(1, 100, rng.integers(0, 4)))
            lengths += np.diff([0, *cuts, 100]).tolist()
        h = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
        assert sum(times for _, times in packing.plan_bins(h, 100)) <= 61


def test_hypergeometric_draws():
    rng = np.random.default_rng(1)
    got = np.array([hypergeometric(7, 5, 6, rng) for _ in range(20_000)])
    from math import comb

    for k in range(1, 7):
        want = comb(7, k) * comb(5, 6 - k) / comb(12, 6)
        assert abs((got == k).mean() - want) < 0.012
    a, b, n = 3 * 10**12, 5 * 10**12, 10**9
    got = np.array([hypergeometric(a, b, n, rng) for _ in range(200)])
    sd = np.sqrt(n * 3 / 8 * 5 / 8)
    assert abs(got.mean() - n * 3 / 8) < 5 * sd / np.sqrt(200) and 0.8 * sd < got.std() < 1.2 * sd
    assert split_tree(100, np.array([30, 30, 40]), rng).tolist() == [30, 30, 40]


def test_the_mix_is_what_the_shards_draw(spark):
    texts = ["w " * (k % 23) for k in range(700)]
    docs = spark.createDataFrame([(k, x, "en", ["a", "b", "c", None][k % 7 // 2], len(x), k, "x") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, hash long, size string")
    taken = {r.doc_id: r for r in mix_digest(docs, shards=5, block=8).collect()}
    rows = mix(docs, shards=5, block=8)
    drawn, shards = {}, {}
    for r in rows.collect():
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r._words
        if r._shard is not None:
            shards.setdefault(r.doc_id, []).append(r._shard)
    assert drawn == {k: r.taken for k, r in taken.items()}
    assert {k: sorted(x) for k, x in shards.items()} == {k: sorted(r.shards) for k, r in taken.items() if r.shards}
    laid = lay_out(rows.where("_shard is not null"), 5)
    for part in laid.rdd.glom().collect():
        at = [(r._shard, r._place) for r in part]
        assert at == sorted(at)
    assert laid.count() == sum(map(len, shards.values()))


def test_passages_of_any_shape(spark):
    rng = random.Random(21)
    bare = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    shapes = {
        "short sentences": " ".join(sentence(rng, 5) for _ in range(12)),
        "quoted stops": " ".join('"' + sentence(rng, 12) + '"' for _ in range(5)),
        "no stops": bare(60),
        "from amid a sentence": bare(17) + ". " + sentence(rng, 25) + " " + bare(19),
        "wrapped": "\n".join(bare(9) for _ in range(7)),
        "52 words": bare(52),
    }
    rows, k = [], 0
    for x in shapes.values():
        for _ in range(3):
            rows.append((k, f"{sentence(rng, 33)} {bare(rng.randint(0, 30))} {x} {bare(rng.randint(1, 30))} {sentence(rng, 30)}"))
            k += 1
    found = {}
    for r in repeated_passages(frame(spark, rows).repartition(4), anywhere=True).collect():
        found.setdefault((r.doc_id, r.kept), []).append(rows[r.doc_id][1][r.start : r.end])
    for at, x in enumerate(shapes.values()):
        for c in range(3):
            assert found[3 * at + c, c == 0] == [x], (at, c)
    out = {r.doc_id: r.text for r in remove_passages(frame(spark, rows)).collect()}
    for at, x in enumerate(shapes.values()):
        assert x in out[3 * at] and x not in out[3 * at + 1] and len(out[3 * at + 2].split()) == len(rows[3 * at + 2][1].split()) - len(x.split())


def test_a_word_that_repeats_itself(spark):
    rows = [(0, "go " * 3_000), (1, "stop " + "go " * 90 + "stay"), (2, "ok " * 70)]
    got = {(r.doc_id, r.kept): r.n_words for r in repeated_passages(frame(spark, rows), anywhere=True).collect()}
    assert got[1, False] >= 90 and 2 not in {d for d, _ in got}


def test_main_text_by_names_and_templates(spark):
    p = lambda k: f"<p>Own words of page {k}, quite a few of them, number {k * 7}.</p>" * 3
    box = "<div><p>Sign up for the letter</p><ul><li>Every week</li></ul></div>"
    pages = [
        ("layout", '<div class="layout has-sidebar"><p>Real text.</p></div>', "Real text."),
        ("named main", '<main class="no-sidebar"><p>Real text.</p></main>', "Real text."),
        ("named wrapper", '<div class="sidebar"><main><p>Real text.</p></main></div>', "Real text."),
        ("entry header", '<article><header class="entry-header"><h1>Title</h1></header><p>Body</p></article>', "Title\nBody"),
        ("article header", '<article><div class="article-header header"><h1>Title</h1></div><p>Body</p></article>', "Title\nBody"),
        ("comments", '<article><p>Body</p></article><section id="comments"><article class="comment"><p>First!</p></article></section>', "Body"),
        ("comments inside", '<main><p>Body</p><div class="comments"><p>First!</p></div></main>', "Body"),
        ("form around", '<div class="menu"><p>Only this</p></div>', "Only this"),
    ]
    rows = [(k, f"http://h{k}.example/{n}", x) for k, (n, x, _) in enumerate(pages)]
    rows += [(100 + k, f"http://site.example/{k}", f"<body><main>{p(k)}{box}</main></body>") for k in range(8)]
    rows += [(200 + k, f"http://copies.example/{k}", f"<body><div>{k}</div><main><div>{p(1)}</div></main></body>") for k in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (name, _, want) in enumerate(pages):
        assert got[k] == want, name
    own = lambda k: "\n".join([f"Own words of page {k}, quite a few of them, number {k * 7}."] * 3)
    for k in range(8):
        assert got[100 + k] == own(k) and got[200 + k] == own(1)


def test_large_pages_take_no_more_than_their_size():
    from postlens.llm.html_main import parse

    began = time.time()
    assert parse("<p>" + "<b>x</b> " * 100_000)[0] == [("x " * 100_000).strip()]
    assert parse("<div>" * 20_000 + "deep")[0] == ["deep"]
    assert len(parse("<div><p>a" * 20_000)[0]) == 20_000
    assert time.time() - began < 20


def test_quality_with_a_labelled_document_repeated(spark):
    rng = random.Random(4)
    rows = [(k, "BUY!! NOW!! " * rng.randint(5, 50) if k % 4 == 0 else " ".join(sentence(rng, 15).capitalize() for _ in range(4))) for k in range(200)]
    rows += [(1, rows[1][1])] * 50_000
    docs = frame(spark, rows).withColumnRenamed("row", "key").withColumnRenamed("doc", "ci")
    y = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    got = classify(docs, y).groupBy("doc_id").agg({"keep": "max", "quality": "count"}).collect()
    assert sum(r["count(quality)"] for r in got) == 50_200
    assert sum(r["max(keep)"] == (r.doc_id % 4 != 0) for r in got) >= 195
    kept = keep_good(docs, y)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 50_001


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _row long, row long, _doc long, gone string, _gone string, of string, _kept int, kept_doc int, _size int, _hash int, hash int, key int, ci int, quality int, keep int, _salt int, _rank int, sequence_id int, fp int, root int"


def wide(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3, "g", "h", "o", 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17) for d, t in rows], NAMES)


def test_columns_of_any_name(spark):
    rng = random.Random(5)
    para = sentence(rng, 60)
    rows = [(1, para), (2, sentence(rng, 30) + "\n" + para), (3, None), (None, ""), (4, sentence(rng, 40)), (4, para)]
    docs = wide(spark, rows)
    y = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (remove_passages, keep_one, lambda d: keep_good(d, y)):
        out = f(docs)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(r)[5:] for r in docs.collect()}
    laid = lay_out(mix(docs)).select(*[c for c in docs.columns if c not in ("_size", "_hash")])
    assert laid.where("text is not null and text != ''").count() >= 4
    for f in (simhash_components, count_tokens, mix_digest, dedup_substrings, repeated_passages, pack_documents, lambda d: classify(d, y)):
        f(docs).collect()


def test_stages_on_empty_tables(spark, tmp_path):
    docs = wide(spark, [(1, "x")]).limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(300_000))
    solid = "x" * 1_500_000
    rows = [(1, long), (2, "start " + long[:400_000] + " end"), (3, solid), (4, solid + "y")]
    docs = frame(spark, rows)
    tokens = {r.doc_id: r.n_bytes for r in count_tokens(docs).collect()}
    assert tokens == {d: len(t) for d, t in rows}
    gone = {r.doc_id: r.n_removed for r in dedup_substrings(docs).collect()}
    assert gone[1] == 0 and gone[2] >= 399_999 and gone[3] == len(solid) - 1 - 0 and gone[4] == len(solid)
    left = {r.doc_id: r.text for r in remove_passages(docs).collect()}
    assert left[1] == long and len(left[2]) < 200 and len(left) == 4
    assert len({r.component_id for r in simhash_components(docs).collect()}) >= 2
