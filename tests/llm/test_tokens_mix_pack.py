import zlib

import numpy as np
import pytest

from postlens.llm.mixing import mix, mix_digest, targets
from postlens.llm.packing import pack, pack_documents, plan_bins, token_pieces
from postlens.llm.tokens import Counter2, count_tokens, default_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long"
TEXTS = [None, "", " ", "a", "Hello  world\n \n x", " lead and trail ", "it's 42's <|endoftext|> end<|endoftext|>", "é ü ß x  y", "x\x1cy \x1f z", "tab\t and\r\nline ", "a " * 3000, "the same", "the same"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(k, x, "en", [None, "a", "b", "c"][k % 4], 7, 9) for k, x in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_pieces_equal_the_library(tokenizer):
    import random

    rng = random.Random(3)
    count, ids = Counter2(default_vocabulary(), "n"), Counter2(default_vocabulary(), "ids")
    parts = ["a", " ", "  ", "\n", "'s", "é", "1", "!!", " ", "word", "\t", "<|endoftext|>", "\x85", "　", "中"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert count(text) == len(want), repr(text)
        assert np.frombuffer(ids(text), "<u4").tolist() == want


def test_ranks_equal_the_library_on_its_whole_vocabulary(tokenizer):
    from postlens.llm.tokens import _library

    encode = _library(default_vocabulary())[0]
    texts = [tokenizer.decode([k]) for k in range(0, 50256)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == want.ids


def test_count_tokens(spark, tokenizer):
    got = {r.doc_id: r for r in count_tokens(rows(spark)).collect()}
    for k, x in enumerate(TEXTS):
        n = len(tokenizer.encode(x or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((x or "").encode()), n, n > 1024)
    assert count_tokens(rows(spark).limit(0)).count() == 0
    assert count_tokens(spark.createDataFrame([(None, "x y")], "doc_id long, text string")).first().n_tokens == 2


def test_other_libraries(spark):
    import public_tokenizers as P

    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        r = count_tokens(spark.createDataFrame([(1, "Hello big world")], "doc_id long, text string"), P.path(name)).first()
        assert r.n_tokens >= 3


def test_packing_round_trip(spark, tokenizer):
    texts = [*TEXTS, *["w" + " w" * k for k in range(0, 700, 9)]]
    docs = rows(spark, texts)
    got = pack_documents(docs, 512).collect()
    ids = {k: tokenizer.encode(x or "", add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for k, want in ids.items():
        ps = sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert sum(p.length for p in ps) == len(want) and all(p.length == 512 for p in ps[1:])
        at = 0
        for p in ps:
            assert p.start == at
            at += p.length
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
    total = sum(map(len, ids.values()))
    assert len(by_seq) <= -(-total // 512) + 1
    assert pack_documents(docs.limit(0)).count() == 0


def test_plan_uses_everything_and_fills():
    rng = np.random.default_rng(0)
    for _ in range(20):
        h = {int(x): int(n) for x, n in zip(rng.integers(1, 101, 30), rng.integers(1, 50, 30))}
        plan = plan_bins(h, 100)
        used = {}
        for combination, times in plan:
            assert sum(x * k for x, k in combination) <= 100
            for x, k in combination:
                used[x] = used.get(x, 0) + k * times
        assert used == h
    assert plan_bins({60: 1, 40: 1, 50: 2}, 100) == [([(60, 1), (40, 1)], 1), ([(50, 2)], 1)]


def test_a_length_beyond_the_capacity_is_an_error(spark):
    with pytest.raises(Exception, match="must be 1 to 10"):
        pack(spark.createDataFrame([(1, 0, 11)], "doc_id long, piece int, length long"), 10).collect()


def test_pieces_keep_ids(spark, tokenizer):
    r = token_pieces(rows(spark, ["one two three"]), 2, keep_ids=True).orderBy("piece").collect()
    assert [x for p in r for x in p.ids] == tokenizer.encode("one two three").ids + [0]


def test_targets_water_fill():
    assert targets(np.array([100, 100, 100]), np.array([5, 2, 1])).tolist() == [187.5, 75, 37.5]
    assert targets(np.array([10, 200, 90]), np.array([5, 2, 1])).tolist() == [30, 180, 90]
    assert targets(np.array([0, 0]), np.array([5, 2])).tolist() == [0, 0]


def test_mix(spark):
    texts = [None if k % 11 == 0 else "w " * (k % 37) for k in range(400)]
    docs = spark.createDataFrame([(k // 2 if k < 20 else k, x, "en", [None, "a", "b", "b", "c", "zz"][k % 6], 1, 2) for k, x in enumerate(texts)], DOCS)
    got = mix_digest(docs, block=8).collect()
    assert len(got) == 400
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for (size, target), rs in by.items():
        assert sum(r.size for r in rs) == size
        assert abs(sum(r.taken for r in rs) - target) <= 1
    again = mix_digest(docs.repartition(3), block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_digest(docs.limit(0)).count() == 0
    copies = mix(docs, shards=5, block=8).where("_copy is not null")
    n = [r["count"] for r in copies.groupBy("_shard").count().collect()]
    assert len(n) == 5
    assert {"_words", "_place", "text", "length"} <= set(copies.columns)
