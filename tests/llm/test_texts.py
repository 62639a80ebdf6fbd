import hashlib
import random

import numpy as np
import pytest

from postlens.llm import paragraphs, suffix
from postlens.llm.html_main import main_text
from postlens.llm.paragraphs import PASSAGE, SIMILAR, jaccard_tree, remove_passages, repeated_passages, shingles, tune
from postlens.llm.quality import classify, keep_good
from postlens.llm.suffix import dedup_substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 3, "x") for d, t in rows], DOCS)


def brute_substrings(rows, length):
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen, out = set(), {}
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[rows[k][0]] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1 << 22, 300])
def test_substrings_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "_CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 6)))
    base = ["".join(word() for _ in range(120)) for _ in range(5)]
    rows = [(900, None), (901, ""), (902, "a" * 99), (903, "a" * 500), (904, "ab" * 300), (905, "x" * 100), (906, "x" * 100)]
    for k in range(60):
        t = base[k % 5]
        i, j = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
        rows.append((rng.randint(0, 10**6) * 61 + k + 1000, rng.choice([t, t[i:j] + word() + t[i:], "".join(word() for _ in range(40)) + t[:j]])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(frame(spark, rows).repartition(5)).collect()}
    assert got == brute_substrings(rows, 100)


def test_substrings_edges(spark):
    t = "z" * 50 + "".join(map(str, range(90)))
    got = dedup_substrings(frame(spark, [(1, t), (1, t), (2, t), (None, t), (1, t + "q")])).collect()
    assert len(got) == 5
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got)[0] == (0, True)
    same = [r for r in got if r.doc_id == 1 and r.n_bytes == len(t)]
    assert len({(r.n_removed, r.kept_sha256) for r in same}) == 1
    assert dedup_substrings(frame(spark, [(1, "a")]).limit(0)).count() == 0


def sentence(rng, n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n)) + "."


def test_passages(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    para = sentence(rng, 80)
    near = para.split()
    near[40] = "changed"
    clean = [(k, "\n".join(sentence(rng, 30) for _ in range(3))) for k in range(20)]
    rows = clean + [(100, sentence(rng, 20) + " " + passage + " " + sentence(rng, 20)), (101, sentence(rng, 9)[:-1] + " " + passage + " " + sentence(rng, 40)), (102, para), (103, sentence(rng, 30) + "\n" + " ".join(near)), (104, None), (105, ""), (106, passage), (107, "short line. " * 3)]
    got = repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.kept} == {101, 103, 106}
    assert {r.doc_id for r in got} == {100, 101, 102, 103, 106}
    assert all(r.n_words >= PASSAGE for r in got)
    out = {r.doc_id: r for r in remove_passages(frame(spark, rows)).collect()}
    assert set(out) == {d for d, _ in rows} - {106}
    for d, t in clean:
        assert out[d].text == t
    assert "changed" not in out[103].text and out[103].n_chars == len(out[103].text)
    assert out[102].text == para and len(out[101].text) < 500
    assert repeated_passages(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_unique_text_between_repeated_lines_stays(spark):
    rng = random.Random(11)
    head, foot = (" ".join(sentence(rng, 14) for _ in range(3)) for _ in range(2))
    body = ["\n".join(sentence(rng, n) for n in (12, 5, 30)) for _ in range(3)]
    rows = [(k, f"{head}\n{body[k]}\n{foot}") for k in range(3)]
    out = {r.doc_id: r.text for r in remove_passages(frame(spark, rows)).collect()}
    assert out == {0: rows[0][1], 1: body[1], 2: body[2]}
    assert all(r.n_words == 42 for r in repeated_passages(frame(spark, rows)).collect())


def test_passages_over_short_lines(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(64)]
    sizes = [5, 12, 7, 9, 5, 6, 11, 9]
    wrapped = "\n".join(" ".join(words[sum(sizes[:k]) : sum(sizes[: k + 1])]) for k in range(len(sizes)))
    listed = "\n".join(sentence(rng, n) for n in (9, 4, 3, 12, 2, 8))
    rows = [(k, "\n".join([sentence(rng, 6), wrapped, sentence(rng, 20), listed, sentence(rng, 5)])) for k in range(2)]
    got = [(r.doc_id, rows[r.doc_id][1][r.start : r.end], r.kept) for r in repeated_passages(frame(spark, rows)).collect()]
    assert sorted(got) == sorted((k, t, k == 0) for k in range(2) for t in (wrapped, listed))


def test_passages_without_cuts_of_their_own(spark):
    rng = random.Random(13)
    line = sentence(rng, 60)
    bare = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(80))
    one, two = ([f"w{rng.randint(0, 5000)}" for _ in range(20)] for _ in range(2))
    near = [" ".join(x) + "." for x in (one, two)]
    changed = [" ".join([*x[:-1], "other"]) + "." for x in (one, two)]
    rows = [(0, line), (1, f"{sentence(rng, 12)} {line} {sentence(rng, 12)}"), (2, f"{sentence(rng, 9)[:-1]} {bare} {sentence(rng, 30)}"), (3, f"{sentence(rng, 14)[:-1]} {bare} {sentence(rng, 21)}")]
    rows += [(4, f"{sentence(rng, 40)} {' '.join(near)} {sentence(rng, 40)}"), (5, f"{sentence(rng, 40)} {' '.join(changed)} {sentence(rng, 40)}")]
    found = {(r.doc_id, r.kept): rows[r.doc_id][1][r.start : r.end] for r in repeated_passages(frame(spark, rows), anywhere=True).collect()}
    assert set(found) == {(k, k % 2 == 0) for k in range(6)}
    assert found[0, True] == found[1, False] == line and found[2, True] == found[3, False]
    assert found[2, True] in bare and len(found[2, True].split()) >= 80 - 2 * (paragraphs.WINDOW - 1)
    assert found[4, True] == " ".join(near) and found[5, False] == " ".join(changed)
    twice = [(0, f"{sentence(rng, 30)} {line} {sentence(rng, 9)} {line}")]
    assert repeated_passages(frame(spark, twice), anywhere=True).where("not kept").count() == 0


def test_near_paragraphs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET", 6)
    rng = random.Random(9)
    base = [[f"v{rng.randint(0, 300)}" for _ in range(70)] for _ in range(6)]
    rows = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(k % 3):
            w[rng.randint(0, 69)] = f"n{k}"
        rows.append((k, " ".join(w)))
    sets = [set(shingles(paragraphs.Units().cut(t)[0]).tolist()) for _, t in rows]
    up = list(range(90))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= SIMILAR:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = {}
    for k in range(90):
        want.setdefault(find(k), set()).add(k)
    got = {}
    for r in repeated_passages(frame(spark, rows)).collect():
        got.setdefault(r.cluster_id, []).append(r)
    assert sorted(sorted({r.doc_id for r in rs}) for rs in got.values()) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    for rs in got.values():
        assert [r.doc_id for r in rs if r.kept] == [min(r.doc_id for r in rs)]


def test_bands_and_tree():
    assert 1 - (1 - SIMILAR**4) ** tune() >= 0.999
    assert jaccard_tree([np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5, 6]), np.array([9])]) == [(1, 0)]


JUNK = ["BUY!! NOW!! CHEAP!! PILLS!! ", "spam spam spam spam ", "foo*** bar### baz%%% ", "a | b | c | d "]


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        t = rng.choice(JUNK) * rng.randint(5, 60) if bad else "\n".join(sentence(rng, rng.randint(8, 40)).capitalize() for _ in range(rng.randint(1, 8)))
        rows.append((k, t))
        if k % 2 == 0 or k % 5 == 0 and k % 3:
            labels.append((k, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (None, "Some quiet line of text, as it goes.")]
    labels += [(5000, 1, 0), (None, 1, 0), (3, None, 0)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r.doc_id: r.keep for r in classify(docs, y).collect()}
    assert len(got) == 603
    known = {d for d, _, _ in labels}
    held = [k for k in range(600) if k not in known]
    assert sum(got[k] == (k % 5 != 0) for k in held) >= 0.97 * len(held)
    kept = keep_good(docs, y)
    assert {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k} and kept.columns == docs.columns
    assert classify(docs, y.limit(0)).where("not keep").count() == 0
    assert classify(docs.limit(0), y).count() == 0


def test_main_text(spark):
    page = "<html><head><title>t</title><script>x='</p>'</script></head><body><nav>m</nav><div class=ad>buy</div><article><h1>A &amp; b</h1><p>One\n  two<b>three</b><p>four</article><div id='comments'>c</div><footer>f</footer></body></html>"
    shared = "<div><div><span>menu of the site</span> x</div><p>own {0}</p><p>all pages say this</p></div>"
    rows = [(1, "http://a/1", page), (2, None, None), (3, "", ""), (4, "http://a/1", page)] + [(10 + k, f"http://b.example/{k}", shared.format(k)) for k in range(6)]
    got = {r.page_id: r for r in main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")).collect()}
    assert got[1].text == "A & b\nOne twothree\nfour" == got[4].text
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    for k in range(6):
        assert got[10 + k].text == f"own {k}" and got[10 + k].n_chars == len(f"own {k}")
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_copies(spark):
    page = "<body><div id=wrap><article><p>one</p><p>two</p></article></div></body>"
    plain = "<body><div><div>three</div><p>four</p></div></body>"
    rows = [(k, "http://a/1", page) for k in range(3)] + [(10 + k, "http://b/1", plain) for k in range(4)]
    rows += [(20 + k, f"http://c/{k}", f"<!-- {k} -->" + page) for k in range(3)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "three\nfour" if 10 <= k < 20 else "one\ntwo" for k, _, _ in rows}
