import random

import corpus_pipeline as cp


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    line = lambda n: " ".join(f"k{rng.randint(0, 9000)}" for _ in range(n)).capitalize() + "."
    passage = " ".join(line(13) for _ in range(5))
    good = ["\n".join(line(rng.randint(12, 40)) for _ in range(4)) for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(good)] + [(200 + k, good[k]) for k in range(5)] + [(300, line(30) + " " + passage), (301, line(40) + " " + passage)]
    rows += [(400 + k, "WOW!! SALE!! " * (20 + k)) for k in range(30)] + [(500, None)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    y = [(d, 0 if d >= 400 else 1, 0) for d, _ in rows if d < 500]
    spark.createDataFrame(y, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns, name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert ids("quality") >= set(range(80)) | {300, 301} and not ids("quality") & set(range(400, 430))
    assert not ids("near_dedup") & set(range(200, 205)) and ids("near_dedup") >= set(range(80)) | {300, 301}
    text = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert passage in text[300] and passage not in text[301]
    words = sum(len((r.text or "").split()) for r in kept["substring_dedup"])
    assert abs(sum(len(r.text.split()) for r in kept["mixing"]) - words) <= 3
    assert sum(r.length for r in kept["packing"]) > words
    assert spark.read.parquet(f"{tmp_path}/packing").select("sequence_id").distinct().count() >= 1
    assert cp.run(spark, str(tmp_path)).count() == len(kept["packing"])
