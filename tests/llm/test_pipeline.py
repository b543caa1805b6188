import random

import corpus_pipeline
from keyloom.llm.simhash import shingle_hashes


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    docs = {i: prose(rng.randrange(60, 250)) for i in range(200)}
    bad = {300 + i: " ".join(w.upper() + "!!##" for w in rng.choices(vocabulary, k=120)) for i in range(60)}
    item, passage = prose(30), prose(70)
    near = docs[3].split()
    near[len(near) // 2] = "edited"
    special = {500: docs[1], 501: " ".join(near), 502: prose(80) + " " + item.upper() + " " + prose(20), 503: prose(50) + " " + passage, 504: passage + " " + prose(50)}
    every = docs | bad | special
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in every.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in docs | bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, after = df.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        after.append({r.doc_id: r for r in df.collect()})
        assert k == 4 or df.columns == columns
    assert len(set(after[0]) & set(bad)) <= 1 and len(set(after[0]) & set(docs)) >= 198
    assert not {500, 501} & set(after[1]) and {1, 3} <= set(after[1])
    assert passage[20:-20] not in after[2][503].text and len(after[2][504].text) >= 100
    assert after[2][7].text == docs[7] and after[2][503].n_chars == len(after[2][503].text)
    assert 502 not in after[3] and set(after[2]) - set(after[3]) == {502}
    assert set(after[4]) == set(after[3])
    assert {tuple(shingle_hashes(docs[i].encode(), 5)[:1]) for i in (1, 3)}


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "sequence_id" in got.columns
