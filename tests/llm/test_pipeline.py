"""Pipeline stages on a small corpus, against what each has to do to it."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    sounds = {"aa": "la le lo na ne no".split(), "bb": "ksch krt zwa grz tz sch".split()}
    say = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(4)) for _ in range(n))
    rows = []
    for i in range(120):
        k = rng.choice(("aa", "bb"))
        rows.append((i, "\n".join(say(k, 12) for _ in range(6)), k, rng.choice("xyz"), 1))
    leak = say("aa", 25)
    rows.append((200, None, None, "x", None))
    rows.append((201, "123 456", "aa", "x", 7))
    rows.append((202, rows[3][1], rows[3][2], "x", 1))  # exact copy
    words = rows[4][1].split(" ")
    words[20] = "changed"
    rows.append((203, " ".join(words).replace("\n", "\n "), rows[4][2], "x", 1))  # near copy whose lines differ
    rows.append((204, say("aa", 30) + "\n" + leak + "\n" + say("aa", 10), "aa", "y", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean, ids = set(range(120)), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == clean | {202, 203, 204}
    assert ids[1] == clean | {203, 204}
    assert ids[2] == clean | {204}
    assert ids[3] == clean
    assert ids[4] <= ids[3] and ids[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])
