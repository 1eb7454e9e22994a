import hashlib

import numpy as np
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_suffix_dedup import brute as brute_repeats

import corpus_pipeline
from tessera.llm import packing


def test_stages_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = say(40)
    rows, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        t = say(60) if good else "$$$ ### ".join(rng.choice(words, 60)).upper()
        if good and i % 5 == 0:
            t += " " + shared
        if good and i % 7 == 0 and rows:
            t = rows[-1][1].replace("a", "b", 1)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(good), 0))
    rows += [(500, "", None, None, None), (501, None, "en", "s1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 3:
            assert docs.columns == corpus_pipeline.COLUMNS
    kept = {r["doc_id"] for r in seen[0]}
    clean = {i for i, q, _ in labels if q == 1}
    assert len(kept & clean) >= 0.9 * len(clean) and len(kept - clean) <= 6
    want = brute_components([(r["doc_id"], r["text"]) for r in seen[0]])
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(d for d, n, c in want if d == c)
    source = {r["doc_id"]: r for r in seen[0]}
    assert all(source[r["doc_id"]] == r for r in seen[1])
    digests = {d: (n - gone, h) for d, n, gone, _, h in brute_repeats([(r["doc_id"], r["text"]) for r in seen[1]])}
    for r in seen[2]:
        assert (len(r["text"].encode()), hashlib.sha256(r["text"].encode()).hexdigest()) == digests[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and r["lang"] == source[r["doc_id"]]["lang"]
    enc = packing.encoder(corpus_pipeline.vocabulary(corpus_pipeline.PACKING_VOCABULARY))
    total = {}
    for r in seen[3]:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {r["doc_id"]: len(enc.encode(r["text"])) // 4 + 1 for r in seen[2]}
    assert len(list(corpus_pipeline.run(spark, str(tmp_path)).collect())) == len(seen[3])
