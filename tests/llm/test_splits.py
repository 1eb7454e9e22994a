"""No result depends on how a read is split, though splits change between jobs when executors come and go."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, jaccard, negatives, packing, queries, sharding, suffix_dedup, token_counts, url_filter, vector_dedup


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Copies of some texts, vectors and urls in many small files."""
    at = str(tmp_path_factory.mktemp("splits"))
    base = [f"{w} and then the {w} went on to see number {w} at the far end of the long road {w}" for w in ("alpha", "beta", "gamma", "delta")]
    docs = [(i, " ".join(base[(i * k) % 4] + f" part {k} of {i % 9}" for k in range(1, 4))) for i in range(240)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(6, "doc_id").write.parquet(f"{at}/docs")
    vectors = [(i, [float((i * 7919 + k * k * 31) % 101) / 101 - 0.5 for k in range(16)], i % 3) for i in range(300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(6, "vec_id").write.parquet(f"{at}/vectors")
    spark.createDataFrame([(i, f"https://www.example.{('com', 'net')[i % 2]}/{('en', 'es', 'fr')[i % 3]}/{i}") for i in range(200)], "page_id long, url string").repartition(6).write.parquet(f"{at}/pages")
    return at


@pytest.fixture
def moving(spark):
    """Splits that change all the time, from one file each to all in one."""
    names = {"spark.sql.files.maxPartitionBytes": ("1k", "64m"), "spark.sql.leafNodeDefaultParallelism": ("8", "2"), "spark.sql.files.openCostInBytes": ("1", "4m")}
    before = {k: spark.conf.get(k, None) for k in names}
    stop = threading.Event()

    def turn():
        for n in range(1 << 30):
            if stop.wait(0.05):
                return
            for k, v in names.items():
                spark.conf.set(k, v[n % 2])

    worker = threading.Thread(target=turn)
    worker.start()
    yield
    stop.set()
    worker.join()
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def steady(spark, f):
    return sorted(map(str, f().collect()))


CASES = {
    "op1": lambda docs, vectors, pages: suffix_dedup.remove_repeats(docs),
    "op2": lambda docs, vectors, pages: url_filter.filter_urls(pages, queries.url_rules(pages.sparkSession, queries.URL_RULES)),
    "op4": lambda docs, vectors, pages: ann.nearest(vectors, every=10),
    "op7": lambda docs, vectors, pages: vector_dedup.link_vectors(vectors, threshold=0.8),
    "op8": lambda docs, vectors, pages: jaccard.link_documents(docs).drop("row"),
    "op8_keep": lambda docs, vectors, pages: jaccard.keep_one(docs),
    "op8_keep_of_a_join": lambda docs, vectors, pages: jaccard.keep_one(docs.join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id").repartition(7)),
    "op9": lambda docs, vectors, pages: sharding.shard_documents(docs, [1.0] * 5, [1.0] * 6),
    "op13": lambda docs, vectors, pages: negatives.mine(vectors, F.col("vec_id") % 10 == 0),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_result_is_the_same_whatever_the_splits(spark, tables, request, name):
    read = lambda: CASES[name](*[spark.read.parquet(f"{tables}/{t}") for t in ("docs", "vectors", "pages")])
    want = steady(spark, read)
    request.getfixturevalue("moving")
    assert steady(spark, read) == want


def test_packing_and_tokens_keep_every_piece(spark, tables, moving):
    path = queries.vocabulary(queries.PACKING_VOCABULARY)
    docs = spark.read.parquet(f"{tables}/docs")
    rows = packing.pack_documents(docs, path).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) >= docs.count()
    counts = token_counts.count_tokens(docs, queries.vocabulary(queries.PIECE_VOCABULARY))
    assert counts.select("doc_id").distinct().count() == docs.count()
