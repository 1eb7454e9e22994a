from datetime import datetime, timezone

from pyspark.sql import functions as F

from tessera.functions import ids, numeric, policy, text
from tessera.sources import secrets


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_tokens_with_cjk(spark):
    got = one(spark, text.tokens(F.col("s"), compat=True), s="Ｈｅｌｌｏ  数据库 a1")
    assert got == ["hello", "数据库", "数", "据", "库", "数据", "据库", "a1"]
    assert one(spark, text.lexical_tokens(F.col("s")), s="The state-of-the-art C++ a 7 数据库 字") == ["state", "art", "c++", "7", "数据", "据库", "字"]
    assert text.query_tokens("Please find the note") == ["please"] or text.query_tokens("Please find the note") == ["find", "note"]
    assert text.query_tokens("please show data") == ["data"]
    assert set(one(spark, text.graph_tokens(F.col("s")), s="Spark 3.5 数据库系统")) >= {"spark", "数据库系统", "数据", "据库系", "数据库系"}


def test_phrases_and_counts(spark):
    s = "A fast Cat; cats and a cat."
    assert one(spark, text.contains_phrase(F.col("s"), "fast cat"), s=s) and not one(spark, text.contains_phrase(F.col("s"), "fast ca"), s=s)
    assert one(spark, text.occurrences(F.col("s"), F.lit("cat")), s=s) == 2
    assert abs(one(spark, text.term_weight(F.col("s"), F.lit("cat")), s=s) - 1.35) < 1e-9
    assert one(spark, text.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))) == 0.5
    assert one(spark, text.shingles(F.split("s", " "), 3, " "), s="a b") == ["a b"] and one(spark, text.shingles(F.split("s", " "), 3, " "), s="a b c d") == ["a b c", "b c d"]
    assert one(spark, text.sentences(F.col("s")), s="One. Two!\n\nThree") == ["One.", "Two!", "Three"]


def test_labels_and_paths(spark):
    assert one(spark, text.humanize(F.col("s")), s="my_note-name.md") == "my note name"
    assert one(spark, text.qualified_name(F.col("s")), s="a/b/c.md") == "b / c"
    assert one(spark, text.keywords(F.col("s")), s="A, b;;a\nC") == ["a", "b", "c"]
    assert one(spark, text.open_uri("app", F.lit("v w"), F.lit("a/b c.md"))) == "app://open?vault=v%20w&file=a%2Fb%20c.md"
    assert one(spark, text.byte_tokens(F.col("s")), s="数据") == 6
    assert text.cut_bytes("数据 ", 5) == "数"
    assert one(spark, text.canonical_content(F.col("s")), s="---\na: 1\n---\nx  \r\ny\n") == "x\ny"


def test_hashes(spark):
    def fnv(s, h=2166136261):
        for ch in s:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h

    assert one(spark, ids.fnv1a(F.col("s")), s="hello") == fnv("hello") == 0x4F9F2CAB
    a = one(spark, ids.document_id(F.lit("s"), F.lit("ab")))
    assert a.startswith("doc_") and len(a) == 47 and a != one(spark, ids.document_id(F.lit("sa"), F.lit("b")))
    assert ids.digest({"b": 1, "a": [1, "é"]}) == ids.digest({"a": [1, "é"], "b": 1})
    assert ids.signed_by({"a": 1}, b"k", ids.sign({"a": 1}, b"k")) and not ids.signed_by({"a": 2}, b"k", ids.sign({"a": 1}, b"k"))


def test_numbers(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert abs(one(spark, numeric.cosine(v(1.0, 0.0), v(1.0, 1.0))) - 0.5**0.5) < 1e-12
    assert one(spark, numeric.cosine(v(1.0), v(1.0, 1.0))) == 0 and one(spark, numeric.cosine(v(0.0), v(1.0))) == 0
    assert not one(spark, numeric.safe_vector(v(1.0, float("nan")), 2)) and one(spark, numeric.safe_vector(v(1.0, 2.0), 2))
    assert one(spark, numeric.shares(v(1.0, 3.0))) == [0.25, 0.75]
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    assert abs(one(spark, numeric.recency(F.lit(now), F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)))) - 0.5) < 1e-12
    c = one(spark, numeric.hsl_to_rgb(F.lit(210.0), F.lit(0.5), F.lit(0.4)))
    h = one(spark, numeric.rgb_to_hsl(F.lit(c["r"]), F.lit(c["g"]), F.lit(c["b"])))
    assert abs(h["h"] - 210) < 1 and abs(h["s"] - 0.5) < 0.02 and abs(h["l"] - 0.4) < 0.01
    assert one(spark, numeric.hex_color(F.lit(1.0), F.lit(255.0), F.lit(16.0))) == "#01ff10"


def classify(spark, path, body="some real text here", title="T", tags=(), **front):
    df = spark.createDataFrame([(path, body, title, list(tags), {k: v if isinstance(v, list) else [v] for k, v in front.items()})], "path string, body string, title string, tags array<string>, front map<string,array<string>>")
    d = df.select(policy.classify(F.col("path"), F.col("front"), F.col("body"), F.col("title"), F.col("tags")).alias("d")).first()["d"]
    return d["corpus"], d["scope"], d["reason"]


def test_policy_rules(spark):
    assert classify(spark, "a/._x.md")[1:] == ("never", "AppleDouble metadata")
    assert classify(spark, "a/.git/x.md")[1] == "never" and classify(spark, "a/AGENTS.md")[1] == "never"
    assert classify(spark, "a.md", sensitivity="team-private")[1] == "never" and classify(spark, "a.md", sensitivity="weird")[2] == "unrecognized sensitivity policy"
    assert classify(spark, "a.md", sensitivity="public")[1] == "reference"
    assert classify(spark, "a.md", retrieval_scope=["a", "b"])[2] == "invalid policy field: retrieval_scope"
    assert classify(spark, "a.md", body="<!-- only -->  ")[2] == "empty body"
    assert classify(spark, "a.md", generated="yes")[0] == "generated"
    assert classify(spark, "projects/a.md") == ("project", "project", "active project path")
    assert classify(spark, "projects/a.md", retrieval_scope="default")[1:] == ("project", "active project path; ignored untrusted frontmatter promotion")
    assert classify(spark, "projects/a.md", corpus="archive") == ("history", "history", "restrictive frontmatter policy")
    assert classify(spark, "30-shared-knowledge/a.md", type="knowledge-card") == ("core", "default", "active shared knowledge card")
    assert classify(spark, "a/readme.md", body="[[x]] [[y]] [[z]]")[2] == "navigation or index document"
    assert classify(spark, "a/readme.md", body="long prose " * 40)[1] == "reference"
    assert classify(spark, "a.md", tags=["archive/2020"])[1] == "history"


def test_secrets(spark):
    find = lambda s: one(spark, secrets.finding(F.col("s")), s=s)
    assert find("key AKIA" + "A" * 16) == "AWS access key"
    assert find("https://user:pw@host/x") == "credential-bearing URL"
    assert find('password = "' + "a1" * 12 + '"') == "credential-like assignment"
    assert find('password = "your-password-placeholder-1"') is None and find("nothing here") is None
