"""Small tables with everything that real ones hold: nulls, empty and long texts, repeats, foreign columns."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "   \t\n ", "de", "b"),
    (6, LONG, "en", "b"),
    (7, "password = \"hunter2hunter2\" all rights reserved", None, "c"),
    (None, "ein Text ohne Nummer und Namen", "de", None),
    (None, None, None, None),
    (8, "\U0001f600 İstanbul K ퟿ 12", "fr", "c"),
    (9, "AKIA" + "A1" * 9 + " deadbeefdeadbeef", "fr", "c"),
]
#: Columns that operators could trip over.
CLASHING = "key node root fp w ws spans toxicity digest place leaf hash host on hit label score block epoch tokens domain n gone again kept id samples".split()


def documents(spark, clashing: bool = True, rows=None):
    df = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING if clashing else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def save(spark, folder, **tables):
    """Writes tables as the driver keeps them; returns the folder."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def edge_folder(spark, folder, empty: bool = False, longest: int | None = None):
    docs = documents(spark, rows=[(i, t and t[:longest], lang, source) for i, t, lang, source in TEXTS])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 1), (None, 0, 1), (9, None, None), (77, 1, 1), (5, 1, 0), (6, 1, 0), (7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, ""), (None, "x y z"), (4, "ok")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.example.com/x", "<p>Hi &amp; bye"), (2, None, None), (2, None, None), (3, "no scheme", ""), (None, "https://b.Example.NET/es/q?x#y", "<div><p>a<div>b</div><br>c</p>" * 50), (4, "://", "<" * 20000)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(0, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [float("nan"), 1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0], 2), (100, [3.0], 2), (6, [], 1), (7, [float("inf"), 0.0], 1)], "vec_id long, embedding array<float>, label int")
    tables = {"documents": docs, "labels": labels, "benchmark": benchmark, "pages": pages, "embeddings": vectors}
    for c in ("host", "hash", "v", "rule", "key", "digest", "on"):
        tables["pages"] = tables["pages"].withColumn(c, F.lit("x"))
        tables["embeddings"] = tables["embeddings"].withColumn(c, F.lit("x"))
    return save(spark, folder, **({k: v.limit(0) for k, v in tables.items()} if empty else tables))
