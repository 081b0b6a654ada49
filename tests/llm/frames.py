"""Small tables with what real ones hold: nulls, empty and long texts, copies, clashing columns."""

from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox and the lazy dog of that house " * 3_000
WILD = [
    (1, "The cat sat on the mat with the dog and the bird.\nIt was a day for this.", "en", "a", 3),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "a", 4),
    (5, LONG, "en", "b", 1),
    (6, "The cat sat on the mat with the dog and the bird.\nIt was a day for this.", "en", "a", 3),
    (6, "The cat sat on the mat with the dog and the bird.\nIt was a day for this.", "en", "a", 3),
    (None, "no id here but words enough to stand for a text", None, "a", 1),
    (None, None, None, None, None),
    (7, "x" * 50_000, "xx", "a", 1),
    (8, "Ünï çödé ΑΣ İ <|endoftext|> 漢字 \u200b \x1c it's", "xx", "a", 1),
    (9, "one", "en", "a", 1),
]
CLASHING = ["score", "key", "n_words", "kept", "label", "node", "length", "piece", "component_id", "signature", "words",
            "part", "guest", "n_tokens", "item", "rule", "root", "conv", "mark"]


def wild(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    docs = spark.createDataFrame(WILD, SCHEMA)
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


def empty(spark):
    return wild(spark).where("false")


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))


WILD_IDS = sorted((row[0] for row in WILD), key=lambda i: (i is not None, i))
