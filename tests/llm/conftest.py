import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def hard_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    rows = [
        (1, passage, "en", "a", 1), (1, passage, "en", "a", 1), (2, passage, "en", "b", 1), (None, passage, None, None, None),
        (3, None, "en", "a", None), (None, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "en", "b", 4),
        (6, long, "en", "b", len(long)), (7, "one", "en", None, 3), (7, "two\n\nthree", "en", "b", 9),
        (8, "x\n" + passage + "\ny", "en", "b", 9), (9, passage + " more", "en", "b", 9), (10, "a b c d e", "de", "ü", 9),
        (11, "a b c d e", "de", "ü", 9), (12, "#*$%&|<>" * 30, "de", "z", 9), (13, "same line\n" * 40, "de", "z", 9),
        (14, "two  spaces \n and   three\t end  ", "de", "z", 9), (15, "<|endoftext|> 漢字 　é😀", "zh", "z", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(hard_documents):
    """The same rows with extra columns named like those that operators add inside or at the end."""
    out = hard_documents
    for c in ("k", "key", "id", "spans", "rows", "row", "size", "target", "start", "c0", "kept", "n_words", "label", "h", "base",
              "m_size", "repeats", "copy", "piece", "worded", "b_n", "host_kept", "judged_domain", "ents"):
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def no_documents(hard_documents):
    return hard_documents.limit(0)
