import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Nulls, empty and very long texts, ties and repeated rows.
ODD_TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "a\n\nb\n", "\tTab\r\nline\x0b\x0c", "▁ mark ▁▁", "é é ﬁ Ǆ İ ß Σ",
    "日本語のテキスト。改行\nなし", "🙂🙂 emoji", "<s> </s> <unk> <|endoftext|>x<|startoftext|>", "don't they've I'M",
    "x" * 5000, "word " * 3000, "same text here", "same text here", "\x00 nul \x1f unit", "1234567890 3.14 -7",
    "The quick brown fox jumps over the lazy dog. " * 40,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "no id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
