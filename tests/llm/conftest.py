import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, score string, line int, kept string, "
          "n_words string, sequence_id string, ids string, row string, prefix string, __id string, __row string, licences string")


def document(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, 0, *["x"] * 3, 7, *["x"] * 8)[:7] + (None, *["x"] * 9)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows,
    equal ids, equal texts; extra columns named like the operators' own."""
    prose = "The quick brown fox jumps over the lazy dog, and then it sleeps.\nA second line of ordinary length follows here, with words."
    long_text = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
    rows = [document(1, prose), document(2, prose), document(2, prose), document(3, None), document(4, ""), document(5, " \n\t "),
            document(None, prose + " More."), document(None, None), document(6, long_text), document(7, "x" * 50_000),
            document(8, "one"), document(8, "other text under the same id, long enough to count as more than ten words in all"),
            document(9, prose, None, None), document(10, "Σ İ ﬁ 漢字 é 😀 <|endoftext|> ▁ \r\n\x00 tail", "xx", ""),
            document(11, prose.replace("sleeps", "slept")), document(12, "Released under the MIT License."),
            document(13, "a\n\na\n" + prose), document(14, "\n".join(["Same line again and again, forty characters."] * 300))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


