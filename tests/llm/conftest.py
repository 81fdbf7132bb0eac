import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


ODD = [None, "", " \n\t ", "a", "a b", "One two three. Four, five six!\nseven", "naïve ÀÉ ß…  «q» 12.5,3  x　 y", "it's  don't <|endoftext|> x\x00y", " lead", "tab\t\n x", "word " * 3000]


@pytest.fixture
def odd_docs(spark):
    """Nulls in both columns, blanks, marks, a long text, repeated rows, and further columns with clashing names."""
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "a b", "y", 2), (3, "a", "x", 1), (3, "a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, tkey string".replace("n long", "n string").replace("tkey string", "tkey long")).selectExpr("doc_id", "text", "n", "tkey", "'en' lang", "'s' source", "length(text) n_chars")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
