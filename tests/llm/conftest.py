import sys
from pathlib import Path

import pytest
from pyspark.sql import Row

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and further columns with clashing names."""
    long_word, prose = "abcdefghij" * 3000, " ".join(f"word{k % 97} of{k % 13}" for k in range(9000))
    texts = [None, "", "   \n", "one", "Two words", "a b c d e f g h", "A B C\td e f g h", prose, prose, long_word,
             'token = "abcdef123456" and AKIA' + "Z" * 16 + " x", "<|endoftext|> a  b\n\nc", "é" * 500 + " 漢字 😀", "x" * 700]
    rows = [Row(doc_id=k, text=t, lang="en", source="s", n_chars=len(t or ""), ids=b"1", score=5.0, spans="q", component_id=1, sequence_id=3, bit=1, node=2)
            for k, t in enumerate(texts)]
    rows += [rows[4], rows[7], Row(**(rows[3].asDict() | {"doc_id": None})), Row(**(rows[6].asDict() | {"lang": None, "source": None, "n_chars": None}))]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, ids binary, score double, spans string, component_id long, sequence_id long, bit int, node long")
