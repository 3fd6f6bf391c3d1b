import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import ODD_TEXTS, running_text  # noqa: E402


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and empty texts, null ids, a repeated row, a very long text, and columns named like the operators' own."""
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, running_text(7, 30_000), None, None), (8, running_text(8, 300), "en", "s"), (8, running_text(8, 300), "en", "s"), (None, running_text(9, 80), "de", "t")]
    return spark.createDataFrame([(*r, 1, "k", 2.5) for r in rows], "doc_id long, text string, lang string, source string, n long, key string, score double")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
