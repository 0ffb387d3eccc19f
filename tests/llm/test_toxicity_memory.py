"""The driver holds the rows of its sample's n-grams in four bytes each."""

import numpy as np

from claimloom.llm import toxicity


def test_rows_take_four_bytes():
    for rows, share in toxicity.bags(["some words, twice some words", "", None]):
        assert rows.dtype == np.int32 and share.dtype == np.float32 and len(rows) == len(share)
