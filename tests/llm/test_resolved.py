"""Rows of resolved contexts without the symbols that no training text has."""

import numpy as np

from lattica.llm import ppm


def test_resolved_rows_hold_the_symbols_of_training_texts():
    code, count = np.array([ord(a) << 8 | ord(b) for a, b in ("ab", "ba", "bc", "cb")]), np.array([5, 4, 2, 1])
    low = [ppm.level(code, count, 1), ppm.level(code, count, 0)]
    kept, column = ppm.columns_of(low)
    p = np.concatenate(list(ppm.resolve(np.array([97, 98, 99, 120]), low)))
    asked = np.delete(np.arange(256), ppm.PAD)
    assert len(kept) == 4 and (p[:, kept][:, column][:, asked] == p[:, asked]).all()
