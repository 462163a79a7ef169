import re

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import words as w

TEXTS = [None, "", "Ab cd\tef\n\nÀé 12x", " x ", "ЖЖ日本 a-b", "a" * 300, "\x0b\x0c\r", "é"]


@pytest.mark.parametrize("size", [1, 9, 1 << 20])
@pytest.mark.parametrize("kind, pattern", [(w.SPACED, rb"[^\x20\x09-\x0d]+"), (w.ALNUM, rb"[0-9a-z\x80-\xff]+")])
def test_words_and_hashes(size, kind, pattern):
    column = pa.chunked_array([pa.array(TEXTS[:3]), pa.array(TEXTS[3:])])
    seen, rows = {}, 0
    for a, b, data, offsets in w.steps(column, size):
        words = w.Words(data, offsets, kind, True)
        hashes = words.hashes()
        for r in range(a, b):
            rows += 1
            want = re.findall(pattern, (TEXTS[r] or "").encode().lower())
            at = range(*words.first[r - a : r - a + 2])
            assert [words.data[words.starts[i] : words.ends[i]].tobytes() for i in at] == want
            for x, i in zip(want, at, strict=True):
                assert seen.setdefault(x, hashes[i]) == hashes[i]
    assert rows == len(TEXTS) and len(set(seen.values())) == len(seen)


def test_windows_do_not_cross_rows():
    data = np.frombuffer(b"a b c d", np.uint8)
    words = w.Words(data, np.array([0, 4, 4, 7]), w.SPACED, False)
    at, row = words.windows(2)
    assert at.tolist() == [0, 2] and row.tolist() == [0, 2]
    assert w.short_rows(words, 3).tolist() == [0, 2]
