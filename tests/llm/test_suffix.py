"""Suffix arrays and common prefixes against sorting and comparing."""

import numpy as np
import pytest
from tidemark.llm import suffix


def plain(data):
    order = sorted(range(len(data)), key=lambda i: data[i:])
    lcp = [0] * len(data)
    for r in range(1, len(data)):
        a, b = data[order[r - 1] :], data[order[r] :]
        while lcp[r] < min(len(a), len(b)) and a[lcp[r]] == b[lcp[r]]:
            lcp[r] += 1
    return order, lcp


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"\x00\xff", bytes(range(256))])
def test_against_sorting(alphabet):
    rng = np.random.default_rng(len(alphabet))
    for n in (0, 1, 2, 7, 8, 9, 30, 200, 700):
        for repeat in (1, 3):
            data = bytes(rng.choice(list(alphabet), n).astype(np.uint8)) * repeat
            order = suffix.suffix_array(data)
            want, lcp = plain(data)
            assert order.tolist() == want
            assert suffix.common_prefixes(data, order).tolist() == lcp


def test_large_inputs_take_the_other_sort():
    rng = np.random.default_rng(7)
    block = rng.integers(0, 4, 1 << 19).astype(np.uint8)
    data = np.concatenate([block] * 5)
    order = suffix.suffix_array(data)
    assert (np.sort(order) == np.arange(len(data))).all()
    lcp = suffix.common_prefixes(data, order)
    picks = rng.integers(1, len(data), 300)
    raw = data.tobytes()
    for r in picks:
        a, b = int(order[r - 1]), int(order[r])
        k = int(lcp[r])
        assert raw[a : a + k] == raw[b : b + k]
        assert b + k == len(raw) or a + k == len(raw) or raw[a + k] < raw[b + k]
        assert a + k <= len(raw) and b + k <= len(raw)
