"""Name scores of whole batches against the table of one pair at a time."""
import random

import numpy as np

from depotlens.functions import similarity as S


def plain(a, b):
    """100 * 2 * longest common subsequence / lengths, by the textbook table."""
    a, b = (" ".join(sorted(s.split())) for s in (a, b))
    if not a and not b:
        return 100.0
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return 100.0 * (2 * int(t[-1, -1])) / (len(a) + len(b))


def names(r, k):
    word = lambda: "".join(r.choice("abcdeé€𝄞") for _ in range(r.randint(1, 7)))
    return [" ".join(word() for _ in range(r.randint(0, 5))) for _ in range(k)]


def test_batches_equal_single_tables(monkeypatch):
    r = random.Random(5)
    a, b = names(r, 400), names(r, 400)
    b[:50] = a[:50]
    want = [plain(x, y) for x, y in zip(a, b)]
    assert S.token_sort_ratios(a, b).tolist() == want
    monkeypatch.setattr(S, "CELLS", 64)  # many small chunks, some of one pair
    assert S.token_sort_ratios(a, b).tolist() == want
    cut = S.token_sort_ratios(a, b, 75.0)
    assert [x for x in cut if x >= 75] == [x for x in want if x >= 75]
    assert all(c in (0.0, w) for c, w in zip(cut, want))


def test_nulls_empty_and_very_long():
    assert S.token_sort_ratios([None, "", "a", ""], ["a", "", None, "b"]).tolist() == [0.0, 100.0, 0.0, 0.0]
    assert S.token_sort_ratios([], []).tolist() == []
    assert S.token_sort_ratio("ab " * 2000, "ab " * 2000) == 100.0
