"""Long lists of a sample: rows met in the order of their bounds are those of a full comparison."""

import random
import time

import pytest

from docloom.operators import field_metric


def rows(rnd, n, letters, keys=("a", "b")):
    made = [{k: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 9))) for k in keys if rnd.random() < 0.9} for _ in range(n)]
    return made + [dict(rnd.choice(made)) for _ in range(n // 4)] + [{"a": None, "b": 3}, {}]


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefghij"), (3, "票据金额一二三")])
def test_long_lists_equal_a_full_comparison(monkeypatch, seed, letters):
    rnd = random.Random(seed)
    for _ in range(20):
        pred, gold = {"l": rows(rnd, 40, letters)}, {"l": rows(rnd, 40, letters)}
        monkeypatch.setattr(field_metric, "STRETCH", rnd.choice((1, 3, 128)))
        monkeypatch.setattr(field_metric, "MANY", 0)
        found = field_metric.field_counts(pred, gold)
        monkeypatch.setattr(field_metric, "MANY", 10**9)
        assert found == field_metric.field_counts(pred, gold)


def test_two_thousand_rows_a_side_take_seconds():
    rnd = random.Random(5)
    make = lambda: {"l": [{"name": "".join(rnd.choice("abcdefghijklmnop ") for _ in range(rnd.randint(5, 40))), "n": str(rnd.randint(1, 10**6))} for _ in range(2000)]}
    began = time.perf_counter()
    counts = field_metric.field_counts(make(), make())
    assert counts["l-name"][1] == 2000 and time.perf_counter() - began < 10
