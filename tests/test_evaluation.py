"""Paired randomisation against brute force over every unit and draw, on the small tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerlens import registry

DATA = "/root/testdata/sf0.001"


def test_sign_flips(spark):
    arms = defaultdict(lambda: ([], []))
    for r in pq.read_table(f"{DATA}/orders.parquet", columns=["o_custkey", "o_orderstatus", "o_totalprice"]).to_pylist():
        arms[r["o_custkey"]][r["o_orderstatus"] != "F"].append(r["o_totalprice"])
    diffs = {u: np.mean(a) - np.mean(b) for u, (a, b) in arms.items() if a and b}
    drawn = np.zeros(10_240)
    for unit, diff in diffs.items():
        digits = "".join(hashlib.sha256(f"7:{unit}:{block}".encode()).hexdigest() for block in range(40))
        bits = np.array([int(x, 16) >> j & 1 for x in digits for j in range(4)])
        drawn += np.where(bits, -diff, diff)
    values = np.array(list(diffs.values()))
    extreme = (np.abs(drawn[:10_000]).round(4) >= abs(values.sum()).round(4)).sum()
    wins, losses = (values > 1e-9).sum(), (values < -1e-9).sum()
    [got] = registry.QUERIES["paired_differences"](spark, DATA).collect()
    assert (got.wins, got.losses, got.ties, got.units) == (wins, losses, len(values) - wins - losses, len(values))
    assert (got["mean"], got.p) == (pytest.approx(values.mean(), abs=1e-4), pytest.approx((extreme + 1) / 10_001, abs=1e-6))
    # far draws are as frequent as for independent signs of these sizes
    assert drawn[:10_000].std() == pytest.approx(np.sqrt((values**2).sum()), rel=0.05)
