"""Draws of the bootstrap of areas: those of all bits, from a table of their beginnings."""

import numpy as np
import pandas as pd

from caseweave.functions.draws import POISSON_ONE
from caseweave.operators import evaluation as ev


def plain_copies(ids, replicates, seed):
    out = np.zeros((len(ids), replicates))
    for i, one in enumerate(ids.tolist()):
        for r in range(replicates):
            x = (one + (r + seed * 1_000_003) * 0x9E3779B97F4A7C15) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> shift)) * factor % 2**64
            x ^= x >> 31
            out[i, r] = sum((x >> 11) / 2**53 >= p for p in POISSON_ONE)
    return out


def test_copies_are_those_of_all_bits():
    ids = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 150)
    assert ev.replicate_copies(ids, 40, 7).tolist() == plain_copies(ids, 40, 7).tolist()
    # Beginnings that hold a limit are looked up by all their bits.
    assert len(ev._OPEN) and ev._COPIES.dtype == np.uint16


def test_slices_count_ties_across_blocks_and_batches():
    draw = np.random.default_rng(2)
    n, replicates = 400, 5
    rows = pd.DataFrame({
        "_slice": 1, "_id": draw.integers(0, 2**62, n), "_label": draw.integers(0, 2, n),
        "_score": np.sort(np.concatenate([np.full(150, 0.5), draw.random(n - 150).round(2)])),
    })
    w = plain_copies(rows["_id"].to_numpy(), replicates, 3)
    parts = pd.concat(ev._slice_concordance(replicates, 3)(iter([rows[:131], rows[131:131], rows[131:]])))
    value, positive = rows["_score"].to_numpy(), rows["_label"].to_numpy() == 1
    for r in range(replicates):
        pos, neg = w[positive, r], w[~positive, r]
        above, same = value[positive][:, None] > value[~positive], value[positive][:, None] == value[~positive]
        want = pos @ (above + 0.5 * same) @ neg / (pos.sum() * neg.sum())
        got = ev._joined_slices(parts[parts["replicate"] == r])["auroc"].iloc[0]
        assert abs(got - want) < 1e-12
