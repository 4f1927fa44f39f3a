"""Nodes that share an entity with a seed: what is shuffled grows with the links, not with the pairs."""

import random

import pytest

from caseweave.operators import graph as gr


@pytest.mark.parametrize("every", [1, 10])
def test_copies_are_bounded(spark, monkeypatch, every):
    """popular entities go over many tasks; each link is copied few times, and pairs are those of a plain search."""
    monkeypatch.setattr(gr, "PAIRS_PER_TASK", 8)
    rng = random.Random(6)
    held = {f"HA-{i}": {f"c{rng.randrange(6)}" for _ in range(rng.randint(0, 4))} for i in range(120)}
    edges = [(n, c) for n, own in held.items() for c in own] * 2 + [(None, "c1"), ("HA-1", None)]
    seeds = [f"HA-{i}" for i in range(0, 130, every)]
    links, seen = sum(map(len, held.values())), []
    plain = gr._dealt_links
    monkeypatch.setattr(gr, "_dealt_links", lambda rows: seen.append([side.count() for side in plain(rows)]) or plain(rows))
    got = [tuple(r) for r in gr.shared_entity(
        spark.createDataFrame([(s,) for s in seeds + seeds[:3]], "id string"),
        spark.createDataFrame(edges, "src_id string, dst_id string"),
    ).collect()]
    want = {(s, n) for s in seeds for n in held if n != s and held.get(s, set()) & held[n]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    mine, others = seen[0]
    asked = sum(len(held.get(s, ())) for s in seeds)
    assert mine <= gr.MOST_COPIES * links + asked and links <= others <= (gr.MOST_COPIES + 1) * links
    assert mine > asked
