"""Every underfull sequence takes part in the local search."""

import random

from llm import packing as m


def test_search_reaches_all_underfull_sequences():
    rng = random.Random(1)
    lengths = [rng.randint(250, 420) for _ in range(3000)]
    plain = m.best_fit(lengths)
    assert sum(sum(lengths[k] for k in b) < m.CAPACITY for b in plain) > 2 * m.SEARCH
    out = m.local_search(plain, lengths)
    assert sorted(k for b in out for k in b) == list(range(len(lengths))) and max(sum(lengths[k] for k in b) for b in out) <= m.CAPACITY
    assert len(out) <= 1.03 * -(-sum(lengths) // m.CAPACITY)
