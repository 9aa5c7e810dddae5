"""Plain Python that the tests of the corpus operators hold results against."""

import itertools
import math

from gristmill.llm import packing, quality_rules


def classes_of(fps, links):
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


def levels_in_force(rows, alpha, delta):
    """{stratum: level in force} in plain Python, from (stratum, level) of good documents."""
    strata, out = {s for s, _ in rows}, {}
    for s in strata:
        levels = [x for t, x in rows if t == s]
        for k in range(quality_rules.N_LEVELS):
            n, bad = len(levels), sum(x <= k for x in levels)
            tail = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(bad + 1))
            if bad > n * alpha or tail > delta / len(strata):
                break
            out[s] = k
    return out


def assert_gapless(got):
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
