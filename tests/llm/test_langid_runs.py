"""Runs of letters that are no pieces have a probability above zero."""

from __future__ import annotations

import math

import numpy as np

from atelier.llm import langid


def test_long_runs_outside_the_vocabulary_do_not_underflow():
    mark = 1e-5
    lattice = langid.Segmentations(["▁", "a"], np.array([[mark, mark], [0.9, 0.1]]))
    got = lattice.log_probability(["語" * langid.RUN, "a"])
    assert np.allclose(got[0], math.log(mark) + langid.RUN * math.log(langid.FLOOR), rtol=1e-12)
    assert got[1].argmax() == 0 and np.allclose(got[1], np.log([mark * 0.9, mark * 0.1]), rtol=1e-12)
    uses = lattice.expected(["語" * langid.RUN, "a"], np.array([2.0, 3.0]), 0)
    assert np.allclose(uses, [5.0, 3.0])
