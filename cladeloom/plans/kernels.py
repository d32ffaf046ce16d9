"""Merge kernels on NumPy blocks: states first, patterns last.

A clade is a (4, P) array, a segment a (4, 4, P) array, or (4, 4, 1) while it
is the same for all patterns. Scales are integer powers of two, so rescaling
never rounds.
"""

from __future__ import annotations

import numpy as np

RESCALE_BELOW = 2.0**-66

# The five ways to join two neighbouring components.
CLADE_CLADE = 1
CLADE_SEGMENT = 2
SEGMENT_SIDE_CLADE = 3
SEGMENT_END_CLADE = 4
SEGMENT_SEGMENT = 5


def merge(kind: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if kind == CLADE_CLADE:
        return left * right
    if kind == CLADE_SEGMENT:
        return left[:, None, :] * right
    if kind == SEGMENT_SIDE_CLADE:
        return left * right[None, :, :]
    if kind == SEGMENT_END_CLADE:
        return (left * right[None, :, :]).sum(axis=1)
    if kind == SEGMENT_SEGMENT:
        out = left[:, 0, None, :] * right[None, 0, :, :]
        for k in (1, 2, 3):
            out = out + left[:, k, None, :] * right[None, k, :, :]
        return out
    raise ValueError(f"merge type {kind}")


def rescale(block: np.ndarray, scale: np.ndarray | int):
    """Pull patterns whose largest value became small back to [0.5, 1)."""
    top = block.max(axis=tuple(range(block.ndim - 1)))
    small = top < RESCALE_BELOW
    if not small.any():
        return block, scale
    exponent = np.where(small & (top > 0), np.frexp(top)[1], 0)
    return np.ldexp(block, -exponent), scale + exponent


def leaf_table(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """(4, 15) messages of every state code through one transition matrix."""
    table = matrix @ states.T
    table[:, -1] = 1.0
    return table


def root_loglik(block: np.ndarray, scale, pi) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(pi) @ block) + np.log(2.0) * scale
