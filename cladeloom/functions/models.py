"""Substitution models as Spark columns and as NumPy matrices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


class SubstitutionModel:
    """Extension point: stationary frequencies and transition probabilities.

    ``probability`` works on Spark columns, ``matrices`` on arrays of branch
    lengths inside a task; both describe the same 4-state reversible model.
    """

    pi: tuple[float, float, float, float]

    def probability(self, i: int, j: int, t: Column) -> Column:
        raise NotImplementedError

    def matrices(self, lengths: np.ndarray) -> np.ndarray:
        """(k, 4, 4) transition matrices of k branch lengths."""
        raise NotImplementedError

    def message(self, partial: list[Column], t: Column) -> list[Column]:
        """Sum over the lower state j of P_ij(t) * partial_j, for each upper state i."""
        return [
            sum((self.probability(i, j, t) * partial[j] for j in range(1, 4)),
                self.probability(i, 0, t) * partial[0])
            for i in range(4)
        ]


@dataclass(frozen=True)
class JukesCantor(SubstitutionModel):
    pi: tuple = (0.25, 0.25, 0.25, 0.25)

    def probability(self, i, j, t):
        decay = F.exp(F.lit(-4.0 / 3.0) * t)
        return 0.25 + 0.75 * decay if i == j else 0.25 - 0.25 * decay

    def message(self, partial, t):
        decay = F.exp(F.lit(-4.0 / 3.0) * t)
        mixed = (F.lit(0.25) - 0.25 * decay) * (partial[0] + partial[1] + partial[2] + partial[3])
        return [mixed + decay * p for p in partial]

    def matrices(self, lengths):
        decay = np.exp(-4.0 / 3.0 * np.asarray(lengths, float))[:, None, None]
        return 0.25 * (1.0 - decay) + decay * np.eye(4)


@dataclass(frozen=True)
class HKY85(SubstitutionModel):
    """Transition/transversion ratio ``kappa`` and base frequencies, unit mean rate."""

    kappa: float
    frequencies: tuple = (0.25, 0.25, 0.25, 0.25)

    @property
    def pi(self):
        total = sum(self.frequencies)
        return tuple(f / total for f in self.frequencies)

    @property
    def rate(self) -> float:
        a, c, g, t = self.pi
        return 1.0 / (2 * (a + g) * (c + t) + 2 * self.kappa * (a * g + c * t))

    def _shape(self, i: int, j: int):
        """P_ij = stationary + slow * e1 + fast * e2, with the exponent of e2."""
        pi = self.pi
        group = pi[i] + pi[(i + 2) % 4]  # purines A,G and pyrimidines C,T
        other = 1.0 - group
        fast_rate = self.rate * (1.0 + group * (self.kappa - 1.0))
        if (i - j) % 2:
            return pi[j], -pi[j], 0.0, fast_rate
        share = pi[j] / group
        return pi[j], share * other, (1.0 if i == j else 0.0) - share, fast_rate

    def probability(self, i, j, t):
        base, slow, fast, fast_rate = self._shape(i, j)
        raw = (
            F.lit(base)
            + F.lit(slow) * F.exp(F.lit(-self.rate) * t)
            + F.lit(fast) * F.exp(F.lit(-fast_rate) * t)
        )
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))

    def matrices(self, lengths):
        t = np.asarray(lengths, float)
        out = np.empty((len(t), 4, 4))
        for i in range(4):
            for j in range(4):
                base, slow, fast, fast_rate = self._shape(i, j)
                out[:, i, j] = (
                    base + slow * np.exp(-self.rate * t) + fast * np.exp(-fast_rate * t)
                )
        return np.clip(out, 0.0, 1.0)


@dataclass(frozen=True)
class GeneralReversible(SubstitutionModel):
    """Any reversible model: six exchange rates (AC, AG, AT, CG, CT, GT) and base frequencies, unit mean rate.

    The rate matrix, scaled by the square roots of the frequencies, is symmetric; its
    eigenvalues and eigenvectors turn every transition probability into a sum of
    four exponentials, on columns as on arrays.
    """

    rates: tuple
    frequencies: tuple = (0.25, 0.25, 0.25, 0.25)

    def __post_init__(self):
        if len(self.rates) != 6 or min(self.rates) < 0 or max(self.rates) <= 0:
            raise ValueError("six rates, none negative and one positive at least")
        if len(self.frequencies) != 4 or min(self.frequencies) <= 0:
            raise ValueError("four positive frequencies")

    @property
    def pi(self):
        total = sum(self.frequencies)
        return tuple(f / total for f in self.frequencies)

    @cached_property
    def _spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        """Exponents (4) and, for each upper and lower state, the factors of their exponentials (4, 4, 4)."""
        pi = np.array(self.pi)
        q = np.zeros((4, 4))
        q[np.triu_indices(4, 1)] = self.rates
        q = (q + q.T) * pi
        q -= np.diag(q.sum(1))
        q /= -(pi @ np.diag(q))
        root = np.sqrt(pi)
        exponents, vectors = np.linalg.eigh(root[:, None] * q / root)
        return exponents, np.einsum("ik,jk->ijk", vectors / root[:, None], vectors * root[:, None])

    def probability(self, i, j, t):
        exponents, factors = self._spectrum
        terms = [F.lit(float(c)) * F.exp(F.lit(float(e)) * t) for e, c in zip(exponents, factors[i, j])]
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms[0] + terms[1] + terms[2] + terms[3]))

    def matrices(self, lengths):
        exponents, factors = self._spectrum
        decay = np.exp(np.asarray(lengths, float)[:, None] * exponents)
        return np.clip(np.einsum("ijk,lk->lij", factors, decay), 0.0, 1.0)
