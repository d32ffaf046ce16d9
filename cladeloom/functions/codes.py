"""Nucleotide states: letters, codes, and one-character pattern symbols.

A site pattern is kept as a STRING with one symbol per taxon. The symbol is the
state code as a base-16 digit, so byte order of strings equals code order and
grouping, sorting and slicing stay inside Spark's native string operators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 15 states, their printed letter and the bases each allows.
LETTERS = "ACGTRYSWKMDVHB?"
STATE_SETS = [
    "A", "C", "G", "T", "AG", "CT", "CG", "AT", "GT", "AC",
    "AGT", "ACG", "ACT", "CGT", "ACGT",
]
ALIASES = {"U": "T", "N": "?", "X": "?", "-": "?"}
MISSING = 14

SYMBOLS = "0123456789abcde"
MISSING_SYMBOL = SYMBOLS[MISSING]

_INPUT = LETTERS + "".join(ALIASES)
_INPUT_SYMBOLS = SYMBOLS + "".join(SYMBOLS[LETTERS.index(v)] for v in ALIASES.values())


def symbols_from_letters(seq: Column) -> Column:
    """Letters of a sequence (any case) to pattern symbols; any other letter fails."""
    upper = F.upper(seq)
    bad = F.regexp_extract(upper, f"[^{_INPUT.replace('-', '')}-]", 0)
    return F.when(
        bad != "", F.raise_error(F.concat(F.lit("not a nucleotide code: "), bad))
    ).otherwise(F.translate(upper, _INPUT, _INPUT_SYMBOLS))


def letters_from_symbols(symbols: Column) -> Column:
    return F.translate(symbols, SYMBOLS, LETTERS)


def symbol_of_code(code: Column) -> Column:
    """Code 0-14, or NULL for an absent cell, to its pattern symbol."""
    return F.substring(F.lit(SYMBOLS), F.coalesce(code, F.lit(MISSING)).cast("int") + 1, 1)


def code_of_symbol(symbol: Column) -> Column:
    return (F.instr(F.lit(SYMBOLS), symbol) - 1).cast("int")


def allows(symbol: Column, base: str) -> Column:
    """1.0 where the state may be ``base``, else 0.0."""
    members = [SYMBOLS[k] for k, s in enumerate(STATE_SETS) if base in s]
    return F.when(symbol.isin(members), 1.0).otherwise(0.0)


def state_vector(symbol: Column) -> Column:
    """Possible bases as four 0/1 values in the order A, C, G, T."""
    return F.array(*[allows(symbol, b) for b in "ACGT"])


def state_matrix() -> np.ndarray:
    """(15, 4) table of the same 0/1 values for Arrow batches."""
    return np.array([[float(b in s) for b in "ACGT"] for s in STATE_SETS])


def codes_of_strings(patterns) -> np.ndarray:
    """Equal-length pattern strings of one batch as a (rows, taxa) code array."""
    joined = "".join(patterns).encode()
    lookup = np.full(256, 255, dtype=np.uint8)
    lookup[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
    return lookup[np.frombuffer(joined, np.uint8)].reshape(len(patterns), -1)
