"""Plain Python twins of the ordered operators, for small inputs."""

from __future__ import annotations

import re
from itertools import groupby

ROW = re.compile(r"[0-9*+-]*")


def spans(rows):
    """``rows`` of (label, position) in slice order: maximal runs of label 0.

    A run reaches from the position before it (0 at the start) to the one
    after it (its own last one at the end).
    """
    rows = list(rows)
    at = [0, *(pos for _, pos in rows), *(pos for _, pos in rows[-1:])]
    runs = [[i for i, _ in run] for zero, run in groupby(enumerate(rows), lambda r: r[1][0] == 0) if zero]
    return [(at[run[0]], at[run[-1] + 2]) for run in runs]


def windows(n, size, step, include_last=False):
    """Starts of windows that end before the last row, or with it."""
    return range(0, n - size + (1 if include_last else 0), step)


def expand(spec):
    """Indexes and flag of a label row; None when it is malformed."""
    numbers = [int(n) for n in re.findall("[0-9]+", spec)]
    signs = re.sub("[0-9]", "", spec)
    core = signs.rstrip("*")
    if not ROW.fullmatch(spec) or not numbers or "*" in core:
        return None
    first, last = numbers[0], numbers[-1]
    if core == "":
        found = numbers
    elif core == "-" and len(numbers) == 2:
        found = list(range(first, last + 1)) or numbers
    elif set(core) == {"+"} and len(numbers) == 1:
        found = list(range(first, first + len(core) + 1))
    elif core == "+" and len(numbers) == 2:
        found = list(range(first, first + last + 1))
    else:
        return None
    return found, "*" in signs
