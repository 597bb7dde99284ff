"""Literals a pattern cannot match without, as a gate in front of it.

Searching a text for a few words is far cheaper than running a pattern over
it, and most texts hold no match of most patterns.  ``required`` reads from a
pattern the words every match contains; ``Gate`` looks each distinct word up
once per text, in one lower-case copy of it, and lets a pattern run only where
its words occur.  A gate never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as _sre
except ImportError:  # Python < 3.11
    import sre_parse as _sre

# Characters beyond ASCII that match ASCII letters without regard to case (long
# s, Kelvin sign, dotless i, dotted capital I): a text with one passes every gate.
FOLDED = "\u017f\u212a\u0131\u0130"
WORDS = 3        # longest words taken from a pattern
SHORTEST = 4     # characters; shorter words tell little


def _clauses(items) -> list[tuple[str, ...]]:
    """One tuple per word (or choice of words) that a match of the parsed sequence holds."""
    out: list[tuple[str, ...]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            out.append((run,))
        run = ""

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).lower()
            continue
        if name == "SUBPATTERN":
            inner = _clauses(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = _clauses(value[2]) if value[0] >= 1 else []
        elif name == "BRANCH":
            inner = []
            choices = [[c for c in _clauses(branch) if len(c) == 1] for branch in value[1]]
            if all(choices):  # the longest word of each branch
                inner = [tuple(sorted({max(c, key=lambda w: len(w[0]))[0] for c in choices}))]
        else:  # classes, any character, borders, assertions
            inner = []
        close()
        out += inner
    close()
    return out


def required(pattern: str) -> list[tuple[str, ...]]:
    """Words of which every match of ``pattern`` (read without regard to case)
    holds one of each tuple: the ``WORDS`` most telling tuples."""
    found = {c for c in _clauses(_sre.parse(pattern)) if min(map(len, c)) >= SHORTEST}
    return sorted(found, key=lambda c: (-min(map(len, c)), len(c), c))[:WORDS]


class Gate:
    """The words of some patterns, looked up once per text."""

    COLUMN = "_words"

    def __init__(self, *patterns: str):
        self.clauses = {p: required(p) for p in patterns}
        self.words = sorted({w for clauses in self.clauses.values() for c in clauses for w in c})

    def add(self, df, text: str):
        """``df`` with a list that says of each word whether it occurs."""
        special = F.lit(False)
        for c in FOLDED:
            special = special | F.col(text).contains(c)
        low = df.select("*", F.lower(text).alias("_low"), special.alias("_special"))
        words = F.array(*[F.lit(w) for w in self.words]).cast("array<string>")
        found = F.transform(words, lambda w: F.col("_special") | F.col("_low").contains(w))
        # Named twice, the lower-case copy stays a projection of its own; named in the list alone, it would be made again for every word.
        some = F.col("_low").isNotNull() & F.col("_special").isNotNull()
        return low.select(*df.columns, F.when(some, found).alias(self.COLUMN))

    def open(self, pattern: str) -> Column:
        """Whether the words that ``pattern`` needs occur (null for no text)."""
        out = F.lit(True)
        for clause in self.clauses[pattern]:
            some = None
            for w in clause:
                here = F.get(F.col(self.COLUMN), self.words.index(w))
                some = here if some is None else some | here
            out = out & some
        return out


def holds(pattern: str, text: str) -> bool:
    """The same for one text in Python."""
    low = text.lower()
    return any(c in text for c in FOLDED) or all(any(w in low for w in clause) for clause in required(pattern))
