"""Licence scans: Aho-Corasick over the words of a text, and a shunting-yard parser for licence expressions.

One automaton holds all phrases and the words of the identifier tag. It runs over the text's words joined by single
blanks, so that a phrase matches wherever its words follow each other. Behind each tag the expression is read
from the text itself: licence names joined by AND, OR and WITH, with brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICES = {
    "all rights reserved": "proprietary",
    "affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier:[ \t]*", re.IGNORECASE)
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "isc", "cc-by", "cc0", "bsl")
DUTIES = {"mit": 0, "apache": 0, "bsd": 0, "isc": 0, "bsl": 0, "cc0": 0, "cc-by": 0, "mpl": 1, "epl": 1, "lgpl": 1, "gpl": 2, "agpl": 2}
UNKNOWN_DUTY = 3
WEIGHT = {"base": 0.7, "notice": 0.5, "tag": 0.95}

NOT_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90))
TABLE = bytes(32 if c in NOT_WORD else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Expression:
    """A parsed expression: its canonical text, the licences in it, and the least duties it can be used under.

    Duties: 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 unknown. OR takes the lesser, AND the
    greater; WITH an exception lowers strong to weak.
    """

    text: str
    licences: frozenset[str]
    duty: int
    rank: int = 4


def family(name: str) -> str:
    """The label of a licence name: its family if known, else the name in lower case."""
    low = name.lower().rstrip("+")
    return next((f for f in FAMILIES if low == f or low.startswith(f + "-") or low.startswith(f + ".")), low)


def parse(text: str, at: int = 0) -> Expression | None:
    """The longest licence expression that starts at a place of ``text``; None if none does.

    Shunting-yard: operands go to one stack, operators to another until one that binds less tightly comes.
    What follows the expression is ignored, as are operators and brackets that are left open at its end.
    """
    out: list[Expression] = []
    ops: list[str] = []
    best = None

    def reduce() -> None:
        op, b, a = ops.pop(), out.pop(), out.pop()
        rank = PRECEDENCE[op]
        left, right = (f"({e.text})" if e.rank < rank else e.text for e in (a, b))
        duty = {"OR": min(a.duty, b.duty), "AND": max(a.duty, b.duty), "WITH": 1 if a.duty == 2 else a.duty}[op]
        names = a.licences if op == "WITH" else a.licences | b.licences
        out.append(Expression(f"{left} {op} {right}", names, duty, rank))

    def whole() -> Expression | None:
        """What has been read, if it stands alone."""
        if "(" in ops:
            return None
        kept, kept_ops = list(out), list(ops)
        while ops:
            reduce()
        found = out[0]
        out[:], ops[:] = kept, kept_ops
        return found

    operand = True
    while found := TOKEN.match(text, at):
        token = found[1]
        op = token.upper()
        if operand and token == "(":
            ops.append("(")
        elif operand and token != ")" and op not in PRECEDENCE:
            name = token.rstrip(".:")
            out.append(Expression(name, frozenset([family(name)]), DUTIES.get(family(name), UNKNOWN_DUTY)))
            operand = False
        elif not operand and token == ")" and "(" in ops:
            while ops[-1] != "(":
                reduce()
            ops.pop()
        elif not operand and op in PRECEDENCE:
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[op]:
                reduce()
            ops.append(op)
            operand = True
        else:
            break
        if not operand:
            best = whole() or best
            if token.endswith((".", ":")):
                break
        at = found.end()
    return best


class Scanner:
    """All phrases in one automaton; finds them and the expressions behind tags."""

    def __init__(self, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES) -> None:
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
        for kind, phrases in (("base", base), ("notice", notices)):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, what in kinds.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, what))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        raw = text or ""
        words = raw.encode("utf-8", "replace").translate(TABLE).split(b" ")
        words = [w for w in words if w]
        joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
        starts, base, labels, sure, tagged = [], set(), set(), {}, False
        at = blanks = 0  # blanks before a place in the text, counted on from match to match
        for end, (back, what) in self.automaton.iter(joined):
            for kind, label in what:
                if kind == "tag":
                    tagged = True
                    continue
                labels.add(label)
                sure[label] = max(sure.get(label, 0.0), WEIGHT[kind])
                if kind == "base":
                    base.add(label)
                    place = end - back
                    blanks += joined.count(" ", at, place) if place >= at else -joined.count(" ", place, at)
                    at = place
                    starts.append(blanks)
        found = [e for m in TAG_TEXT.finditer(raw) if (e := parse(raw, m.end()))] if tagged else []
        for e in found:
            labels |= e.licences
            sure |= {name: WEIGHT["tag"] for name in e.licences}
        doubt = 1.0
        for label in sorted(sure):
            doubt *= 1 - sure[label]
        return (
            len(words),
            len(starts),
            min(starts) if starts else None,
            max(starts) if starts else None,
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            1 - doubt,
            sorted({e.text for e in found}),
            max((e.duty for e in found), default=None),
        )


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<string>, duty int"
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What every whole text says of licences; NULL is an empty text. One row per row of ``docs``.

    n_words: words (letters, digits and all beyond ASCII, A-Z lowered); n_base: places of base phrases,
    first_word and last_word the smallest and largest word they start at; base_labels and labels: distinct,
    sorted, comma-joined; score: 1 less the product of the labels' doubts; expressions: canonical, sorted;
    duty: the greatest of the expressions.
    """

    @F.pandas_udf(FIELDS)
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner, names = Scanner(), [f.split()[0] for f in FIELDS.split(", ")]
        for batch in texts:
            out = pd.DataFrame([scanner(t) for t in batch], columns=names)
            for c in ("first_word", "last_word", "duty"):
                out[c] = out[c].astype("Int64")
            yield out

    found = docs.select(F.col(doc_id).alias("doc_id"), look(F.col(text).cast("string")).alias("found"))
    return found.select("doc_id", "found.*")
