"""A text that a rule's pattern matches, read off the pattern."""

from __future__ import annotations

import re

try:
    from re import _parser as regex_parser
except ImportError:  # before Python 3.11
    import sre_parse as regex_parser

#: What stands for a class of characters, in this order of preference.
_LIKELY = "a1x0 _-./<>()[]{}'\"=;:,&|$%@#!?*+^~`\\\n\t"


def _one_of(members) -> str:
    """A character of a class."""
    negated = bool(members) and str(members[0][0]) == "NEGATE"
    kinds = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " \t\n", "CATEGORY_WORD": "abcdefghijklmnopqrstuvwxyz0123456789_"}

    def within(c: str) -> bool:
        for kind, value in members:
            kind = str(kind)
            if kind == "LITERAL" and ord(c) == value or kind == "RANGE" and value[0] <= ord(c) <= value[1]:
                return True
            if kind == "CATEGORY":
                name, opposite = str(value).replace("_NOT", ""), "_NOT" in str(value)
                if (c in kinds.get(name, "")) != opposite:
                    return True
        return False

    own = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in members if str(k) in ("LITERAL", "RANGE") and v not in (0, (0, 8))]
    return next(c for c in [*([] if negated else own), *_LIKELY, *"bcdefghijklmnopqrstuvwyz23456789"] if within(c) != negated)


def _written(items) -> str:
    out = ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "NOT_LITERAL":
            out += next(c for c in _LIKELY if ord(c) != value)
        elif name == "ANY":
            out += " "
        elif name == "IN":
            out += _one_of(value)
        elif name == "SUBPATTERN":
            out += _written(value[-1])
        elif name == "BRANCH":
            out += _written(value[1][0])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            # Where nothing need stand, a space keeps words apart.
            apart = value[0] == 0 and value[1] > 0 and re.search("ANY|CATEGORY_SPACE", str(value[2]))
            out += " " if apart else _written(value[2]) * value[0]
    return out


def example(pattern: str) -> str:
    return _written(regex_parser.parse(re.sub(r"^\(\?-?i\)", "", pattern)))
