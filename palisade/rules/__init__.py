"""The rule catalogue and its plan-time selection: a rule that is not wanted never
becomes part of an expression."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import DataFrame, SparkSession

from palisade.config import Config, Exclusion, Selector
from palisade.model import ATTACK_TYPES
from palisade.rules import command, deserialization, ldap, protocol, scanner, sqli, ssrf, ssti, traversal, xpath, xss

#: In load order, with the toggle that switches each family, if any.
FAMILIES = (
    (sqli, "sqli"),
    (xss, "xss"),
    (traversal, "path_traversal"),
    (command, "command_injection"),
    (protocol, "protocol"),
    (scanner, "protocol"),
    (ssti, None),
    (ldap, None),
    (xpath, None),
    (ssrf, None),
    (deserialization, None),
)


@dataclass(frozen=True)
class Rule:
    """A detection rule; also what a user writes to add one. No targets: every location."""

    id: int
    name: str
    attack: str
    severity: str = "Medium"
    confidence: str = "Medium"
    paranoia: int = 1
    base: int = 5
    tags: tuple[str, ...] = ()
    pattern: str = ""
    targets: tuple[str, ...] = ()

    def applies_to(self, location: str) -> bool:
        """Targets are path, query, body, cookie, header or header:Name (case counts)."""
        if not self.targets:
            return True
        kind = location.partition(":")[0]
        return location in self.targets or (kind in self.targets and kind in ("path", "query", "header", "cookie", "body", "response_body"))


def _row(row: tuple) -> Rule:
    *head, tags, pattern = row
    return Rule(*head, tuple(tags.split(",")) if tags else (), pattern)


CATALOGUE = tuple(_row(row) for module, _ in FAMILIES for row in module.RULES)


def matches(selector: Selector, rule: Rule) -> bool:
    """An id, "@tag", "first-last", "prefix*" or an id as text."""
    if isinstance(selector, int):
        return selector == rule.id
    if selector.startswith("@"):
        return selector[1:] in rule.tags
    first, dash, last = selector.partition("-")
    if dash and first.isdecimal() and last.isdecimal():
        return int(first) <= rule.id <= int(last)
    if selector.endswith("*"):
        return str(rule.id).startswith(selector[:-1])
    return selector == str(rule.id)


def load(config: Config, extra: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """The rules of a configuration, in evaluation order; extra ones come last."""
    wanted = [_row(row) for module, toggle in FAMILIES if toggle is None or getattr(config, toggle) for row in module.RULES]
    chosen = lambda rule: config.enabled is None or any(matches(s, rule) for s in config.enabled)
    barred = lambda rule: any(matches(s, rule) for s in config.disabled)
    return tuple(r for r in (*wanted, *extra) if r.paranoia <= config.paranoia and chosen(r) and not barred(r))


def by_id(rules, rule_id: int) -> Rule | None:
    return next((r for r in rules if r.id == rule_id), None)


def by_attack(rules, attack: str) -> list[Rule]:
    return [r for r in rules if r.attack == attack]


def by_tag(rules, tag: str) -> list[Rule]:
    return [r for r in rules if tag in r.tags]


def excluded_ids(rules, exclusion: Exclusion) -> list[int]:
    return [r.id for r in rules if any(matches(s, r) for s in exclusion.rules)]


def as_table(spark: SparkSession, rules=CATALOGUE) -> DataFrame:
    rows = [(i, r.id, r.name, ATTACK_TYPES[r.attack], r.severity, r.confidence, r.paranoia, r.base, list(r.tags)) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "ordinal int, rule_id int, rule_name string, attack_type string, severity string, confidence string, paranoia int, base_score int, tags array<string>"
    )


def _outside_classes(pattern: str, find: str, put: str) -> str:
    """pattern with an unescaped character outside of classes replaced."""
    out, escaped, inside = [], False, False
    for c in pattern:
        if not escaped:
            inside = c == "[" or inside and c != "]"
        out.append(put if c == find and not escaped and not inside else c)
        escaped = c == "\\" and not escaped
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """For Java: the dot excludes only line feeds, and the dollar is the end of the text."""
    return "(?d)" + _outside_classes(pattern, "$", r"\z")


def re2_pattern(pattern: str) -> str:
    """For DuckDB's engine."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\u([0-9A-Fa-f]{4})", r"\1\\x{\2}", pattern)


def _literals(items) -> frozenset | None:
    """Texts of which every match holds one, the longest choice; None if nothing is sure."""
    best, run = None, ""

    def better(new: frozenset | None) -> None:
        nonlocal best
        if new and (best is None or min(map(len, new)) > min(map(len, best))):
            best = new

    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL" and (value < 128 or chr(value).lower() == chr(value).upper()):
            run += chr(value).lower()
            continue
        if run:
            better(frozenset([run]))
            run = ""
        if name == "SUBPATTERN":
            better(_literals(value[-1]))
        elif name == "IN" and len(value) <= 8 and all(str(kind) == "LITERAL" and c < 128 for kind, c in value):
            better(frozenset(chr(c).lower() for _, c in value))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            better(_literals(value[2]))
        elif name == "BRANCH":
            parts = [_literals(branch) for branch in value[1]]
            if all(parts):
                better(frozenset().union(*parts))
    return best


def needed_texts(pattern: str) -> tuple[str, ...]:
    """Lower-case texts, or single marks, of which a lower-cased value must hold one for the pattern to match; () if unknown."""
    try:
        found = _literals(regex_parser.parse(re.sub(r"^\(\?-?i\)", "", pattern), re.I))
    except (re.error, ValueError, OverflowError):
        return ()
    sure = found and len(found) <= 40 and all(len(t) > 1 or t > " " and not t.isalnum() for t in found)
    return tuple(sorted(found)) if sure else ()


def is_mark(c: str) -> bool:
    """Whether c is an ASCII character but no letter, digit or blank."""
    return c < "\x80" and c != " " and not c.isalnum()


def _marks(items) -> set[frozenset]:
    """Sets of marks, of each of which every match holds one."""
    found = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL" and is_mark(chr(value)):
            found.add(frozenset(chr(value)))
        elif name == "SUBPATTERN":
            found |= _marks(value[-1])
        elif name == "IN" and all(str(kind) in ("LITERAL", "RANGE") for kind, _ in value):
            chars = [c for kind, x in value for c in ((x,) if str(kind) == "LITERAL" else range(x[0], x[1] + 1))]
            if len(chars) <= 40 and all(is_mark(chr(c)) for c in chars):
                found.add(frozenset(map(chr, chars)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            found |= _marks(value[2])
        elif name == "BRANCH":
            parts = [_marks(branch) for branch in value[1]]
            if all(parts):
                found.add(frozenset().union(*(min(part, key=lambda one: (len(one), sorted(one))) for part in parts)))
    return found


def needed_marks(pattern: str) -> frozenset:
    """Sets of characters that are no letter, digit or blank; a value must hold one of each set for the pattern to match."""
    try:
        return frozenset(_marks(regex_parser.parse(re.sub(r"^\(\?-?i\)", "", pattern), re.I)))
    except (re.error, ValueError, OverflowError):
        return frozenset()


def whole_words(pattern: str) -> tuple[str, ...]:
    r"""The lower-case words of a pattern like \b(this|that)\b; () of any other."""
    found = re.fullmatch(r"\(\?i\)\\b\(([A-Za-z0-9_|]+)\)\\b", pattern)
    words = found[1].lower().split("|") if found else ()
    return tuple(sorted(set(words))) if all(words) else ()


def cased_texts(pattern: str) -> tuple[str, ...]:
    """The texts of a pattern that is a choice of them in upper and lower case, exactly as written; () of any other."""
    found = re.fullmatch(r"(?:\(\?-i\))?\(([A-Za-z|]+)\)", pattern)
    texts = found[1].split("|") if found else ()
    return tuple(texts) if all(texts) and any(t != t.lower() for t in texts) else ()


#: The ASCII characters of a class, as Java and Python have it.
_CLASSES = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " \t\n\v\f\r", "CATEGORY_WORD": "abcdefghijklmnopqrstuvwxyz0123456789_"}

#: What Java takes for more than Python does: Unicode case, vertical white space, other borders.
_WIDER = re.compile(r"\(\?[a-zA-Z-]*u|\\v|\\b\{")


def _firsts(items) -> tuple[set[str] | None, bool]:
    """Lower-case characters that a match can begin with, None if they are not sure; and whether it can be empty."""
    found: set[str] = set()
    for op, value in items:
        name, maybe_none = str(op), False
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            here = {chr(value)}
        elif name == "IN" and all(str(kind) in ("LITERAL", "RANGE") or str(kind) == "CATEGORY" and str(x) in _CLASSES for kind, x in value):
            of = {"LITERAL": lambda x: chr(x), "RANGE": lambda x: map(chr, range(x[0], x[1] + 1)), "CATEGORY": lambda x: _CLASSES[str(x)]}
            here = {c for kind, x in value for c in of[str(kind)](x)}
        elif name == "SUBPATTERN":
            here, maybe_none = _firsts(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            here, maybe_none = _firsts(value[2])
            maybe_none |= value[0] == 0
        elif name == "BRANCH":
            parts = [_firsts(branch) for branch in value[1]]
            here, maybe_none = None if any(part is None for part, _ in parts) else set().union(*(part for part, _ in parts)), any(none for _, none in parts)
        else:
            return None, True
        if here is None or any(c > "\x7f" for c in here):
            return None, True
        found |= {c.lower() for c in here}
        if not maybe_none:
            return found, False
    return found, True


def first_characters(pattern: str) -> str:
    """The ASCII characters, letters in both cases, one of which every match begins with; none if they are not sure."""
    if _WIDER.search(pattern):
        return ""
    try:
        found, maybe_none = _firsts(regex_parser.parse(re.sub(r"^\(\?-?i\)", "", pattern), re.I))
    except (re.error, ValueError, OverflowError):
        return ""
    return "" if maybe_none or found is None else "".join(sorted({c for x in found for c in (x, x.upper())}))


def may_be_empty(pattern: str) -> bool:
    """Whether a match can be the empty text, as far as can be told."""
    try:
        return regex_parser.parse(re.sub(r"^\(\?-?i\)", "", pattern)).getwidth()[0] == 0
    except (re.error, ValueError, OverflowError):
        return False
