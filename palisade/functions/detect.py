"""Matching values against rules, as Catalyst expressions.

Every rule is one literal regular expression, evaluated only where the value holds what
every match of the rule must hold: one of each set of marks (characters that are no letter,
digit or blank), and one of its texts. A value's marks are cut out of it in one pass, and its
seldom letters in another: what stands together in the value does so in those short texts,
so that a text is looked for in the whole value only where its marks and seldom letters are
found. Rules that are a choice of whole words share one pass over the beginnings of words."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.binding import let
from palisade.model import ATTACK_TYPES, DETECTIONS
from palisade.rules import Rule, cased_texts, first_characters, is_mark, java_pattern, may_be_empty, needed_marks, needed_texts, whole_words

#: Branches of a trie that are tried one after the other; more are halved by their first characters.
FEW = 3
#: A pattern whose matches begin with one of no more characters is tried only at those.
BEGINNINGS = 40
#: Letters that are kept to look for a text's among them.
SELDOM = "bcfgjkmpquvwxyz"
#: What stands before and after no whole word, one by one, as Java tests ranges one after the other. Letters that lower()
#: makes of others (k of the Kelvin sign, i of the dotted I) may stand there, as those may be no part of a word.
BEFORE, AFTER = ("".join(c for c in "abcdefghijklmnopqrstuvwxyz0123456789_" if c not in not_these) for not_these in ("k", "ik"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _class(chars: str) -> str:
    return f"[{''.join(map(re.escape, chars))}]"


def _choice(branches: list[tuple[str, str]]) -> str:
    """A pattern of one of the branches, which begin with different characters: as Java tries the branches
    of a choice one after the other, many of them are found by halving."""
    if len(branches) <= FEW:
        return "|".join(pattern for _, pattern in branches)
    half = len(branches) // 2
    return "|".join(f"(?={_class(''.join(head for head, _ in part))})(?:{_choice(part)})" for part in (branches[:half], branches[half:]))


def _trie(texts: list[str]) -> str:
    """A pattern of the longest of texts at a place."""
    heads: dict[str, list[str]] = {}
    for text in texts:
        if text:
            heads.setdefault(text[0], []).append(text[1:])
    branches = [(head, re.escape(head) + _trie(rest)) for head, rest in sorted(heads.items())]
    if not branches:
        return ""
    whole = "" in texts
    return branches[0][1] if len(branches) == 1 and not whole else f"(?:{_choice(branches)}){'?' if whole else ''}"


@lru_cache(maxsize=64)
def _guards(rules: tuple[Rule, ...]) -> tuple[list[frozenset], list[list[int]], list[tuple[str, ...]], list[tuple[str, ...]]]:
    """The sets of marks; and of each rule the places of those that it needs, its whole words or else its texts."""
    marks = [needed_marks(rule.pattern) for rule in rules]
    words = [whole_words(rule.pattern) for rule in rules]
    texts = [() if some else needed_texts(rule.pattern) for rule, some in zip(rules, words)]
    sets = sorted(set().union(*marks), key=sorted)
    # What is a mark itself is in a set.
    texts = [() if some and marks[i] and min(map(len, some)) == 1 else some for i, some in enumerate(texts)]
    # What holds a text holds any part of it.
    texts = [tuple(t for t in some if not any(t != x and x in t for x in some)) for some in texts]
    return sets, [[sets.index(m) for m in sorted(needed, key=lambda m: (len(m), sorted(m)))] for needed in marks], words, texts


def _holds(text: str) -> str:
    """SQL of whether the lower-cased value holds a text."""
    marks, seldom = "".join(c for c in text if is_mark(c)), "".join(c for c in text if c in SELDOM)
    tests = [f"contains(b.marks, {_quoted(marks)})"] if marks else []
    if len(seldom) > 1:
        tests.append(f"contains(b.seldom, {_quoted(seldom)})")
    return " AND ".join([*tests, f"contains(b.low, {_quoted(text)})"])


def _tried(pattern: str) -> str:
    """The pattern for Java, which tries the branches of a choice one after the other at every place: one look at
    the character there says that none can match."""
    heads = first_characters(pattern)
    return f"(?=[{''.join(f'\\x{ord(c):02x}' for c in heads)}])(?:{java_pattern(pattern)})" if 0 < len(heads) <= BEGINNINGS else java_pattern(pattern)


def _first_match(pattern: str) -> str:
    """SQL of the first match in b.v, null if there is none."""
    java = _quoted(_tried(pattern))
    # regexp_substr knows no empty match.
    return f"CASE WHEN b.v RLIKE {java} THEN regexp_extract(b.v, {java}, 0) END" if may_be_empty(pattern) else f"regexp_substr(b.v, {java})"


def _applies(rule: Rule) -> str:
    kinds = ", ".join(_quoted(t) for t in rule.targets if ":" not in t) or "NULL"
    return f"b.place IN ({', '.join(map(_quoted, rule.targets))}) OR split_part(b.place, ':', 1) IN ({kinds})"


@lru_cache(maxsize=64)
def _detections(rules: tuple[Rule, ...]) -> str:
    """SQL lambda from struct(v, low, place, marks, seldom, held, words) to its detections: written as text, as a plan
    of hundreds of rules takes seconds to put together call by call."""

    _, marks, words, texts = _guards(rules)

    def hit(i: int, rule: Rule) -> str:
        matched = _first_match(rule.pattern)
        needed = [f"b.held[{k}]" for k in marks[i]]
        if words[i]:
            needed.append(f"arrays_overlap(b.words, array({', '.join(map(_quoted, words[i]))}))")
        elif exact := cased_texts(rule.pattern):
            needed.append(f"({' OR '.join(f'contains(b.v, {_quoted(t)})' for t in exact)})")
        elif texts[i]:
            needed.append(f"({' OR '.join(map(_holds, texts[i]))})")
        if needed:
            matched = f"CASE WHEN {' AND '.join(needed)} THEN {matched} END"
        if rule.targets:
            matched = f"CASE WHEN {_applies(rule)} THEN {matched} END"
        return f"named_struct('i', {i}, 'm', {matched})"

    def fact(rule: Rule) -> str:
        tags = f"array({', '.join(map(_quoted, rule.tags))})" if rule.tags else "cast(array() AS array<string>)"
        return f"named_struct('rule_id', {rule.id}, 'rule_name', {_quoted(rule.name)}, 'attack_type', {_quoted(ATTACK_TYPES[rule.attack])}, 'base_score', {rule.base}, 'tags', {tags})"

    hits = ", ".join(hit(i, r) for i, r in enumerate(rules))
    facts = ", ".join(map(fact, rules))
    put = "named_struct('rule_id', f.rule_id, 'rule_name', f.rule_name, 'attack_type', f.attack_type, 'matched_value', h.m, 'location', b.place, 'base_score', f.base_score, 'tags', f.tags)"
    return f"b -> transform(filter(array({hits}), x -> x.m IS NOT NULL), h -> transform(array(get(array({facts}), h.i)), f -> {put})[0])"


@lru_cache(maxsize=64)
def _held(rules: tuple[Rule, ...]) -> str:
    """SQL lambda from a value's marks to whether it holds one of each set of them."""
    sets, *_ = _guards(rules)
    return f"marks -> array({', '.join('(' + ' OR '.join(f'contains(marks, {_quoted(m)})' for m in sorted(one)) + ')' for one in sets)})"


def _all_but(kept: str) -> str:
    """A pattern of runs of other characters."""
    return f"[^{''.join(map(re.escape, sorted(set(kept))))}]+"


def _marks(rules: tuple[Rule, ...]) -> str:
    """The marks that rules look for."""
    sets, _, _, texts = _guards(rules)
    return "".join({c for one in sets for c in one} | {c for some in texts for t in some for c in t if is_mark(c)} | {"."})


def _words(low: Column, rules: tuple[Rule, ...]) -> Column:
    """The whole words that rules look for in a lower-cased value, and now and then a part of a word."""
    _, _, words, _ = _guards(rules)
    wanted = sorted(set().union(*words))
    if not wanted:
        return F.expr("cast(array() AS array<string>)")
    pattern = f"[^{BEFORE}](?=({_trie(wanted)})(?![{AFTER}]))"
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), low), F.lit(pattern), F.lit(1)))


def detect(value: Column, location: Column | str, rules: tuple[Rule, ...]) -> Column:
    """array<detection> of value: one for each rule that matches, in rule order; empty for null."""
    location = F.lit(location) if isinstance(location, str) else location
    none = F.expr(f"cast(array() as {DETECTIONS})")
    if not rules:
        return none
    # Each is worked out once: what an expression names twice Spark works out twice.
    of_value = lambda b: let(of_lower, v=b["v"], low=F.lower(b["v"]), marks=F.regexp_replace(b["v"], _all_but(_marks(rules)), ""))

    def of_lower(b: Column) -> Column:
        held = F.call_function("transform", F.array(b["marks"]), F.expr(_held(rules)))[0]
        seldom = F.regexp_replace(b["low"], _all_but(SELDOM), "")
        known = [b["v"].alias("v"), b["low"].alias("low"), location.alias("place"), b["marks"].alias("marks")]
        known += [seldom.alias("seldom"), held.alias("held"), _words(b["low"], rules).alias("words")]
        return F.call_function("transform", F.array(F.struct(*known)), F.expr(_detections(rules)))[0]

    return F.coalesce(let(of_value, v=value), none)
