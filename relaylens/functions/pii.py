"""Finding personal data, replacing it by tokens, and the hold-back rule for streams.

All functions are Catalyst expressions, the long ones written as SQL because that builds them
in one step. They refer to the text several times and inside lambdas, so ``text`` is the name
of a column (or a field of a lambda variable), not an expression that costs anything.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relaylens.functions.regex import java, literal

# Entity types and patterns, most specific first.
PII_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?(\d{3})\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("IP_ADDR", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
]

# The token format, and what may still grow into a token.
TOKEN_MARK = "[PII_"
TOKEN_PATTERN = r"\[PII_([A-Z_]+)_([0-9a-f]{8})\]"
PARTIAL_PATTERN = (
    r"^\[(?:P(?:I(?:I(?:_(?:[A-Z_]*(?:_[0-9a-f]{0,8}\]?)?)?)?)?)?)?$")

# Necessary conditions that are cheap to test: every match contains one of these.
_HINTS = {
    "SSN": r"\d-\d{2}-\d{4}",
    "EMAIL": r"[A-Za-z0-9._%+\-]@[A-Za-z0-9.\-]",
    "PHONE": r"\d{3}[-.\s]?\d{4}",
    "IP_ADDR": r"\d\.\d{1,3}\.\d{1,3}\.\d",
}

NO_SPANS = ("CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, stop: INT, value: STRING, "
            "entity_type: STRING>>)")


def token(entity_type: Column, value: Column, digits: int = 8, key: str = "") -> Column:
    """``[PII_<type>_<hash>]``. More digits lower the risk of collisions, and a key makes the
    hash useless for guessing the value; both are off by default."""
    keyed = F.concat(F.lit(key), value) if key else value
    return F.concat(F.lit(TOKEN_MARK), entity_type, F.lit("_"),
                    F.substring(F.sha2(keyed, 256), 1, digits), F.lit("]"))


def _may_contain(text: str) -> str:
    return f"{text} RLIKE {literal(java('|'.join(_HINTS.values())))}"


def may_contain(text: str) -> Column:
    """False only for texts without any personal data; one scan, meant as a guard."""
    return F.expr(_may_contain(text))


def _matches(text: str, rank: int, entity_type: str, pattern: str) -> str:
    """All matches of one pattern with code point offsets.

    The matches and the gaps between them alternate, so running lengths give the offsets.
    """
    regex = literal(java(pattern))
    begin = "acc.at + length(pair.gap)"
    stop = f"{begin} + length(pair.value)"
    span = (f"named_struct('start', {begin}, 'rank', {rank}, 'stop', {stop}, "
            f"'value', pair.value, 'entity_type', '{entity_type}')")
    return f"""CASE WHEN {text} RLIKE {literal(java(_HINTS[entity_type]))} THEN aggregate(
        zip_with(regexp_extract_all({text}, {regex}, 0), split({text}, {regex}, -1),
                 (value, gap) -> named_struct('value', value, 'gap', gap)),
        named_struct('at', 0, 'spans', {NO_SPANS}),
        (acc, pair) -> CASE WHEN pair.value IS NULL THEN acc ELSE named_struct(
            'at', {stop}, 'spans', concat(acc.spans, array({span}))) END,
        acc -> acc.spans) ELSE {NO_SPANS} END"""


def _spans(text: str) -> str:
    every = ", ".join(_matches(text, rank, kind, p) for rank, (kind, p) in enumerate(PII_PATTERNS))
    return f"""aggregate(array_sort(concat({every})),
        named_struct('stop', -1, 'kept', {NO_SPANS}),
        (acc, s) -> CASE WHEN s.start >= acc.stop
            THEN named_struct('stop', s.stop, 'kept', concat(acc.kept, array(s))) ELSE acc END,
        acc -> acc.kept)"""


def spans(text: str, guarded: bool = True) -> Column:
    """Non-overlapping matches in text order.

    Every pattern is matched on its own; of overlapping matches the earlier start wins, and of
    equal starts the earlier pattern. Callers that have tested ``may_contain`` pass
    ``guarded=False``.
    """
    found = _spans(text)
    return F.expr(f"CASE WHEN {_may_contain(text)} THEN {found} ELSE {NO_SPANS} END"
                  if guarded else found)


def _mask_at(text: str, found: str, digits: int = 8, key: str = "") -> str:
    keyed = f"concat({literal(key)}, s.value)" if key else "s.value"
    return f"""aggregate({found}, named_struct('at', 0, 'out', ''),
        (acc, s) -> named_struct('at', s.stop, 'out', concat(
            acc.out, substring({text}, acc.at + 1, s.start - acc.at), '{TOKEN_MARK}',
            s.entity_type, '_', substring(sha2({keyed}, 256), 1, {digits}), ']')),
        acc -> concat(acc.out, substring({text}, acc.at + 1)))"""


def _mask(text: str, digits: int = 8, key: str = "") -> str:
    replaced = _mask_at(text, _spans(text), digits, key)
    return f"CASE WHEN {_may_contain(text)} THEN {replaced} ELSE {text} END"


def mask_at(text: str, found: str) -> Column:
    """The text with its ``spans``, a column computed before, replaced by their tokens."""
    return F.expr(f"CASE WHEN size({found}) > 0 THEN {_mask_at(text, found)} ELSE {text} END")


def part_spans(parts: str) -> Column:
    """The spans of every text part; none for other parts and missing texts."""
    inner = f"CASE WHEN {_may_contain('p.text')} THEN {_spans('p.text')} ELSE {NO_SPANS} END"
    return F.expr(f"""transform({parts}, p -> CASE WHEN p.type = 'text' AND p.text IS NOT NULL
        THEN {inner} ELSE {NO_SPANS} END)""")


def mask_parts_at(parts: str, found: str) -> Column:
    """Parts with their ``part_spans`` replaced by tokens."""
    return F.expr(f"""transform({parts}, (p, i) -> CASE WHEN size({found}[i]) > 0
        THEN named_struct('type', p.type, 'text', {_mask_at('p.text', f'{found}[i]')}) ELSE p END)""")


def mask(text: str, digits: int = 8, key: str = "") -> Column:
    """The text with every match replaced by its token; clean texts cost one scan."""
    return F.expr(_mask(text, digits, key))


def mask_parts(parts: str) -> Column:
    """Text parts masked; other parts and missing texts untouched."""
    return F.expr(f"""transform({parts}, p -> named_struct('type', p.type, 'text',
        CASE WHEN p.type = 'text' THEN {_mask('p.text')} ELSE p.text END))""")


def tokens_in(text: Column, digits: int = 8) -> Column:
    pattern = TOKEN_PATTERN.replace("{8}", f"{{{digits}}}")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def held_tail(text: Column, digits: int = 8) -> Column:
    """The end of a text that may still become a token: from its last ``[``, or empty."""
    whole = TOKEN_PATTERN.replace("{8}", f"{{{digits}}}")
    partial = PARTIAL_PATTERN.replace("{0,8}", f"{{0,{digits}}}")
    tail = F.regexp_extract(text, r"\[[^\[]*\z", 0)
    grows = tail.rlike(java(partial)) & ~tail.rlike(whole)
    return F.when(grows, tail).otherwise(F.lit(""))


def safe_head(text: Column, digits: int = 8) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(held_tail(text, digits)))


