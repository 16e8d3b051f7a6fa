"""Message texts: extraction, length, normalisation and injection patterns."""

from __future__ import annotations

import logging
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from relaylens.functions.regex import java, literal

logger = logging.getLogger(__name__)

# Pattern names and patterns, in order of precedence.
INJECTION_PATTERNS = [
    ("override_ignore",
     r"\b(?:ignore|disregard|forget|bypass|override)\s+(?:all\s+)?(?:previous|prior|above|earlier|your|the\s+previous)\s+instructions?\b"),
    ("new_instructions",
     r"\bnew\s+instructions?\s*:"),
    ("override_instructions",
     r"\boverride\s+(?:your\s+)?(?:instructions?|restrictions?|guidelines?|programming|training)\b"),
    ("extract_system_prompt",
     r"\b(?:reveal|repeat|show|print|output|display|tell\s+me|what\s+(?:are|were|is))\s+(?:your\s+)?(?:system\s+prompt|original\s+instructions?|initial\s+instructions?|hidden\s+instructions?|true\s+instructions?)\b"),
    ("leak_instructions",
     r"\b(?:what\s+(?:are|were)\s+your\s+instructions?|repeat\s+(?:your|the)\s+(?:system\s+)?instructions?)\b"),
    ("remove_restrictions",
     r"\bwithout\s+(?:any\s+)?(?:restrictions?|limitations?|ethical\s+(?:guidelines?|constraints?)|safety\s+guidelines?|filters?)\b"),
    ("ignore_safety",
     r"\b(?:ignore|bypass|disable|remove|turn\s+off)\s+(?:your\s+)?(?:ethical\s+)?(?:guidelines?|restrictions?|limitations?|safety|filters?|training|values?)\b"),
    ("no_restrictions_persona",
     r"\b(?:you\s+(?:have|had)\s+no\s+restrictions?|you\s+(?:are|were)\s+(?:not|no\s+longer)\s+(?:bound|limited|restricted|constrained))\b"),
    ("you_are_now",
     r"\byou\s+are\s+now\s+(?:a\s+)?(?:DAN|STAN|DUDE|AIM|GPT-?4|an?\s+unrestricted|an?\s+unfiltered|an?\s+uncensored)\b"),
    ("developer_mode",
     r"\bdeveloper\s+mode\s*(?:enabled|on|activated|is\s+now\s+active)?\b"),
    ("dan_mode",
     r"\bDAN\s+mode\b"),
    ("jailbreak_explicit",
     r"\bjailbreak\b"),
    ("do_anything_now",
     r"\bdo\s+anything\s+now\b"),
    ("true_self",
     r"\byour\s+true\s+(?:purpose|self|nature|instructions?|capabilities?|identity)\b"),
    ("hidden_mode",
     r"\b(?:secret|hidden|real|true|actual)\s+(?:mode|instructions?|programming|training|guidelines?)\b"),
    ("pretend_no_restrictions",
     r"\bpretend\s+(?:you\s+(?:have\s+no|don.t\s+have|are\s+without)\s+(?:restrictions?|guidelines?|ethical|limitations?)|to\s+be\s+an?\s+(?:AI|model|assistant)\s+(?:with\s+no|without)\s+restrictions?)\b"),
    ("act_as_unrestricted",
     r"\bact\s+as\s+(?:if\s+you\s+(?:have\s+no|don.t\s+have|are\s+not\s+bound)|an?\s+(?:AI|assistant|model)\s+(?:with\s+no|without)\s+(?:restrictions?|ethical|guidelines?))\b"),
    ("control_tokens",
     r"<\|(?:im_start|im_end|system|endoftext|pad|unk|begin_of_text|end_of_text)\|>"),
    ("encoding_bypass",
     r"\b(?:base64|rot13|hex|morse|binary)\b.{0,80}\b(?:decode|encoded|encoded\s+as|cipher)\b"),
]

# Words without which a pattern cannot match: of every group at least one must occur. A plain
# search for them rules out most texts before any regular expression runs.
PATTERN_WORDS = {
    "override_ignore": [["instruction"]],
    "new_instructions": [["instruction"]],
    "override_instructions": [["override"]],
    "extract_system_prompt": [["prompt", "instruction"]],
    "leak_instructions": [["instruction"]],
    "remove_restrictions": [["without"]],
    "ignore_safety": [["ignore", "bypass", "disable", "remove", "turn"]],
    "no_restrictions_persona": [["you"], ["restrict", "bound", "limited", "constrained"]],
    "you_are_now": [["you"], ["now"]],
    "developer_mode": [["developer"]],
    "dan_mode": [["dan"], ["mode"]],
    "jailbreak_explicit": [["jailbreak"]],
    "do_anything_now": [["anything"]],
    "true_self": [["your"], ["true"]],
    "hidden_mode": [["secret", "hidden", "real", "true", "actual"],
                    ["mode", "instruction", "programming", "training", "guideline"]],
    "pretend_no_restrictions": [["pretend"]],
    "act_as_unrestricted": [["act"], ["have", "bound", "with"]],
    "control_tokens": [["<|"]],
    "encoding_bypass": [["base64", "rot13", "hex", "morse", "binary"],
                        ["decode", "encoded", "cipher"]],
}

# Letters that a case-blind match takes for an ASCII letter although lowering keeps them apart.
CASE_ODDITIES = ("\u0130\u0131\u017f\u212a", "iisk")

# Cyrillic and Greek letters and the Latin letters they look like.
LOOKALIKES = [
    ("А", "A"), ("а", "a"), ("В", "B"), ("С", "C"), ("с", "c"),
    ("Е", "E"), ("е", "e"), ("І", "I"), ("і", "i"), ("О", "O"),
    ("о", "o"), ("Р", "P"), ("р", "p"), ("Ѕ", "S"), ("ѕ", "s"),
    ("Т", "T"), ("Х", "X"), ("х", "x"), ("У", "Y"), ("у", "y"),
    ("ο", "o"), ("α", "a"), ("ε", "e"), ("ν", "v"),
]

# Beside ASCII, letters and marks that NFKC never changes, alone or next to each other: Latin-1
# and Latin Extended-A, Greek, Cyrillic, kana, CJK ideographs, Hangul, quotes and dashes.
NFKC_STABLE = (
    r"¡-§©«-®°±¶·»¿-ı"
    r"Ĵ-ľŁ-ňŊ-žΑ-ΡΣ-ώЀ-҂"
    r"Ҋ-ԯ–—‘-„•、。ぁ-ゖァ-ヺ"
    r"一-鿿가-힣")


def extract_texts(content: Column, parts: Column) -> Column:
    """The texts of a message: its string content, or its parts of type ``text``."""
    listed = F.transform(F.filter(parts, lambda p: p["type"] == "text"),
                         lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(content.isNotNull(), F.array(content)).otherwise(
        F.coalesce(listed, F.array().cast("ARRAY<STRING>")))


def text_length(content: Column, parts: Column) -> Column:
    """Code points over a message's texts."""
    return F.aggregate(extract_texts(content, parts), F.lit(0).cast("bigint"),
                       lambda total, text: total + F.length(text))


def role_list(roles: str) -> list[str]:
    return [role.strip() for role in roles.split(",")]


def keep_roles(messages: Column, roles: str) -> Column:
    """An array of messages without those of other roles."""
    return F.filter(messages, lambda m: m["role"].isin(*role_list(roles)))


def snippet(text: Column, n: int = 120) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalise(text: Column) -> Column:
    """NFKC, then look-alike letters to Latin.

    Spark has no NFKC, so this one step runs in Python over Arrow batches. Rows made of
    characters that NFKC leaves alone send a null instead of their text.
    """
    # most characters are ASCII and leave the class at its first, cheap half
    unstable = F.when(text.rlike(f"[[^\\x00-\\x7f]&&[^{NFKC_STABLE}]]"), text)
    letters = F.coalesce(_nfkc(unstable), text)
    return F.translate(letters, "".join(a for a, _ in LOOKALIKES),
                       "".join(b for _, b in LOOKALIKES))


def folded(text: Column) -> Column:
    """Lower case, such that a case-blind match of ASCII words becomes a plain search."""
    return F.lower(F.translate(text, *CASE_ODDITIES))


def first_match(text: str, lowered: str, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern found in an already normalised text; null when clean.

    ``text`` and ``lowered`` (its ``folded`` form) are column names, so both are computed once.
    """
    arms = []
    for name, pattern in patterns:
        tests = [" OR ".join(f"contains({lowered}, {literal(word)})" for word in words)
                 for words in PATTERN_WORDS.get(name, [])]
        tests.append(f"{text} RLIKE {literal(java(pattern, ignore_case=True))}")
        arms.append(f"WHEN {' AND '.join(f'({t})' for t in tests)} THEN {literal(name)}")
    return F.expr(f"CASE {' '.join(arms)} END" if arms else "CAST(NULL AS STRING)")


def custom_patterns(spark: SparkSession, raw: str) -> list[tuple[str, str]]:
    """One pattern per line; blank and malformed lines are skipped and do not count."""
    java_pattern = spark._jvm.java.util.regex.Pattern
    kept: list[str] = []
    for line in filter(None, map(str.strip, raw.splitlines())):
        try:
            re.compile(line)
            java_pattern.compile(java(line, ignore_case=True))
            kept.append(line)
        except Exception as error:
            logger.warning("skipped pattern %r: %s", line, str(error)[:200])
    return [(f"custom_{i}", line) for i, line in enumerate(kept)]
