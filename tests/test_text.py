"""Normalisation and injection patterns."""

import random
import re
import re._parser as parser
import unicodedata

import pytest
from pyspark.sql import functions as F

from relaylens.functions import text
from relaylens.operators import injection


def sample(nodes, rng):
    """A random string that the parsed pattern matches (anchors and classes kept simple)."""
    out = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += rng.choice("x'")
        elif name == "IN":
            out += " "  # the only classes in the patterns are white space
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            for _ in range(rng.randint(low, min(high, low + 2))):
                out += sample(body, rng)
    return out


def samples():
    rng = random.Random(3)
    for name, pattern in text.INJECTION_PATTERNS:
        for _ in range(60):
            s = sample(parser.parse(pattern), rng)
            if re.search(pattern, s, re.I):
                yield name, "".join(rng.choice((c.lower(), c.upper())) if c.isascii() else c
                                    for c in s)


def test_a_pattern_never_matches_without_its_words():
    seen = set()
    for name, s in samples():
        seen.add(name)
        assert all(any(w in s.lower() for w in group) for group in text.PATTERN_WORDS[name]), (name, s)
    assert seen == set(text.PATTERN_WORDS)


def test_scan_matches_python(spark):
    compiled = [(n, re.compile(p, re.I)) for n, p in text.INJECTION_PATTERNS]
    look = dict(text.LOOKALIKES)

    def expected(s):
        plain = "".join(look.get(c, c) for c in unicodedata.normalize("NFKC", s))
        return next((n for n, p in compiled if p.search(plain)), None)

    rng = random.Random(8)
    cases = [s for _, s in samples()]
    cases += [s.replace("o", "о").replace("e", "е") for s in cases[::7]]       # Cyrillic
    cases += ["".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)
              for s in cases[::11]]                                            # full width
    cases += [s.replace("i", "ı").replace("s", "ſ") for s in cases[::13]]
    cases += [s.replace(" ", rng.choice([" ", "\n", "\x1c", "é "])) for s in cases[::5]]
    cases += ["x" + s for s in cases[::9]] + ["é" + s for s in cases[::9]]
    rows = spark.createDataFrame([(c,) for c in cases], "text STRING")
    got = injection.scan(rows, "text").collect()
    wrong = [(r.text, r.pattern, expected(r.text)) for r in got if r.pattern != expected(r.text)]
    assert wrong == []


def test_stable_characters_are_stable():
    members = [chr(c) for c in range(0x80, 0x10000)
               if not 0xD800 <= c < 0xE000 and re.match(f"[{text.NFKC_STABLE}]", chr(c))]
    assert len(members) > 30_000
    assert all(unicodedata.normalize("NFKC", c) == c for c in members)
    assert not any(unicodedata.combining(c) for c in members)
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(members) for _ in range(12))
        assert unicodedata.normalize("NFKC", s) == s


def test_normalise(spark):
    cases = ["plain", "Іgnore", "ｉｇｎｏｒｅ", "ﬁne", "ét", "αβεν", None]
    rows = spark.createDataFrame([(c,) for c in cases], "t STRING")
    look = dict(text.LOOKALIKES)
    got = [r[0] for r in rows.select(text.normalise(F.col("t"))).collect()]
    assert got == [None if c is None else "".join(
        look.get(x, x) for x in unicodedata.normalize("NFKC", c)) for c in cases]


def test_custom_patterns_are_numbered_over_the_valid_ones(spark):
    kept = text.custom_patterns(spark, "foo\n\n (bad\n it's \n")
    assert kept == [("custom_0", "foo"), ("custom_1", "it's")]
    rows = spark.createDataFrame([("FOO",), ("IT'S",), ("x",)], "t STRING")
    assert [r.pattern for r in injection.scan(rows, "t", kept).collect()] == [
        "custom_0", "custom_1", None]


def test_actions(spark):
    requests = spark.createDataFrame([(1,), (2,)], "request_id INT")
    found = spark.createDataFrame([(1, "p")], "request_id INT, pattern STRING")
    for action, outcome, flag in [("log_only", "passed", None), ("flag", "flagged", "p"),
                                  ("block", "blocked", None)]:
        rows = {r.request_id: r for r in injection.apply_action(requests, found, action).collect()}
        assert (rows[1].disposition, rows[1].injection_detected) == (outcome, flag)
        assert (rows[2].disposition, rows[2].injection_detected) == ("passed", None)
    with pytest.raises(ValueError):
        injection.apply_action(requests, found, "drop")
