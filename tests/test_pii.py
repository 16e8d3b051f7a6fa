"""Masking and restoring against Python's ``re``, the token store, and collisions."""

import hashlib
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from relaylens.functions import pii
from relaylens.operators import pii as ops
from relaylens.sources import schemas

PATTERNS = [(kind, re.compile(p)) for kind, p in pii.PII_PATTERNS]
AS_OF = "2024-01-31 00:00:00"


def expected_spans(text):
    every = sorted(((m.start(), rank, m.end(), m.group(), kind)
                    for rank, (kind, p) in enumerate(PATTERNS) for m in p.finditer(text)),
                   key=lambda m: (m[0], m[1]))
    kept = []
    for start, _, stop, value, kind in every:
        if not kept or start >= kept[-1][1]:
            kept.append((start, stop, value, kind))
    return kept


def expected_mask(text):
    out, at = "", 0
    for start, stop, value, kind in expected_spans(text):
        digest = hashlib.sha256(value.encode()).hexdigest()[:8]
        out, at = f"{out}{text[at:start]}[PII_{kind}_{digest}]", stop
    return out + text[at:]


def texts():
    rng = random.Random(5)
    pieces = ["555-867-5309", "123-45-6789", "a.b@x.com", "10.0.0.1", "256.1.1.1", "1.2.3.4.5",
              "(555) 867-5309", "+1-555-867-5309", "5551234567", "4567.a@x.com", " ", ".", "-",
              "_", "é", "²", "́", "😀", " ", "\x1c", "\n", "word", "[PII_EMAIL_0123abcd]",
              "٣", "1", "@", "x"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    return ["", "no pii at all", "555 123 4567.a@x.com", *made]


def test_spans_and_masks_match_python(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "text STRING")
    got = rows.select("text", pii.spans("text").alias("spans"), pii.mask("text").alias("masked"),
                      ).collect()
    for r in got:
        assert [(s.start, s.stop, s.value, s.entity_type) for s in r.spans] == expected_spans(r.text)
        assert r.masked == expected_mask(r.text)


def test_masking_twice_changes_nothing_and_null_stays_null(spark):
    rows = spark.createDataFrame([(t,) for t in texts()] + [(None,)], "text STRING")
    once = rows.select(pii.mask("text").alias("a"))
    moved = once.withColumn("b", pii.mask("a")).filter(~F.col("a").eqNullSafe(F.col("b")))
    # a token next to digits may complete a new number, which is why mask is idempotent only
    # where the masked text holds no further match
    left = [r for r in moved.collect() if not expected_spans(r.a)]
    assert left == []
    assert once.filter(F.col("a").isNull()).count() == 1


def test_restore_undoes_mask_and_keeps_unknown_and_expired_tokens(spark):
    rows = spark.createDataFrame(
        [(1, "call 555-867-5309 or a@b.co"), (2, "nothing here"), (3, "see 10.0.0.1"),
         (4, "[PII_SSN_deadbeef] stays"), (5, None)], "id INT, text STRING")
    found = ops.entities(rows.filter("id <> 3"), "text", "id").withColumnRenamed("id", "request_id")
    store = ops.store_upsert(spark.createDataFrame([], schemas.PII_TOKENS), found, AS_OF)
    old = ops.entities(rows.filter("id = 3"), "text", "id").withColumnRenamed("id", "request_id")
    store = ops.store_upsert(store, old, "2024-01-30 00:00:00")  # expires exactly at AS_OF
    masked = rows.withColumn("text", pii.mask("text"))
    back = {r.id: r.text for r in ops.restore(masked, "text", ["id"], store, AS_OF).collect()}
    assert back[1] == "call 555-867-5309 or a@b.co"
    assert back[2] == "nothing here" and back[5] is None
    assert back[3].startswith("see [PII_IP_ADDR_")
    assert back[4] == "[PII_SSN_deadbeef] stays"
    kept, purged = ops.purge(store, AS_OF)
    assert purged.first().purged == 0 and kept.count() == 3  # equal to as_of is kept


def test_store_gives_up_colliding_tokens_and_keeps_the_later_expiry(spark):
    when = datetime(2024, 2, 2)
    store = spark.createDataFrame([("t", "first", "EMAIL", "r1", when)], schemas.PII_TOKENS)
    found = spark.createDataFrame([("t", "second", "EMAIL", "r2"), ("u", "x", "SSN", "r3")],
                                  "token STRING, original_value STRING, entity_type STRING, "
                                  "request_id STRING")
    for small in (False, True):
        after = {r.token: r for r in ops.store_upsert(
            store, found, AS_OF, small_updates=small).collect()}
        assert after["t"].original_value is None and after["t"].request_id == "r1"
        assert after["t"].expires_at == when
        assert after["u"].expires_at == datetime(2024, 2, 1)
    clash = ops.collisions(store, found)
    assert [r.token for r in clash.collect()] == ["t"]
    texts_ = spark.createDataFrame([(1, "[PII_EMAIL_00000000]")], "id INT, text STRING")
    risky = ops.store_upsert(store, found, AS_OF).filter("token = 't'").withColumn(
        "token", F.lit("[PII_EMAIL_00000000]"))
    assert ops.restore(texts_, "text", ["id"], risky, AS_OF).first().text == "[PII_EMAIL_00000000]"
    again = ops.store_upsert(ops.store_upsert(store, found, AS_OF), found.limit(1), AS_OF)
    assert again.filter("token = 't'").first().original_value is None  # for good
    risky = store.withColumn("token", F.lit("[PII_EMAIL_00000000]"))
    unsafe = spark.createDataFrame([("[PII_EMAIL_00000000]",)], "token STRING")
    assert ops.restore(texts_, "text", ["id"], risky, AS_OF).first().text == "first"
    assert ops.restore(texts_, "text", ["id"], risky, AS_OF, unsafe=unsafe
                       ).first().text == "[PII_EMAIL_00000000]"


def test_parts_are_masked_one_by_one(spark):
    rows = spark.createDataFrame(
        [(1, 0, None, [("text", "mail a@b.co"), ("image_url", "a@b.co"), ("text", None)]),
         (1, 1, "plain", None), (1, 2, None, None)],
        f"request_id INT, turn INT, content STRING, parts {schemas.MESSAGE_PARTS}")
    got = {r.turn: r for r in ops.mask_messages(rows).collect()}
    assert got[0].changed and got[0].parts[0].text == expected_mask("mail a@b.co")
    assert got[0].parts[1].text == "a@b.co" and got[0].parts[2].text is None
    assert not got[1].changed and not got[2].changed and got[2].content is None
