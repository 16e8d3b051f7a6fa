"""Early chunks cost a few calls of the state store for a block of them."""

import random

import pandas as pd
from fake_state import Handle, clock

from relaylens.streaming import chunks


def test_early_chunks_are_packed_by_blocks():
    rng, n = random.Random(5), 3000
    text = "".join(rng.choice("ab [PII_]c") for _ in range(16 * n))
    rows = [(i, text[16 * i:16 * i + 16], "stop" if i == n - 1 else None) for i in range(n)]
    rng.shuffle(rows)
    handle, processor = Handle(), chunks._ChunkProcessor(None)
    processor.init(handle)
    out = []
    for part in (rows[:1000], rows[1000:2000], rows[2000:] + rows[:50]):
        whole = pd.DataFrame(part, columns=["seq", "delta", "finish_reason"])
        batches = [whole[k:k + 300] for k in range(0, len(whole), 300)]
        out += list(processor.handleInputRows(("r",), iter(batches), None))
    got = pd.concat(out)
    assert got["seq"].tolist() == list(range(n))
    assert "".join(got["safe"]) == text
    assert len(handle.states["early"].calls) <= 40
    assert handle.states["early"].rows == {}


def test_idle_responses_are_flushed_from_their_blocks():
    handle, processor = Handle(), chunks._ChunkProcessor(60_000)
    processor.init(handle)
    rows = pd.DataFrame([(0, "a [PII", None), (5000, "late", None), (2, "mid ", None)],
                        columns=["seq", "delta", "finish_reason"])
    first = list(processor.handleInputRows(("r",), iter([rows]), clock(0)))
    rest = list(processor.handleExpiredTimer(("r",), clock(60_000), None))
    got = pd.concat(first + rest)
    assert list(zip(got["seq"], got["safe"], got["missing"])) == [
        (0, "a ", 0), (1, "[PII", 0), (2, "mid ", 1), (5000, "late", 4997)]
