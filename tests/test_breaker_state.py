"""The reorder buffer writes events once, and the rows of a span go out before the next is read."""

import pandas as pd
import pytest
from fake_state import Handle, clock

from relaylens.streaming import breakers

MINUTE = 60_000_000


@pytest.mark.parametrize("piece_rows", [2, 500_000])
def test_events_of_a_span_are_written_once(monkeypatch, piece_rows):
    monkeypatch.setattr(breakers, "PIECE_ROWS", piece_rows, raising=False)
    handle, processor = Handle(), breakers._BreakerProcessor(60)
    processor.init(handle)
    rows = pd.DataFrame({
        "event_id": range(40), "ts_us": [k % 4 * MINUTE + 1_000_000 * k for k in range(40)],
        "ok": [k % 3 > 0 for k in range(40)], "reset": False, "failure_threshold": 2,
        "recovery_timeout": 30, "success_threshold": 1})
    shuffled = rows.sample(frac=1, random_state=3)
    for part in (shuffled[:20], shuffled[20:]):
        batches = [part[k:k + 5] for k in range(0, 20, 5)]
        assert list(processor.handleInputRows(("m",), iter(batches), clock(0))) == []
    buffer = handle.states["buffer"]
    assert set(buffer.calls) == {"updateValue"}
    assert len(buffer.calls) <= (2 * 4 if piece_rows > 40 else 40)
    buffer.calls.clear()
    due = processor.handleExpiredTimer(("m",), clock(4 * MINUTE // 1000), None)
    first = next(due)
    assert len(buffer.calls) < len(buffer.rows)  # the later spans are not read yet
    calls = [frame for frame in [first, *due] if (frame["kind"] == breakers.CALL).all()]
    assert [int(e) for frame in calls for e in frame["event_id"]] == rows.sort_values(
        ["ts_us", "event_id"])["event_id"].tolist()
    assert buffer.rows == {}
