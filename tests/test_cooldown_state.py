"""Cooldowns are set, moved on and lifted from plain rows, without a frame for each key."""

from fake_state import Handle, clock
from pyspark.sql import Row

from relaylens.streaming import cooldowns


def test_a_key_takes_plain_rows():
    handle, processor = Handle(), cooldowns._CooldownProcessor()
    processor.init(handle)

    def feed(*ends):
        return list(processor.handleInputRows(
            ("m-free",), iter([Row(until_us=end) for end in ends]), clock(0)))

    assert feed(5_000_000, None, 3_000_000) == [
        Row(model_key="m-free", change="set", until_us=5_000_000)]
    assert feed(4_000_000) == [] and feed(None) == []
    assert [r.until_us for r in feed(9_000_000)] == [9_000_000]
    assert handle.timers == {5000, 9000}
    assert list(processor.handleExpiredTimer(("m-free",), clock(5000), None)) == []
    assert list(processor.handleExpiredTimer(("m-free",), clock(9000), None)) == [
        Row(model_key="m-free", change="lifted", until_us=9_000_000)]
    assert handle.states["until"].value is None
