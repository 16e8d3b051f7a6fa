"""What a stretch of a breaker's rows makes of every state it may be entered with.

A breaker enters a stretch closed with some failures, half-open with some successes, or open since
some time. For each of the three this is a step function of that one number, and a stretch turns it
into few pieces: all numbers that close, trip or resume at the same row go on alike, and pieces that
meet in one state are merged. Rows are taken in batches, and all pieces move through a batch at once
as arrays: the next opening after every row's opening is looked up, and pointers are doubled.

The failures of a breaker that is not closed decide nothing; a piece tells either what they are at the
end (``fixed``) or by how much they have grown (``off``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

CLOSED, OPEN, HALF, AS_ENTERED = range(4)
ANY = np.iinfo(np.int64).max
COLUMNS = ["kind", "upto", "code", "val", "fixed", "off"]


class Spots:
    """States as arrays; ``node`` is the row whose failure has just opened the breaker, or -1."""

    FIELDS = ("code", "val", "fixed", "off", "node")

    def __init__(self, size: int):
        self.code, self.val, self.off = (np.zeros(size, dtype=np.int64) for _ in range(3))
        self.fixed, self.node = np.zeros(size, dtype=bool), np.full(size, -1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.code)

    def put(self, where, other: Spots) -> None:
        for name in self.FIELDS:
            getattr(self, name)[where] = getattr(other, name)

    def take(self, where) -> Spots:
        out = Spots(0)
        for name in self.FIELDS:
            setattr(out, name, getattr(self, name)[where])
        return out

    def then(self, later: Spots) -> Spots:
        """The states of ``later``, with the failures counted from where these began."""
        later.off = np.where(later.fixed, later.off, self.off + later.off)
        later.fixed = self.fixed | later.fixed
        return later

    def add(self, other: Spots) -> None:
        for name in self.FIELDS:
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))


def _ahead(mask: np.ndarray) -> np.ndarray:
    """For every row the next one, itself included, where the mask holds; else their number."""
    n = len(mask)
    found = np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1]
    return np.append(found, n)


class Batch:
    """Consecutive rows of one module, and where states before any of them lead."""

    def __init__(self, ts, ok, reset, threshold: int, recovery: int, needed: int):
        n = self.n = len(ts)
        self.ts, self.reset = ts, np.append(reset, False)
        self.threshold, self.recovery, self.needed = threshold, recovery, needed
        self.breaks, self.bad, self.resets = _ahead(ok | reset), _ahead(~ok), _ahead(reset)
        place = np.arange(n)
        run = place - np.maximum.accumulate(np.where(ok | reset, place, -1))
        self.trips, self.last_run = _ahead(run >= threshold), int(run[-1])
        self._ends = self._resolved(self.opened(ts, place + 1))

    def closed(self, p: np.ndarray, count: np.ndarray) -> Spots:
        """From a closed breaker with ``count`` failures before row ``p``."""
        needed, pause = np.maximum(self.threshold - count, 1), self.breaks[p]
        direct = pause - p >= needed
        trip = np.where(direct, p + needed - 1, self.trips[pause])
        out, stays = Spots(len(p)), trip >= self.n
        out.val = np.where(pause < self.n, self.last_run, count + self.n - p)
        out.off = np.where(stays, 0, np.where(direct, count + needed, self.threshold))
        out.fixed[:] = True
        out.node = np.where(stays, -1, trip)
        return out

    def half(self, p: np.ndarray, good: np.ndarray) -> Spots:
        """From a half-open breaker with ``good`` successes before row ``p``."""
        more, bad = np.maximum(self.needed - good, 1), self.bad[p]
        enough = bad - p >= more
        closes = enough | self.reset[bad]
        fails = ~closes & (bad < self.n)
        out = Spots(len(p))
        out.code[:], out.val = HALF, good + self.n - p
        out.node[fails], out.off[fails] = bad[fails], 1
        after = np.where(enough, p + more, bad + 1)[closes]
        out.put(closes, self.closed(after, np.zeros(len(after), dtype=np.int64)))
        return out

    def opened(self, since: np.ndarray, p: np.ndarray) -> Spots:
        """From a breaker open since a time, before row ``p``."""
        resume = np.maximum(np.searchsorted(self.ts, since + self.recovery), p)
        reset = self.resets[p]
        cleared = (reset <= resume) & (reset < self.n)
        resumes = ~cleared & (resume < self.n)
        out = Spots(len(p))
        out.code[:], out.val = OPEN, since.copy()
        zeros = np.zeros(len(p), dtype=np.int64)
        out.put(cleared, self.closed(reset[cleared] + 1, zeros[cleared]))
        out.put(resumes, self.half(resume[resumes], zeros[resumes]))
        return out

    @staticmethod
    def _resolved(spots: Spots) -> Spots:
        """Every row's opening followed to the end of the batch."""
        while True:
            todo = np.flatnonzero(spots.node >= 0)
            if not len(todo):
                return spots
            spots.put(todo, spots.take(todo).then(spots.take(spots.node[todo])))

    def finish(self, spots: Spots) -> Spots:
        todo = np.flatnonzero(spots.node >= 0)
        spots.put(todo, spots.take(todo).then(self._ends.take(spots.node[todo])))
        return spots

    def move(self, spots: Spots) -> Spots:
        """States before the batch to those after it."""
        out = Spots(len(spots))
        for code, start in ((CLOSED, lambda v, p: self.closed(p, v)),
                            (OPEN, lambda v, p: self.opened(v, p)),
                            (HALF, lambda v, p: self.half(p, v))):
            chosen = spots.code == code
            out.put(chosen, start(spots.val[chosen], np.zeros(chosen.sum(), dtype=np.int64)))
        return spots.then(self.finish(out))


class Passage:
    """The three step functions of a growing stretch.

    A state is addressed by its kind and a number: minus its failures, the time it opened, or minus
    its successes; a piece holds for numbers up to ``upto``. Numbers beyond the last piece still
    wait: nothing has happened to them but ``lead`` failures or successes in a row.
    """

    def __init__(self):
        self.first = self.last = None
        self.upto = {k: np.zeros(0, dtype=np.int64) for k in (CLOSED, OPEN, HALF)}
        self.spots = {k: Spots(0) for k in self.upto}
        self.lead, self.settled = dict.fromkeys(self.upto, 0), dict.fromkeys(self.upto, False)

    def extend(self, batch: Batch) -> None:
        if self.first is None:
            self.first = int(batch.ts[0])
        for kind, start in ((CLOSED, self._tripped), (OPEN, self._resumed), (HALF, self._shut)):
            spots = batch.move(self.spots[kind])
            upto = self.upto[kind]
            if not self.settled[kind]:
                for bounds, new in start(batch):
                    spots.add(batch.finish(new))
                    upto = np.append(upto, bounds)
            last = np.ones(len(upto), dtype=bool)  # of pieces that have met in one state
            for column in (spots.code, spots.val, spots.fixed, spots.off):
                last[:-1] &= column[1:] == column[:-1]
            last[:-1], last[-1:] = ~last[:-1], True
            self.upto[kind], self.spots[kind] = upto[last], spots.take(last)
        self.last = int(batch.ts[-1])

    @staticmethod
    def _one(batch: Batch, row: int) -> Spots:
        return batch.closed(np.array([row]), np.zeros(1, dtype=np.int64))

    def _tripped(self, batch: Batch):
        """Closed breakers that the leading failures trip; the first other row equals the rest."""
        lead, pause = self.lead[CLOSED], int(batch.breaks[0])
        rows = np.arange(min(pause, batch.threshold - lead))
        new = Spots(len(rows))
        new.node, new.fixed[:], new.off[:] = rows, True, batch.threshold
        yield lead + rows + 1 - batch.threshold, new
        self.lead[CLOSED] += pause
        self.settled[CLOSED] = pause < batch.n or self.lead[CLOSED] >= batch.threshold
        if self.lead[CLOSED] < batch.threshold and pause < batch.n:
            yield [ANY], self._one(batch, pause + 1)

    def _shut(self, batch: Batch):
        """Half-open breakers that the leading successes close."""
        lead, bad = self.lead[HALF], int(batch.bad[0])
        rows = np.arange(min(bad, batch.needed - lead))
        yield (lead + rows + 1 - batch.needed,
               batch.closed(rows + 1, np.zeros(len(rows), dtype=np.int64)))
        self.lead[HALF] += bad
        self.settled[HALF] = bad < batch.n or self.lead[HALF] >= batch.needed
        if self.lead[HALF] < batch.needed and bad < batch.n:
            yield [ANY], batch.half(np.array([bad]), np.zeros(1, dtype=np.int64))

    def _resumed(self, batch: Batch):
        """Open breakers by the row at which they resume: none opened after the first row."""
        reset = int(batch.resets[0])
        ts = batch.ts[:reset]
        before = np.append(ts[:1] - 1 if self.last is None else self.last, ts)[:len(ts)]
        rows = np.flatnonzero(ts > before)
        over = np.flatnonzero(ts[rows] - batch.recovery >= self.first)
        if len(over):
            rows = rows[:over[0] + 1]
        yield (ts[rows] - batch.recovery,
               batch.half(rows, np.zeros(len(rows), dtype=np.int64)))
        self.settled[OPEN] = len(over) > 0 or reset < batch.n
        if not len(over) and reset < batch.n:
            yield [ANY], self._one(batch, reset + 1)

    def pieces(self) -> pd.DataFrame:
        parts = []
        for kind, spots in self.spots.items():
            parts.append(pd.DataFrame({
                "kind": kind, "upto": self.upto[kind], "code": spots.code, "val": spots.val,
                "fixed": spots.fixed, "off": spots.off}))
            if not self.settled[kind]:
                parts.append(pd.DataFrame([[kind, ANY, AS_ENTERED, self.lead[kind], False, 0]],
                                          columns=COLUMNS))
        return pd.concat([p for p in parts if len(p)], ignore_index=True)
