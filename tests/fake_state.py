"""A state store in a dictionary that counts the calls; no session is needed."""

from types import SimpleNamespace


class Value:
    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class Map:
    def __init__(self):
        self.rows, self.calls = {}, []

    def containsKey(self, key):
        self.calls.append("containsKey")
        return key in self.rows

    def getValue(self, key):
        self.calls.append("getValue")
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self.rows[key] = value

    def removeKey(self, key):
        self.calls.append("removeKey")
        self.rows.pop(key, None)

    def clear(self):
        self.calls.append("clear")
        self.rows.clear()

    def keys(self):
        return iter(list(self.rows))

    def values(self):
        return iter(list(self.rows.values()))

    def iterator(self):
        return iter(list(self.rows.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key_schema, value_schema):
        return self.states.setdefault(name, Map())

    def registerTimer(self, moment):
        self.timers.add(moment)

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, moment):
        self.timers.discard(moment)


def clock(watermark_ms: int):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms,
                           getCurrentProcessingTimeInMs=lambda: watermark_ms)
