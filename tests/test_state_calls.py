"""Keyed state is read and written once for a user and trigger, however many days there are."""

from __future__ import annotations

import pandas as pd

from siltstone.streaming.events import Days


class Handle:
    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_days_are_read_and_written_once_a_trigger():
    handle, days = Handle(), Days()
    days.init(handle)
    first = next(days.handleInputRows((7,), iter([pd.DataFrame({"day": list(range(40)) + [3]}), pd.DataFrame({"day": [3, 41]})]), None))
    assert first.values.tolist() == [[7, 41, 3]] and handle.calls == 2
    again = next(days.handleInputRows((7,), iter([pd.DataFrame({"day": [3, 50]})]), None))
    assert again.values.tolist() == [[7, 42, 4]] and handle.calls == 4
