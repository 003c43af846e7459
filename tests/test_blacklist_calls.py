"""A token's rows of a batch cost one reading and one writing of its state, however many they are."""

from datetime import datetime, timedelta

from pyspark.sql import Row

from quillsieve.streaming.blacklist import _Tokens


class Calls:
    def __init__(self):
        self.value, self.timers, self.made = None, set(), 0

    def exists(self):
        self.made += 1
        return self.value is not None

    def get(self):
        self.made += 1
        return self.value

    def update(self, value):
        self.made, self.value = self.made + 1, value

    def clear(self):
        self.made, self.value = self.made + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.made += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.made += 1
        self.timers.remove(at)


def test_many_rows_of_a_token_are_few_calls():
    calls, tokens = Calls(), _Tokens(3_600_000)
    tokens.handle = tokens.entry = calls
    start = datetime(2024, 1, 1)
    add = lambda m: Row(kind="add", at=start + timedelta(minutes=m), expires_at=start + timedelta(minutes=m + 30), user_id="u", reason="r")
    ask = lambda m: Row(kind="ask", at=start + timedelta(minutes=m), expires_at=None, user_id="u", reason=None)
    rows = [row for m in range(0, 5000, 50) for row in (ask(m + 31), add(m), ask(m + 30))]
    answers = [r.blacklisted for r in tokens.handleInputRows(("t",), iter(rows), None)]
    assert answers == [True, False] * 100 and calls.made <= 5 and calls.value is None and not calls.timers
    assert [r.blacklisted for r in tokens.handleInputRows(("t",), iter([add(6000)]), None)] == [] and len(calls.timers) == 1
    assert [r.blacklisted for r in tokens.handleInputRows(("t",), iter([ask(6010), add(6090), ask(6100)]), None)] == [True, True] and len(calls.timers) == 1
    assert [r.blacklisted for r in tokens.handleInputRows(("t",), iter([ask(6200)]), None)] == [False] and not calls.timers and calls.value is None
