"""A call's snapshots are put together before the state is touched."""

from furlong.streaming.stages import Stages


class State:
    def __init__(self):
        self.value, self.writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, _):  # noqa: N802
        return self.states.setdefault(name, State())

    def registerTimer(self, _):  # noqa: N802
        pass


class Timers:
    @staticmethod
    def getCurrentWatermarkInMs():  # noqa: N802
        return 0


def test_each_state_is_written_once_a_call():
    stages, handle, start = Stages(), Handle(), 10_000_000
    stages.init(handle)
    rows = [{"at_ms": start - 30_000 * k, "ref": -k, "value": float(k), "ok": k % 5 > 0} for k in range(-3, 200)]
    for part in (rows[:100], rows[100:], []):
        list(stages.handleInputRows((1, start), iter(part), Timers))
    usable = [(r["at_ms"], r["ref"], r["value"]) for r in rows if r["ok"] and r["at_ms"] < start]
    s = handle.states
    assert s["final"].value == min(x for x in usable if x[0] >= start - 1_200_000)
    assert s["provisional"].value == min(x for x in usable if x[0] >= start - 3_600_000)
    assert s["latest"].value == max(usable)
    assert s["final"].writes == 1 and s["provisional"].writes == 2 and s["latest"].writes == 2
