"""Journeys: a state machine for each enrolled person, driven by events and time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.durations import SpecError, seconds
from .ordered import Ordered, ordered

KINDS = ("wait", "branch", "set_fact", "add_to_list", "webhook", "exit")
MOST_HOPS = 25
STEP = "passport_id long, step string, action string, value string, at timestamp"


def validate(journey: dict) -> None:
    """{start, trigger, steps: {name: {kind, next, ...}}}; every step is of a known kind and leads somewhere that exists."""
    steps = journey["steps"]
    for name, step in steps.items():
        if step.get("kind") not in KINDS:
            raise SpecError(f'journey: step "{name}" has no kind of {"/".join(KINDS)}')
        for to in (step.get("next"), step.get("then"), step.get("otherwise")):
            if to is not None and to not in steps:
                raise SpecError(f'journey: step "{name}" leads to "{to}", which there is not')


class Journey(Ordered):
    """Where a person stands, and what events there were since enrolling, as JSON; nothing for those not under way."""

    def __init__(self, journey: dict) -> None:
        self.journey, self.steps = journey, journey["steps"]

    def event(self, who, held, us, said, out):
        where = json.loads(held) if held else None
        due = where["due"] if where else None
        if where is None and said == self.journey["trigger"]:
            where, due = self._walk(who, self.journey["start"], us, [], out)
        if where is None:
            return None, None
        where["had"] = sorted({*where["had"], said} - {None})
        return json.dumps(where), due

    def deadline(self, who, held, due, out):
        where = json.loads(held)
        where, due = self._walk(who, self.steps[where["step"]].get("next"), due, where["had"], out)
        return (None, None) if where is None else (json.dumps(where), due)

    def _walk(self, who, name: str | None, us: int, had: list[str], out: list) -> tuple[dict | None, int | None]:
        """Steps one after the other until one waits, or the end."""
        for _ in range(MOST_HOPS):
            if name is None:
                return None, None
            step = self.steps[name]
            kind = step["kind"]
            if kind == "wait":
                due = us + 1_000_000 * seconds(step["for"])
                return {"step": name, "due": due, "had": list(had)}, due
            if kind == "branch":
                name = step.get("then") if step["event"] in had else step.get("otherwise")
                continue
            value = None if kind == "exit" else str(step.get("value"))
            out.append(Row(passport_id=who, step=name, action=kind, value=value, us=us))
            if kind == "exit":
                return None, None
            name = step.get("next")
        out.append(Row(passport_id=who, step=name, action="stopped", value=f"more than {MOST_HOPS} steps in a row", us=us))
        return None, None


def run_journeys(events: DataFrame, journey: dict, late: str = "1 hour") -> DataFrame:
    """(passport_id, step, action, value, at) of every action taken; events are (passport_id, ts, type and, if there is one, id).

    A trigger enrols a person who is not under way.  Steps follow one another at once, at most MOST_HOPS in a row, until a wait;
    a wait ends when event time has passed it, before any event of that instant.  A branch asks whether the person has had an event of a
    type since enrolling.  Events count in order of time, however they come in, once the watermark has passed them; later ones are
    dropped.  Those not under way keep no state.
    """
    validate(journey)
    made = ordered(events, Journey(journey), F.col("type"), STEP.replace("at timestamp", "us long"), late)
    return made.select("passport_id", "step", "action", "value", F.timestamp_micros("us").alias("at"))
