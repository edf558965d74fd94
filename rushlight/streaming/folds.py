"""The scripted take as a state step over protocol ticks, for its batch replay and its stream."""

from __future__ import annotations

import numpy as np
import pandas as pd

# The scripted take (seconds, ceiling, how the phase ends) and its limits.
SCRIPT = (("perch", 2, 8, "rest"), ("arc", 12, 20, "sweep"), ("reseat", 3, 12, "settle"), ("hold", 3, 3, "moves"))
ARC_FLOOR_DEG = 40
REST_CONFIRM_MS = 700
COUNTDOWN_MS = 1500
SWEEP_GRACE_MS = 3000
SWEEP_STARTED_DEG = 6.0
PHASE_SCHEMA = (
    "capture_id {key}, t_ms long, phase string, warning string, countdown_ms long, rest_confirmed boolean, transitions int, finished string, aborted boolean"
)


def phase_start() -> dict:
    return {"index": 0, "began": 0, "counting": None, "confirmed": False, "moves": 0, "finished": None, "aborted": False, "warning": None}


# What each kind of ending looks at, as columns over the ticks of one phase: when the phase is passed, when it fails
# and why, and what to tell meanwhile (later tests win). ``settled`` is a confirmed rest, ``counted`` a run out countdown.
ENDINGS = {
    "rest": {
        "passed": lambda c: c["long"] & c["rested"],
        "failed": lambda c: c["late"],
        "reason": "never_settled",
        "tell": (("hands_off", lambda c: ~c["rest"]),),
    },
    "sweep": {
        "passed": lambda c: c["long"] & c["wide"],
        "failed": lambda c: c["long"] & c["late"],
        "reason": "too_narrow",
        "tell": (
            ("walk_around", lambda c: c["grace"] & ~c["orbit"]),
            ("move_around", lambda c: c["grace"] & ~c["begun"]),
            ("wider", lambda c: c["long"]),
        ),
    },
    "settle": {
        "passed": lambda c: c["counted"],
        "failed": lambda c: c["late"] & ~c["settled"],
        "reason": "never_settled",
        "tell": (),
    },
    "moves": {"passed": lambda c: c["rest"] & c["long"], "failed": lambda c: ~c["rest"], "reason": "moved", "tell": ()},
}


def phase_step(s: dict, rows: pd.DataFrame) -> pd.DataFrame:
    """Ticks (t_ms, at_rest, rest_for_ms, swept_deg, orbit_likely) drive the script.

    Each phase takes all ticks up to the first that passes or fails it, so a batch is a few array steps, one for each
    phase that it touches. Warnings and reasons are codes.
    """
    n = len(rows)
    t, rest = rows["t_ms"].to_numpy(np.int64), rows["at_rest"].to_numpy(bool)
    rested = rows["rest_for_ms"].to_numpy(np.int64) >= REST_CONFIRM_MS
    swept, orbit = rows["swept_deg"].to_numpy(np.float64), rows["orbit_likely"].to_numpy(bool)
    phase, warning, finished = np.empty(n, object), np.full(n, None, object), np.full(n, None, object)
    left = np.full(n, np.nan)
    confirmed, aborted, moves = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int32)
    at = 0
    while at < n:
        name, seconds, ceiling, ends = SCRIPT[s["index"]]
        rule, span = ENDINGS[ends], slice(at, n)
        if s["finished"]:
            phase[span], warning[span], finished[span] = name, s["warning"], s["finished"]
            confirmed[span], aborted[span], moves[span] = s["confirmed"], s["aborted"], s["moves"]
            break
        inside = t[span] - s["began"]
        c = {"rest": rest[span], "rested": rested[span], "settled": rest[span] & rested[span], "orbit": orbit[span],
             "long": inside >= seconds * 1000, "late": inside >= ceiling * 1000, "grace": inside >= SWEEP_GRACE_MS,
             "begun": swept[span] >= SWEEP_STARTED_DEG, "wide": swept[span] >= ARC_FLOOR_DEG}
        # when the current run of settled ticks began: a run that came in with the state, or its own first tick
        opening = np.where(c["settled"] & ~np.concatenate([[s["counting"] is not None], c["settled"][:-1]]), t[span], -1)
        came_in = s["counting"] if s["counting"] is not None else -1
        since = np.maximum.accumulate(np.maximum(opening, came_in))
        remains = COUNTDOWN_MS - (t[span] - since)
        c["counted"] = c["settled"] & (remains <= 0)
        passed = rule["passed"](c)
        over = passed | rule["failed"](c)
        stop = int(over.argmax()) if over.any() else n - at
        quiet = slice(at, at + stop)
        phase[quiet], confirmed[quiet], moves[quiet] = name, s["confirmed"], s["moves"]
        for code, test in rule["tell"]:
            warning[quiet] = np.where(test(c)[:stop], code, warning[quiet])
        if ends == "settle":
            confirmed[quiet] = c["settled"][:stop]
            left[quiet] = np.where(c["settled"][:stop], remains[:stop], np.nan)
            if stop:
                running = bool(c["settled"][stop - 1])
                s.update(confirmed=running, counting=int(since[stop - 1]) if running else None)
        s["warning"] = warning[at + stop - 1] if stop else s["warning"]
        at += stop
        if at == n:
            break
        if ends == "settle":
            s["confirmed"] = bool(c["settled"][stop])
        if not passed[stop]:
            s.update(finished=rule["reason"], aborted=True, warning=rule["reason"], counting=None)
        elif s["index"] + 1 == len(SCRIPT):
            s.update(finished="complete", warning=None)
        else:
            s.update(index=s["index"] + 1, began=int(t[at]), counting=None, moves=s["moves"] + 1, warning=None)
        phase[at], warning[at], finished[at] = SCRIPT[s["index"]][0], s["warning"], s["finished"]
        confirmed[at], aborted[at], moves[at] = s["confirmed"], s["aborted"], s["moves"]
        at += 1
    made = pd.DataFrame(
        {"capture_id": rows["capture_id"].to_numpy(), "t_ms": t, "phase": phase, "warning": warning, "countdown_ms": left,
         "rest_confirmed": confirmed, "transitions": moves, "finished": finished, "aborted": aborted}
    )
    return made.astype({"countdown_ms": "Int64"})
