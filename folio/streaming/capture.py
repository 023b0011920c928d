"""Camera capture: when to take the picture, and when the next page has arrived."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions.signatures import signature_distance
from folio.operators.ordered import day, neighbor
from folio.streaming import state as ST

# fixed values
HOLD_SECONDS = 0.9
STILL = 0.025
MIN_AREA = 0.12
FRAME_MARGIN = 0.008
MIN_CONFIDENCE = 0.5
RELEASE_MOVE = 0.08
RELEASE_LOST = 0.5
RELEASE_CHANGE = 14.0

def touches_frame(q: Column) -> Column:
    return F.exists(q, lambda v: (v <= FRAME_MARGIN) | (v >= 1 - FRAME_MARGIN))


def gate_cue(q: Column, confidence: Column) -> Column:
    """Why a frame cannot be captured at all; null when it may be."""
    return (F.when(q.isNull(), "Searching").when(touches_frame(q), "OutOfFrame").when(G.quad_area(q) < MIN_AREA, "TooFar")
            .when(confidence < MIN_CONFIDENCE, "Searching"))


def with_gates(frames: DataFrame) -> DataFrame:
    """Frames with their ``gate``; the outline leaves a generator, so its many uses don't each compute it again."""
    d = frames.withColumn("_q", F.explode(F.array("quad")))
    return d.withColumn("gate", gate_cue(F.col("_q"), F.col("confidence"))).drop("_q")


# --- one session as a table of transitions -----------------------------------------

#: ``(mode, event) -> (next mode, cue)``; a mode of None keeps the mode, a cue of None is the frame's own gate.
#: ``idle``: nothing to hold on to; ``holding``: waiting for the frame remembered to stay still; ``taken``: the picture of it was taken.
IDLE, HOLDING, TAKEN = "idle", "holding", "taken"
TRANSITIONS = {
    (IDLE, "empty"): (IDLE, "Searching"),
    (IDLE, "barred"): (IDLE, None),
    (IDLE, "fresh"): (HOLDING, "Holding"),
    (HOLDING, "empty"): (IDLE, "Searching"),
    (HOLDING, "barred"): (IDLE, None),
    (HOLDING, "fresh"): (HOLDING, "Holding"),
    (HOLDING, "still"): (HOLDING, "Holding"),
    (HOLDING, "ripe"): (TAKEN, "Capture"),
    (TAKEN, "empty"): (TAKEN, "Captured"),
    (TAKEN, "same"): (TAKEN, "Captured"),
    (TAKEN, "away"): (IDLE, "Searching"),
    (TAKEN, "barred"): (IDLE, None),
    (TAKEN, "fresh"): (HOLDING, "Holding"),
}
#: Events at which the frame itself is remembered.
REMEMBERED = {"fresh", "ripe"}
INIT = {"mode": IDLE, "quad": None, "sig": None, "at": 0.0, "gone": None}


def _apart(a, b) -> float:
    """Largest move of a corner."""
    return float(np.hypot(*(np.reshape(a, (4, 2)) - np.reshape(b, (4, 2))).T).max())


def _unlike(a, b) -> float:
    """Mean difference of two signatures; none where one is missing."""
    return 0.0 if a is None or b is None else float(np.abs(np.subtract(a, b)).mean())


def event(s: dict, r) -> tuple[str, float]:
    """What a frame (``t, quad, gate, sig``) means to a session, and how far a hold has come."""
    if r.quad is None:
        waited = s["mode"] == TAKEN and s["gone"] is not None and r.t - s["gone"] >= RELEASE_LOST
        return ("away" if waited else "empty"), 0.0
    apart = _apart(r.quad, s["quad"]) if s["mode"] != IDLE else math.inf
    if s["mode"] == TAKEN and apart <= RELEASE_MOVE and _unlike(r.sig, s["sig"]) <= RELEASE_CHANGE:
        return "same", 0.0
    if r.gate is not None:
        return "barred", 0.0
    if s["mode"] == HOLDING and apart <= STILL:
        share = (r.t - s["at"]) / HOLD_SECONDS
        return ("ripe", 1.0) if share >= 1 else ("still", max(0.0, share))
    return "fresh", 0.0


def step(s: dict, r) -> tuple[dict, tuple]:
    """One frame: the state after it, the cue shown and the progress of the hold."""
    what, share = event(s, r)
    mode, cue = TRANSITIONS[s["mode"], what]
    after = s | {"mode": mode, "gone": (r.t if s["gone"] is None else s["gone"]) if r.quad is None else None}
    if what in REMEMBERED:
        after |= {"quad": [float(v) for v in r.quad], "sig": None if r.sig is None else [int(v) for v in r.sig], "at": r.t}
    return after, (cue or r.gate, share)


OUT = "session_id long, event_id long, cue string, progress double"


def capture_cues(frames: DataFrame, live: bool = False, idle_ms: int | None = None) -> DataFrame:
    """``session_id, event_id, cue, progress`` for frames ``session_id, event_id, t, quad, confidence, sig``.

    Live, ``idle_ms`` drops the state of sessions without frames for so long.
    """
    f = with_gates(frames).select("session_id", "event_id", "t", "quad", "gate", "sig")
    args = f, "session_id", "t", ["event_id"], step, INIT, OUT, ["cue", "progress"]
    return ST.stream(*args, idle_ms=idle_ms) if live else ST.batch(*args)


def frame_change(frames: DataFrame) -> DataFrame:
    """``session_id, event_id, change``: signature distance to the session's previous frame."""
    d = neighbor(frames.select("session_id", "event_id", "ts", "sig"), "session_id", day("ts"), ["event_id"], "event_id", -1)
    prev = frames.select(F.col("event_id").alias("neighbor_id"), F.col("sig").alias("prev_sig"))
    d = d.join(prev, "neighbor_id", "left")
    return d.select("session_id", "event_id", signature_distance(F.col("sig"), F.col("prev_sig")).alias("change"))


CHANGE_OUT = "session_id long, event_id long, change double"


def _change_step(s: dict, r) -> tuple[dict, tuple]:
    return {"sig": [int(v) for v in r.sig]}, (None if s["sig"] is None else _unlike(r.sig, s["sig"]),)


def frame_change_stream(frames: DataFrame) -> DataFrame:
    return ST.stream(frames.select("session_id", "event_id", "sig"), "session_id", "event_id", ["event_id"], _change_step,
                     {"sig": None}, CHANGE_OUT, ["change"])
