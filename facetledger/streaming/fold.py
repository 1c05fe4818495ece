"""One session's state, advanced call by call. A small helper for the stateful stream (and the check of the batch
job): the calls arrive already classified by the same Column builders the batch uses."""

from __future__ import annotations

from facetledger.operators.sessions import FROM_ANCHOR, FROM_ARC, FROM_TRIGGER, INHERITED, SessionRules
from facetledger.schemas import FACETS, SCALAR_FACETS


def resolve(candidates: list[dict]) -> list[dict]:
    out: list[dict] = []
    for name, facet in FACETS.items():
        viable = [c for c in candidates if c["facet"] == name and c["confidence"] >= facet.min_confidence]
        if not facet.array:
            out += sorted(viable, key=lambda c: -c["confidence"])[:1]
            continue
        kept: dict[str, dict] = {}
        for c in viable:
            if c["value"] not in kept or c["confidence"] > kept[c["value"]]["confidence"]:
                kept[c["value"]] = c
        out += sorted(kept.values(), key=lambda c: -c["confidence"])[: facet.top_n]
    return [dict(c) for c in out]


def verdict_of(entry: dict, facet: str) -> dict | None:
    return next((v for v in entry["verdicts"] if v["facet"] == facet), None)


def value_of(entry: dict, facet: str):
    found = verdict_of(entry, facet)
    return found and found["value"]


def new_state() -> dict:
    return {"facets": {}, "history": []}


def step(state: dict, call: dict, rules: SessionRules, arc_verdicts=None) -> list[dict]:
    """Advances the state by one call and returns what happened as records.

    ``call``: session_id, call_id, at (seconds), workdir, declared, anchor, candidates. ``arc_verdicts``: verdicts of an arc
    without an anchor, by the arc's id; without it such an arc is only reported.
    """
    events: list[dict] = []
    history = state["history"]
    last = history[-1] if history else None
    fresh_session = last is None
    if last is not None:
        context = value_of(last, "context")
        if call["at"] - last["at"] > rules.arc_gap_minutes * 60:
            events += close(state, rules, arc_verdicts)
        moved = last["workdir"] is not None and call["workdir"] is not None and last["workdir"] != call["workdir"]
        flipped = context is not None and call["declared"] is not None and context != call["declared"]
        fresh_session = call["at"] - last["at"] > rules.gap_minutes * 60 or moved or flipped
    if fresh_session:
        state["facets"] = {}
    inherited = [
        {"facet": f, "value": s["value"], "confidence": min(s["confidence"], rules.inherit_cap), "source": INHERITED + s["call_id"]}
        for f, s in state["facets"].items() if s["confidence"] >= rules.min_inherit
    ]
    entry = {
        "session_id": call["session_id"], "call_id": call["call_id"], "at": call["at"], "workdir": call["workdir"], "anchor": call["anchor"],
        "verdicts": resolve(call["candidates"] + sorted(inherited, key=lambda c: list(FACETS).index(c["facet"]))),
    }
    for v in entry["verdicts"]:
        held = state["facets"].get(v["facet"], {"confidence": 0.0})
        if v["confidence"] > held["confidence"] and v["confidence"] >= rules.min_inherit:
            state["facets"] = {**state["facets"], v["facet"]: {**v, "call_id": call["call_id"]}}
    events += [{"kind": "verdict", "call_id": call["call_id"], **v} for v in entry["verdicts"]]
    events += spread(history, entry, rules)
    history.append(entry)
    return events


def spread(history: list[dict], entry: dict, rules: SessionRules) -> list[dict]:
    """Back-propagates the entry's strong verdicts, newest call first."""
    events = []
    active = {
        v["facet"]: v for v in entry["verdicts"]
        if v["facet"] in SCALAR_FACETS and v["confidence"] >= rules.trigger and not v["source"].startswith(INHERITED)
    }
    context = value_of(entry, "context")
    for prior in reversed(history):
        if not active:
            break
        prior_context = value_of(prior, "context")
        for facet, trigger in list(active.items()):
            old = verdict_of(prior, facet)
            if old is None:
                continue
            other = rules.stop_on_context and facet != "context" and None not in (context, prior_context) and context != prior_context
            if old["confidence"] >= rules.override_below or other:
                del active[facet]
                continue
            events.append({
                "kind": "back-propagation", "call_id": prior["call_id"], "facet": facet, "value": trigger["value"],
                "confidence": rules.propagated, "source": FROM_TRIGGER + entry["call_id"],
            })
            old.update(value=trigger["value"], confidence=rules.propagated, source=FROM_TRIGGER + entry["call_id"])
    return events


def trailing_arc(history: list[dict], rules: SessionRules) -> list[dict]:
    """The last calls whose gaps stay within the arc limit."""
    arc = history[-1:]
    for older, newer in zip(reversed(history[:-1]), reversed(history)):
        if newer["at"] - older["at"] > rules.arc_gap_minutes * 60:
            break
        arc.insert(0, older)
    return arc


def close(state: dict, rules: SessionRules, arc_verdicts=None) -> list[dict]:
    """Revises the last arc, once: a timer or the next call beyond the gap may come first."""
    history = state["history"]
    if not history or history[-1].get("closed"):
        return []
    events = revise(state, trailing_arc(history, rules), rules, arc_verdicts)
    history[-1]["closed"] = True
    return events


def revise(state: dict, arc: list[dict], rules: SessionRules, arc_verdicts=None) -> list[dict]:
    """Followers of a finished arc take the nearest anchor's verdicts; an arc without one takes its own."""
    if len(arc) < 2:
        return []
    events = []
    anchors = [e if e["anchor"] else None for e in arc]
    if not any(anchors):
        if arc_verdicts is None:
            return [{"kind": "arc-without-anchor", "call_id": arc[0]["call_id"], "facet": None, "value": None, "confidence": None, "source": None}]
        arc_id = f"{arc[0]['session_id']}:{arc[0]['call_id']}"
        for entry in arc:
            events += take_over(entry, arc_verdicts(arc_id), FROM_ARC + arc_id, rules)
        return events
    for i, entry in enumerate(arc):
        if not entry["anchor"]:
            before = [a for a in anchors[:i] if a]
            anchor = before[-1] if before else next(a for a in anchors[i:] if a)
            events += take_over(entry, anchor["verdicts"], FROM_ANCHOR + anchor["call_id"], rules)
    return events


def take_over(entry: dict, verdicts: list[dict], source: str, rules: SessionRules) -> list[dict]:
    events = []
    for facet in dict.fromkeys(v["facet"] for v in verdicts):
        own = [v for v in entry["verdicts"] if v["facet"] == facet]
        if own and max(v["confidence"] for v in own) >= rules.pass1_floor:
            continue
        taken = [{**v, "source": source} for v in verdicts if v["facet"] == facet]
        entry["verdicts"] = [v for v in entry["verdicts"] if v["facet"] != facet] + taken
        events += [{"kind": "revision", "call_id": entry["call_id"], **v} for v in taken]
    return events


def flush(state: dict, rules: SessionRules, arc_verdicts=None) -> list[dict]:
    """Revises every arc whose last call does not carry a revised verdict."""
    events, rest = [], list(state["history"])
    arcs = []
    while rest:
        arc = trailing_arc(rest, rules)
        arcs.insert(0, arc)
        rest = rest[: len(rest) - len(arc)]
    for arc in arcs:
        if len(arc) > 1 and not any(v["source"].startswith((FROM_ARC, FROM_ANCHOR)) for v in arc[-1]["verdicts"]):
            events += revise(state, arc, rules, arc_verdicts)
    return events


def forget(state: dict, rules: SessionRules, reach: float | None = None) -> None:
    """Drops history no later call can reach: before the open arc, and with a strong verdict of every scalar facet
    behind it, or more than ``reach`` seconds before the last call. With a reach, what is left is bounded by the calls of
    that time and of the open arc, however weak their verdicts are."""
    history = state["history"]
    if not history:
        return
    arc = len(history) - len(trailing_arc(history, rules))
    keep = arc
    for facet in SCALAR_FACETS:
        strong = [i for i, e in enumerate(history) if (verdict_of(e, facet) or {"confidence": 0})["confidence"] >= rules.override_below]
        keep = min(keep, strong[-1] if strong else 0)
    if reach is not None:
        near = next(i for i, e in enumerate(history) if history[-1]["at"] - e["at"] <= reach)
        keep = max(keep, min(arc, near))
    state["history"] = history[keep:]


def merge_turn(tags: list[dict], fresh: list[dict], factor=0.7, floor=0.30, top_n=5) -> list[dict]:
    """Fading tags after one turn, strongest first, ties by value."""
    kept: dict[str, dict] = {}
    for t in tags:
        faded = t["confidence"] * factor
        if faded >= floor:
            kept[t["value"]] = {"value": t["value"], "confidence": round(faded, 3), "turns_since_seen": t["turns_since_seen"] + 1}
    for c in fresh:
        old = kept.get(c["value"], {"confidence": 0.0})
        kept[c["value"]] = {"value": c["value"], "confidence": max(old["confidence"], round(c["confidence"], 3)), "turns_since_seen": 0}
    return sorted(kept.values(), key=lambda t: (-t["confidence"], t["value"]))[:top_n]
