"""The session reducer on Structured Streaming (O-81 to O-84): commands in, activity and signals out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

LOG = 40
OUTPUT = "session string, seq long, kind string, who string, action string, detail string"
STATE = "state string"


def empty() -> dict:
    return {"seq": 0, "query": "", "searched_by": None, "searching": False, "sort": "relevance", "open": None, "saved": [], "log": []}


def reduce(state: dict, who: str | None, action: str, arg: str | None, hit: str | None = None) -> list[tuple[int, str, str | None, str, str]]:
    """Applies a command to the state; rows (seq, kind, who, action, detail) of what it logs, signals and refuses.

    hit: for a search, the document whose code alone the query found, which it opens. `begin` marks
    a search as running. Entries of the log have rising numbers; a signal or refusal has the last one.
    """
    out: list = []

    def note(what: str, detail: str) -> None:
        state["seq"] += 1
        state["log"] = [*state["log"], [state["seq"], who, what, detail]][-LOG:]
        out.append((state["seq"], "activity", who, what, detail))

    def signal(what: str, detail: str) -> None:
        if who is None:
            out.append((state["seq"], "signal", who, what, detail))

    def search(query: str) -> None:
        state.update(query=query, searched_by=who, searching=False)
        if hit is not None and query:
            state["open"] = hit
        if query:
            note("search", query)

    arg = arg or ""
    if action == "begin":
        state.update(query=arg.strip(), searched_by=who, searching=True)
    elif action == "search":
        search(arg.strip())
    elif action == "open":
        state["open"] = arg
        note("open", arg)
        signal("doc.opened", arg)
    elif action == "save" and arg not in state["saved"]:
        state["saved"] = [*state["saved"], arg]
        note("save", arg)
        signal("saved.changed", arg)
    elif action == "unsave" and arg not in state["saved"]:
        out.append((state["seq"], "error", who, "unsave", f"{arg} is not in the saved list"))
    elif action == "unsave":
        state["saved"] = [x for x in state["saved"] if x != arg]
        note("unsave", arg)
        signal("saved.changed", arg)
    elif action == "sort":
        state["sort"] = arg
        search(state["query"])
        note("sort", arg)
    elif action == "attach":
        state["open"] = None
    return out


def session_stream(commands: DataFrame) -> DataFrame:
    """commands(session, seq, who, action, arg[, hit]), streaming, to OUTPUT rows in the order of the commands' seq within each batch."""

    def step(key, frames, state):
        now = json.loads(state.get[0]) if state.exists else empty()
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            who, arg, hit = (None if pd.isna(x) else x for x in (r.who, r.arg, getattr(r, "hit", None)))
            out += [(key[0], *row) for row in reduce(now, who, r.action, arg, hit)]
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "who", "action", "detail"])

    return commands.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
