"""The tool guard as a stateful stream: what a session has called is kept between calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tool_guard import Policy, ordering_text, stateless_reasons

OUTPUT = "session_id string, call_index long, tool_name string, reason string, allowed boolean"

#: The tool name of a row that resets its session.
RESET = "__reset__"


class OrderGuard(StatefulProcessor):
    """Decides on order rules; its state is the set of prerequisite tools that a session has called."""

    def __init__(self, policy: Policy, audit: bool = False, keep_ms: int | None = None):
        self.rules, self.audit, self.keep_ms = [(o.prerequisite, o.dependent, ordering_text(o)) for o in policy.ordering], audit, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.called = handle.getMapState("called", "tool string", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        wanted = {p for p, _, _ in self.rules}
        # A key's rows may come in several frames; the order is over all that a batch has of it.
        frames = list(rows)
        if frames:
            out = []
            for r in pd.concat(frames).sort_values("call_index", kind="stable").itertuples(index=False):
                if r.tool_name == RESET:
                    self.called.clear()
                    continue
                reason = r.before
                if reason is None:
                    reason = next((text for p, d, text in self.rules if d == r.tool_name and not self.called.containsKey((p,))), None)
                if reason is None:
                    reason = r.after
                if r.tool_name in wanted:
                    self.called.updateValue((r.tool_name,), (True,))
                out.append((key[0], r.call_index, r.tool_name, reason, reason is None or self.audit))
            yield pd.DataFrame(out, columns=["session_id", "call_index", "tool_name", "reason", "allowed"])

    def close(self) -> None:
        pass


def guard_stream(calls: DataFrame, policy: Policy, audit: bool = False, keep_ms: int | None = None) -> DataFrame:
    """A stream of calls (session_id, call_index, tool_name, arguments) to a stream of verdicts.

    Rules that need no history are Column expressions ahead of the state. In audit mode every call is
    allowed and keeps its reason. A call of the tool RESET forgets its session's history and has no verdict. With
    keep_ms a tool's call is forgotten that long after it; without, sessions are kept for good. Calls are judged in the
    order of call_index within a batch; one that comes in a later batch than its followers is judged then.
    """
    before, after = stateless_reasons(policy, F.col("tool_name"), F.col("arguments"))
    none = F.lit(None).cast("string")
    ready = calls.select("session_id", "call_index", "tool_name", F.coalesce(*before, none).alias("before"), F.coalesce(*after, none).alias("after"))
    return ready.groupBy("session_id").transformWithStateInPandas(statefulProcessor=OrderGuard(policy, audit, keep_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")
