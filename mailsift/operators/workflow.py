"""The case workflow: one table of transitions, what refuses an action, and requests applied in order.

``NEXT`` is the whole state machine: of each action, the states it applies to and the state it leads to
(None: the case stays as it is). Single requests (``refusal``), tables of them (``decided``), ordered
updates (``updates``) and the stream's fold (``streaming.state``) all read it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("open", "in_review", "escalated", "resolved")
RESOLUTIONS = ("confirmed_phishing", "released")
NEXT: dict[str, tuple[tuple[str, ...], str | None]] = {
    "claim": (("open",), "in_review"),
    "unclaim": (("in_review",), "open"),
    "escalate": (("in_review",), "escalated"),
    "resolve": (("in_review", "escalated"), "resolved"),
    "reopen": (("resolved",), "open"),
    "comment": (STATES, None),
}
BLOCK = 0.8
#: Requests of a case that are put in order at a time.
SLICE = 1000


def refusal(action: Column, block: float = BLOCK) -> Column:
    """Why an action is refused, or null. Reads state, role, owns, note, resolution and score of the row.

    The caller's role comes first, then what the action needs of the case, of the caller and of the request.
    """
    state, note = F.col("state"), F.coalesce(F.trim("note"), F.lit("")) != ""
    admin = F.col("role") == "admin"
    mine = F.coalesce(F.col("owns"), F.lit(False)) | admin
    fits = lambda name: state.isin(*NEXT[name][0])
    release = F.when(~note, "note_required").when((F.col("score") >= block) & ~admin, "needs_admin")
    resolve = (
        F.when(~F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False)), "resolution_required")
        .when((state == "escalated") & ~admin, "needs_admin")
        .when((state == "in_review") & ~mine, "not_assignee")
        .when(~fits("resolve"), "illegal_state")
        .when(F.col("resolution") == "released", release)
    )
    rules = {
        "comment": F.when(~note, "note_required"),
        "claim": F.when(~fits("claim"), "illegal_state"),
        "unclaim": F.when(~fits("unclaim"), "illegal_state").when(~mine, "not_assignee"),
        "escalate": F.when(~fits("escalate"), "illegal_state").when(~mine, "not_assignee").when(~note, "note_required"),
        "resolve": resolve,
        "reopen": F.when(~fits("reopen"), "illegal_state").when(~admin, "needs_admin").when(~note, "note_required"),
    }
    why = F.lit("unknown_action")
    for name, rule in rules.items():
        why = F.when(action == name, rule).otherwise(why)
    return F.when(~F.coalesce(F.col("role").isin("analyst", "admin"), F.lit(False)), "not_permitted").otherwise(why)


def decided(requests: DataFrame, block: float = BLOCK) -> DataFrame:
    """Requests (action, state, role, owns, note, resolution, score, ...) with refused, or next_state."""
    to = F.col("state")
    for name, (_, after) in NEXT.items():
        to = F.when(F.col("action") == name, F.lit(after) if after else F.col("state")).otherwise(to)
    return requests.withColumn("refused", refusal(F.col("action"), block)).withColumn("next_state", F.when(F.col("refused").isNull(), to))


def _run(requests: str, start: str) -> str:
    """SQL: the state after the requests of an ordered array, from a start."""
    return f"aggregate({requests}, {start}, (s, r) -> if(r.expected = s, r.next, s))"


def updates(cases: DataFrame, requests: DataFrame, size: int = SLICE) -> DataFrame:
    """(request_id, case_id, state, applied, new_state, refused): compare-and-set requests, applied to each case in order of request_id.

    A request (request_id, case_id, expected, next) is applied where the case's state at its turn is the
    expected one, and is ``stale`` otherwise. What a run of requests does to a case is a map from each state to
    another, and maps of neighbouring runs compose; so a case's requests are cut into slices by their ids, each slice is
    summed up to its map by itself, only the maps of a case (one row a slice) meet in order, and then
    the slices are replayed from their first states. However many requests one case has, no task holds more than a slice of
    them, beside one row of four states for each slice.

    Defined cases: requests on unknown cases are left out; null expected states never fit; request ids
    are distinct whole numbers.
    """
    x = requests.join(cases.select("case_id", F.col("state").alias("_first")), "case_id")
    x = x.groupBy("case_id", "_first", F.floor(F.col("request_id") / size).alias("_slice")).agg(F.array_sort(F.collect_list(F.struct("request_id", "expected", "next"))).alias("_r"))
    maps = x.select("case_id", "_first", "_slice", *(F.expr(_run("_r", f"'{s}'")).alias(f"from_{s}") for s in STATES))

    at = {s: i for i, s in enumerate(STATES)}

    def chain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of whole cases in order: a case begins in its first state, and its next slice where the one before it leads."""
        last, state = (), None
        for part in parts:
            firsts, leads, found = part.column("_first").to_pylist(), [part.column(f"from_{s}").to_pylist() for s in STATES], []
            for i, case in enumerate(part.column("case_id").to_pylist()):
                if (case,) != last:
                    last, state = (case,), firsts[i]
                found.append(state)
                state = leads[at[state]][i] if state in at else state
            yield pa.RecordBatch.from_arrays([part.column("case_id"), part.column("_slice"), pa.array(found, pa.string())], ["case_id", "_slice", "_start"])

    kind = requests.schema["case_id"].dataType.simpleString()
    starts = maps.repartition("case_id").sortWithinPartitions("case_id", "_slice").mapInArrow(chain, f"case_id {kind}, _slice long, _start string")
    step = "named_struct('s', if(r.expected = a.s, r.next, a.s), 'o', concat(a.o, array(struct(r.request_id as request_id, a.s as before, coalesce(r.expected = a.s, false) as applied))))"
    empty = "cast(array() as array<struct<request_id:{0},before:string,applied:boolean>>)".format(requests.schema["request_id"].dataType.simpleString())
    replayed = x.join(starts, ["case_id", "_slice"]).withColumn("_o", F.expr(f"aggregate(_r, named_struct('s', _start, 'o', {empty}), (a, r) -> {step}, a -> arrays_zip(a.o, _r))"))
    y = replayed.select("case_id", F.explode("_o").alias("x")).select("case_id", F.col("x.o.request_id").alias("request_id"), F.col("x.o.before").alias("state"), F.col("x.o.applied").alias("applied"), F.col("x._r.next").alias("_next"))
    return y.select("request_id", "case_id", "state", "applied", F.when(F.col("applied"), F.col("_next")).otherwise(F.col("state")).alias("new_state"), F.when(~F.col("applied"), "stale").alias("refused"))
