"""A ledger of calls: sent, done or error, with a cost. The same rules over a table and over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "n long, state string, at timestamp, ms long, model string, tokens_in long, tokens_out long, usd double"


def running(rows: DataFrame, key: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """Each row's number and spend so far within its key, and whether that passes the cap."""
    so_far = Window.partitionBy(key).orderBy(*order)
    spent = F.sum(cost).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"n": F.row_number().over(so_far), "spent": spent}).withColumn("over_cap", F.col("spent") > cap)


def usage(rows: DataFrame, key: str, state: str, cost: str) -> DataFrame:
    """Calls by state and their cost; works on a stream too, in update mode."""
    is_ = lambda x: F.col(state) == x
    return rows.groupBy(key).agg(F.count_if(is_("click")).alias("sent"), F.count_if(is_("purchase")).alias("done"), F.count_if(is_("error")).alias("failed"), F.coalesce(F.sum(F.when(is_("purchase"), F.col(cost))), F.lit(0.0)).alias("usd"))


def once(calls: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream of calls without repeats of a key within the delay: the result cache's rule."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def read_stream(spark, path: str) -> DataFrame:
    """Appended JSON lines as a stream."""
    return spark.readStream.schema(SCHEMA).json(path)


def admit(calls: DataFrame, key: str, calls_cap: int, usd_cap: float, reserve: float) -> DataFrame:
    """A decision for each call that asks to be sent: ``n`` (its number, null if refused), ``refused`` (null, "calls" or "usd"), ``spent`` before it.

    ``calls`` is a stream of (key, call, state, at, usd); a table is read as one, in micro-batches. Row by row in order of (at, call, asked before done), a
    call of state "sent" is let through while fewer than ``calls_cap`` were and the dollars spent, with ``reserve`` for it
    and each call in flight, stay within ``usd_cap``. "done" ends a call and spends its dollars (null: none), "error" ends
    it. Such rows of calls that are not in flight, and rows without a call or of another state, count for nothing; nor does
    a second "sent" of a call in flight. Null keys are one key.

    State is a few numbers and the calls in flight of each key. A stream's rows are put in order within a micro-batch,
    which has to hold one key's rows in memory (bound it by the source's rate); a row that comes later is taken as it comes.
    """

    def decide(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, spent, flying = state.get if state.exists else (0, 0.0, [])
        flying = set(flying)
        rows = pd.concat(list(parts)).dropna(subset=["call"])
        rows["step"] = (rows["state"] != "sent").astype(int)
        out = []
        for call, what, usd in rows.sort_values(["at", "call", "step"], kind="stable")[["call", "state", "usd"]].itertuples(index=False):
            if what == "sent" and call not in flying:
                refused = "calls" if n + 1 > calls_cap else "usd" if spent + reserve * (len(flying) + 1) > usd_cap else None
                if refused is None:
                    n += 1
                    flying.add(call)
                out.append((group[0], call, None if refused else n, refused, spent))
            elif what in ("done", "error") and call in flying:
                flying.remove(call)
                spent += usd if what == "done" and pd.notna(usd) else 0.0
        state.update((n, spent, sorted(flying)))
        found = pd.DataFrame(out, columns=[key, "call", "n", "refused", "spent"])
        yield found.astype({"n": "Int64"})

    kind = calls.schema[key].dataType.simpleString()
    rows = calls.select(F.col(key), F.col("call").cast("string").alias("call"), "state", "at", F.col("usd").cast("double").alias("usd"))
    return rows.groupBy(key).applyInPandasWithState(decide, f"{key} {kind}, call string, n long, refused string, spent double", "n long, spent double, flying array<string>", "append", GroupStateTimeout.NoTimeout)
