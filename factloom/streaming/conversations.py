"""Conversations as a stream: newest value of each person's attribute, kept as state by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.catalog.joins import TEMPLATES

#: Values that the stream's state keeps of each attribute's past; the batch keeps all.
HISTORY = 100
OUT = "conv_id bigint, who string, attribute string, value string, turn int, history array<string>"
STATE = "facts string"


def statements(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, who, attribute, value) of the turns that state a fact, read by the template bank."""
    q, any_ = F.col("text"), F.lit(False)
    out: dict = {"attribute": None, "who": None, "value": None}
    for n, rx in TEMPLATES:
        any_ = any_ | q.rlike(rx)
        for k, v in (("attribute", F.lit("lives" if n == "moved" else n)), ("who", F.regexp_extract(q, rx, 1)), ("value", F.regexp_replace(F.regexp_extract(q, rx, 2), r"[.]+$", ""))):
            out[k] = F.when(q.rlike(rx), v) if out[k] is None else out[k].when(q.rlike(rx), v)
    return turns.filter(any_).select("conv_id", "turn", *[c.alias(k) for k, c in out.items()])


def upsert(facts: dict, rows: pd.DataFrame, most: int | None = None) -> set[str]:
    """Put rows into facts in order of turn; a turn that came late doesn't replace a newer value but joins the history."""
    touched = set()
    for r in rows.sort_values("turn").itertuples():
        key = f"{r.who}\x01{r.attribute}"
        old = facts.get(key)
        if old is None:
            facts[key] = {"value": r.value, "turn": int(r.turn), "history": []}
        elif r.turn >= old["turn"]:
            if r.value != old["value"]:
                old["history"].append(old["value"])
                del old["history"][: -most if most else 0]
            old |= {"value": r.value, "turn": int(r.turn)}
        elif r.value not in (old["value"], *old["history"]):
            old["history"] = [r.value, *old["history"]][:most]
        touched.add(key)
    return touched


def rows_of(conv_id: int, facts: dict, keys: set[str]) -> pd.DataFrame:
    rows = [(conv_id, *k.split("\x01"), facts[k]["value"], facts[k]["turn"], facts[k]["history"]) for k in sorted(keys)]
    return pd.DataFrame(rows, columns=["conv_id", "who", "attribute", "value", "turn", "history"])


def stream_facts(turns: DataFrame) -> DataFrame:
    """The facts that each micro-batch changes, by conversation. turns is a stream of conv_id, turn and text."""
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        facts = json.loads(state.get[0]) if state.exists else {}
        touched: set[str] = set()
        for pdf in batches:
            touched |= upsert(facts, pdf, HISTORY)
        state.update((json.dumps(facts),))
        yield rows_of(key[0], facts, touched)

    return statements(turns).groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def batch_facts(turns: DataFrame) -> DataFrame:
    """The same over a finished table: a conversation is the unit of state, as in the stream, but with its whole history."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        facts: dict = {}
        return rows_of(int(pdf["conv_id"].iloc[0]), facts, upsert(facts, pdf))

    return statements(turns).groupBy("conv_id").applyInPandas(fold, OUT)
