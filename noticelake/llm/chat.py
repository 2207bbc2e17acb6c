"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans.

A window holds the system turn, some turns before its own as history, and its own turns; only the assistant's texts among
its own turns are targets, so each is trained on once. A conversation may have any number of turns: its prefix sums are
put together from those of range partitions, and its windows are chosen within blocks of a bounded number of tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticelake.llm.common import size_in_words, stage

BUDGET = 512
HISTORY = 128
#: Tokens a turn's marks count for; so a block has a bounded number of turns.
TURN_COST = 4
#: Tokens of a block of windows, in budgets.
BLOCK = 16
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"
# A turn is written <turn:ROLE>, a line feed, its text, </turn> and a line feed. In roles and texts a backslash stands
# before \, < and >, so no mark can be spelled inside them, and taking one backslash off each gives the text back.
_ESCAPED = re.compile(r"([\\<>])")
_UNESCAPED = re.compile(r"\\([\\<>])")
_TURN = re.compile(r"<turn:((?:[^\\<>]+|\\.)*)>\n((?:[^\\<>]+|\\.)*)</turn>\n", re.DOTALL)

_WINDOW = "conv_id long, block long, part int, text string, loss array<struct<a:int,b:int>>, n_repeated int, n_own int, n_tokens long"


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], first_target: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns, and the spans of the assistant's texts from turn ``first_target`` on, in characters."""
    parts, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body, tail = f"<turn:{escape(role)}>\n", escape(text), "</turn>\n"
        if role == TARGET_ROLE and i >= first_target:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts, as they were before formatting."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def choose_windows(costs: list[int], n_before: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """``(first of history, first own, end)`` of windows over turns of these costs, the first ``n_before`` being history only.

    Each own turn is in one window, as its own. A window has as many turns as the budget allows beside the system turn,
    one at least; of the turns before it, as many of the last as fit with its first own turn and cost at most ``history``.
    """
    sums = np.concatenate(([0], np.cumsum(costs)))
    out, at = [], n_before
    while at < len(costs):
        room = budget - system
        back = max(0, min(history, room - costs[at]))
        start = min(at, int(np.searchsorted(sums, sums[at] - back, side="left")))
        end = max(at + 1, int(np.searchsorted(sums, sums[start] + room, side="right")) - 1)
        out.append((start, at, end))
        at = end
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition, place in it, and tokens of the conversation before the turn in it."""
    part, place, held, before = TaskContext.get().partitionId(), 0, (), 0
    for batch in batches:
        sums = []
        for conv, cost in zip(batch.column("conv_id").to_pylist(), batch.column("cost").to_pylist(), strict=True):
            if held != (conv,):
                held, before = (conv,), 0
            sums.append(before)
            before += cost
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(np.full(n, part), pa.int32()),
                pa.array(np.arange(place, place + n), pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            names=[*batch.schema.names, "pid", "place", "local"],
        )
        place += n


def with_prefix_sums(conversations: DataFrame) -> DataFrame:
    """``conv_id, role, text, cost, pid, place, before``: turns in order, with the tokens of their conversation before them.

    Sorted ranges of turns are summed apart; a conversation that spans several gets its sums from one row per range.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("cost", size_in_words() + TURN_COST)
    # The salt deals equal turns out, whose order does not matter.
    order = ["conv_id", "turn", "role", F.md5("text"), F.monotonically_increasing_id()]
    numbered = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text", "cost")
        .mapInArrow(_number, "conv_id long, role string, text string, cost long, pid int, place long, local long"),
        "turns",
    )
    totals = numbered.groupBy("conv_id", "pid").agg(F.sum("cost").alias("total"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("conv_id").alias("base_id"), F.col("pid").alias("base_pid"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")
    )
    same = numbered["conv_id"].eqNullSafe(bases["base_id"]) & (numbered["pid"] == bases["base_pid"])
    return numbered.join(bases, same).select(
        "conv_id", "role", "text", "cost", "pid", "place", (F.col("base") + F.col("local")).alias("before")
    )


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations: ``conv_id, block, part, text, loss, n_repeated, n_own, n_tokens``.

    ``(block, part)`` orders the windows of a conversation. The first ``n_repeated`` turns of a window are the system turn
    and history, repeated and masked; ``loss`` spans the targets. A turn counts its words and ``TURN_COST``; one above
    the budget is a window alone, whole. The system turn is the first turn if its role is system. Turns are ordered by
    turn, role and text, NULL first; a NULL role or text is empty, and NULL conversations are one.
    """
    size = BLOCK * budget
    turns = with_prefix_sums(conversations).withColumn("block", F.floor(F.col("before") / size).cast("long"))
    system = turns.where((F.col("before") == 0) & (F.col("role") == SYSTEM_ROLE)).select(
        F.col("conv_id").alias("system_id"), F.col("text").alias("system_text"), F.col("cost").alias("system_cost")
    )
    # A turn that can be history of the next block goes there too.
    blocks = F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("own")))
    both = F.when(
        F.col("before") >= (F.col("block") + 1) * size - history,
        F.concat(blocks, F.array(F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))),
    ).otherwise(blocks)
    placed = turns.select("conv_id", "role", "text", "cost", "pid", "place", "before", F.explode(both).alias("b")).select(
        "conv_id", "role", "text", "cost", "pid", "place", "before", "b.*"
    )
    joined = placed.join(system, placed["conv_id"].eqNullSafe(system["system_id"]), "left").select(
        *placed.columns,
        # The first block has the system turn as its own.
        F.when(F.col("block") > 0, F.col("system_text")).alias("system_text"),
        F.coalesce("system_cost", F.lit(0)).alias("system_cost"),
        (F.col("system_id").isNotNull() & (F.col("before") == 0)).alias("is_system"),
    )
    ordered = joined.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pid", "place")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [
                        ("conv_id", pa.int64()),
                        ("block", pa.int64()),
                        ("part", pa.int32()),
                        ("text", pa.string()),
                        ("loss", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        ("n_repeated", pa.int32()),
                        ("n_own", pa.int32()),
                        ("n_tokens", pa.int64()),
                    ]
                ),
            )

        held: list[dict] = []
        rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["conv_id"], r["block"])):
            turns = list(group)
            first = turns[0]
            lead = None
            if first["is_system"]:
                lead = (SYSTEM_ROLE, first["text"], first["cost"])
            elif first["system_text"] is not None:
                lead = (SYSTEM_ROLE, first["system_text"], first["system_cost"])
            opening = first["is_system"] and first["own"]
            body = turns[1:] if first["is_system"] else turns
            costs = [t["cost"] for t in body]
            spans = choose_windows(costs, sum(not t["own"] for t in body), lead[2] if lead else 0, budget, history)
            if opening and not spans:
                spans = [(0, 0, 0)]
            for part, (start, own, end) in enumerate(spans):
                chosen = [(t["role"], t["text"]) for t in body[start:end]]
                if lead:
                    chosen.insert(0, lead[:2])
                repeated = own - start + bool(lead) - (opening and part == 0)
                text, loss = format_turns(chosen, own - start + bool(lead))
                held.append(
                    {
                        "conv_id": first["conv_id"],
                        "block": first["block"],
                        "part": part,
                        "text": text,
                        "loss": [{"a": a, "b": b} for a, b in loss],
                        "n_repeated": repeated,
                        "n_own": len(chosen) - repeated,
                        "n_tokens": sum(costs[start:end]) + (lead[2] if lead else 0),
                    }
                )
            if len(held) > 500:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return ordered.mapInArrow(windows, _WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Turns are parsed from the text, without the repeated ones. A digest takes a conversation's turns in order, so one
    task reads a conversation, window by window; it never holds more than one batch.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

        for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
            turns, loss, n, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in group:
                size += len(r["text"])
                for role, text in parse_turns(r["text"])[r["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in r["loss"]:
                    text = unescape(r["text"][span["a"] : span["b"]])
                    n_loss += len(text)
                    loss.update(text.encode())
            done.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), size))
            if len(done) > 2_000:
                yield out()
                done = []
        if done:
            yield out()

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
