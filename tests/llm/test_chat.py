import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from noticelake.llm import chat

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


def conversations():
    rows = [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    rows += [(1, i, ("system", "user", "assistant")[0 if i == 0 else 1 + (i + 1) % 2], f"word <turn:user>\n {i} " * (i % 9)) for i in range(400)]
    rows += [(2, 0, "assistant", None), (2, 1, None, "\\<\\\\>"), (2, 1, None, "\\<\\\\>"), (2, None, "user", "")]
    rows += [(3, 0, "system", "x " * 100), (3, 1, "assistant", "y " * 300), (3, 2, "system", "late"), (4, 5, "system", "only")]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "bé")]
    return rows


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(512, 128), (20, 5), (3, 0)])
def test_round_trip(spark, budget, history):
    rows = conversations()
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget, history)
    found = {r[0]: tuple(r[1:5]) for r in chat.read_back(windows).collect()}
    assert found == expected(rows)
    for w in windows.collect():
        turns = chat.parse_turns(w["text"])
        assert len(turns) == w["n_repeated"] + w["n_own"]
        assert w["n_tokens"] <= budget or w["n_own"] == 1 or w["n_tokens"] - budget < 0 or w["n_repeated"] <= 1
        if w["conv_id"] == 1:
            assert turns[0][0] == "system"


def test_windows_respect_the_budget():
    for start, own, end in chat.choose_windows([5, 7, 3, 40, 2, 2, 9], 1, 4, 20, 6):
        costs = [5, 7, 3, 40, 2, 2, 9]
        assert sum(costs[start:end]) + 4 <= 20 or end == own + 1
        assert sum(costs[start:own]) <= 6
    own = [(a, b) for _, a, b in chat.choose_windows([5, 7, 3, 40, 2, 2, 9], 1, 4, 20, 6)]
    assert own[0][0] == 1 and own[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_escape_is_reversible():
    for text in ("", "\\", "<", "</turn>\n<turn:a>", "\\<\\\\>", "a\\", "\n\n"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.parse_turns(chat.format_turns([(text, text), ("assistant", text)], 0)[0]) == [(text, text), ("assistant", text)]


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_windows(none)).count() == 0
