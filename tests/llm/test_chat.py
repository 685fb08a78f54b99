"""Chat formatting: every text comes back from the rendered conversation."""

import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["### User:", "### Assistant: ", "### Role: ", "</turn>", "</role>", "\n</turn>\n", "\n</role>\n", "\\", "\\\\", "#", "### ", "<", "</tur", "n>", " ", "\n", "$1", "x", "É", "😀", "### user:"]


def back(spark, rows):
    """conv_id -> (turns, text under the mask, formatted, spans)."""
    made = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS piece", "3 AS `span`"))
    read = made.select("conv_id", "formatted", "spans", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.under_mask().alias("loss"))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss, r.formatted, r.spans) for r in read.collect()}


def want(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_awkward_rows(spark):
    rows = [
        (1, 0, "user", "plain"), (1, 1, "assistant", "answer"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, None, "tool\n</role>\n", "x"),
        (None, 0, "assistant", "no id"), (4, 0, "User", "</turn>"), (4, 1, "assistant", "\\### Assistant: </turn> ok"), (5, 0, "assistant", "y" * 2_000_000 + "\n</turn>\n" + "\\" * 1_000_000), (6, 0, "system", "### User: \n</turn>\n### Assistant: "),
    ]
    found = back(spark, rows)
    expected = want(rows)
    assert set(found) == set(expected)
    for c, (turns, loss, formatted, spans) in found.items():
        assert turns == expected[c]
        assert loss == "".join(t for r, t in expected[c] if r == "assistant")
        assert [s.start for s in spans] == [sum(x.length for x in spans[:i]) for i in range(len(spans))] and sum(s.length for s in spans) == len(formatted)
        masked = [formatted[s.body_start : s.body_start + s.body_length] for s in spans if s.loss]
        assert len("".join(masked)) >= len(loss)
    assert found[1][2] == "### User: plain\n</turn>\n### Assistant: answer\n</turn>\n"
    assert "\\\\### Assistant: \\</turn> ok" in found[4][2]


def test_random_texts_come_back(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(700) for t in range(rng.randint(1, 5))]
    expected = want(rows)
    for c, (turns, loss, _, _) in back(spark, rows).items():
        assert turns == expected[c] and loss == "".join(t for r, t in expected[c] if r == "assistant")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd"]), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), min_size=1, max_size=30))
def test_any_text_comes_back(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    assert back(spark, rows)[1][0] == turns


def test_parser_refuses_what_no_one_rendered(spark):
    wrong = ["### User: a", "a\n</turn>\n", "### User: a </turn>\n</turn>\n", "### User: a ### User: b\n</turn>\n", "### Role: a\n</turn>\n", "### User: a\n</turn>\nrest"]
    df = spark.createDataFrame([(x,) for x in wrong], "x string").select(chat_format.parse(F.col("x")).alias("t"))
    assert all(any(t.text is None for t in r.t) for r in df.collect())


def test_empty_table_and_no_python(spark):
    assert back(spark, []) == {}
    made = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert hashlib.sha256(b"").hexdigest() == made.select(F.sha2(chat_format.under_mask().cast("binary"), 256)).first()[0]
