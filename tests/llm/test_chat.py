"""Chat formatting: round trips, states, repeated rows, long texts."""

import collections
import hashlib
import random
import time
import tracemalloc

from pyspark.sql import functions as F

from tidewatch.llm import chat
from tidewatch.llm.queries import PLANTED


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be <s> good"), (1, 1, "user", PLANTED), (1, 2, "assistant", "a\\[INST]\\\\"), (2, 0, "assistant", None), (2, 1, None, "x"), (2, 1, "tool", "[ROLE] y [:]"), (3, 0, "user", ""), (3, 1, "assistant", PLANTED), (None, None, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(9))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows = sorted(rows, key=lambda x: (x[0] is not None, x))
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and got[3].valid and not got[2].valid and got[2].first_error == "order"
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_escapes_are_reversible():
    template, rnd = chat.ChatTemplate(), random.Random(1)
    bits = [*template.controls, "\\", "<", "[", "]", "a", "\n", "INST]"]
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "system", "x[y", ""]), "".join(rnd.choices(bits, k=rnd.randint(0, 9)))) for _ in range(rnd.randint(1, 5))]
        formatted = "".join(s for r, t in turns for s, _ in template.segments(r, t))
        assert template.parse(formatted) == turns


def test_long_turns_in_flat_memory():
    template = chat.ChatTemplate()
    for text in ("word " * 4_000_000, "a[b<c\\" * 300_000):
        tracemalloc.start()
        began = time.perf_counter()
        formatted = "".join(s for s, _ in template.segments("user", text))
        assert template.parse(formatted) == [("user", text)]
        assert tracemalloc.get_traced_memory()[1] < 8 * len(formatted) and time.perf_counter() - began < 20
        tracemalloc.stop()


def test_cut_output_is_not_read():
    template = chat.ChatTemplate()
    whole = "".join(s for s, _ in template.segments("user", "hello"))
    for bad in (whole[:-1], whole[1:], "x" + whole, whole.replace("hello", "he[llo")):
        try:
            assert template.parse(bad) is None
        except ValueError:
            pass


def test_repeated_rows_are_turns_each(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "state": F.lit("x"), "role_": F.lit(None).cast("string")})
    made = chat.format_turns(df)
    assert [r.state for r in made.orderBy("pos").collect()] == ["ok", "turn", "turn", "turn", "ok", "turn"]
    got = chat.read_back(made).first()
    assert (got.n_turns, got.first_error, got.valid) == (6, "turn", False)
