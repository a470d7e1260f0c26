import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import chat as C

pieces = st.lists(st.sampled_from(["\\", "#", "### ", "</turn>", "\n", ": ", ":", "User", "=", "x", "é😀", " "]), max_size=12).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "User", ""]), pieces)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(roles, pieces), max_size=5))
def test_round_trip(messages):
    text, spans = C.render(messages)
    assert C.parse(text) == messages
    assert "".join(C.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in messages if r == "assistant")


def test_fold():
    ev = [("message", "m1", "user", "hi"), ("delta", "m2", "assistant", "he"), ("delta", "m2", None, "llo"), ("message", "m3", "user", "more"), ("edit", "m1", None, "hey"), ("delta", "m4", "assistant", "a"),
          ("regenerate", "m4", None, None), ("delta", "m4", None, "b"), ("edit", "zz", None, "?"), ("message", None, "user", "x"), ("message", None, "user", "x"), ("message", "m9", "user", "gone"), ("delete", "m9", None, None)]
    assert C.fold(ev) == [("user", "hey"), ("assistant", "b")] + [("user", "x")] * 2


def test_query_rows(spark):
    rows = [(1, 1, "assistant", "b ### </turn>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "tool: x", "\\"), (None, 0, "user", "n"), (None, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.digests(C.format_chats(C.events_of_turns(df))).collect()}
    kinds = {r["kind"] for r in C.events_of_turns(df).collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    assert set(got) == {1, 2, None} and got[1]["n_turns"] == 4
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nassistant\nb ### </turn>\n\n\n").hexdigest()
    assert got[1]["loss_chars"] == 13 and got[None]["loss_chars"] == 0
    assert C.format_chats(C.events_of_turns(df.limit(0))).count() == 0


def test_turns_come_back_from_their_log(spark):
    """Brute force over turns with ties, repeats, nulls, clashing columns, text ids and a very long text."""
    import random

    rng = random.Random(2)
    rows = [(f"c{rng.randint(0, 9)}", rng.randint(0, 6), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["", None, "x", "héllo 😀 ### a: </turn>", "w " * rng.randint(1, 40)]), 5, 6, 7, 8) for _ in range(300)]
    rows += [("long", 0, "user", "q", 1, 1, 1, 1), ("long", 1, "assistant", "\\é " * 700_000, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, seq long, kind long, message long, formatted long").repartition(5)
    got = {r["conv_id"]: r for r in C.digests(C.format_chats(C.events_of_turns(df))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == sum(len(t) for role, t in turns if role == "assistant")
        assert got[conv]["formatted_chars"] == sum(len(C.render([t])[0]) for t in turns)
    one = got["long"]
    assert one["loss_sha256"] == hashlib.sha256(("\\é " * 700_000).encode()).hexdigest()
    ordered = [(i, i, ["user", "assistant"][i % 2], t, 0, 0, 0, 0) for i, t in enumerate(["a", "b\nc", "", "d" * 10])]
    d = spark.createDataFrame([("k", *r[1:]) for r in ordered], df.schema)
    want = hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in ordered).encode()).hexdigest()
    assert C.digests(C.format_chats(C.events_of_turns(d))).first()["turns_sha256"] == want
