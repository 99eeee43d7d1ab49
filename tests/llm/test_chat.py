import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import chat


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "</s>[INST] ok [/INST]"), ("user", "<\\/s> <s> [ROLE]x[/ROLE]"), ("assistant", "[\\\\ROLE] <|im_end|> <\\\\s>")],
    2: [("assistant", "")],
    3: [("</s>", "é🤖 $1 \\ \\\\"), ("assistant", "a\nb"), ("assistant", "a\nb"), ("system", "x")],
    4: [("user", ""), ("", "no role")],
}


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_round_trip_of_rows(spark):
    rows = [(c, k, r or None, t or None) for c, turns in CONVERSATIONS.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(chat.format_chats(chat.turns_of_rows(table))).collect()}
    assert got == {c: digests(t) for c, t in CONVERSATIONS.items()}
    assert chat.chat_digests(chat.format_chats(chat.turns_of_rows(table.where("false")))).collect() == []
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_rows(table.drop("turn").withColumn("formatted", F.lit(1)))
    more = table.withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    assert chat.turns_of_rows(more, columns=("conv_id", "turn", "role", "text")).count() == 4
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(chat.format_chats(chat.turns_of_rows(more))).collect()}
    assert got == {c: digests(t) for c, t in CONVERSATIONS.items()}


def test_random_control_strings_round_trip(spark):
    rng = random.Random(2)
    bits = ["<", "[", "\\", "/", "s>", "ROLE]", "INST]", "|", "</s>", "<s>", "a", "\n", "[/ROLE]"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, [("assistant", t), (t, "x")]) for i, t in enumerate(texts)], f"conv_id long, turns {chat.TURNS}")
    back = chat.format_chats(df).select("conv_id", chat.parsed(F.col("formatted")).alias("turns"), F.col("formatted"))
    for r in back.collect():
        t = texts[r.conv_id]
        assert [tuple(x) for x in r.turns] == [("assistant", t), (t, "x")]
        assert r.formatted.count(chat.END) == r.formatted.count(chat.BEGIN) == 2


def test_layouts_by_fingerprint(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, turns),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, turns),
        ({"response": "a", "prompt": "q"}, turns),
        ({"instruction": "q", "output": "a"}, turns),
        ({"instruction": "s", "input": "q", "output": "a"}, [("system", "s"), *turns]),
        ({"instruction": "s", "input": "", "output": "a"}, [("system", "s"), ("assistant", "a")]),
        ({"question": "q", "answer": None}, [("user", "q")]),
        ({"question": "q", "answer": {"text": "a"}}, None),
        ({"other": 1}, None),
        ([1], None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(98, "{no json"), (99, None)]
    df = spark.createDataFrame(rows, "conv_id long, json string")
    got = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical_turns(df, keep=("conv_id",)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(records)} | {98: None, 99: None}


def test_loss_spans_are_places_in_the_text(spark):
    df = spark.createDataFrame([(1, [("user", "é"), ("assistant", "ab</s>"), ("assistant", "c")])], f"conv_id long, turns {chat.TURNS}")
    r = chat.format_chats(df).select("formatted", chat.loss_spans(F.col("formatted")).alias("spans")).first()
    assert [r.formatted[s.start : s.end] for s in r.spans] == ["ab<\\/s>", "c"]


def test_deeper_layouts_have_other_fingerprints(spark):
    def record(content):
        return {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": content}]}

    contents = ["a", [{"type": "text", "text": "a"}], {"text": "a"}, {"body": "a"}, ["a"], [["a"]], []]
    records = [*map(record, contents), {"messages": [[{"role": "user", "content": "q"}]]}, {"messages": []}, {"prompt": "q", "response": "a"}, {"prompt": "q", "response": "a", "messages": []}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, json string")
    got = {r.conv_id: r for r in chat.canonical_turns(df, keep=("conv_id",)).collect()}
    assert len({r.fingerprint for r in got.values()}) == len(records)
    assert {i for i, r in got.items() if r.turns is not None} == {0, 9}


def test_tables_are_mapped_by_hash(spark):
    table = spark.createDataFrame([(1, 0, "human", "q")], "id long, turn long, `from` string, value string")
    own = chat.schema_fingerprint(table.schema)
    assert own == spark.range(1).select(chat.fingerprint(F.lit(",".join(chat.field_paths(table.schema))))).first()[0]
    assert own in chat.TURN_TABLES and [tuple(t) for t in chat.turns_of_rows(table).first().turns] == [("user", "q")]
    deep = spark.createDataFrame([], "conv_id long, turn long, role string, text struct<a:string>")
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_rows(deep)
