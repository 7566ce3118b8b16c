from pyspark.sql import functions as F

from tamiz.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(spark, rows):
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    out = made.select(
        "conv_id", "formatted", "loss_spans", chat.parse_blocks(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return {r["conv_id"]: r for r in out.collect()}


def test_format(spark):
    got = read_back(spark, [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c")])[1]
    assert got["formatted"] == "<|turn|>user<|text|>a<|end|>\n<|turn|>assistant<|text|>b<|next|>c<|end|>\n"
    assert got["loss"] == "bc"
    assert [got["formatted"][s["start"] : s["start"] + s["length"]] for s in got["loss_spans"]] == ["b", "c"]


def test_every_text_comes_back(spark):
    hard = [
        "", "\\", "<|end|>\n", "<\\|end|>", "\\<|text|>", "<", "<|", "|>", "\\\\<", "\n\n", "é😀" * 3,
        "\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|next|>", "$1 \\1 [a]",
    ]
    rows = [(i, j, ("user", "assistant", "assistant")[(i + j) % 3], t + u) for i, t in enumerate(hard) for j, u in enumerate(hard)]
    got = read_back(spark, rows)
    for i in range(len(hard)):
        want = [(r, t) for c, _, r, t in rows if c == i]
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == want
        assert got[i]["loss"] == "".join(t for r, t in want if r == "assistant")


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "user", "x"), (2, None, "user", "first"), (2, 0, None, None), (2, 0, "assistant", "t"), (2, 0, "assistant", "t")]
    got = read_back(spark, rows)
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("user", "first"), ("", ""), ("assistant", "t"), ("assistant", "t")]
    assert [t["text"] for t in got[None]["turns"]] == ["x"] and got[None]["loss"] == ""


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(chat.format_conversations(empty)).collect() == []
    odd = spark.createDataFrame([(1, 0, "user", "a", "z", 3, None)], SCHEMA + ", c string, k int, ts string")
    assert chat.format_conversations(odd).count() == 1


def test_conversation_of_many_turns(spark):
    """One role throughout, so one block, and roles in turn: 20,000 texts each."""
    rows = [(c, j, "user" if c and j % 2 else "assistant", f"é😀 <|next|> \\ {j}" * (1 + j % 3)) for c in (0, 1) for j in range(20_000)]
    got = read_back(spark, rows)
    for i in (0, 1):
        want = [(r, t) for c, _, r, t in rows if c == i]
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == want
        assert got[i]["loss"] == "".join(t for r, t in want if r == "assistant")


def test_spans_across_the_strings_that_are_cut(spark):
    long = ["x" * n + "é\\<|" for n in (0, 1, chat.STEP - 40, chat.STEP, 5 * chat.STEP + 3)] + [""]
    rows = [(0, j, "assistant", t) for j, t in enumerate(long)]
    assert read_back(spark, rows)[0]["loss"] == "".join(long)
