import hashlib
import itertools

from pyspark.sql import functions as F

from linkloom.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\s>", "</\\s>", "ok", "<\\/s>", "[\\\\INST]"]
NASTY = ["".join(p) for n in (1, 2, 3) for p in itertools.product(PARTS, repeat=n)]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    out = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in out)
    assert not any(c in r["e"] for r in out for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_round_trip_and_digests(spark):
    rows = [(k // 5, k % 5, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    rows += [(9999, 1, None, None), (9999, 0, "assistant", ""), (9999, 0, "assistant", ""), (None, 0, "[/INST]x", "y" * 20_000), (9998, None, "user", "a")]
    made = chat.digests(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(made) == len(groups)
    for m in made:
        turns = sorted(groups[m["conv_id"]])
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert m["round_trip_ok"] and m["n_turns"] == len(turns)
        assert m["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
        assert m["loss_chars"] == len(loss) and m["loss_sha256"] == sha(loss)


def test_plain_turns_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "<s>[INST]user[/INST]hi</s><s>[INST]assistant[/INST]yo</s>"
    at = row["loss_spans"][0]
    assert row["formatted"][at["start"] : at["start"] + at["n"]] == "yo"


def test_parser_refuses_what_is_no_turn(spark):
    df = spark.createDataFrame([("x</s>",), ("<s>[INST]u[/INST]a[INST]</s>",), ("",)], "f string")
    assert [r[0] for r in df.select(chat.parse(F.col("f"))).collect()] == [[None], [None], []]


def test_planted_conversation_without_parallelized_rows(spark):
    df = chat.with_planted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert [tuple(r) for r in df.orderBy("turn").collect()] == chat.PLANTED
    assert chat.digests(df).first()["loss_chars"] == len("</s>[INST] ok [/INST]")
