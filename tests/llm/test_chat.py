from pyspark.sql import functions as F

from hoploom.llm import chat


def test_round_trip_and_machine(spark):
    turns = [
        (1, 0, "system", "be <|end|>\n & kind"), (1, 1, "user", "hi &lt; [INST]"), (1, 2, "assistant", "</s><|turn|>assistant\nno"),
        (2, 0, "assistant", "first"), (2, 1, "user", None),
        (3, 0, None, ""), (4, 0, "us\ner<", "x\\E"), (5, None, "user", "a"), (5, 1, "assistant", ""), (None, 0, "user", "q"),
        (6, 0, "user", "tie b"), (6, 0, "user", "tie a"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_conversations(df)
    back = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {t[0] for t in turns}:
        want = sorted([(t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv])
        assert [(t.role, t.text) for t in back[conv].turns] == [w[1:] for w in want]
        assert back[conv].loss == "".join(w[2] for w in want if w[1] == "assistant")
    assert back[1].valid and not back[2].valid and back[2].first_invalid_turn == 0
    assert not back[6].valid and back[6].first_invalid_turn == 1
    assert chat.format_conversations(df.limit(0)).count() == 0
