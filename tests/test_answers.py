import pytest
from pyspark.sql import functions as F

from stratalens.functions import choices, prompts
from stratalens.functions.text import list_notation, strip
from stratalens.operators import accuracy

# Response and 1-based option; -1 where there is no answer.
RESPONSES = {
    "Question\nAnswer: A": 1, "Answer:": -1, "Answer: ": -1, "no colon": -1, "x: B: c": 2, "  Answer:  C and more \n ": 3,
    "Answer: D": 4, "Answer: b": 34, "Answer: 2": -14, "Answer: ?": -1, "Answer: \U0001F600": 128448, "": -1, "   ": -1,
    "Answer: A\nlast line": -1, "a\r\nAnswer: B": 2, "Answer: E\u3000": 5, "Answer: \u00e9": 169, "Answer:A:B": 1,
}


def test_parsing(spark):
    df = spark.createDataFrame([(r,) for r in RESPONSES], "response string")
    parsed = choices.parsed_or_mark(choices.parse_choice(F.col("response"), index_base=1))
    assert [r[0] for r in df.select(parsed).collect()] == list(RESPONSES.values())


def test_bases_and_marks(spark):
    df = spark.createDataFrame([("Answer: B",), ("Answer: 3",), ("none",)], "response string")
    letter = choices.parse_choice(F.col("response"))
    digit = choices.parse_choice(F.col("response"), marks="digit")
    assert [tuple(r) for r in df.select(letter, digit).collect()] == [(1, 17), (-14, 2), (None, None)]


def test_strip_takes_every_python_blank(spark):
    texts = ["  a b  \t", "\x1fz\x85", "plain", " \n ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_list_notation_equals_python(spark):
    lists = [
        ["a", "it's", 'say "x"', """both ' and " """, "back\\slash", "new\nline", "tab\t\r", "nbsp ", "\x07bell"],
        [], ["é", "中", "\U0001F600", "​", " ", ""],
    ]
    df = spark.createDataFrame([(x,) for x in lists], "x array<string>")
    assert [r[0] for r in df.select(list_notation(F.col("x"))).collect()] == [str(x) for x in lists]


def test_list_notation_takes_no_text_apart(spark):
    """Stretches without an unprintable character stay in one piece; only those characters stand alone."""
    lists = [["a\u00a0b", "\u3000\u3000", "x\n\u200by'\t", " \x85 \U000e0001é\U0001f600", "\\n\n\x7f", "\ue000"], ["plain 'text'\n" * 2000]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<string>").select(list_notation(F.col("x")).alias("shown"))
    assert [r[0] for r in df.collect()] == [str(x) for x in lists]
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_prompts(spark):
    options = ["red", "it's", 'a "b"']
    df = spark.createDataFrame(
        [("Why?", options, (options, [0, 0, 1]))],
        "question string, choices array<string>, mc1_targets struct<choices: array<string>, labels: array<int>>",
    )
    lettered = """Question: Why?
A. red
B. it's
C. a "b"
Answer:"""
    headed = "Choose the correct answer from the options below.\n" + lettered
    assert prompts.format_items(df, "mmlu").first().prompt == headed
    bare = df.select(prompts.mmlu_prompt(F.col("question"), F.col("choices"), header=False)).first()[0]
    assert bare == lettered
    assert prompts.format_items(df, "truthfulqa").first().prompt == """Question: Why?
1. red
2. it's
3. a "b"
Answer:"""
    ctx = df.withColumnsRenamed({"question": "ctx", "choices": "endings"})
    assert prompts.format_items(ctx, "hellaswag").first().prompt == """Sentence: Why?
Options: ['red', "it's", 'a "b"']
Answer:"""


def test_thirteen_options_are_marked(spark):
    df = spark.createDataFrame([("Q", [str(i) for i in range(13)])], "question string, choices array<string>")
    assert prompts.format_items(df, "mmlu").first().prompt.endswith("L. 11\nM. 12\nAnswer:")


def test_instruction_context_line_only_when_not_blank(spark):
    data = [("do", "", "r", "c"), ("do", "  \n", "r", "c"), ("do", " some ", "r", "c")]
    df = spark.createDataFrame(data, "instruction string, context string, response string, category string")
    found = prompts.format_instructions(df)
    assert found.columns == ["prompt", "completion"]
    bare = "Instruction: do\nAnswer:"
    assert [r.prompt for r in found.collect()] == [bare, bare, "Instruction: do\nContext:  some \nAnswer:"]


def test_messages(spark):
    df = spark.createDataFrame([("Describe.",)], "prompt string")
    message = df.select(prompts.chat_messages(F.col("prompt"))).first()[0]
    assert [(m.role, [(c.type, c.text) for c in m.content]) for m in message] == [
        ("user", [("image", None), ("text", "Describe.")])
    ]
    assert df.select(prompts.plain_image_prompt(F.col("prompt"))).first()[0] == "<|image|>\nDescribe."


def test_truths(spark):
    df = spark.createDataFrame(
        [(2, 1, (["a", "b"], [0, 1]))],
        "answer int, label int, mc1_targets struct<choices: array<string>, labels: array<int>>",
    )
    found = df.select(*[choices.ground_truth(b) for b in ("mmlu", "hellaswag", "truthfulqa")]).first()
    assert tuple(found) == (2, 1, 1)
    none = spark.createDataFrame([([0, 0],)], "labels array<int>")
    with pytest.raises(Exception, match="no label 1"):
        none.select(choices.first_true_label(F.col("labels"))).collect()


def test_accuracy_and_curve(spark):
    pred = spark.createDataFrame(
        [("m", 0, 1, 1), ("m", 0, 2, 0), ("m", 1, 1, 1), ("m", 1, 2, None), ("m", 9, 1, 0)],
        "model string, n int, item_id long, predicted int",
    )
    items = spark.createDataFrame([(1, 1), (2, 0)], "item_id long, truth int")
    scored = accuracy.choice_accuracy(accuracy.match_predictions(pred, items), ["model", "n"])
    assert {r.n: (r.correct, r.total, r.accuracy) for r in scored.collect()} == {
        0: (2, 2, 1.0), 1: (1, 2, 0.5), 9: (0, 1, 0.0),
    }
    best = spark.createDataFrame([("m", 1, 3, 4)], "model string, n int, block_start int, block_end int")
    curve = accuracy.performance_curve(best, scored)
    assert {(r.n, r.block_start, r.accuracy) for r in curve.collect()} == {(0, None, 1.0), (1, 3, 0.5), (9, None, 0.0)}
    empty = accuracy.choice_accuracy(accuracy.match_predictions(pred.where("false"), items)).first()
    assert (empty.total, empty.accuracy) == (0, None)
