"""Pairs with shared prefixes, and masks that cut out the trained turns."""

from tidebar.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pair_id string, a int, t int"


def test_pairs(spark):
    x = ("z", 1, 2)
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "so?"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "so?"), (1, 3, "assistant", "bad"), (1, 3, "assistant", "bad"),
            (2, 0, "user", "a"), (2, 1, None, None), (3, 0, "user", "a"), (4, 0, "user", "alone"), (7, 0, "system", "only rejected"), (None, 0, "user", "nobody's")]
    got = {r["pair_id"]: r for r in chat.format_pairs(spark.createDataFrame([r + x for r in rows], SCHEMA)).collect()}
    r = got[0]
    assert r["n_prompt"] == 3 and r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nso?<|end|>\n"
    assert r["chosen"] == "<|assistant|>\ngood<|end|>\n" and r["rejected"] == "<|assistant|>\nbad<|end|>\n"
    s = r["chosen_mask"][0]
    assert r["chosen"][s["start"] : s["end"]] == "good<|end|>"
    assert got[1]["n_prompt"] == 1 and got[1]["chosen"] == "<|user|>\n<|end|>\n" and got[1]["rejected"] == "" and got[1]["rejected_mask"] == []
    assert (got[2]["chosen_id"], got[2]["rejected_id"], got[2]["rejected"], got[2]["n_prompt"]) == (4, None, None, 0)
    assert (got[3]["chosen_id"], got[3]["chosen"]) == (None, None)
    assert len(got) == 4


def test_negative_numbers_pair_up(spark):
    rows = [(i, 0, "user", f"{i}", "z", 1, 2) for i in (-2, -1, 0, 1)]
    got = {r["pair_id"]: (r["chosen_id"], r["rejected_id"]) for r in chat.format_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {-1: (-2, -1), 0: (0, 1)}


def test_answers_of_the_next_conversation(spark):
    x = ("z", 1, 2)
    rows = [(-1, 0, "user", "q"), (-1, 1, "assistant", "a"), (0, 0, "user", "p"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b"), (0, 2, "user", "more"), (0, 3, "assistant", "c"), (0, 4, None, None),
            (1, 0, "assistant", "c"), (2, 0, "user", "no answer"), (5, 0, "user", "u"), (5, 1, "assistant", "v"), (None, 0, "user", "nobody's")]
    got = {r["pair_id"]: r for r in chat.format_answers(spark.createDataFrame([r + x for r in rows], SCHEMA)).collect()}
    assert set(got) == {-1, 0, 1, 2, 5}
    assert (got[-1]["rejected_id"], got[-1]["n_prompt"], got[-1]["prompt"], got[-1]["chosen"], got[-1]["rejected"]) == (0, 1, "<|user|>\nq<|end|>\n", "<|assistant|>\na<|end|>\n", "<|assistant|>\nc<|end|>\n")
    assert (got[0]["rejected_id"], got[0]["n_prompt"], got[0]["chosen"], got[0]["rejected"]) == (1, 5, "", "")  # the same answer: all is prompt
    assert (got[1]["rejected_id"], got[1]["n_prompt"], got[1]["chosen"], got[1]["rejected"]) == (5, 0, "<|assistant|>\nc<|end|>\n", "<|assistant|>\nv<|end|>\n")  # 2 has no answer, 3 and 4 aren't there
    assert got[2]["n_prompt"] == 0 and got[2]["chosen"] == "<|user|>\nno answer<|end|>\n" and got[2]["rejected"] is None
    assert got[2]["rejected_id"] is None and got[5]["rejected_id"] is None


def test_sparse_numbers_over_buckets(spark):
    """Numbers far apart and runs without answers: only the last conversation with an answer has no rejected side."""
    ids = [i * i * 37 - 5000 for i in range(60)]
    silent = {ids[k] for k in (3, 4, 5, 6, 20, 41, 59)}
    rows = [r for i in ids for r in [(i, 0, "user", f"q{i}", "z", 1, 2), *([] if i in silent else [(i, 1, "assistant", f"a{i}", "z", 1, 2)])]]
    answered = [i for i in ids if i not in silent]
    want = {i: None for i in ids} | dict(zip(answered, answered[1:], strict=False))
    for bucket_rows in (1, 7, 1000):
        got = {r["pair_id"]: r for r in chat.format_answers(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows).collect()}
        assert {i: r["rejected_id"] for i, r in got.items()} == want
        assert all(r["rejected"] == f"<|assistant|>\na{want[i]}<|end|>\n" for i, r in got.items() if want[i] is not None)


def test_prompts_are_found_in_the_table(spark, smoke_dir):
    got = chat.query(spark, smoke_dir).select("n_prompt", "rejected_id").collect()
    assert sum(r["n_prompt"] > 0 for r in got) > 0.5 * len(got)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    for out in (chat.format_pairs(df), chat.format_answers(df)):
        assert out.count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
