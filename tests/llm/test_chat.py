import hashlib

from satzwerk.llm import chat

EVENT = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_a_log_folds_to_its_final_turns(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "delta", "assistant", "he"),
        (1, 3, 1, "delta", None, "o"),
        (1, 2, 1, "delta", None, "ll"),
        (1, 4, 2, "message", "user", "old question"),
        (1, 5, 3, "message", "assistant", "old answer"),
        (1, 6, 0, "edit", "user", "hi there"),
        (1, 7, 1, "regenerate", "assistant", None),
        (1, 8, 1, "delta", None, "good "),
        (1, 9, 1, "delta", None, "day"),
        (1, 10, 2, "message", "user", "new question"),
        (2, 0, 0, "message", None, None),
        (None, 0, 0, "delta", "user", "no id"),
    ]
    found = chat.fold(spark.createDataFrame(log, EVENT)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, 0, "user", "hi there"), (1, 1, "assistant", "good day"), (1, 2, "user", "new question"), (2, 0, "", ""), (None, 0, "user", "no id")],
        key=repr,
    )


HOSTILE = [
    "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<", "<|role|>user<|text|>x<|end|>", " [/INST]", "[INST] ", "", "a\n\n", "<\\/s>", "<s>é😀</s", "$1 \\1",
]


def test_any_text_comes_back(spark):
    rows = []
    for conv, role in enumerate(["user", "assistant", "system", "<|text|>", "", "a\nb", None]):
        rows += [(conv, turn, role if turn % 3 else "assistant", text) for turn, text in enumerate(HOSTILE + [None])]
    rows.append(rows[0])
    rows.append((None, None, None, None))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.render(chat.fold(chat.as_events(frame)))
    found = {r.conv_id: r for r in chat.digests(formatted).collect()}
    order = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        assert found[conv].n_turns == len(turns)
        assert found[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), sha(loss))
    lengths = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    assert {c: r.formatted_chars for c, r in found.items()} == lengths


def test_spans_cover_the_assistant_alone(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<s>"), (1, 2, "assistant", "")]
    [row] = chat.render(chat.fold(chat.as_events(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).collect()
    assert row.formatted == "[INST] a [/INST]b<\\s></s></s>"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == ["b<\\s>", ""]


def test_no_python_runs(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    done = chat.digests(chat.render(chat.fold(chat.as_events(frame))))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert done.collect() == []
