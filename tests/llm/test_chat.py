"""Chat formatting: marks and escapes read back, spans of turns, templates that rewrite history, edge rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookflow.llm import chat

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE x] ", "\\", "<", "[", "/s>", " ", "é", "\n", "ok", "", ""]), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "tool", "a] b", "ünï"])
FIELDS = "conv_id long, turn long, role string, text string, formatted int, turns string, t int"


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(ROLES, PIECES), max_size=6))
def test_marked_template_reads_back_and_spans_hold_the_texts(turns):
    out, spans, rewritten = chat.locate(chat.render_marked, turns)
    assert chat.parse_marked(out) == turns and rewritten == []
    assert [chat.unescape(out[s[2] : s[3]]) for s in spans] == [t for _, t in turns]
    assert [0, *[s[1] for s in spans]][:-1] == [s[0] for s in spans] and (not spans or spans[-1][1] == len(out))


@given(PIECES)
def test_no_control_string_is_left_in_an_escaped_text(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE", "[/ROLE]"))


def system_moves(turns):
    """The system text stands before the last user turn, wherever that is."""
    system = "".join(t for r, t in turns if r == "system")
    users = [k for k, (r, _) in enumerate(turns) if r == "user"]
    return "".join((f"{{{system}}}" if users and k == users[-1] else "") + f"<{r}>{t}</{r}>" for k, (r, t) in enumerate(turns) if r != "system")


def forgets_thoughts(turns):
    """Only the last turn shows what stands in parentheses."""
    return "".join(f"|{r}:{t if k == len(turns) - 1 else t.split(')')[-1]}" for k, (r, t) in enumerate(turns))


def test_rewriting_templates_are_detected():
    turns = [("system", "be brief"), ("user", "hi"), ("assistant", "ho"), ("user", "hi"), ("assistant", "ho")]
    out, spans, rewritten = chat.locate(system_moves, turns)
    assert rewritten == [3] and [s and out[s[2] : s[3]] for s in spans] == [t for _, t in turns]
    out, spans, rewritten = chat.locate(forgets_thoughts, [("user", "x"), ("assistant", "(why)y"), ("user", "z")])
    assert rewritten == [2] and spans[1] is None or out[spans[1][2] : spans[1][3]] == "y"
    twice = lambda turns: "".join(f"[{t}|{t}]" for _, t in turns)
    assert chat.locate(twice, [("user", "a")])[1] == [None]
    trimmed = lambda turns: "".join(f"[{t.strip()}]" for _, t in turns)
    out, spans, _ = chat.locate(trimmed, [("user", " a "), ("assistant", "b")])
    assert [out[s[2] : s[3]] for s in spans] == ["a", "b"]


ROWS = [
    (1, 1, "assistant", "yes </s>"), (1, 0, "user", "is it [INST]?"), (1, None, "system", None), (2, 0, None, ""), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"),
    (None, 5, "user", "alone"), (None, 4, "assistant", "too"), (3, 0, "assistant", "x" * 300_000), (4, 0, "user", " probe"),
]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, 7, "clash", 1) for r in ROWS], FIELDS).repartition(3)


def test_rows_against_a_plain_version(conversations):
    held = {}
    for k, (c, turn, role, text) in enumerate(ROWS):
        held.setdefault(c if c is not None else f"row {k}", []).append((turn is not None, turn, role or "", text or ""))
    want = []
    for c, found in held.items():
        turns = [(r[2], r[3]) for r in sorted(found)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((None if isinstance(c, str) else c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.render_marked(turns))))
    got = [tuple(r) for r in chat.summary(conversations).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_spans_and_empty_table(spark, conversations):
    for r in chat.formatted(conversations).collect():
        assert r["rewritten"] == [] and [chat.unescape(r["formatted"][s["text_start"] : s["text_end"]]) for s in r["spans"]] == [t["text"] for t in r["turns"]]
        assert r["loss_texts"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
    assert chat.summary(spark.createDataFrame([], FIELDS)).collect() == []
    probe = {r["conv_id"]: r for r in chat.summary(chat.hostile(spark)).collect()}[-1]
    assert probe["n_turns"] == 2 and probe["loss_chars"] == 21
