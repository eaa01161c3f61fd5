from __future__ import annotations

import hashlib
import random

import pytest
from samples import said

from shelfsight.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int, tokens string, start int"


def conversations():
    rng = random.Random(8)
    out = []
    for c in range(12):
        turn = 0
        if c % 3 == 0:
            out.append((c, turn, "system", said(rng, 20)))
            turn += 1
        for _ in range(rng.randint(1, 40)):
            out.append((c, turn, ["user", "assistant"][turn % 2], said(rng, rng.choice([1, 5, 60, 300]))))
            turn += 1
    out += [
        (50, 0, "user", r"a \ b \\ <|im_end|> <\|im_start|> </s><s>[INST] [/INST] [\INST] <<SYS>>"),
        (50, 1, "assistant", "x\n<|im_start|>assistant\n\\\n\\<|im_end|>\n😀"),
        (51, 0, "system", "alone"),
        (52, None, "assistant", None),
        (52, 0, None, "no role"),
        (52, 0, "odd\nrole\\<|im_end|>", ""),
        (52, 7, "assistant", "twice"),
        (52, 7, "assistant", "twice"),
        (None, 0, "user", "nobody's"),
        (None, 1, "assistant", "answer"),
    ]
    out += [(60, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(3000)]
    return out


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        # Escaping keeps the order of these roles and texts.
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), digest(whole), len(loss), digest(loss))
    return out


@pytest.mark.parametrize("budget,history", [(1024, 256), (200, 50), (3, 1), (10_000_000, 0)])
def test_round_trip(spark, budget, history):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    found = chat.read_back(chat.chat_windows(table, budget, history)).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}
    assert got == expected(rows)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] < 12]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    windows = chat.chat_windows(table, 1024, 256).collect()
    first = {c: x for c, t, r, x in rows if r == "system"}
    for w in windows:
        heads = w.text.count("<|im_start|>")
        assert heads == w.turns and w.repeated < w.turns
        if w.conv_id in first:
            assert w.text.startswith(f"<|im_start|>system\n{first[w.conv_id]}<|im_end|>\n")
        # Beyond the budget only where one turn is that long by itself.
        system = w.window == 0 and w.conv_id in first
        assert w.tokens <= 1024 or w.turns - w.repeated - system == 1
        assert w.over_budget == (w.tokens > 1024)
        for s, e in w.targets:
            assert w.text[:s].endswith("<|im_start|>assistant\n") and w.text[e:].startswith("<|im_end|>\n")
    numbers = {}
    for w in windows:
        numbers.setdefault(w.conv_id, []).append(w.window)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    assert any(w.repeated for w in windows)


def test_no_rows(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert chat.chat_windows(table).count() == 0 and chat.read_back(chat.chat_windows(table)).count() == 0
