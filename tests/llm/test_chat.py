import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from docloom.llm import chat

marks = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>assistant", "\n", "a ", "<|"])).map("".join)


@given(st.lists(st.tuples(st.booleans(), st.one_of(st.sampled_from(["user", "assistant"]), marks), marks)))
def test_window_round_trip(turns):
    turns = sorted(turns, key=lambda t: t[0])
    text, mask = chat.format_window(turns)
    n = sum(not t[0] for t in turns)
    assert chat.parse_window(text, n) == [(r, t) for new, r, t in turns if new]
    found = [chat.unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2])]
    assert found == [t for new, r, t in turns if new and r == "assistant"]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, _, r, t in mine if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in mine)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(mine), sha(turns), len(loss), sha(loss))
    return out


def test_read_back_equals_brute_force(spark):
    r = random.Random(4)
    text = lambda: r.choice([None, "", "<|im_end|>\n", "é " * r.randint(0, 300), "word " * r.randint(0, 90)])
    rows = []
    for c in [*range(30), None]:
        n = 900 if c == 7 else r.randint(1, 12)
        for t in range(n):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", None, "to\nol"])
            rows.append((c, t, role, text(), 1))
    rows += [(3, 0, "user", "again", 1), (3, 0, "user", "again", 1), (3, None, "assistant", "no turn", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int").repartition(6)
    made = chat.windows(df)
    got = {x.conv_id: tuple(x)[1:5] for x in chat.read_back(made).collect()}
    assert got == brute(rows)
    by = {}
    for w in made.collect():
        by.setdefault(w.conv_id, []).append(w)
    assert len(by[7]) > 20
    for c, ws in by.items():
        ws.sort(key=lambda w: w.window)
        first = chat.parse_window(ws[0].formatted, 0)
        before = list(first)
        assert ws[0].n_repeated == 0
        for w in ws[1:]:
            turns = chat.parse_window(w.formatted, 0)
            system = first[:1] if first[0][0] == "system" else []
            past = before[max(len(system), len(before) - chat.HISTORY) :]
            assert turns[: w.n_repeated] == system + past
            before += turns[w.n_repeated :]
            fresh = sum(len(t.split()) + 2 for _, t in turns[w.n_repeated : -1])
            assert fresh <= chat.SPAN_TOKENS
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0
