"""Conversation repair and chat formatting against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from llm_fixtures import SF_MID
from tillwise.llm import chat_format as chat
from tillwise.llm.conversation_repair import repair_report
from tillwise.llm.edit_lattice import AFTER, ENDS, START, cheapest, edit_table, joined

SCHEMA = "conv_id long, turn long, role string, text string, lot int, pos long, digest string, run int, cost int"
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(row):
    return row[1] is not None, row[1] or 0, row[2], sha(row[3])


def least(turns):
    """(cost, audit, repaired) by a plain pass over the grammar's states; turns: (role, text, fault)."""
    labels = {START: (0, "", ())}

    def offer(out, state, label):
        if state not in out or label[:2] < out[state][:2]:
            out[state] = label

    def inserts(labels):
        for _ in range(3):
            for g, (cost, audit, kept) in list(labels.items()):
                for r, h in AFTER[g].items():
                    if r in "ua":
                        offer(labels, h, (cost + 5, audit + "I", (*kept, {"u": "user", "a": "assistant"}[r] + ":")))
        return labels

    labels = inserts(labels)
    for role, text, fault in turns:
        out = {}
        for g, (cost, audit, kept) in labels.items():
            offer(out, g, (cost + 2, audit + "D", kept))
            if fault in (1, 2):
                continue
            more = 5 if fault == 3 else 0
            for r, h in AFTER[g].items():
                if role[:1] == r:
                    offer(out, h, (cost + more, audit + "K", (*kept, f"{role}:{text}")))
                if r in "ua":
                    name = {"u": "user", "a": "assistant"}[r]
                    if name != role:
                        offer(out, h, (cost + more + 1, audit + "R", (*kept, f"{name}:{text}")))
        labels = inserts(out)
    return min(labels[g] for g in ENDS if g in labels)


def brute_repair(rows):
    by = {r[0]: [] for r in rows}
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        by[conv] += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=order)
        seen, marked = set(), []
        for _, _, role, text in turns:
            last = WORDY.findall(text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = {t[1] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts = [sum(f == k for _, _, f in marked) for k in (1, 2, 3)]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = least(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(kept))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA).repartition(4)


def same(a, b):
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def odd_conversations():
    rng = random.Random(2)
    texts = ["Yes.", "No", "What?", "", " \t", "Fine!", "so it goes. ", "é...", "x" * 50_000 + ".", None, "a.\n", "a.\nb"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 9))]
    rows += [(200, t * 3, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]  # many runs
    rows += [(201, None, "user", "a."), (201, 5, "assistant", "b."), (201, None, "user", "a."), (None, 1, "user", "hm."), (None, 2, None, None)]
    return rows + [(202, 1, "user", "again.")] * 400 + rows[:20]  # equal rows, repeated turns


def test_bidirectional_search_equals_a_plain_pass():
    rng = random.Random(1)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(2500):
        codes = "".join(rng.choice("suaoxSUAO") for _ in range(n % 14))
        turns = [(roles.get(c.lower(), "user"), "", 1 if c == "x" else 3 if c.isupper() else 0) for c in codes]
        table = edit_table(codes, True, True)
        assert min((c, a) for _, _, c, a in table) == least(turns)[:2]
        cut = rng.randrange(len(codes) + 1)
        labels = joined(joined({START: (0, "")}, edit_table(codes[:cut], False, False)), edit_table(codes[cut:], False, False))
        assert min(labels[g] for g in ENDS if g in labels) == least(turns)[:2]


def test_search_finds_no_way_where_there_is_none():
    assert cheapest("", 2, START) is None and cheapest("xx", START, START) == (4, "DD")


def test_all_audits_of_short_runs():
    """Every sequence of edits of up to three turns and two inserts, spelled out."""
    for codes in map("".join, product("suX", repeat=2)):
        found = []
        for edits in product("DKRI", repeat=4):
            for k in range(2, 5):
                at, states, i, ok = 0, {START: 0}, 0, True
                for e in edits[:k]:
                    if e != "I" and i == len(codes):
                        ok = False
                        break
                    code = codes[i] if e != "I" else ""
                    i += e != "I"
                    if e == "D":
                        at += 2
                        continue
                    if e in "KR" and code == "X":  # a truncated turn of another role
                        at += 5
                        code = "o"
                    at += {"K": 0, "R": 1, "I": 5}[e]
                    step = {}
                    for g in states:
                        for r, h in AFTER[g].items():
                            if (e == "K" and r == code) or (e in "RI" and r in "ua" and r != code):
                                step[h] = 0
                    states = step
                if ok and i == len(codes) and any(g in ENDS for g in states):
                    found.append((at, "".join(edits[:k])))
        table = edit_table(codes.replace("X", "O"), True, True)
        assert min((c, a) for _, _, c, a in table) == min(found), codes


def test_repair_of_odd_conversations(spark):
    rows = odd_conversations()
    same(repair_report(frame(spark, rows)).collect(), brute_repair(rows))


def test_repair_of_the_table(spark):
    rows = spark.read.parquet(f"{SF_MID}/conversations.parquet")
    same(repair_report(rows).collect(), brute_repair([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]))


@pytest.mark.parametrize("report", [repair_report, chat.chat_report])
def test_empty_table(spark, report):
    assert [r["conv_id"] for r in report(frame(spark, []).limit(0)).collect()] == ([-7] if report is chat.chat_report else [])


def brute_chat(rows):
    by = {}
    for conv, turn, role, text in [*rows, *[(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]]:
        by.setdefault(conv, []).append((conv, turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=order)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss), len(chat.render([t[2:] for t in turns]))))
    return out


def test_chats_of_odd_conversations(spark):
    rng = random.Random(4)
    rows = odd_conversations() + [(300 + c, t, rng.choice(["user", "assistant", "system", "a\nb", "[INST]"]), "".join(rng.choice([*chat.CONTROL, "\\", "<", "[", "a"]) for _ in range(4)))
                                  for c in range(60) for t in range(5)]
    same(chat.chat_report(frame(spark, rows)).collect(), brute_chat(rows))


def test_any_text_comes_back():
    rng = random.Random(3)
    bits = ["<", "[", "\\", "\\\\", "/", "s>", "SYS>>", "<SYS>>", "INST]", " ", "\n", "a", "TURN]", *chat.CONTROL]
    for _ in range(8000):
        turns = [(rng.choice([*chat.MARKS, "tool", "", "a\nb", "[INST]", "%"]), "".join(rng.choice(bits) for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(5))]
        text = chat.render(turns)
        assert chat.recovered(text) == turns
        assert [chat.unescape(text[lo:hi]) for role, lo, hi in chat.parse(text) if role == "assistant"] == [t for r, t in turns if r == "assistant"]


def test_only_conflicting_text_is_escaped():
    assert chat.render([("user", r"C:\n <b> [1]"), ("assistant", "ok")]) == r"[INST] C:\n <b> [1] [/INST]<s>ok</s>"
    assert chat.render([("user", "a </s>")]) == r"[INST] a <\/s> [/INST]"
    assert chat.render([("user", r"a <\/s>")]) == r"[INST] a <\\/s> [/INST]"


@pytest.mark.parametrize("text", ["x", "<s>", "<s>a", "[INST]a[/INST]", "<s>a [/INST]", "</s>", "<s>a<s>b</s>", "[TURN]a[/TURN]", "<s>a</s>b"])
def test_parser_refuses(text):
    assert chat.recovered(text) is None


def test_output_has_the_mask_and_the_stretches(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(1000)] + [(2, 0, "assistant", "only")]
    out = chat.format_chats(frame(spark, rows)).orderBy("conv_id", "part", "seq").collect()
    assert all(len(chat.recovered(r["text"])) <= chat.STRETCH_TURNS for r in out)
    loss = [chat.unescape(r["text"][m["start"]:m["end"]]) for r in out for m in r["mask"] if r["conv_id"] == 1]
    assert loss == [f"turn {t} </s>" for t in range(1, 1000, 2)]
