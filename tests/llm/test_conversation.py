import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from auditspark.llm import conversation, queries

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     *[T.StructField(n, T.StringType()) for n in ("audit", "digest", "n", "code", "meta.lang")]])
LEGAL = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], ROWS)


def damaged(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept[conv]
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        role = "user" if mark == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if mark == 3 else 1)
    for conv in kept:
        kept[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return kept


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits by trying all of them, at most two inserts in a row (three in a row never pay)."""
    marks = faults(rows)
    best = {("", ""): (0, ())}  # role initials, audit -> cost, lines; all kept

    def inserted(now):
        out = dict(now)
        for _ in range(2):
            for (roles, audit), (cost, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    key, value = (roles + role[0], audit + "I"), (cost + 2, (*lines, f"{role}:"))
                    if key not in out or out[key] > value:
                        out[key] = value
        return out

    for (_, role, text), mark in zip(rows, marks):
        after = {}
        for (roles, audit), (cost, lines) in inserted(best).items():
            options = [("D", "", 3, ())]
            if mark not in ("blank", "duplicate"):
                extra = 1 if mark == "truncated" else 0
                options += [("K", role[:1] or "?", extra, (f"{role}:{text}",))]
                options += [("R", to[0], 2 + extra, (f"{to}:{text}",)) for to in ("user", "assistant")]
            for letter, initial, more, line in options:
                key, value = (roles + initial, audit + letter), (cost + more, lines + line)
                # A prefix of no legal sequence is of no use.
                if re.fullmatch(r"s?(ua)*u?", key[0]) and (key not in after or after[key] > value):
                    after[key] = value
        best = after
    whole = [(cost, audit, lines) for (roles, audit), (cost, lines) in inserted(best).items() if LEGAL.fullmatch(roles)]
    return min(whole)


def expected(rows):
    out = {}
    for conv, own in damaged(rows).items():
        marks = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = brute(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("blank"), marks.count("duplicate"),
                     marks.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in df.collect()}


def test_against_all_edits(spark, monkeypatch):
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", "uma", None]
    texts = ["Yes.", "no", "What?", " \n", "", None, "é!", "Yes. \t", "stop"]
    rows = [(c, rng.choice([None, t, t, t, t + 3]), rng.choices(roles, (6, 6, 2, 1, 1, 1, 1))[0], rng.choice(texts))
            for c in [None, *range(150)] for t in range(rng.randint(1, 5))]
    rows += [(900, 1, "user", "Same."), (900, 1, "user", "Same."), (900, 1, "user", "Same."), (900, 2, "assistant", "End")]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "Gone.")]
    monkeypatch.setattr(queries, "table", lambda *a: frame(spark, rows))
    out = queries.op11_conversation_repair(spark, "")
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    result = got(out)
    assert result == expected(rows)
    assert result[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_checkpoints_give_the_plain_result():
    """Long sequences: same cost and audit as a walk over all stored vectors."""
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 17, 400, 2500):
        codes = bytes(rng.choice([1, 2, 3, 2, 3, 2 | 4, 3 | 4, 0, 2 | 8, 3 | 8]) for _ in range(n))
        vectors = [conversation._with_inserts(list(conversation.END))]
        for code in reversed(codes):
            vectors.append(conversation._before(code, vectors[-1]))
        vectors.reverse()
        cost, audit = conversation.repair(codes)
        assert cost == vectors[0][0]
        state, spent, at = 0, 0, 0
        for letter in audit:
            spent += {"D": 3, "I": 2, "K": 0, "R": 2}[letter]
            if letter != "I":
                code, at = codes[at], at + 1
            if letter in "IR":
                state = conversation._NEXT[state]
            if letter == "K":
                state = conversation._AFTER[state][code & 3]
                assert state >= 0
            if letter in "KR":
                assert not code & 8
                spent += 1 if code & 4 else 0
            assert spent + vectors[at][state] == cost  # every step is tight
        assert at == n and state in (0, 3)


def test_one_long_conversation(spark):
    """A third of all rows in one conversation, half of them one repeated row."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(2000)]
    rows += [(1, 5000, "user", "Again.")] * 2000
    rows += [(c, 0, "user", "Hello.") for c in range(2, 300)] + [(c, 1, "assistant", "Fine.") for c in range(2, 300)]
    out = got(conversation.repair_conversations(conversation.intact(frame(spark, rows))))
    assert out[1][2] == 1999 and out[1][5] == 3 * 1999 + 2 and out[1][6][:2000] == "K" * 2000
    assert sorted(out[1][6][2000:]) == ["D"] * 1999 + ["I", "K"] and all(out[c][6] == "KK" for c in range(2, 300))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty_and_null(spark, rows):
    out = got(conversation.repair_conversations(conversation.damage(frame(spark, rows))))
    assert len(out) == len(rows)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a" * 3_000_000 + "."), (1, 1, "assistant", " " * 1_000_000)]
    out = got(conversation.repair_conversations(conversation.intact(frame(spark, rows))))
    assert out[1][1] == 1 and out[1][3] == 0
