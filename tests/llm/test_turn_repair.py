import hashlib
import itertools
import random
import re

import pytest

from sluice.llm import turn_repair
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = ["user", "assistant", "system", "tool", " ", "User", ""]
TEXTS = ["Well.", "Why?", "so on", "", " \n", "!", "a. \x0b"]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def exhaustive(rows):
    """(cost, audit, lines) of the cheapest of all edit scripts with at most two inserts in a row; rows: (role, text) in order."""
    seen, kinds = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        kinds.append((blank or (role, text) in seen, not blank and (role, text) not in seen and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)))
        seen.add((role, text))
    inserts = ["", "u", "a", "ua", "au", "uu", "aa"]
    name, best = {"u": "user", "a": "assistant"}, None
    per_row = []
    for (role, text), (gone, cut) in zip(rows, kinds, strict=True):
        own = [(4, "D", "", [])]
        if not gone:
            own.append((3 * cut, "K", role[:1] or "-", [f"{role}:{text}"]))
            own += [(3 + 3 * cut, "R", to, [f"{name[to]}:{text}"]) for to in "ua"]
        per_row.append([(3 * len(i) + c, "I" * len(i) + e, i + x, [f"{name[y]}:" for y in i] + lines) for i in inserts for c, e, x, lines in own])
    for script in itertools.product(*per_row, [(3 * len(i), "I" * len(i), i, [f"{name[y]}:" for y in i]) for i in inserts]):
        if re.fullmatch("(s?(ua)+)?", "".join(s[2] for s in script)):
            key = (sum(s[0] for s in script), "".join(s[1] for s in script))
            if best is None or key < best[:2]:
                best = (*key, [line for s in script for line in s[3]])
    return best


def test_by_all_edit_scripts():
    rng = random.Random(4)
    for _ in range(40):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(4))]
        cost, audit, lines = exhaustive(rows)
        digest, out = turn_repair.repaired([(i, *r, 1) for i, r in enumerate(rows)])
        assert (digest["cost"], digest["audit"]) == (cost, audit)
        assert [f"{r}:{t}" for _, r, t in out] == lines
        assert digest["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in (*range(convs), None):
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.85:
                rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(ROLES[:5]), rng.choice([*TEXTS, f"turn {turn}.", f"turn {turn}"])))
    return rows + [r for r in rows if rng.random() < 0.1]


def plain(rows):
    by, out = {}, {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    for conv, own in by.items():
        own = in_order(own)
        digest, turns = turn_repair.repaired([(*r, 1) for r in own])
        # counts in plain words
        initials = [r[1][:1] for r in own]
        numbers = [r[0] for r in own if r[0] is not None]
        assert digest["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert digest["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert digest["blank"] == sum(not r[2].strip() for r in own)
        assert digest["duplicate"] == sum(bool(r[2].strip()) and any(r[1:] == s[1:] for s in own[:i]) for i, r in enumerate(own))
        out[conv] = (digest, turns)
    return out


@pytest.mark.parametrize("most", [3, 4096])
def test_chunks_agree_with_whole_conversations(spark, monkeypatch, most):
    monkeypatch.setattr(turn_repair, "CHUNK", most)
    rows = made(6, 12, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    got = turn_repair.repair_conversations(df).collect()
    assert {r["conv_id"]: {k: r[k] for k in FIELDS} for r in got} == {k: d for k, (d, _) in want.items()} and len(got) == len(want)
    turns = turn_repair.repaired_turns(df).orderBy("part", "seq", "place").collect()
    for conv, (_, out) in want.items():
        assert [(r["edit"], r["role"], r["text"]) for r in turns if r["conv_id"] == conv] == out


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "CHUNK", 50)
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", f"turn {i}."])) for i in range(3000)]
    rows += [(7, 5, "user", "again and again.")] * 400
    got = turn_repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    digest = plain(rows)[7][0]
    assert len(got) == 1 and {k: got[0][k] for k in FIELDS} == digest


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, 3, "user", "x " * 50_000), (None, 1, "assistant", "so."), (3, 1, "system", "be kind.")]
    df = spark.createDataFrame([(*r, 1, "x", [2]) for r in rows], SCHEMA + ", cost int, audit string, turns array<int>")
    got = {r["conv_id"]: r for r in turn_repair.repair_conversations(df).collect()}
    assert (got[1]["audit"], got[1]["blank"], got[1]["cost"], got[1]["gaps"]) == ("DD", 2, 8, 0)
    # to drop a cut-off turn is cheaper than to keep and to answer it
    assert (got[2]["audit"], got[2]["truncated"], got[2]["cost"]) == ("D", 1, 4)
    assert got[None]["audit"] == "IK" and got[3]["audit"] == "D"
    assert turn_repair.repair_conversations(df.where("false")).count() == 0
    assert turn_repair.repaired_turns(df.where("false")).count() == 0


def test_conversations_that_damage_empties(spark, tmp_path):
    rows = spark.sql("SELECT id AS conv_id, 0L AS turn, 'user' AS role, 'Hm.' AS text FROM range(60)")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = turn_repair.op13_turn_repair(spark, str(tmp_path)).collect()
    gone = [r for r in got if r["audit"] == ""]
    assert len(got) == 60 and gone
    for r in gone:
        assert [r[k] for k in FIELDS[:6]] == [0] * 6 and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_whole_table_covers_every_conversation(spark):
    got = [r["conv_id"] for r in turn_repair.op13_turn_repair(spark, SF).collect()]
    want = [r[0] for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()]
    assert sorted(got) == sorted(want)
