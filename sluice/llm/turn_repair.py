"""Conversation structure repair by rank-compressed dynamic programming.

The cheapest edits that make a conversation's roles `(s?(ua)+)?` are found turn by
turn. A macro edit is a run of inserts and the edit of one turn; its initials, as
IIK or D, are a code word. No code word begins another one and all are ordered, so
audits of as many turns compare word by word. A layer of the program, the states
after a turn, therefore holds no audit strings: each state has its cost, its
audit's rank among those of the layer, and a pointer to its parent in the layer
before. The audit is read off the pointers afterwards.

Turns are sorted by ranges of (conversation, turn), so one long conversation lies in
many partitions. Conversations that lie in one are repaired as they stream by. Others
are cut in chunks of bounded size: each chunk is solved from every state in which it
may be entered, a fold over these small tables of costs and ranks chooses the states
between the chunks, and each chunk is then repaired by itself. Only the digest of a
conversation's whole text goes through its chunks one after the other, as SHA-256
is defined; nothing of that is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import few_rows, load, written

WHITE = " \t\n\x0b\x0c\r"
#: Turns, and characters of text, from which a run is cut into a chunk.
CHUNK, CHUNK_TEXT = 4096, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What has been given out so far, by its last role.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: The state after an inserted or reroled turn, and how many inserts end a conversation.
NEXT = (USER, USER, ASSISTANT, USER)
CLOSING = (0, 2, 1, 0)
MACROS = tuple(sorted("I" * n + edit for n in range(3) for edit in "DKR"))
LEGAL = ("su", "ua", "au")
FAR = 1 << 62

FAULTS = "blank long, duplicate long, truncated long, illegal long"
DIGEST = f"gaps long, {FAULTS}, cost long, audit string, repaired_sha256 string"
TURN = "struct<turn:long,role:string,text:string,copies:long>"


def _kept(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, if it may follow."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@lru_cache
def _moves(initial: str, deleted: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """(state before, state after, macro, cost) of all macro edits of such a turn."""
    out = []
    for code, macro in enumerate(MACROS):
        for before in range(4):
            state, cost = before, 0
            for _ in macro[:-1]:
                state, cost = NEXT[state], cost + INSERT
            if macro[-1] == "D":
                out.append((before, state, code, cost + DELETE))
            elif not deleted:
                cost += TRUNCATED * truncated
                if macro[-1] == "R":
                    out.append((before, NEXT[state], code, cost + REROLE))
                elif (after := _kept(state, initial)) is not None:
                    out.append((before, after, code, cost + KEEP))
    return out


class Run:
    """Consecutive turns of one conversation: (turn, role, text, copies), and which are the first with their role and text."""

    def __init__(self, turns: list[tuple], fresh: set[int] | None = None) -> None:
        if fresh is None:
            seen: set[tuple[str, str]] = set()
            fresh = {i for i, (_, role, text, _) in enumerate(turns) if (role, text) not in seen and not seen.add((role, text))}
        self.turns, self.kinds = turns, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.extra = 0
        for i, (_, role, text, copies) in enumerate(turns):
            bare = text.rstrip(WHITE)
            again, cut = i not in fresh, bool(bare) and bare[-1] not in ".!?"
            self.kinds.append((role[:1], not bare or again, cut))
            self.blank += copies if not bare else 0
            self.duplicate += (copies if again else copies - 1) if bare else 0
            self.truncated += bool(bare) and not again and cut
            self.illegal += copies - 1 + (i > 0 and turns[i - 1][1][:1] + role[:1] not in LEGAL)
            # copies beyond the first are blank or duplicate
            self.extra += DELETE * (copies - 1)

    def solve(self, cost: list[int], rank: list[int]) -> tuple[list[int], list[int], list[list]]:
        """Cost and rank of each state after the last turn, and each layer's (parent, macro) by state."""
        layers = []
        for kind in self.kinds:
            best: list = [None] * 4
            for before, after, code, price in _moves(*kind):
                if cost[before] < FAR:
                    key = (cost[before] + price, rank[before], code, before)
                    if best[after] is None or key < best[after]:
                        best[after] = key
            cost = [FAR if b is None else b[0] for b in best]
            order = sorted((b[1:3], q) for q, b in enumerate(best) if b is not None)
            rank = [0] * 4
            for place, (_, q) in enumerate(order):
                rank[q] = place
            layers.append([b and (b[3], b[2]) for b in best])
        return [c if c == FAR else c + self.extra for c in cost], rank, layers

    def edited(self, entry: int, layers: list[list], last: int) -> tuple[str, list[tuple[str, str, str]]]:
        """The audit, and (edit, role, text) of the turns given out, from the state at entry to the state last."""
        codes, state = [], last
        for layer in reversed(layers):
            state, code = layer[state]
            codes.append(code)
        audit, out, state = [], [], entry
        for (_, role, text, copies), (initial, _, _), code in zip(self.turns, self.kinds, reversed(codes), strict=True):
            macro = MACROS[code]
            for _ in macro[:-1]:
                state = NEXT[state]
                out.append(("I", NAMES[state], ""))
            if macro[-1] == "K":
                state = _kept(state, initial)
                out.append(("K", role, text))
            elif macro[-1] == "R":
                state = NEXT[state]
                out.append(("R", NAMES[state], text))
            audit.append(macro + "D" * (copies - 1))
        return "".join(audit), out

    def spread(self) -> tuple[int, int | None, int | None]:
        """How many different turn numbers there are, the first and the last; without nulls."""
        own = [t for t, *_ in self.turns if t is not None]
        return len(set(own)), own[0] if own else None, own[-1] if own else None


def closing(state: int) -> list[tuple[str, str, str]]:
    out = []
    for _ in range(CLOSING[state]):
        state = NEXT[state]
        out.append(("I", NAMES[state], ""))
    return out


def _ends(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """The least cost with the closing inserts, and the state that it ends in."""
    total, _, state = min((c + INSERT * CLOSING[q], rank[q], q) for q, c in enumerate(cost) if c < FAR)
    return total, state


def _gaps(different: int, first: int | None, last: int | None) -> int:
    return last - first + 1 - different if different else 0


def _lines(out: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in out)


def repaired(turns: list[tuple]) -> tuple[dict, list[tuple[str, str, str]]]:
    """A whole conversation's digest, and the (edit, role, text) given out."""
    run = Run(turns)
    cost, rank, layers = run.solve([0, FAR, FAR, FAR], [0] * 4)
    total, state = _ends(cost, rank)
    audit, out = run.edited(EMPTY, layers, state)
    out += closing(state)
    digest = {"gaps": _gaps(*run.spread()), "blank": run.blank, "duplicate": run.duplicate, "truncated": run.truncated, "illegal": run.illegal, "cost": total}
    return digest | {"audit": audit + "I" * CLOSING[state], "repaired_sha256": hashlib.sha256(_lines(out).encode()).hexdigest()}, out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        # few rows at a time become Python objects
        for start in range(0, batch.num_rows, 1024):
            yield from batch.slice(start, 1024).to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, weigh: str | None = None) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 1 + (len(row[weigh] or "") >> 10 if weigh else 0)
        if weight >= 1024:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(fields: str, like: DataFrame) -> pa.Schema:
    """The Arrow schema of a list of fields; conv is of the type that like has."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields.replace("conv ?", f"conv {like.schema['conv'].dataType.simpleString()}")))


def _mapped(df: DataFrame, function, fields: str, like: DataFrame, weigh: str | None = None) -> DataFrame:
    """df's rows through a function from dicts to dicts, partition by partition."""
    schema = _arrow(fields, like)
    return df.mapInArrow(lambda batches: _batched(function(_rows(batches)), schema, weigh), fields.replace("conv ?", f"conv {like.schema['conv'].dataType.simpleString()}"))


def _runs(direct: bool, most: int):
    """Sorted turns to digests of conversations that lie in this partition, where direct, and chunks of at most so many turns of the others."""

    def function(rows: Iterator[dict]) -> Iterator[dict]:
        part, seq, count = TaskContext.get().partitionId(), 0, 0
        held, weight, conv, cut = [], 0, None, False
        none = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "turns"))

        def chunk() -> dict:
            return none | {"conv": conv, "part": part, "seq": seq, "turns": [dict(zip(("turn", "role", "text", "copies"), t, strict=True)) for t in held]}

        for row in rows:
            if count and row["conv"] != conv:
                # the first conversation may begin in the partition before
                if cut or count == len(held) or not direct:
                    yield chunk()
                    seq += 1
                else:
                    yield none | {"conv": conv, "part": part, "seq": -1} | repaired(held)[0]
                held, weight, cut = [], 0, False
            if held and (len(held) >= most or weight >= CHUNK_TEXT):
                yield chunk()
                held, weight, cut, seq = [], 0, True, seq + 1
            conv = row["conv"]
            held.append((row["turn"], row["role"], row["text"], row["copies"]))
            weight += len(row["text"])
            count += 1
        if held:
            yield chunk()

    return function


def _as_run(row: dict) -> Run:
    return Run([(t["turn"], t["role"], t["text"], t["copies"]) for t in row["turns"]], set(row["fresh"] or ()))


def _tables(rows: Iterator[dict]) -> Iterator[dict]:
    """Each chunk from every state: costs and ranks after it, 4 for each state before, and what its counts and ends are."""
    for row in rows:
        run = _as_run(row)
        costs, ranks = [], []
        for state in range(4):
            cost, rank, _ = run.solve([0 if s == state else FAR for s in range(4)], [0] * 4)
            costs += cost
            ranks += rank
        different, first, last = run.spread()
        yield {"conv": row["conv"], "part": row["part"], "seq": row["seq"], "costs": costs, "ranks": ranks, "different": different, "first": first, "last": last, "opens": run.turns[0][1][:1], "ends": run.turns[-1][1][:1]} | {k: getattr(run, k) for k in ("blank", "duplicate", "truncated", "illegal")}


def _fold(rows: Iterator[dict]) -> Iterator[dict]:
    """The states before and after each chunk of the cheapest repair; the last chunk has the conversation's counts and cost."""

    def done(own: list[tuple], parents: list[list], totals: dict, cost: list[int], rank: list[int]) -> Iterator[dict]:
        total, state = _ends(cost, rank)
        closed = {"gaps": _gaps(totals["different"], totals["first"], totals["last"]), "cost": total} | {k: totals[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        for (conv, part, seq), parent in zip(reversed(own), reversed(parents), strict=True):
            yield {"conv": conv, "part": part, "seq": seq, "entry": parent[state], "leave": state} | dict.fromkeys(closed) | closed
            closed, state = {}, parent[state]

    own: list[tuple] = []
    for row in rows:
        if own and row["conv"] != own[-1][0]:
            yield from done(own, parents, totals, cost, rank)  # noqa: F821
            own = []
        if not own:
            parents, cost, rank = [], [0, FAR, FAR, FAR], [0] * 4
            totals, ends = {"different": 0, "first": None, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, None
        own.append((row["conv"], row["part"], row["seq"]))
        best: list = [None] * 4
        for p in range(4):
            for q in range(4):
                if cost[p] < FAR and row["costs"][4 * p + q] < FAR:
                    key = (cost[p] + row["costs"][4 * p + q], rank[p], row["ranks"][4 * p + q], p)
                    best[q] = key if best[q] is None else min(best[q], key)
        cost = [FAR if b is None else b[0] for b in best]
        parents.append([b and b[3] for b in best])
        rank = [0] * 4
        for place, (_, q) in enumerate(sorted((b[1:3], q) for q, b in enumerate(best) if b is not None)):
            rank[q] = place
        for k in ("blank", "duplicate", "truncated", "illegal"):
            totals[k] += row[k]
        totals["illegal"] += ends is not None and ends + row["opens"] not in LEGAL
        ends = row["ends"]
        # a turn number may go on in the next chunk
        totals["different"] += row["different"] - (totals["last"] is not None and totals["last"] == row["first"])
        totals["first"] = row["first"] if totals["first"] is None else totals["first"]
        totals["last"] = row["last"] if row["last"] is not None else totals["last"]
    if own:
        yield from done(own, parents, totals, cost, rank)


def _edit_chunks(turns: bool):
    def function(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            run = _as_run(row)
            _, _, layers = run.solve([0 if s == row["entry"] else FAR for s in range(4)], [0] * 4)
            audit, out = run.edited(row["entry"], layers, row["leave"])
            if row["cost"] is not None:
                audit += "I" * CLOSING[row["leave"]]
                out += closing(row["leave"])
            if turns:
                yield {"conv": row["conv"], "part": row["part"], "seq": row["seq"], "out": [{"edit": e, "role": r, "text": t} for e, r, t in out]}
            else:
                yield {k: row[k] for k in ("conv", "part", "seq", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": audit, "lines": _lines(out) if out else None}

    return function


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """Chunks in order to one digest for each conversation."""
    audit, sha, any_line = [], hashlib.sha256(), False
    for row in rows:
        audit.append(row["audit"])
        if row["lines"] is not None:
            sha.update((("\n" if any_line else "") + row["lines"]).encode())
            any_line = True
        if row["cost"] is not None:
            yield {k: row[k] for k in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
            audit, sha, any_line = [], hashlib.sha256(), False


def _sorted_runs(df: DataFrame, direct: bool) -> DataFrame:
    # repeated rows are one with a number of copies, so that they may be of any number
    once = few_rows(df, 4096).groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = ["conv", F.asc_nulls_first("turn"), "role"]
    ranged = once.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    return written(_mapped(ranged, _runs(direct, CHUNK), f"conv ?, part int, seq int, {DIGEST}, turns array<{TURN}>", df), "conversation-runs")


def _edited_chunks(runs: DataFrame, turns: bool) -> DataFrame:
    chunks = runs.where("turns is not null").select("conv", "part", "seq", "turns")
    each = chunks.select("conv", "part", "seq", F.posexplode("turns").alias("pos", "t"))
    first = each.groupBy("conv", "t.role", F.sha2("t.text", 256)).agg(F.min(F.struct("part", "seq", "pos")).alias("at")).select("at.*")
    # at most CHUNK places in a chunk
    fresh = first.groupBy("part", "seq").agg(F.collect_list("pos").alias("fresh"))
    known = written(chunks.join(fresh, ["part", "seq"], "left").select("conv", "part", "seq", "turns", "fresh"), "conversation-chunks")
    tables = _mapped(known, _tables, f"conv ?, part int, seq int, costs array<long>, ranks array<int>, different long, first long, last long, opens string, ends string, {FAULTS}", runs)
    placed = _mapped(tables.repartition("conv").sortWithinPartitions("conv", "part", "seq"), _fold, f"conv ?, part int, seq int, entry int, leave int, gaps long, {FAULTS}, cost long", runs)
    planned = known.join(placed.drop("conv"), ["part", "seq"])
    if turns:
        return _mapped(planned, _edit_chunks(True), "conv ?, part int, seq int, out array<struct<edit:string,role:string,text:string>>", runs)
    edited = _mapped(planned, _edit_chunks(False), f"conv ?, part int, seq int, gaps long, {FAULTS}, cost long, audit string, lines string", runs, "lines")
    return _mapped(edited.repartition("conv").sortWithinPartitions("conv", "part", "seq"), _digests, f"conv ?, {DIGEST}", runs)


def _named(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    copies = F.col("copies") if "copies" in (conv_id, turn, role, text) else F.lit(1).cast("long")
    plain = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return df.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), copies.alias("copies"))


def repair_conversations(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    Turns go by number, nulls first, then by role and text. A null role or text is
    one space; a null conv_id is a conversation of its own. A role is what its first
    letter says. Repeated rows are duplicates of the first. Of an empty table
    nothing comes back. Further columns are left out, whatever their names.
    """
    return _digested(_named(df, conv_id, turn, role, text)).withColumnRenamed("conv", conv_id)


def _digested(rows: DataFrame) -> DataFrame:
    runs = _sorted_runs(rows, True)
    fields = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return runs.where("turns is null").select(fields).unionByName(_edited_chunks(runs, False).select(fields))


def repaired_turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, seq, place, edit (I, K or R), role and text of the repaired conversations' turns, in the order of part, seq and place."""
    out = _edited_chunks(_sorted_runs(_named(df, conv_id, turn, role, text), False), True)
    return out.select(F.col("conv").alias(conv_id), "part", "seq", F.posexplode("out").alias("place", "t")).select(conv_id, "part", "seq", "place", "t.edit", "t.role", "t.text")


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text and copies: conversations with the contract's faults; nulls of a row are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = df.select(F.col("conv_id").alias("conv"), "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hurt.select("conv", F.col("turn").cast("long").alias("turn"), F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "conversations")
    found = _digested(damaged(given))
    both = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLE_SQL = {
    "op13_turn_repair": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), c AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, b:
           list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, b)), CAST(4294967295 AS BIGINT))) % 20 AS fate
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE fate <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), f AS (
  SELECT *, left(role, 1) AS x, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM n
), e AS (
  SELECT ins, edit, p FROM (VALUES (0), (1), (2)) a(ins), (VALUES ('K'), ('R'), ('D')) b(edit), (VALUES (0), (1), (2), (3)) c(p)
), m AS (
  SELECT *, CASE WHEN ins = 0 THEN p WHEN (ins = 1) = (p = 2) THEN 3 ELSE 2 END AS s,
         CASE ins WHEN 0 THEN '' WHEN 1 THEN CASE WHEN p = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
                  ELSE CASE WHEN p = 2 THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END END AS added
  FROM e
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM f
  UNION ALL
  SELECT conv_id, i, state, b.cost, b.audit, b.said FROM (
    SELECT conv_id, i, state, min(struct_pack(cost := cost, audit := audit, said := said)) AS b FROM (
      SELECT dp.conv_id, f.i,
             CASE m.edit WHEN 'D' THEN m.s WHEN 'R' THEN CASE WHEN m.s = 2 THEN 3 ELSE 2 END ELSE CASE f.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
             dp.cost + 3 * m.ins + CASE m.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN m.edit <> 'D' AND f.cut THEN 3 ELSE 0 END AS cost,
             dp.audit || repeat('I', m.ins) || m.edit AS audit,
             dp.said || m.added || CASE m.edit WHEN 'D' THEN '' WHEN 'R' THEN CASE WHEN m.s = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END || f.text ELSE chr(10) || f.role || ':' || f.text END AS said
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN m ON m.p = dp.state
      WHERE m.edit = 'D' OR NOT (f.blank OR f.again) AND (m.edit = 'R' OR f.x = 's' AND m.s = 0 OR f.x = 'u' AND m.s <> 2 OR f.x = 'a' AND m.s = 2)
    ) GROUP BY conv_id, i, state
  ) WHERE i IS NOT NULL
), z AS (
  SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id
), y AS (
  SELECT dp.conv_id, min(struct_pack(cost := dp.cost + CASE dp.state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
         audit := dp.audit || CASE dp.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
         said := dp.said || CASE dp.state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END)) AS b
  FROM dp JOIN z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.i = dp.i GROUP BY dp.conv_id
), t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum(CASE WHEN blank THEN 1 ELSE 0 END) AS blank, sum(CASE WHEN again AND NOT blank THEN 1 ELSE 0 END) AS duplicate,
         sum(CASE WHEN cut AND NOT again AND NOT blank THEN 1 ELSE 0 END) AS truncated,
         sum(CASE WHEN i > 1 AND before || x NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
  FROM f GROUP BY conv_id
), o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, CAST(coalesce(t.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(t.blank, 0) AS BIGINT) AS blank, CAST(coalesce(t.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(t.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(t.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(y.b.cost, 0) AS BIGINT) AS cost,
       coalesce(y.b.audit, '') AS audit, sha256(coalesce(substr(y.b.said, 2), '')) AS repaired_sha256
FROM o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM o.conv_id
"""
}
