"""Conversation structure repair by cheapest edits over a suffix-shared automaton.

Each row of a conversation is one symbol: what has to go, or its role's initial, small where the text is whole and capital
where it is truncated.  The cheapest edits of what is left of a conversation depend on that suffix of its signature and
on the state of the grammar only, so distinct signatures are sorted from their ends and suffixes shared: every node (a
distinct suffix) gets its cost-to-go and the first edit of its best audit once for each grammar state, whatever number of
conversations and signatures run through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, sent_by_bytes, written

BLANK, WHOLE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Grammar (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; a conversation may end in 0 and 3.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state after a made row, whose role follows from the state.
MADE, NAMES = (2, 2, 3, 2), {2: "user", 3: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
Node = tuple[tuple[int, str], ...]  # for each state: cost-to-go and first edit


def with_inserts(own: list[tuple[int, str]]) -> Node:
    """own: the best without an insert before, for each state.  Costs decide, then the initials of edits."""
    ends = own[2:]
    made = [min(ends[0], (INSERT + ends[1][0], "I")), min(ends[1], (INSERT + ends[0][0], "I"))]
    return (*(min(x, (INSERT + made[0][0], "I")) for x in own[:2]), *made)


END = with_inserts([(0, ""), (NEVER, ""), (NEVER, ""), (0, "")])


def before(symbol: str, node: Node) -> Node:
    """The node of a suffix that begins with symbol and goes on with node's."""
    role, more = symbol.lower(), TRUNCATED * symbol.isupper()
    own = []
    for state in range(4):
        ways = [(DELETE + node[state][0], "D")]
        if symbol != "x":
            ways.append((REROLE + more + node[MADE[state]][0], "R"))
            to = NEXT[role][state] if role in NEXT else None
            if to is not None:
                ways.append((more + node[to][0], "K"))
        own.append(min(ways))
    return with_inserts(own)


class SuffixAutomaton:
    """Nodes of the signature last asked for, from its end; what the next one shares with it is not made again."""

    def __init__(self) -> None:
        self.last, self.nodes, self.made = "", [END], 0

    def best(self, signature: str) -> tuple[int, str]:
        """Cost and audit.  Signatures that come sorted from their ends make each distinct suffix once."""
        shared, most = 0, min(len(self.last), len(signature))
        while shared < most and self.last[-1 - shared] == signature[-1 - shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reversed(signature[: len(signature) - shared]):
            self.nodes.append(before(symbol, self.nodes[-1]))
            self.made += 1
        self.last = signature
        state, audit, at = 0, [], len(signature)
        while (edit := self.nodes[at][state][1]) != "":
            audit.append(edit)
            if edit in "IR":
                state = MADE[state]
            elif edit == "K":
                state = NEXT[signature[len(signature) - at].lower()][state]
            at -= edit != "I"
        return self.nodes[-1][0][0], "".join(audit)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by crc32(`conv_id:turn`) % 20; nulls in key, role and text are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    after = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), after.alias("text"), copies.alias("copy")).drop("copy")


def judged(df: DataFrame) -> DataFrame:
    """The rows with pos (from 1, by turn with nulls first, then role and text), fault, symbol and illegal (the pair with the row before).

    One shuffle, by conversation; rows before a row are never gathered, Spark sorts and spills.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    rows = rows.withColumns({"pos": F.row_number().over(order), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(again, "duplicate").when(~F.col("text").rlike(WHOLE), "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.withColumn("fault", fault).withColumn("symbol", symbol)


def audits(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of the distinct signatures, sorted from their ends so that shared suffixes meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in by_bytes(batches):
            own = batch.column(0).to_pylist()
            found = [automaton.best(s) for s in own]
            yield pa.record_batch([pa.array(own, pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])

    from_end = F.reverse("signature")
    dealt = signatures.select("signature").distinct().repartitionByRange(from_end).sortWithinPartitions(from_end)
    return sent_by_bytes(dealt).mapInArrow(run, "signature string, cost long, audit string")


class Repairing:
    """Takes a conversation's audit, then its rows in order, and says which role:text rows come out."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def made(self) -> Iterator[tuple[str, str]]:
        """Inserts that stand next."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, MADE[self.state]
            yield NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.made()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self.state = MADE[self.state]
            yield NAMES[self.state], text
        elif edit == "K":
            self.state = NEXT[role[0]][self.state]
            yield role, text


def headed(df: DataFrame) -> DataFrame:
    """Per conversation one row at pos 0 with its figures, and its cost and audit in front of its rows, sorted within partitions."""
    rows, _ = written(judged(df), "judged")
    count = lambda c: F.count_if(c).alias
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    # The audit, an output of one string for each conversation, has a character a row; so has the signature.
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("signature")
    faults = [count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")]
    by = rows.groupBy("conv_id")
    plain = by.agg(*faults, count(F.col("illegal"))("illegal"), gaps, joined)
    heads, _ = written(plain, "signatures")
    heads = heads.join(audits(heads), "signature").select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return heads.unionByName(rows.select("conv_id", "pos", "role", "text"), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn (from 1), role, text of the repaired conversations; a conversation that loses all rows is not there.

    Rows go through one by one, the audit ahead of them, so that a conversation of any length takes little memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, turn = None, None, 0
        for batch in by_bytes(batches):
            out: list[tuple] = []

            def put(rows: Iterator[tuple[str, str]]) -> None:
                nonlocal turn
                for role, text in rows:
                    turn += 1
                    out.append((conv, turn, role, text))  # noqa: B023

            for conv_id, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pos == 0:
                    if now:
                        put(now.made())
                    conv, now, turn = conv_id, Repairing(text), 0
                else:
                    put(now.row(role, text))
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text"])
        if now and (rest := list(now.made())):
            yield pa.record_batch([pa.array([conv] * len(rest), pa.int64()), pa.array(range(turn + 1, turn + 1 + len(rest)), pa.int64()), pa.array([r for r, _ in rest]), pa.array([t for _, t in rest])], names=["conv_id", "turn", "role", "text"])

    return sent_by_bytes(headed(df)).mapInArrow(run, "conv_id long, turn long, role string, text string")


def repaired(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in df.

    Nulls in role and text are one space; a null turn comes first; rows of one turn are taken by role and text; rows
    without a conv_id are one conversation; repeated rows are duplicates.  A role whose initial is not s, u or a, or
    that is empty, can only be rerolled or deleted.  An empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, hashed, any_ = None, (), hashlib.sha256(), False
        names = ["conv_id", *FIGURES, "audit", "repaired_sha256"]
        kinds = [*[pa.int64()] * (1 + len(FIGURES)), pa.string(), pa.string()]

        def put(rows: Iterator[tuple[str, str]]) -> None:
            nonlocal any_
            for role, text in rows:
                hashed.update((("\n" if any_ else "") + f"{role}:{text}").encode("utf-8"))
                any_ = True

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

        for batch in by_bytes(batches):
            out: list[tuple] = []
            for conv_id, pos, role, text, *figures in zip(*(batch.column(i).to_pylist() for i in range(4 + len(FIGURES))), strict=True):
                if pos == 0:
                    if now:
                        put(now.made())
                        out.append((*head, hashed.hexdigest()))
                    now, head, hashed, any_ = Repairing(text), (conv_id, *figures, text), hashlib.sha256(), False
                else:
                    put(now.row(role, text))
            yield table(out)
        if now:
            put(now.made())
            yield table([(*head, hashed.hexdigest())])

    schema = f"conv_id long, {', '.join(f'{n} long' for n in FIGURES)}, audit string, repaired_sha256 string"
    return sent_by_bytes(headed(df)).mapInArrow(run, schema)


def repaired_after_damage(df: DataFrame) -> DataFrame:
    """repaired(damaged(df)) for every conv_id of df; one that loses all rows to the damage gets zeros, an empty audit and the hash of nothing."""
    found = repaired(damaged(df)).withColumnRenamed("conv_id", "own")
    ids = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    known = ids.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    none: dict[str, Column] = {**{n: F.lit(0).cast("long") for n in FIGURES}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return known.select("conv_id", *[F.coalesce(F.col(n), x).alias(n) for n, x in none.items()])
