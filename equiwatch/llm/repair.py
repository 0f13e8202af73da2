"""Conversation structure repair: faults, cheapest edits and the repaired messages.

1. Each message becomes one symbol (``blocks.py``).  Whether role and text were seen
   earlier is found with partial aggregates over their digests, so a message that
   a conversation repeats without end is one row before the shuffle.
2. Symbols are sorted within conversations and pass through a task in a stream.  A
   task keeps one byte a message of the conversation at hand, no text, and gives
   back its edits as a string of initials (D delete, I insert, K keep, R new role).
3. That string and the messages meet in the same order; texts pass through one
   at a time.

Defined cases: a null role or text is one space; messages of one turn number follow
by role, then by two hashes of the text (null turns first); rows that repeat
are duplicates; a null conversation id is a conversation of its own; a
conversation whose rows are all absent has no edits; a role's first character is
its initial (an empty role has none and can't be kept); extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import materialize
from .arrowtext import tidy
from .blocks import KEPT, NOTHING, ROLE, THEN, BlockTable, symbol

SPACED = r"[^\x20\x09-\x0D]"
WHOLE_END = r"[.!?][\x20\x09-\x0D]*\z"
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1
ORDER = ("conv_id", "kind", "turn", "role", "t1", "t2")


def _named(messages: DataFrame, key: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Our own column names only, nulls as one space, hashes of the text."""
    def spaced(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    t = spaced(text)
    return messages.select(
        F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), spaced(role).alias("role"),
        t.alias("text"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(29), t).alias("t2"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"), F.lit(1).alias("kind"))


def _flagged(rows: DataFrame) -> DataFrame:
    """Small rows without texts, with what tells the faults; ``later``: its role and text have an earlier turn number."""
    small = rows.select(
        "conv_id", "kind", "turn", "role", "t1", "t2", "present", (~F.col("text").rlike(SPACED)).alias("blank"),
        (~F.col("text").rlike(WHOLE_END)).alias("cut_short"),
        *[F.xxhash64(F.lit(k), "conv_id", F.col("conv_id").isNull(), "role", "t1", "t2").alias(f"g{k}") for k in (1, 2)])
    # A turn that is null comes first, so the least turn decides only where there is none.
    first = small.where("present").groupBy("g1", "g2").agg(
        F.count(F.lit(1)).alias("_n"), F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_null")
    ).where("_n > 1").drop("_n")
    later = F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_least"))
    return small.join(first, ["g1", "g2"], "left").withColumn("later", F.coalesce(later, F.lit(False)))


class _Audit:
    """What a conversation's messages add up to."""

    def __init__(self):
        self.symbols = bytearray()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.before = self.least = self.last = self.initial = None

    def add(self, turn, role, blank, cut_short, later, same) -> None:
        duplicate = not blank and (later or same == self.before)
        truncated = not blank and not duplicate and cut_short
        for name, has in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.faults[name] += has
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        if turn is not None:
            self.turns += turn != self.last
            self.least = turn if self.least is None else self.least
            self.last = turn
        self.before, self.initial = same, initial
        self.symbols.append(symbol(initial, truncated, blank or duplicate))

    def row(self, table: BlockTable) -> dict:
        cost, audit = table.cheapest_edits(bytes(self.symbols))
        gaps = 0 if self.least is None else min(MOST, self.last - self.least + 1 - self.turns)
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit}


def audit_conversations(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text", present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation.

    Rows for which ``present`` is false only name their conversation.
    """
    return _audits(_named(messages, key, turn, role, text, present))


def _audits(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _flagged(rows).repartition(n, "conv_id").sortWithinPartitions(*ORDER)

    def run(batches):
        now, state, type_, table = None, None, None, BlockTable()

        def batch(done):
            return pa.RecordBatch.from_pylist(done, schema=pa.schema(
                [("conv_id", type_), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                 ("audit", pa.string())]))

        for b in batches:
            type_, done = b.schema.field(0).type, []
            for conv, live, turn_, role_, t1, t2, *flags in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append({"conv_id": now, **state.row(table)})
                    now, state = conv, _Audit()
                if live:
                    state.add(turn_, role_, *flags, (turn_, role_, t1, t2))
            if done:
                yield batch(done)
        if state is not None:
            yield batch([{"conv_id": now, **state.row(table)}])

    return ordered.select("conv_id", "present", "turn", "role", "t1", "t2", "blank", "cut_short", "later").mapInArrow(
        tidy(run), f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                   "cost bigint, audit string")


def repair_conversations(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The audits, and one row per edit: conv_id, position, edit, turn, role, text.

    Rows of edit D are the messages deleted, as they were; the others, by position,
    are the repaired conversation.  Rows of a conversation lie in order in one
    partition.
    """
    rows = _named(messages, key, turn, role, text, present)
    audits = materialize(_audits(rows))
    kind = rows.schema["conv_id"].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The edits come before the messages of their conversation.
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"),
                          F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("t1"),
                          F.lit(0).cast("bigint").alias("t2"))
    both = heads.unionByName(rows.where("present").drop("present"))
    ordered = both.repartition(n, "conv_id").sortWithinPartitions(*ORDER)

    def run(batches):
        audit, at, position, state, now = "", 0, 0, NOTHING, None
        out: list[list] = [[] for _ in range(6)]

        def write(*values):
            nonlocal position
            for column, value in zip(out, (now, position, *values), strict=True):
                column.append(value)
            position += 1

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = THEN[state]
                write("I", None, ROLE[state], "")
                at += 1

        for b in batches:
            for conv, head, turn_, role_, text_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if head == 0:
                    inserts()  # at the end of the one before
                    audit, at, position, state, now = text_, 0, 0, NOTHING, conv
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = KEPT[state, role_[0]]
                elif edit == "R":
                    state = THEN[state]
                    role_ = ROLE[state]
                write(edit, turn_, role_, text_)
            yield _rows(out, b.schema.field(0).type)
        inserts()
        if out[0]:
            yield _rows(out, b.schema.field(0).type)

    return audits, ordered.select("conv_id", "kind", "turn", "role", "text").mapInArrow(
        tidy(run), f"conv_id {kind}, position bigint, edit string, turn bigint, role string, text string")


def _rows(out: list[list], key) -> pa.RecordBatch:
    types = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                     names=["conv_id", "position", "edit", "turn", "role", "text"])
    for c in out:
        c.clear()
    return got


def repaired_digests(edits: DataFrame) -> DataFrame:
    """conv_id and sha256 of the repaired ``role:text`` lines, of the conversations that have any."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, digest = None, None

        def batch(done, type_):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type_), pa.array([h for _, h in done])],
                                              names=["conv_id", "repaired_sha256"])

        type_ = None
        for b in batches:
            type_, done = b.schema.field(0).type, []
            for conv, role_, text_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest is not None and conv == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{role_}:{text_}".encode())
            if done:
                yield batch(done, type_)
        if digest is not None:
            yield batch([(now, digest.hexdigest())], type_)

    return edits.where("edit <> 'D'").select("conv_id", "role", "text").mapInArrow(
        run, f"conv_id {kind}, repaired_sha256 string")


def damage(messages: DataFrame) -> DataFrame:
    """Messages with faults by crc32 of ``conv_id:turn`` mod 20: 0 absent, 1 emptied, 2 without ends, 3 twice, 4 by a user."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = messages.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"))


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and a digest of the repaired messages of all conversations, after damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    audits, edits = repair_conversations(damage(rows), present=F.col("present"))
    digests = repaired_digests(edits).withColumnRenamed("conv_id", "_conv")
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        *audits.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
