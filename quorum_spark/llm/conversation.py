"""Conversation structure repair: the cheapest edits that give each conversation the roles (system? (user assistant)+)?.

Rows of a conversation stand in order of turn (null first), then role, first characters of the text, and a hash of the text, so
only equal rows are interchangeable. A row's first fault counts: blank (nothing but spaces), duplicate (role and text stand
earlier in the conversation), truncated (the last character that isn't a space is none of . ! ?). Edits: Keep costs 0, Rerole to
user or assistant 2, Delete 3, Insert of an empty user or assistant message 2; blank and duplicate rows must be deleted; a
truncated row that stays adds 1. Of the cheapest edits those whose initials, in order, are ASCII-least are taken.

A forward Viterbi pass over four states (nothing yet, system, user, assistant last) carries the least (cost, initials) of each;
every row's layer is closed by at most two inserts, since a third would repeat a state. Equal costs are told apart by initials that
can't be each other's beginning (that would be further inserts, which cost), so the least one stays least.

Rows are sorted by range, so a conversation of any length is spread over tasks. It is passed in blocks of BLOCK rows: a block that
may continue a conversation is passed once from every state, and the blocks' results are chained by conversation in a stream that
holds one row's blocks and four strings of initials, a byte for each message. Edits then meet their rows by unique places.

Null roles and texts are one space; null turns come first; rows of a null conv_id are one conversation, whose id is null. A role's
initial is its first character; roles with other initials than s, u and a can't be kept. Repeated rows are duplicates. Very long
texts are never gathered: only their faults and digests are. An empty table gives empty tables; further columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch

BLOCK_BITS = 12
SPACES = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT, START = range(5)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What follows a state when a message with an initial is written.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one initial, of those that can be written by an edit, that may follow a state.
DUE = {NOTHING: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
EMPTY_SHA = sha256(b"").hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes it the user's. Nulls are one space, but for the turn and conv_id themselves."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(at, conv_id, turn, role, text, digest, blank, truncated): rows sorted by conversation, with places that rise in this order and by one within a task's rows.

    Equal rows, which are the only ones that may take each other's place, are spread by a salt.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text")]
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64))).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    end = F.rtrim("text", F.lit(SPACES))
    truncated = ~F.substring(end, -1, 1).isin(".", "!", "?")
    return scratch.cut(rows.select(F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (end == "").alias("blank"), truncated.alias("truncated")), "rows")


def faults(rows: DataFrame) -> DataFrame:
    """(at, conv_id, turn, initial, fault) of placed rows; no texts. First rows of a role and text are found by a grouped minimum and met by their unique places."""
    first = rows.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    small = rows.select("at", "conv_id", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), "blank", "truncated")
    return small.join(first, "at", "left").select("at", "conv_id", "turn", "initial", fault.alias("fault"))


def _closed(layer: dict) -> dict:
    """A layer after inserts: a user message wherever one is due, then an assistant's."""
    for state in (USER, ASSISTANT):
        due = [(layer[s][0] + COST[INSERT], layer[s][1] + INSERT) for s in layer if NEXT.get((s, DUE[s])) == state]
        best = min(due + [layer[state]] if state in layer else due, default=None)
        if best is not None:
            layer[state] = best
    return layer


def viterbi(layer: dict, initials: str, found: list[int]) -> dict:
    """The least (cost, initials of edits) of each state that can be reached from a closed layer's states over rows with these initials and faults."""
    for initial, fault in zip(initials, found, strict=True):
        new = {s: (c + COST[DELETE], t + DELETE) for s, (c, t) in layer.items()}
        if fault in (NONE, TRUNCATED):
            more = fault == TRUNCATED
            for s, (c, t) in layer.items():
                for edit, into in ((KEEP, NEXT.get((s, initial))), (REROLE, NEXT[s, DUE[s]])):
                    way = (c + COST[edit] + more, t + edit)
                    if into is not None and (into not in new or way < new[into]):
                        new[into] = way
        layer = _closed(new)
    return layer


def _passed(table: pa.Table) -> pa.Table:
    """A block's conversations: (conv_id, at, initials, ways), ways being (from, to, cost, edits). Its first one may continue another block's."""
    table = table.sort_by("at")
    conv, at, initial, fault = (table.column(c).to_pylist() for c in ("conv_id", "at", "initial", "fault"))
    out, lo = [], 0
    for hi in range(1, len(conv) + 1):
        if hi < len(conv) and conv[hi] == conv[lo]:
            continue
        initials, found = "".join(initial[lo:hi]), fault[lo:hi]
        ways = []
        for s in range(5) if lo == 0 else [START]:
            layer = _closed({NOTHING: (0, "")}) if s == START else {s: (0, "")}
            ways += [{"from": s, "to": to, "cost": c, "edits": t} for to, (c, t) in viterbi(layer, initials, found).items()]
        out.append({"conv_id": conv[lo], "at": at[lo], "initials": initials, "ways": ways})
        lo = hi
    return pa.Table.from_pylist(out, pa.schema([("conv_id", table.schema.field("conv_id").type), ("at", pa.int64()), ("initials", pa.string()), ("ways", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))]))


class _Chain:
    """A conversation's blocks, passed one after the other."""

    def __init__(self, conv_id):
        self.conv_id, self.layer, self.blocks, self.last, self.illegal = conv_id, None, [], "", 0

    def add(self, at: int, initials: str, ways: list[dict]) -> None:
        own = self.last + initials
        self.illegal += sum(own[k : k + 2] not in LEGAL for k in range(len(own) - 1))
        self.last = initials[-1]
        new, back = {}, {}
        for w in ways:
            if self.layer is None:
                before = (0, "") if w["from"] == START else None
            else:
                before = self.layer.get(w["from"])
            if before is None:
                continue
            way = (before[0] + w["cost"], before[1] + w["edits"])
            if w["to"] not in new or way < new[w["to"]]:
                new[w["to"]], back[w["to"]] = way, (NOTHING if w["from"] == START else w["from"], w["edits"])
        self.layer = new
        self.blocks.append((at, initials, back))

    def rows(self) -> list[dict]:
        state = min((s for s in (NOTHING, ASSISTANT) if s in self.layer), key=lambda s: self.layer[s])
        total, out = self.layer[state], []
        for at, initials, back in reversed(self.blocks):
            state, edits = back[state]
            out.append({"conv_id": self.conv_id, "at": at, "initials": initials, "state": state, "edits": edits, "cost": None, "audit": None, "illegal": None})
        out[-1] |= {"cost": total[0], "audit": total[1], "illegal": self.illegal}
        return out


def _chained(batches):
    held = None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("at", pa.int64()), ("initials", pa.string()), ("state", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
        out = []
        for r in batch.to_pylist():
            if held is not None and held.conv_id != r["conv_id"]:
                out += held.rows()
                held = None
            held = held or _Chain(r["conv_id"])
            held.add(r["at"], r["initials"], r["ways"])
        yield pa.RecordBatch.from_pylist(out, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist(held.rows(), schema)


def decided(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, at, initials, state, edits, cost, audit, illegal): the edits of each block, and in a conversation's first row its cost, all its edits and its illegal neighbours."""
    key = f"conv_id {found.schema['conv_id'].dataType.simpleString()}"
    blocks = found.select(F.shiftright("at", BLOCK_BITS).alias("block"), "at", "conv_id", "initial", "fault").groupBy("block")
    passed = blocks.applyInArrow(_passed, f"{key}, at long, initials string, ways array<struct<from:int,to:int,cost:long,edits:string>>")
    by_conversation = passed.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return scratch.cut(by_conversation.mapInArrow(_chained, f"{key}, at long, initials string, state int, edits string, cost long, audit string, illegal long"), "decided")


def _spread(batches):
    """Each row's edit by its place: the role it gets, and roles of messages inserted before it and, behind a block's last row, after it."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state, initials, lead, n = r["state"], r["initials"], [], 0
            for edit in r["edits"]:
                initial = initials[n] if edit == KEEP else DUE[state]
                if edit == INSERT:
                    lead.append(ROLE[initial])
                else:
                    out.append({"at": r["at"] + n, "edit": edit, "new_role": ROLE[initial] if edit == REROLE else None, "lead": lead, "trail": []})
                    lead, n = [], n + 1
                if edit != DELETE:
                    state = NEXT[state, initial]
            out[-1]["trail"] = lead
        yield pa.RecordBatch.from_pylist(out, pa.schema([("at", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("lead", pa.list_(pa.string())), ("trail", pa.list_(pa.string()))]))


def messages(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, at, k, turn, role, text, edit) in order of at and k. Inserted messages have no turn."""
    edits = chosen.select("at", "initials", "state", "edits").mapInArrow(_spread, "at long, edit string, new_role string, lead array<string>, trail array<string>")
    inserted = lambda c: F.transform(c, lambda role: F.struct(F.lit(None).cast("long").alias("turn"), role.alias("role"), F.lit("").alias("text"), F.lit(INSERT).alias("edit")))
    own = F.array(F.struct("turn", F.coalesce("new_role", "role").alias("role"), "text", "edit"))
    kept = F.when(F.col("edit") == DELETE, F.slice(own, 1, 0)).otherwise(own)
    both = rows.select("at", "conv_id", "turn", "role", "text").join(edits, "at")
    return both.select("conv_id", "at", F.posexplode(F.concat(inserted("lead"), kept, inserted("trail"))).alias("k", "m")).select("conv_id", "at", "k", "m.*")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired messages of conversations (conv_id, turn, role, text): conv_id, at, k, turn, role, text, edit (K, R or I)."""
    scratch = Scratch(rows.sparkSession, "repair")
    own = placed(rows, scratch)
    return messages(own, decided(faults(own), scratch))


def _digests(batches):
    conv, whole, any_yet = None, None, False
    for batch in batches:
        done = []
        lines = batch.column("line")
        for k, key in enumerate(batch.column("conv_id").to_pylist()):
            if any_yet and key != conv:
                done.append((conv, whole.hexdigest()))
            if not any_yet or key != conv:
                conv, whole, any_yet = key, sha256(), True
            else:
                whole.update(b"\n")
            whole.update(lines[k].as_buffer())
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if any_yet:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([whole.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of role:text, lines joined. A digest needs its conversation in one stream; nothing of it is held."""
    lines = repaired.select("conv_id", "at", "k", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    sorted_lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k")
    return sorted_lines.mapInArrow(_digests, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def _count(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long").alias(name)


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """What the repair of rows found, for every conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    scratch = Scratch(rows.sparkSession, "repair")
    own = placed(rows, scratch)
    found = scratch.cut(faults(own), "faults")
    chosen = decided(found, scratch)
    turns = found.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = found.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == k).alias(name) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    parts = [conversations.select("conv_id").distinct(), turns, counts, chosen.where("cost is not null").select("conv_id", "illegal", "cost", "audit"), digests(messages(own, chosen))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    numbers = [_count(F.max(c), c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(EMPTY_SHA)).alias("repaired_sha256"))
