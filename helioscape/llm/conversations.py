"""Repair of conversation structure at least cost: turns are kept, given another role, deleted or inserted until roles alternate.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant. The value of a path
of edits is one integer: its high part is the cost, its low part the audit letters in fixed-width octal digits, padded
with zeros at the end. The least integer of a node thus has the least cost and, of equal costs, the audit that comes first
in ASCII order; plain minima over the edges of an acyclic graph decide everything.

Conversations are sorted by one range shuffle. One that lies inside a task's range is repaired there and then. Long ones and
those at a rim are cut into segments of bounded size; a segment yields the least integers between any two states at its
ends, these are chained per conversation, and every segment is then repaired from the state that the chain assigns. For
equal costs and equal rows no audit is a beginning of another (it would have fewer inserts and cost less), so the least
integer of a segment is part of the least one of the conversation.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.spark_support import join_same, stored

#: Rows and characters after which a task closes a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20

WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. Those in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = range(4), (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state that may follow a state, by kind of turn.
_FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)}
#: Octal digits of the audit letters, in ASCII order.
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_TO_DIGITS, _TO_LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")
BITS = 3
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: Inserts that lead from a state to another; more of them cost more and lead nowhere else.
_GAPS = {START: [(0, START), (1, USER), (2, ASSISTANT)], SYSTEM: [(0, SYSTEM), (1, USER), (2, ASSISTANT)],
         USER: [(0, USER), (1, ASSISTANT)], ASSISTANT: [(0, ASSISTANT), (1, USER)]}


def symbol(role: str, blank_or_repeated: bool, cut_short: bool) -> str:
    """One letter for all that matters of a turn: x must go; s, u, a, o by role, as a capital if it is cut short."""
    if blank_or_repeated:
        return "x"
    letter = role[:1] if role[:1] in _STATE_OF else "o"
    return letter.upper() if cut_short else letter


@lru_cache(maxsize=16)
def _edits(letter: str) -> list[list[tuple[int, int, int]]]:
    """For every state the edits (digit, cost, next state) of a turn."""
    out = []
    for state in STATES:
        found = [(_DIGIT["D"], DELETE, state)]
        if letter != "x":
            extra = CUT_SHORT if letter.isupper() else 0
            role = _STATE_OF.get(letter.lower())
            found += [(_DIGIT["K"], KEEP + extra, role)] if (state, role) in _FOLLOWS else []
            found += [(_DIGIT["R"], REROLE + extra, r) for r in (USER, ASSISTANT) if (state, r) in _FOLLOWS]
        out.append(found)
    return out


def width(turns: int) -> int:
    """Digits that hold any audit: a letter a turn, two inserts before each and at the end."""
    return 3 * turns + 2


def solve(symbols: str, exits: tuple[int, ...]) -> list[int | None]:
    """Least integer from every state at the beginning to one of the exits at the end; None where there is no way."""
    shift = BITS * width(len(symbols))
    low, top = (1 << shift) - 1, shift - BITS

    def put(digit: int, cost: int, rest: int) -> int:
        """The integer of an edge followed by the path `rest`: cost is added, the digits move up behind the new one."""
        return ((rest >> shift) + cost << shift) | digit << top | (rest & low) >> BITS

    def gap(values: list[int | None]) -> list[int | None]:
        out: list[int | None] = []
        for state in STATES:
            found = []
            for inserts, after in _GAPS[state]:
                value = values[after]
                if value is not None:
                    for _ in range(inserts):
                        value = put(_DIGIT["I"], INSERT, value)
                    found.append(value)
            out.append(min(found, default=None))
        return out

    values = gap([0 if s in exits else None for s in STATES])
    for letter in reversed(symbols):
        values = gap([min((put(d, c, values[n]) for d, c, n in _edits(letter)[s] if values[n] is not None), default=None) for s in STATES])
    return values


def read(value: int, digits: int) -> tuple[int, str]:
    """(cost, audit) of an integer with this number of low digits."""
    shift = BITS * digits
    return value >> shift, oct(value & (1 << shift) - 1)[2:].rstrip("0").translate(_TO_LETTERS)


@lru_cache(maxsize=1 << 14)
def best_edits(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return read(solve(symbols, FINAL)[START], width(len(symbols)))


def ways(symbols: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a segment for every two states that have a way."""
    out = []
    for after in STATES:
        for state, value in enumerate(solve(symbols, (after,))):
            if value is not None:
                out.append((state, after, *read(value, width(len(symbols)))))
    return out


def chain(segments: list[tuple[int, list[tuple[int, int, int, str]]]]) -> list[tuple[int, str, int]]:
    """(state before, audit, cost) of every segment on the least way through a conversation; segments are (turns, ways)."""
    values: list[int | None] = [0 if s in FINAL else None for s in STATES]
    digits, chosen = 0, []
    for turns, segment in reversed(segments):
        digits += width(turns)
        shift, rest_shift = BITS * digits, BITS * (digits - width(turns))
        found: list[list[tuple[int, int]]] = [[] for _ in STATES]
        for number, (state, after, cost, audit) in enumerate(segment):
            rest = values[after]
            if rest is not None:
                # the segment's letters come first, the rest's digits follow at once
                letters = int(audit.translate(_TO_DIGITS) or "0", 8) << shift - BITS * len(audit)
                behind = (rest & (1 << rest_shift) - 1) << shift - rest_shift >> BITS * len(audit)
                found[state].append((((rest >> rest_shift) + cost << shift) | letters | behind, number))
        least = [min(f, default=None) for f in found]
        values = [f and f[0] for f in least]
        chosen.append([f and segment[f[1]] for f in least])
    state, out = START, []
    for options in reversed(chosen):
        before, after, cost, audit = options[state]
        out.append((before, audit, cost))
        state = after
    return out


def apply_edits(audit: str, roles: Iterable[str], texts: Iterable[str], state: int = START) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of an audit, from a given state on."""
    rows, out_roles, out_texts = zip(roles, texts), [], []
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = _STATE_OF[role[:1]] if letter == "K" else ASSISTANT if state == USER else USER
        out_roles.append(role if letter == "K" else NAMES[state])
        out_texts.append(text)
    return out_roles, out_texts


_COUNTS = ["lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal"]


class Segment:
    """Rows of one conversation in order, with what they add to its report."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq = conv, seq
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.symbols: list[str] = []
        self.seen: dict[tuple[str, str], int] = {}
        self.count = dict.fromkeys(_COUNTS[2:], 0)
        self.lo = self.hi = None
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        bare = text.rstrip(WHITE)
        repeated = bool(bare) and (role, text) in self.seen
        cut_short = bool(bare) and bare[-1] not in ".!?"
        if bare and not repeated:
            self.seen[role, text] = len(self.roles)
        self.count["blank" if not bare else "duplicate" if repeated else "truncated"] += not bare or repeated or cut_short
        if self.roles:
            self.count["illegal"] += illegal(self.roles[-1], role)
        if turn is not None:
            self.count["turns"] += turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        self.symbols.append(symbol(role, not bare or repeated, cut_short))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.chars >= SEGMENT_CHARS

    def row(self, whole: bool) -> dict:
        symbols = "".join(self.symbols)
        cost, audit = best_edits(symbols) if whole and len(symbols) <= 64 else best_edits.__wrapped__(symbols) if whole else (None, None)
        roles, texts = apply_edits(audit, self.roles, self.texts) if whole else (self.roles, self.texts)
        rims = [self.roles[0], self.roles[-1]] if self.roles else None
        keys = None if whole else [hashlib.sha256(f"{len(r)}:{r}:{t}".encode("utf-8", "surrogatepass")).digest() for r, t in self.seen]
        return {"conv": self.conv, "seq": self.seq, "whole": whole, "symbols": symbols, "rims": rims, "lo": self.lo, "hi": self.hi,
                **self.count, "cost": cost, "audit": audit, "roles": roles, "texts": texts,
                "keys": keys, "key_rows": None if whole else list(self.seen.values())}


def illegal(role: str, following: str) -> bool:
    return role[:1] + following[:1] not in ("su", "ua", "au")


_SEGMENT_TYPE = ("seq long, whole boolean, symbols string, rims array<string>, lo long, hi long, turns long, blank long, duplicate long, "
                 "truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>, "
                 "keys array<binary>, key_rows array<int>")


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> segments; a conversation that begins and ends inside the task's rows in one segment is whole."""
    base = TaskContext.get().partitionId() << 33
    out, chars, number, first, now = [], 0, 0, True, None

    def ready(limit: int) -> Iterator[pa.RecordBatch]:
        nonlocal out, chars
        if out and (chars > limit or len(out) >= 4096):
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0

    def close(ended: bool) -> None:
        nonlocal now, chars, first
        out.append(now.row(whole=ended and not first and not now.seq & 1))
        chars += now.chars
        first = first and not ended

    for batch in batches:
        for conv, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv != conv:
                if now is not None:
                    close(ended=True)
                    yield from ready(SEGMENT_CHARS)
                number += 2
                now = Segment(conv, base + number)
            elif now.full(segment_rows):
                close(ended=False)
                yield from ready(SEGMENT_CHARS)
                number += 2
                now = Segment(conv, base + number + 1)  # odd: goes on a conversation
            if not dropped:
                now.add(turn, role, text)
    if now is not None:
        close(ended=False)
    yield from ready(-1)


_WAY = "array<struct<state:int,after:int,cost:long,audit:string>>"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols = batch.column("symbols").to_pylist()
        found = [[dict(zip(("state", "after", "cost", "audit"), w)) for w in ways(s)] for s in symbols]
        kind = pa.list_(pa.struct([("state", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield batch.append_column("ways", pa.array(found, kind)).drop_columns(["symbols"])


def _chain(rows: pa.Table) -> pa.Table:
    """Segments of one conversation, without their texts -> the state before and the audit of each; the first has the whole report."""
    parts = sorted(rows.to_pylist(), key=lambda p: p["seq"])
    path = chain([(p["size"], [(w["state"], w["after"], w["cost"], w["audit"]) for w in p["ways"]]) for p in parts])
    total = {c: sum(p[c] for p in parts) for c in _COUNTS[2:]}
    last_role = first_turn = last_turn = None
    for p in parts:
        if p["rims"]:
            total["illegal"] += last_role is not None and illegal(last_role, p["rims"][0])
            last_role = p["rims"][1]
        if p["lo"] is not None:
            total["turns"] -= last_turn == p["lo"]
            first_turn, last_turn = p["lo"] if first_turn is None else first_turn, p["hi"]
    total |= {"lo": first_turn, "hi": last_turn, "cost": sum(c for _, _, c in path), "audit": "".join(a for _, a, _ in path)}
    out = [{"seq": p["seq"], "state": s, "edits": a, "head": False} for p, (s, a, _) in zip(parts, path)]
    out[0] |= total | {"head": True}
    kinds = [("seq", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), ("head", pa.bool_()), ("audit", pa.string()),
             *[(c, pa.int64()) for c in (*_COUNTS, "cost")]]
    conv = rows.column("conv").combine_chunks()
    return pa.Table.from_arrays([conv, *[pa.array([r.get(n) for r in out], k) for n, k in kinds]], ["conv", *[n for n, _ in kinds]])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("edits", "roles", "texts", "state")}
        done = [apply_edits(e, r, t, s) for e, r, t, s in zip(*columns.values())]
        kept = batch.drop_columns(["edits", "state", "roles", "texts"])
        for n, values in zip(("roles", "texts"), zip(*done) if done else ((), ())):
            kept = kept.append_column(n, pa.array(list(values), pa.list_(pa.string())))
        yield kept


@dataclass
class Repair:
    """reports: a row per conversation (conv, gaps, blank, duplicate, truncated, illegal, cost, audit);
    chunks: its repaired turns as arrays of roles and texts, in one or more rows (conv, seq), those of one row marked whole."""
    reports: DataFrame
    chunks: DataFrame

    def turns(self) -> DataFrame:
        """Repaired turns, one a row: conv, seq and place order them."""
        rows = self.chunks.select("conv", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
        return rows.select("conv", "seq", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))

    def digests(self) -> DataFrame:
        """conv, digest: sha256 of the turns as role:text, joined by newlines; of the empty string where no turn is left.

        Such a digest reads a conversation from its beginning to its end. Conversations of one row take no shuffle; the rows of
        the others (at most SEGMENT_ROWS turns each) are sorted and pass through the digest one after the other.
        """
        lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
        whole = self.chunks.where("whole").select("conv", F.sha2(lines, 256).alias("digest"))
        parts = self.chunks.where("not whole").select("conv", "seq", F.when(F.size("roles") > 0, lines).alias("lines"))
        sorted_parts = parts.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "seq")
        schema = T.StructType([parts.schema["conv"], T.StructField("digest", T.StringType())])
        return whole.unionByName(sorted_parts.mapInArrow(_stream_digests, schema))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = state = None
    started = False
    for batch in batches:
        done: list[tuple] = []
        for i in range(batch.num_rows):
            this, text = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if state is None or this != conv:
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state, started = this, hashlib.sha256(), False
            if text is not None:
                state.update(("\n" if started else "").encode() + text.encode("utf-8", "surrogatepass"))
                started = True
        yield _digest_batch(done, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if state is not None:
        yield _digest_batch([(conv, state.hexdigest())], kind)


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv", "digest"])


def repair(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, dropped_col: str | None = None,
           segment_rows: int = SEGMENT_ROWS) -> Repair:
    """Cheapest repair of every conversation.

    Rows stand by turn, nulls first; rows of one turn by copy (column `copy` of the input, if it has one, last), before that
    by role and by the text's sha256. Null roles and texts read as one blank. Rows marked in dropped_col only name their
    conversation, which is reported even if no other row names it: with zeros, an empty audit and no turns. A null
    conversation id is a conversation. Faults: blank (only white space), duplicate (role and text seen earlier),
    truncated (last character other than white space is not . ! or ?); the first that holds counts. Roles count by their first
    character. Texts of any length are one row of a segment, and segment_rows
    never changes a result. Empty tables give empty results; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    copy = F.col("copy") if "copy" in df.columns else F.lit(0)
    dropped = F.lit(False) if dropped_col is None else F.col(dropped_col)
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
                     F.coalesce(text_col, F.lit(" ")).alias("text"), dropped.alias("dropped"), copy.alias("copy"))
    rows = rows.withColumn("key", F.sha2("text", 256)).withColumn("text", F.when(~F.col("dropped"), F.col("text")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("copy")]
    kind = T.StructType([rows.schema["conv"], *T._parse_datatype_string(_SEGMENT_TYPE).fields])
    arrow = to_arrow_schema(kind)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "dropped")
    segments = stored(ranged.mapInArrow(lambda b: _segments(b, arrow, segment_rows), kind), "conversation-segments")

    open_ones = segments.where("not whole")
    seen = open_ones.select("conv", "seq", F.explode(F.arrays_zip("keys", "key_rows")).alias("k")) \
        .select("conv", "seq", F.col("k.keys").alias("key"), F.col("k.key_rows").alias("row"))
    earliest = seen.groupBy("conv", "key").agg(F.min("seq").alias("first"))
    late = join_same(seen, earliest, ["conv", "key"]).where("seq > first").groupBy("conv", "seq").agg(F.collect_list("row").alias("late"))
    light = open_ones.drop("whole", "cost", "audit", "roles", "texts", "keys", "key_rows")
    marked = join_same(light, late, ["conv", "seq"], "left").withColumn("late", F.coalesce("late", F.array().cast("array<int>")))
    # a turn seen in an earlier segment is a duplicate, and no longer one that is cut short
    letters = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.when(F.array_contains("late", i), "x").otherwise(F.substr("symbols", i + 1, F.lit(1))))
    was_cut = F.size(F.filter("late", lambda i: F.substr("symbols", i + 1, F.lit(1)).rlike("[SUAO]"))).cast("long")
    marked = marked.withColumn("size", F.length("symbols")).withColumn("duplicate", F.col("duplicate") + F.size("late")) \
        .withColumn("truncated", F.col("truncated") - was_cut) \
        .withColumn("symbols", F.when(F.size("late") > 0, F.array_join(letters, "")).otherwise(F.col("symbols"))).drop("late")
    solved = marked.mapInArrow(_ways, T.StructType([f for f in marked.schema.fields if f.name != "symbols"] + [T.StructField("ways", T._parse_datatype_string(_WAY))]))
    chained = T.StructType([rows.schema["conv"], *T._parse_datatype_string(
        "seq long, state int, edits string, head boolean, audit string, " + ", ".join(f"{c} long" for c in (*_COUNTS, "cost"))).fields])
    decided = stored(solved.groupBy("conv").applyInArrow(_chain, chained), "conversation-edits")

    texts = join_same(open_ones.select("conv", "seq", "whole", "roles", "texts"), decided.select("conv", "seq", "state", "edits"), ["conv", "seq"])
    chunk_type = T.StructType([segments.schema[c] for c in ("conv", "seq", "whole", "roles", "texts")])
    repaired = texts.mapInArrow(_applied, chunk_type)
    span = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    report = ["conv", span, "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return Repair(segments.where("whole").select(*report).unionByName(decided.where("head").select(*report)),
                  segments.where("whole").select("conv", "seq", "whole", "roles", "texts").unionByName(repaired))


def damage(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Planted faults by crc32(`conv:turn`) % 20: 0 drops the row (kept with a mark), 1 empties its text, 2 takes out . ! and ?,
    3 repeats it, 4 makes its role user. Nulls read as one blank, in the checksum too. Columns: conv, turn, role, text, dropped, copy."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))) % 20
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
