"""Chat formatting in DataFrame operations only: a finite-state machine over roles, and segments with loss flags.

A Template declares all of it: how a turn of each role begins and ends, which roles are
learned from, and which role may follow in which state. Each turn becomes segments of text,
each with a flag that says whether it counts for the loss: the mark of the role, the
text, the mark of the end. Only the texts of learned roles have the flag, so a loss over
flagged segments sees each of these texts once and no mark.

Marks can't be forged: wherever a text holds one, or a mark with backslashes behind its first
character, one more backslash is put there, and reading takes it away again. No mark overlaps
another (a Template refuses such marks), so none can arise where a text meets its marks, and a
formatted conversation is read back by its marks alone.

The machine runs in any number of tasks: a turn is a function from state to state, CHUNK such functions
compose to one, and so on up to one for each conversation; then the states before the turns follow downwards.
Turns are numbered over range partitions. So no conversation is one task's work until
`records` puts its segments into one row, as a training record is; a record ends at 2 GB, the most a value may hold.

Edge cases: a null text is empty; a null role is an empty one. Roles that the template doesn't
name are written with their name, aren't learned from, and break the conversation. Turns of a broken
conversation are formatted all the same: `valid` says so. Turns go in the order of turn, nulls
first; ties by role, then by text, so that reruns agree; rows that repeat are turns each. Null is a
conversation of its own. A very long text is one segment. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import cut, let, pick
from kindling.operators.ranks import ranked

#: Turns, or groups of turns, whose functions are composed in one step.
CHUNK = 64
START, BROKEN = "start", "broken"


def _java(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


@dataclass(frozen=True)
class Template:
    """marks: role to the beginning of its turns. Other roles begin with other[0], their name and other[1]. All turns end with
    `end` and then `after`. learned: roles whose texts count for the loss. follows: state to {role: next state}; a conversation
    may end in the states of `final`."""

    marks: tuple[tuple[str, str], ...] = (("system", "### System: "), ("user", "### User: "), ("assistant", "### Assistant: "))
    other: tuple[str, str] = ("### Other: ", "<says>")
    end: str = "</turn>"
    after: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = (
        (START, (("system", "told"), ("user", "asked"))),
        ("told", (("user", "asked"),)),
        ("asked", (("assistant", "answered"),)),
        ("answered", (("user", "asked"),)),
    )
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [*(m for _, m in self.marks), *self.other, self.end]

    def __post_init__(self):
        for a in self.controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"{a!r} can't be a mark: it needs two characters and no backslash")
            for b in self.controls:
                if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")
        if len({*self.controls}) < len(self.controls):
            raise ValueError("two marks are equal")

    def escaped(self, text: Column) -> Column:
        """One more backslash behind the first character of each mark, whatever backslashes are there."""
        places = "|".join(rf"(?<={_java(c[0])})(?=\\*{_java(c[1:])})" for c in self.controls)
        return F.regexp_replace(text, places, r"\\")

    def unescaped(self, text: Column) -> Column:
        places = "|".join(rf"(?<={_java(c[0])})\\(?=\\*{_java(c[1:])})" for c in self.controls)
        return F.regexp_replace(text, places, "")

    def segments(self, role: Column, text: Column) -> Column:
        """The segments of a turn: array<struct<text, loss>>."""
        segment = lambda t, loss=False: F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(loss).alias("loss"))
        shapes = None
        for name, mark in self.marks:
            own = F.array(segment(mark), segment(self.escaped(text), name in self.learned), segment(self.end + self.after))
            shapes = F.when(role == name, own) if shapes is None else shapes.when(role == name, own)
        return shapes.otherwise(F.array(segment(self.other[0]), segment(self.escaped(role)), segment(self.other[1]), segment(self.escaped(text)), segment(self.end + self.after)))

    @property
    def states(self) -> list[str]:
        names = [START, *(s for s, _ in self.follows), *(t for _, moves in self.follows for _, t in moves)]
        return [*dict.fromkeys(n for n in names if n != BROKEN), BROKEN]

    def move(self, role: Column) -> Column:
        """A role's function, as the array of the next state's number by that of the state before."""
        at, follows = {s: i for i, s in enumerate(self.states)}, dict(self.follows)
        of = lambda name: F.array(*(F.lit(at[dict(follows.get(s, ())).get(name, BROKEN)]) for s in self.states))
        roles = dict.fromkeys(r for _, moves in self.follows for r, _ in moves)
        out = None
        for name in roles:
            out = F.when(role == name, of(name)) if out is None else out.when(role == name, of(name))
        return out.otherwise(F.array(*[F.lit(at[BROKEN])] * len(at)))


def states(turns: DataFrame, template: Template) -> DataFrame:
    """known, conv, seq and state, the number of the state before the turn, of turns (known, conv, seq from 0, move)."""
    levels, nodes = [], turns.select("known", "conv", "seq", "move")
    most = turns.agg(F.max("seq")).first()[0] or 0
    after = lambda f, g: F.transform(f, lambda s: F.get(g, s))
    one = F.array(*map(F.lit, range(len(template.states))))
    while True:
        own = nodes.groupBy("known", "conv", F.expr(f"seq div {CHUNK}").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("seq", "move"))).alias("run"))  # CHUNK at most
        levels.append(cut(own.withColumn("move", F.aggregate("run", one, lambda f, r: after(f, r["move"])))))
        nodes, most = levels[-1].select("known", "conv", "seq", "move"), most // CHUNK
        if most == 0:
            break
    before = nodes.select("known", "conv", "seq", F.lit(0).alias("state"))
    for level in reversed(levels):
        met = level.join(before, ["known", "conv", "seq"])
        first = F.struct(F.col("state").alias("now"), F.expr("cast(array() AS array<struct<seq:bigint,state:int>>)").alias("out"))
        step = lambda a, r: F.struct(F.get(r["move"], a["now"]).alias("now"), F.array_append(a["out"], F.struct(r["seq"].alias("seq"), a["now"].alias("state"))).alias("out"))
        met = met.select("known", "conv", F.explode(F.aggregate("run", first, step)["out"]).alias("r"))
        before = met.select("known", "conv", F.col("r.seq").alias("seq"), F.col("r.state").alias("state"))
    return before


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, seq from 0, role, segments, state (after the turn) and ok, false from the turn that breaks the conversation on."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.select("turn", "role", "text", F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    turns = cut(ranked(rows, ["known", "conv"], order, "seq").withColumn("seq", F.col("seq") - 1))
    turns = turns.withColumn("move", template.move(F.col("role")))
    met = turns.join(states(turns, template), ["known", "conv", "seq"])
    names = F.array(*map(F.lit, template.states))
    met = met.withColumn("state", F.get(names, F.get("move", "state")))
    return met.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), "seq", "role", template.segments(F.col("role"), F.col("text")).alias("segments"), "state", (F.col("state") != BROKEN).alias("ok"))


def records(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, segments of all its turns in order, and valid: each turn in its place and the last in a final state."""
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "segments"))).alias("turns"), F.max(F.struct("seq", "state"))["state"].alias("last"))
    return own.select("conv_id", F.flatten("turns.segments").alias("segments"), F.col("last").isin(*template.final).alias("valid"))


def parsed(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, by its marks alone."""
    turns = F.split(text, _java(template.end + template.after))
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)  # nothing stands behind the last end

    def turn(piece: Column) -> Column:
        behind = lambda mark: F.substring(piece, F.lit(len(mark) + 1), F.length(piece))
        shape = lambda role, t: F.struct(role.alias("role"), template.unescaped(t).alias("text"))
        name = F.substring_index(behind(template.other[0]), template.other[1], 1)
        rest = F.substring(piece, F.length(name) + len("".join(template.other)) + 1, F.length(piece))
        out = F.when(F.startswith(piece, F.lit(template.other[0])), shape(template.unescaped(name), rest))
        for role, mark in template.marks:
            out = out.when(F.startswith(piece, F.lit(mark)), shape(F.lit(role), behind(mark)))
        return out.otherwise(F.raise_error(F.lit("a turn begins with no mark")))

    return F.transform(turns, turn)


def learned(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, as it was."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")


def digests(written: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and valid of each record, from its formatted text and loss flags."""
    text = F.array_join(F.col("segments.text"), "")
    rows = written.select("conv_id", "valid", let(text, lambda t: F.struct(F.length(t).alias("chars"), parsed(t, template).alias("turns"))).alias("own"), learned(F.col("segments"), template).alias("loss"))
    said = F.array_join(F.transform(F.col("own.turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    long = lambda c: c.cast("long")
    return rows.select(
        "conv_id", long(F.size("own.turns")).alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), long(F.length("loss")).alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), long(F.col("own.chars")).alias("formatted_chars"), "valid",
    )


def round_trip(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Writes all conversations as records in the shared folder and reads them back: digests."""
    return digests(cut(records(formatted(conversations, template), template)), template)
