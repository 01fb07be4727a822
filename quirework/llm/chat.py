"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

A template says, for each role, what stands before and after its text and whether the text is trained on. The machine
accepts at most one system turn in front and then user and assistant turns in alternation, the user first; a conversation it
rejects is formatted all the same and carries the first turn it did not accept. Control strings inside texts are escaped by a
private mark, so no text can pose as a turn and every text comes back exactly.

One row per conversation results, with its segments (text and loss flag) in order; the formatted string is their
concatenation. A conversation is as long as its turns, so it is gathered as one row. Defined results: a null text is empty; null or unknown roles are formatted
under their own name and rejected by the machine; turns with equal numbers are ordered by role and text; repeated rows are repeated turns; an empty table
gives no rows; rows with a null conversation id form one conversation, which is as large as they are: give them ids, or leave them out, where there may be many; very long texts are formatted whole, by
patterns that repeat no group without bound; only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A character that the escape writes in front of itself and of the first character of each control string.
MARK = "␛"


@dataclass(frozen=True)
class Template:
    """What stands around a text by role, with {role} for other roles; roles whose text is trained on."""

    before: dict[str, str] = field(default_factory=lambda: {"system": "<s><<SYS>>", "user": "<s>[INST] ", "assistant": "<s>[ANS] "})
    after: dict[str, str] = field(default_factory=lambda: {"system": "<</SYS>></s>", "user": " [/INST]</s>", "assistant": " [/ANS]</s>"})
    other_before: str = "<s>[ROLE {role}] "
    other_after: str = " [/ROLE]</s>"
    trained: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """Strings that only the template may write: each begins with a bracket."""
        return ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE", "[/ROLE]"]


#: The machine: state and role to the next state; what is missing is not accepted.
MOVES = {("start", "system"): "opened", ("start", "user"): "asked", ("opened", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in s)


def escaped(text: Column, template: Template, *more: str) -> Column:
    heads = "|".join([MARK, *map(_quoted, sorted([*template.controls(), *more], key=len, reverse=True))])
    return F.regexp_replace(text, f"(?={heads})", MARK)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{MARK}(.|$)", "$1")


def _around(role: Column, known: dict[str, str], other: str) -> Column:
    head, tail = other.split("{role}") if "{role}" in other else (other, None)
    out = F.lit(head) if tail is None else F.concat(F.lit(head), role, F.lit(tail))
    for name, text in known.items():
        out = F.when(role == name, F.lit(text)).otherwise(out)
    return out


def first_rejected(roles: Column) -> Column:
    """Place of the first role that the machine does not accept, or -1."""
    def step(acc: Column, role: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, name), after in MOVES.items():
            to = F.when((acc["state"] == state) & (role == name), F.lit(after)).otherwise(to)
        stuck = acc["bad"] >= 0
        bad = F.when(stuck, acc["bad"]).when(to.isNull(), acc["at"]).otherwise(F.lit(-1))
        return F.struct(F.coalesce(F.when(~stuck, to), acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")), step)["bad"]


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, rejected_at, segments (text, loss) and formatted, of every conversation."""
    template = template or Template()
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    kept = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    chats = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    safe_role = lambda r: escaped(r, template, "]")
    def parts(t: Column) -> Column:
        before = _around(safe_role(t["role"]), template.before, template.other_before)
        after = _around(safe_role(t["role"]), template.after, template.other_after)
        segment = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(segment(before, F.lit(False)), segment(escaped(t["text"], template), t["role"].isin(*template.trained)), segment(after, F.lit(False)))

    out = chats.withColumn("segments", F.flatten(F.transform("turns", parts))).withColumn("rejected_at", first_rejected(F.transform("turns", lambda t: t["role"])))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "rejected_at", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that a formatted string holds.

    A turn ends where "</s>" meets "<s>": inside texts the escape stands between them. No pattern repeats a group with
    backtracking, so long texts need no deep stack.
    """
    template = template or Template()
    head, tail = template.other_before.split("{role}")
    role_shape = f"^{_quoted(head)}((?:[^{MARK}\\]]|(?s:{MARK}.))*+){_quoted(tail)}"

    def turn(t: Column) -> Column:
        own = F.regexp_extract(t, role_shape, 1)
        role = unescaped(own)
        low, high = F.length(own) + (len(head) + len(tail)), F.lit(len(template.other_after))
        for name, before in template.before.items():
            is_it = t.startswith(before)
            role = F.when(is_it, F.lit(name)).otherwise(role)
            low, high = F.when(is_it, F.lit(len(before))).otherwise(low), F.when(is_it, F.lit(len(template.after[name]))).otherwise(high)
        return F.struct(role.alias("role"), unescaped(F.substr(t, low + 1, F.length(t) - low - high)).alias("text"))

    return F.transform(F.split(formatted, "(?<=</s>)(?=<s>)"), turn)


def digest(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    out = format_chats(turns, template).withColumn("back", read_back(F.col("formatted"), template))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
