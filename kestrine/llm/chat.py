"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

Everything is DataFrame expressions. A template names the control strings
before and after a turn's text, the roles whose text carries loss, and the
transitions between roles. Texts and roles are escaped so that they never
hold a control string, and the escapes can be undone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + middle + text + close for each turn; control strings begin with mark."""

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    mark: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) to the next state; a state is the role before, or start. What is missing is a violation.
    moves: Mapping[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column, t: Template = CHATML) -> Column:
    """No control string remains: & becomes &amp;, and the first character of a mark its character reference."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(t.mark), F.lit(f"&#{ord(t.mark[0])};{t.mark[1:]}"))


def unescape(text: Column, t: Template = CHATML) -> Column:
    return F.replace(F.replace(text, F.lit(f"&#{ord(t.mark[0])};{t.mark[1:]}"), F.lit(t.mark)), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column, t: Template = CHATML) -> Column:
    """As escape, and the middle string can't occur either."""
    return F.replace(escape(role, t), F.lit(t.middle), F.lit("&#10;"))


def unescape_role(role: Column, t: Template = CHATML) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit(t.middle)), t)


def machine(roles: Column, t: Template = CHATML) -> Column:
    """State after all roles, or 'invalid' from the first that the template doesn't allow."""
    table = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\x00{role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\x00"), r)), F.lit("invalid")))


def formatted(turns: DataFrame, t: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments array<struct<text, loss>>, formatted, valid.

    formatted is the segments' texts joined. Turns are in order of turn (null
    first), then role and text, so ties and repeated rows have one result and
    are all kept. Null texts and roles are empty; turns with a null conv_id
    are one conversation; conversations that break the turn order are
    formatted too, with valid false. Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.open), escape_role(x["role"], t), F.lit(t.middle))
        loss = x["role"].isin(*t.loss_roles)
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escape(x["text"], t).alias("text"), loss.alias("loss")), F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))

    done = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"), machine(F.col("turns")["role"], t).isin(*t.final).alias("valid"))
    return done.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def parsed(text: Column, t: Template = CHATML) -> Column:
    """Turns array<struct<role, text>> of a formatted conversation, escapes undone."""
    close = F.lit("\\Q" + t.close + "\\E")
    parts = F.filter(F.split(text, close), lambda p: F.startswith(p, F.lit(t.open)))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(t.open) + 1), F.length(p))
        at = F.instr(body, F.lit(t.middle))
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1), t).alias("role"), unescape(F.substring(body, at + len(t.middle), F.length(body)), t).alias("text"))

    return F.transform(parts, turn)


def learned(segments: Column, t: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
