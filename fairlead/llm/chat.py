"""Chat formatting in budgeted windows, with DataFrame functions only.

Each turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string
in a text is escaped by one more backslash between ``<`` and ``|``; taking one away
restores it. Roles are written as in a URL.

Tokens of a turn are counted by a fixed rule that needs no tokenizer: runs of ASCII
letters, digits and characters beyond ASCII, and single ASCII marks, of its written
role and text, and two for its frame.

Prefix sums of the turns' tokens choose windows. What the system turn (the first
turn, if its role is ``system``) and the history allowance leave of the budget is
the room of a window, and the tokens of the other turns, laid end to end, fall into
stretches of that length. Turns inside one stretch are one span; a turn across the
end of a stretch is a span of its own, which takes in the stretch that begins in it
if both fit the room. Each span is a window: the system turn, repeated, as many of
the turns before the span as fit both the history allowance and the budget, and the
span's turns, the only ones that are targets. So every assistant text is under the
loss mask exactly once, and no window exceeds the budget unless a single turn, with
the system turn, does: such a turn is a window of its own, uncut.

All of it is window functions over the turns: a conversation is never held in one
row but for the digests of ``read_back``, and each window is a row. A conversation
of very many turns is sorted by one task, which spills if it must.

Defined results: rows are ordered by turn, nulls first, then role and text;
a null text or role is empty; rows with a null conversation id form one
conversation; repeated rows are repeated turns; an empty table gives an empty
one; other columns are ignored, also where their names clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import keyed

START, END = "<|im_start|>", "<|im_end|>"
# Fixed value: what counts as a token.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"


@dataclass(frozen=True)
class WindowRules:
    """Tokens in a window, and tokens of repeated history in it."""

    budget: int = 512
    history: int = 128


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def measured(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, body) numbered by ``i`` within their conversation, as written, with their tokens and characters."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    whole = Window.partitionBy("conv")
    written = turns.select("conv", "role", F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"), escaped(F.col("body")).alias("safe"), (F.row_number().over(order) - 1).alias("i"))
    sized = written.select("*", (tokens(F.url_encode("role")) + tokens(F.col("safe")) + 2).alias("cost"), (F.length("head") + F.length("safe") + len(END) + 1).alias("chars"))
    system = (F.col("i") == 0) & (F.col("role") == "system")
    marked = sized.select("*", F.max(system.cast("int")).over(whole).alias("first"), F.max(F.when(system, F.col("cost")).otherwise(0)).over(whole).alias("system_cost"))
    by = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(F.when(F.col("i") >= F.col("first"), F.col("cost")).otherwise(0)).over(by)
    return marked.select("*", F.coalesce(earlier, F.lit(0)).cast("long").alias("before"))


def spans(sized: DataFrame, rules: WindowRules) -> DataFrame:
    """The turns after the system turn, with the number of their window, whether they open it, and the history that it may repeat."""
    body = sized.where(F.col("i") >= F.col("first"))
    room = F.greatest(F.lit(1), F.lit(rules.budget - rules.history) - F.col("system_cost"))
    stretch = F.floor(F.col("before") / room)
    across = F.floor((F.col("before") + F.col("cost") - 1) / room) != stretch
    by = Window.partitionBy("conv").orderBy("i")
    placed = body.select("*", room.cast("long").alias("room"), stretch.cast("long").alias("stretch"), across.alias("across"))
    opens = F.lag("i").over(by).isNull() | F.col("across") | F.lag("across").over(by) | (F.lag("stretch").over(by) != F.col("stretch"))
    grouped = placed.select("*", opens.cast("int").alias("opens"), F.lag("across").over(by).alias("after"), F.lag("cost").over(by).alias("across_cost")).select("*", F.sum("opens").over(by).alias("span"))
    cost = F.sum("cost").over(Window.partitionBy("conv", "span"))
    joins = F.coalesce(F.col("after") & ~F.col("across") & (F.col("across_cost") + F.col("span_cost") <= F.col("room")), F.lit(False))
    final = grouped.select("*", cost.alias("span_cost")).select("*", (F.col("opens") * (~joins).cast("int")).alias("begins"))
    numbered = final.select("*", (F.sum("begins").over(by) - 1).cast("int").alias("window"))
    new = F.sum("cost").over(Window.partitionBy("conv", "window"))
    allowed = F.greatest(F.lit(0), F.least(F.lit(rules.history), F.lit(rules.budget) - F.col("system_cost") - new))
    return numbered.select("conv", "i", "role", "head", "safe", "cost", "chars", "before", "window", "begins", allowed.cast("long").alias("allowed"))


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rules: WindowRules = WindowRules()) -> DataFrame:
    """Windows of each conversation.

    Columns: the conversation, ``window`` (from 0), ``text``, ``n_repeated``
    (leading turns of the text that stood in an earlier window), ``targets``: spans
    (start, end) of assistant texts in code points of ``text``, and ``n_tokens``.
    """
    rows = keyed(turns, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "body").fillna("", ["role", "body"])
    sized = measured(rows)
    body = spans(sized, rules)
    # A window that opens after at most ``history`` tokens may repeat this turn.
    ahead = Window.partitionBy("conv").orderBy("before").rangeBetween(1, rules.history)
    opened = F.collect_list(F.when(F.col("begins") == 1, F.struct("window", "before", "allowed"))).over(ahead)
    later = F.filter(F.col("opened"), lambda w: w["before"] - F.col("before") <= w["allowed"])
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("again")))
    again = F.transform("later", lambda w: F.struct(w["window"].alias("window"), F.lit(True).alias("again")))
    held = body.select("*", opened.alias("opened")).select("*", later.alias("later")).select("conv", "i", "role", "head", "safe", "cost", "chars", F.explode(F.concat(own, again)).alias("w"))
    dealt = held.select("conv", "w.window", "w.again", "i", "role", "head", "safe", "cost", "chars")
    system = sized.where((F.col("i") == 0) & (F.col("first") == 1)).select(F.col("conv").alias("own"), F.concat("head", "safe", F.lit(END + "\n")).alias("system"), F.col("cost").alias("system_cost"), F.col("chars").alias("system_chars"))
    only = sized.groupBy("conv").agg(F.max("i").alias("last"), F.max("first").alias("first")).where(F.col("last") < F.col("first")).select("conv")
    inside = Window.partitionBy("conv", "window").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("chars").over(inside), F.lit(0)).cast("int")
    target = F.when((F.col("role") == "assistant") & ~F.col("again"), F.struct((F.col("at") + F.length("head")).alias("start"), (F.col("at") + F.length("head") + F.length("safe")).alias("end")))
    packed = (
        dealt.select("*", at.alias("at"))
        .select("conv", "window", "again", "cost", F.struct("i", F.concat("head", "safe", F.lit(END + "\n")).alias("piece")).alias("piece"), target.alias("target"))
        .groupBy("conv", "window")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.array_sort(F.collect_list("target")).alias("targets"), F.count_if("again").alias("n_again"), F.sum("cost").alias("n_tokens"))
    )
    alone = only.select("conv", F.lit(0).alias("window"), F.array().cast("array<struct<i:int,piece:string>>").alias("pieces"), F.array().cast("array<struct<start:int,end:int>>").alias("targets"), F.lit(0).cast("long").alias("n_again"), F.lit(0).cast("long").alias("n_tokens"))
    joined = packed.unionByName(alone).join(system, F.col("conv").eqNullSafe(F.col("own")), "left").withColumn("lead", F.coalesce("system_chars", F.lit(0)))
    text = F.concat(F.coalesce("system", F.lit("")), F.array_join(F.transform("pieces", lambda x: x["piece"]), ""))
    repeated = F.col("n_again") + F.when(F.col("system").isNotNull() & (F.col("window") > 0), 1).otherwise(0)
    moved = F.transform("targets", lambda s: F.struct((s["start"] + F.col("lead")).alias("start"), (s["end"] + F.col("lead")).alias("end")))
    tokens_in = F.col("n_tokens") + F.coalesce("system_cost", F.lit(0))
    return joined.select(F.col("conv").alias(conv_col), "window", text.alias("text"), repeated.cast("int").alias("n_repeated"), moved.alias("targets"), tokens_in.alias("n_tokens"))


def fixed(df: DataFrame) -> DataFrame:
    """The same rows with computed columns as they are.

    The optimizer would otherwise write their expressions into lambdas that refer
    to them, which are then evaluated again for each element of an array.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of turns and targets, from the formatted texts alone."""
    windows = fixed(windows.select("*", F.split("text", r"<\|im_start\|>").alias("pieces of text")))
    pieces = F.col("pieces of text")
    turns = F.transform(
        F.slice(pieces, F.col("n_repeated") + 2, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0))),
        lambda x: F.concat(
            F.url_decode(F.substring_index(x, "\n", 1)),
            F.lit("\n"),
            restored(x.substr(F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - (len(END) + 1))),
            F.lit("\n"),
        ),
    )
    targets = F.array_join(F.transform("targets", lambda s: restored(F.col("text").substr(s["start"] + 1, s["end"] - s["start"]))), "")
    parts = windows.select(F.col(conv_col).alias("conv"), "window", F.length("text").cast("long").alias("chars"), F.greatest(F.size("pieces of text") - 1 - F.col("n_repeated"), F.lit(0)).cast("long").alias("n"), F.array_join(turns, "").alias("turns"), targets.alias("loss"))
    whole = parts.groupBy("conv").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
    )
    turns_text, loss = F.array_join("parts.turns", ""), F.array_join("parts.loss", "")
    return whole.select(
        F.col("conv").alias(conv_col),
        "n_turns",
        F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
