"""Chat formatting into budgeted windows of turns, with a loss mask.

Each conversation becomes windows of whole turns. Prefix sums of turn tokens choose the
spans: a turn belongs to the cell of the token line in which it starts, cells being half
of what a window can hold beside the system turn and ``history`` tokens, so a span never
exceeds that; a turn larger than a cell gets a span of its own. A window leads with the
conversation's system turn, if both fit the budget, and then repeats as history the last
turns before its span, as many as the rest of the budget takes. So a window exceeds the
budget only where a turn does by itself, as turns are never cut; it then holds that turn
and the system turn. The loss mask covers the assistant texts of the span; repeated turns are masked
out, so each assistant text is a target once.

Tokens are counted by a bound that no byte-level tokenizer exceeds, one a byte of what the
turn adds to the window, template and escapes included; or, for the texts, by a column of
counts (``tokens_col``).

Template: ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline, for
each turn. In texts and roles ``<``, any backslashes, ``|`` gains a backslash, so no
control string of the template can occur inside them, and the escape is reversible; in
roles ``%`` and the newline are written as ``%25`` and ``%0A``.

DataFrame functions only.

Cases. Null text and null role count as empty, a null or negative count as the bound. A null turn sorts
first; turns of equal number sort by role and text, and repeated rows are repeated turns.
Null conversation ids form one conversation. Texts of any length stay whole. Extra columns
are not read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Most tokens of a window, and tokens kept free for history.
BUDGET, HISTORY = 4096, 512
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape_text(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens_col: str | None = None,
) -> DataFrame:
    """(conv_id, window, n_repeated, n_turns, formatted, targets, tokens) for each window.

    ``n_repeated`` turns lead the window as context, ``n_turns`` follow as its own span;
    ``targets`` lists the (start, length) of the loss mask's spans in code points of
    ``formatted``; ``tokens`` counts the whole window. Windows count from 0.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    said = F.lit(None).cast("long") if tokens_col is None else F.col(tokens_col).cast("long")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), said.alias("said"))
    around = len(START) + 1 + len(END) + F.octet_length(escape_role(F.col("role")))
    body, plain = F.octet_length(escape_text(F.col("text"))), F.octet_length("text")
    rows = rows.withColumn("tokens", (around + F.coalesce(body - plain + F.when(F.col("said") >= 0, F.col("said")), body)).cast("long")).drop("said")
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "tokens")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.row_number().over(by_turn).alias("nth"), F.coalesce(F.sum("tokens").over(so_far), F.lit(0)).alias("at"))
    rows = rows.withColumn("leads", (F.col("nth") == 1) & (F.col("role") == SYSTEM_ROLE))
    # the system turn, and how much of the budget is left for a span
    whole = Window.partitionBy("conv_id").orderBy("at")
    segment = F.struct("nth", "role", "text")
    rows = rows.select("*", F.first(F.when(F.col("leads"), F.struct("tokens", "role", "text"))).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("system"))
    kept = F.least(F.coalesce("system.tokens", F.lit(0)), F.lit(budget // 2))
    rows = rows.withColumn("half", F.floor(F.greatest(budget - history - kept, F.lit(2)) / 2))
    # turns that a span that starts here may repeat; the system turn is retained apart
    lately = whole.rangeBetween(-budget, -1)
    rows = rows.withColumn("before", F.collect_list(F.when(~F.col("leads"), F.struct("nth", "role", "text", "at"))).over(lately))
    large = F.col("tokens") > F.col("half")
    rows = rows.withColumn("span", F.floor(F.col("at") / F.col("half")) * 2 + large.cast("int"))
    new = rows.groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list(segment)).alias("own"),
        F.min(F.struct("nth", "at", "before", "system")).alias("head"),
        F.sum("tokens").alias("tokens"),
    )
    new = new.withColumn("led", F.coalesce((F.col("head.nth") > 1) & ((F.col("head.system.tokens") + F.col("tokens") <= budget) | (F.col("head.system").isNotNull() & (F.col("tokens") > budget))), F.lit(False)))
    new = new.withColumn("tokens", F.col("tokens") + F.when(F.col("led"), F.col("head.system.tokens")).otherwise(0))
    new = new.withColumn("again", F.filter("head.before", lambda t: F.col("head.at") - t["at"] <= budget - F.col("tokens")))
    new = new.withColumn("tokens", F.col("tokens") + F.coalesce(F.col("head.at") - F.array_min(F.col("again.at")), F.lit(0)))
    none = F.array().cast("array<struct<nth:int,role:string,text:string>>")
    retained = F.when(F.col("led"), F.array(F.struct(F.lit(0).alias("nth"), F.col("head.system.role"), F.col("head.system.text")))).otherwise(none)
    context = F.concat(retained, F.sort_array(F.transform("again", lambda t: F.struct(t["nth"].alias("nth"), t["role"].alias("role"), t["text"].alias("text")))))
    order = Window.partitionBy("conv_id").orderBy("head.nth")
    new = new.select("conv_id", (F.row_number().over(order) - 1).alias("window"), context.alias("context"), "own", "tokens")
    pieces = F.concat(_pieces("context", False), _pieces("own", True))
    done = new.select("conv_id", "window", F.size("context").alias("n_repeated"), F.size("own").alias("n_turns"), pieces.alias("pieces"), "tokens")
    # a piece's place is the length of all before it
    ends = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("targets")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["target"], F.concat(s["targets"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(s["targets"]).alias("targets"),
        ),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return done.select("conv_id", "window", "n_repeated", "n_turns", formatted.alias("formatted"), ends["targets"].alias("targets"), "tokens")


def _pieces(turns: str, fresh: bool) -> Column:
    """Head, escaped text and whether the text is a target, for each turn of an array."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape_text(t["text"]).alias("body"),
            (F.lit(fresh) & (t["role"] == TARGET_ROLE)).alias("target"),
        ),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses) read back from formatted windows alone.

    ``turns`` are the window's own turns, without what it repeats; ``losses`` the texts
    under its mask, unescaped.
    """
    said = F.split("formatted", r"<\|im_end\|>\n")
    own = F.slice(said, F.col("n_repeated") + 1, F.col("n_turns"))
    turns = F.transform(
        own,
        lambda s: F.struct(
            unescape_role(F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape_text(F.substr(s, F.instr(s, "\n") + 1)).alias("text"),
        ),
    )
    losses = F.transform("targets", lambda t: unescape_text(F.substr("formatted", (t["start"] + 1).cast("int"), t["length"].cast("int"))))
    return windows.select("conv_id", "window", turns.alias("turns"), losses.alias("losses"), F.length("formatted").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: counts and digests of turns and targets."""
    read = read_windows(windows)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read.select("conv_id", "window", F.size("turns").alias("n"), turns.alias("turns"), F.array_join("losses", "").alias("loss"), "chars")
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    loss = F.array_join("parts.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
