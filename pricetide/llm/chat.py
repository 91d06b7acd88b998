"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens lay a conversation over intervals of ``room`` tokens: the budget less the
history's and the system turn's.  The system turn is always kept: a long one takes its tokens from the history
as well, until ``LEAST`` tokens are left to own turns.  Turns within an interval make a window.  The turn across an
interval's end joins the window before it, or else the one after it, if the sum fits in ``room``;
else it is a window of its own.  So no window depends on how earlier ones were chosen.

A window's text is the conversation's system turn, the last turns of the window before within the
history budget, and its own turns; the loss mask covers the texts of its own assistant turns.
Prefix sums go over blocks of turns first, so a conversation of any length is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and of those that history may take.
BUDGET, HISTORY = 1280, 256
#: Tokens of own turns for which there is room in any window, whatever the system turn takes.
LEAST = 256
#: Order of a window's turns.
_SYSTEM, _HISTORY, _OWN = 0, 1, 2
#: Turn numbers of one block of prefix sums.
BLOCK = 64
#: Escapes inside texts and roles: the escape sign itself, the opening of control strings, and (in roles) line feeds.
_ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"))


def _lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, line_feeds: bool = False) -> Column:
    """Text in which no control string can begin; ``unescape`` gives the original back."""
    for old, new in _ESCAPES:
        c = _lit_replace(c, old, new)
    return _lit_replace(c, "\n", "\\n") if line_feeds else c


def unescape(c: Column) -> Column:
    """Doubled escape signs are set apart first, so that what follows them stays as it is."""
    part = lambda x: _lit_replace(_lit_replace(x, "\\|", "|"), "\\n", "\n")
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def turn_tokens(text: Column) -> Column:
    """A turn's size: a token for each four characters begun, and four for the template."""
    return F.floor((F.length(text) + 3) / 4).cast("long") + 4


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """One row per window: the conversation's id, ``window`` (tokens before it, which orders windows),
    ``formatted``, ``n_context`` (turns that repeat earlier windows or the system turn), ``n_own``,
    ``n_tokens`` and ``loss`` (array of start and length in characters of ``formatted``, from 0).

    ``n_tokens`` is at most ``budget``, unless a single own turn leaves no room in it, or the system turn leaves
    less than ``LEAST``; then the window holds its own turns and the system turn only.  ``tokens`` gives a turn's
    size (``turn_tokens``, an estimate, if left out).
    Null roles and texts count as empty; equal turn numbers are ordered by role and text;
    repeated rows are turns of their own; a null conversation id is a conversation; other columns
    are not read; an empty table gives none.
    """
    if not 0 <= 2 * history <= budget:
        raise ValueError("the history may take half of the budget at most")
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # a null id travels as a flag beside a value, so that plain equality joins keep it
    conv = [F.col(conv_col).isNull().alias("_none"), F.coalesce(F.col(conv_col), F.lit(0).cast(df.schema[conv_col].dataType)).alias("_conv")]
    keys = ["_none", "_conv"]
    turns = df.select(*conv, F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**62))).alias("_turn"), role.alias("_role"), text.alias("_text"))
    turns = turns.withColumn("_tokens", F.greatest((tokens if tokens is not None else turn_tokens(F.col("_text"))).cast("long"), F.lit(1)))
    turns = turns.withColumn("_block", F.floor(F.col("_turn") / BLOCK))

    order = ["_turn", "_role", "_text"]
    blocks = turns.groupBy(*keys, "_block").agg(F.sum("_tokens").alias("_sum"))
    of_conv = Window.partitionBy(*keys)
    in_order = of_conv.orderBy("_block")
    blocks = blocks.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(of_conv).alias("_total"),
        (F.row_number().over(in_order) == 1).alias("_opens"),
    )
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    turns = turns.join(blocks, [*keys, "_block"])
    turns = turns.withColumn("_end", F.col("_before") + F.sum("_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("_begin", F.col("_end") - F.col("_tokens")).withColumn("_rank", F.row_number().over(within))
    turns = turns.withColumn("_system", F.col("_opens") & (F.col("_rank") == 1) & (F.col("_role") == "system"))
    # written once; turns are placed by their sizes alone, and texts join what was found
    at = [*keys, "_block", "_rank"]
    turns = materialize(turns.select(*at, "_begin", "_end", "_tokens", "_total", "_system", "_role", "_text"), "turns")
    slim = turns.drop("_role", "_text")
    # a conversation's system turn goes to its blocks first, so that not all of its turns meet in one task
    systems = slim.filter("_system").select(*keys, F.col("_tokens").alias("_kept"))
    systems = slim.select(*keys, "_block").distinct().join(systems, keys)
    slim = slim.join(systems, [*keys, "_block"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(0)))
    slim = slim.withColumn("_room", F.greatest(budget - history - F.col("_kept"), F.lit(min(LEAST, budget - history))))
    slim = slim.withColumn("_past", F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("_kept") - F.col("_room"))))
    slim = slim.withColumn("_k", F.floor(F.col("_begin") / F.col("_room"))).withColumn("_across", F.col("_end") > (F.col("_k") + 1) * F.col("_room"))
    part = lambda across: F.coalesce(F.sum(F.when(F.col("_across") == across, F.col("_tokens"))), F.lit(0))
    intervals = slim.groupBy(*keys, "_k").agg(part(False).alias("_inside"), part(True).alias("_over"), F.max("_room").alias("_r"))
    intervals = materialize(intervals.withColumn("_back", F.col("_inside") + F.col("_over") <= F.col("_r")).drop("_r"), "intervals")
    after = intervals.select(*keys, (F.col("_k") - 1).alias("_k"), (F.col("_inside") + F.when(F.col("_back"), F.col("_over")).otherwise(0)).alias("_next"))
    slim = slim.join(intervals, [*keys, "_k"]).join(after, [*keys, "_k"], "left")
    forward = F.col("_tokens") + F.coalesce("_next", F.lit(0)) <= F.col("_room")
    number = 2 * F.col("_k") + F.when(~F.col("_across") | F.col("_back"), 0).when(forward, 2).otherwise(1)
    of_window = Window.partitionBy(*keys, "_number")
    slim = slim.withColumn("_number", number)
    slim = slim.withColumn("_window", F.min("_begin").over(of_window)).withColumn("_last", F.max("_end").over(of_window))
    places = materialize(slim.select(*at, "_window", "_last", "_kept", "_room", "_past"), "places")
    turns = turns.join(places, at)

    piece = F.concat(F.lit(START), escape(F.col("_role"), True), F.lit("\n"), escape(F.col("_text")), F.lit(END + "\n"))
    head = F.length(escape(F.col("_role"), True)) + len(START) + 1
    turns = turns.select(*keys, "_window", "_begin", "_tokens", "_last", "_total", "_system", "_kept", "_room", "_past", piece.alias("piece"), (F.col("_role") == "assistant").alias("target"), head.cast("long").alias("skip"), F.length(escape(F.col("_text"))).cast("long").alias("size"))

    def cell(place: int) -> Column:
        return F.struct(F.lit(place).alias("place"), F.col("_begin").alias("begin"), F.col("_tokens").alias("tokens"), "piece", "target", "skip", "size")

    # own turns stay where they are; only what a later window repeats moves
    own = turns.groupBy(*keys, F.col("_window").alias("window")).agg(F.collect_list(cell(_OWN)).alias("own"), F.sum("_tokens").alias("own_tokens"), F.max("_room").alias("room"))
    # the next window begins where this one ends
    follows = turns.filter((F.col("_last") < F.col("_total")) & (F.col("_begin") >= F.col("_last") - F.col("_past")) & ~F.col("_system"))
    repeated = follows.select(*keys, F.col("_last").alias("window"), cell(_HISTORY).alias("cell"))
    system = turns.filter("_system and _kept > 0").select(*keys, cell(_SYSTEM).alias("cell"))
    system = places.filter("_window > 0").select(*keys, F.col("_window").alias("window")).distinct().join(system, keys)
    context = repeated.unionByName(system).groupBy(*keys, "window").agg(F.collect_list("cell").alias("context"))
    fits = F.filter("context", lambda c: (F.col("own_tokens") <= F.col("room")) | (c["place"] == _SYSTEM))
    nothing = F.array().cast(own.schema["own"].dataType)
    cells = F.sort_array(F.concat(F.coalesce(fits, nothing), "own"))
    windows = own.join(context, [*keys, "window"], "left").select(*keys, "window", cells.alias("cells"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    step = lambda acc, c: F.struct(
        (acc["at"] + F.length(c["piece"])).alias("at"),
        F.when(c["target"] & (c["place"] == _OWN), F.concat(acc["spans"], F.array(F.struct((acc["at"] + c["skip"]).alias("start"), c["size"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return windows.select(
        F.when(~F.col("_none"), F.col("_conv")).alias(conv_col),
        "window",
        F.array_join(F.col("cells.piece"), "").alias("formatted"),
        F.size(F.filter("cells", lambda c: c["place"] != _OWN)).cast("long").alias("n_context"),
        F.size(F.filter("cells", lambda c: c["place"] == _OWN)).cast("long").alias("n_own"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + c["tokens"]).alias("n_tokens"),
        F.aggregate("cells", zero, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns`` (role and text of its own turns, parsed from ``formatted``) and
    ``targets`` (the texts under the loss mask, unescaped, in order)."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context") + 2, F.greatest(F.col("n_own"), F.lit(1)))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        body = F.substring(piece, cut + 1, F.length(piece) - cut - (len(END) + 1))
        return F.struct(unescape(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    span = lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return windows.withColumn("turns", F.transform(pieces, turn)).withColumn("targets", F.transform("loss", span))
