"""Chat formatting with budgeted windows (operator 7), DataFrame functions only.

A turn is written ``<s>[INST]role[/INST]text</s>``. In roles and texts a backslash is doubled and a control string
gets a backslash after its first character, so none can stand there by itself, and unescaping (a backslash goes, what
follows stays) gives back the very text.

Prefix sums of the turns' tokens cut a conversation: the line of tokens is marked every ``step`` tokens; turns between two marks make a
window, a turn across a mark makes one of its own. ``step`` is the budget less the system turn and the history, so a
window stays within the budget unless a single turn is longer. Windows after the first repeat the system turn
(if the conversation begins with one) and as many turns before as fit ``history`` tokens. Every turn is new in one window only: the
loss mask covers the escaped texts of new assistant turns, never repeated ones.

A conversation of more than ``PART_TURNS`` turns is dealt by its order into parts of about so many turns, each a sorted stream of its own, so that no task
has to read a very long conversation alone; equal, missing or outlying turn numbers don't matter to that, only turns that agree in number, role and the first
``PREFIX`` characters of different texts stay together. Parts carry on one line of tokens: one row a part tells the tokens before it, the last turn before it and the windows
that begin within the history after it, so windows are those of the whole conversation. Only windows are collected, and these are bounded by the budget. Order is by turn, then role, then text; null turns
first. Null roles and texts are empty; a null conv_id is a conversation like any other; repeated rows are turns each. Empty tables give
no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

OPEN, SHUT, BEGIN, END = "[INST]", "[/INST]", "<s>", "</s>"
#: The template's control strings.
CONTROLS = (BEGIN, END, OPEN, SHUT)
#: Turns of a part, at least; parts at most; characters of a text that decide where parts are cut.
PART_TURNS, MOST_PARTS, PREFIX = 4096, 2000, 64


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def tokens_of(text: Column) -> Column:
    """Tokens of the budget: runs of letters, of digits and of other visible characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+"), F.lit(0)))


def windows(turns: DataFrame, budget: int = 512, history: int = 128, frame: int = 3) -> DataFrame:
    """``conv_id``, ``first`` (orders a conversation's windows), ``formatted``, ``repeated`` (turns that are shown again, at
    its beginning), ``loss`` (array of ``start`` and ``size`` in code points), ``tokens``. ``turns``: conv_id, turn, role, text.

    ``frame``: tokens that a turn has beside its text's.
    """
    if budget - history < 1:
        raise ValueError("the history must leave room in the budget")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("size", (tokens_of(F.col("text")) + frame).cast("bigint"))
    # One row for at least PART_TURNS turns; Spark sees its size before it joins.
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > PART_TURNS)
    long_ = common.durable(counts.select(F.col("conv_id").alias("c"), "n"), "long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    many = long_.agg(F.sum("n")).first()[0] or 0
    dealt = _dealt(rows.join(long_, same).select(*rows.columns), min(MOST_PARTS, -(-many // PART_TURNS))) if many else None

    def room() -> Column:
        # A long system turn leaves at least a quarter of the budget to the other turns.
        return F.greatest(F.lit(budget - history) - F.coalesce("system.size", F.lit(0)), F.lit(max(1, budget // 4)))

    def window_of(before: Column, size: Column) -> Column:
        cell = F.floor(before / room())
        return 2 * cell + (F.floor((before + size - 1) / room()) > cell).cast("bigint")

    def marked(rows: DataFrame, keys: list[str], system: Column | None) -> DataFrame:
        """The turns with their places, tokens before, windows and whether these begin there. ``rows`` has ``run``, ``offset`` and ``prior``."""
        order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("turn"), "role", "text")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        numbered = rows.select(
            "conv_id", "run", "role", "text", "size", "offset", "prior",
            (F.col("run") * (1 << 32) + F.row_number().over(order)).alias("place"),
            (F.col("offset") + F.sum("size").over(so_far) - F.col("size")).alias("before"),
            (F.when(F.first("role").over(so_far) == "system", F.first(F.struct("role", "text", "size")).over(so_far)) if system is None else system).alias("system"),
        )
        windowed = numbered.withColumn("window", window_of(F.col("before"), F.col("size")))
        last = F.coalesce(F.lag("window").over(Window.partitionBy(*keys).orderBy("place")), window_of(F.col("offset") - F.col("prior"), F.col("prior")))
        return windowed.withColumn("begins", ~F.col("window").eqNullSafe(last))

    def shown_later(turns: DataFrame, keys: list[str]) -> DataFrame:
        # Windows that begin within the next ``history`` tokens show this turn again. Every turn has tokens, so ``before`` is strictly rising.
        near = Window.partitionBy(*keys).orderBy("before").rangeBetween(1, history)
        return turns.withColumn("later", F.collect_list(F.when(F.col("begins"), F.col("window"))).over(near))

    none = [F.lit(0).cast("bigint").alias(c) for c in ("run", "offset")]
    short = rows.join(long_, same, "left_anti") if many else rows
    short = short.select("*", *none, F.lit(None).cast("bigint").alias("prior"))
    short_rows = _formatted(shown_later(marked(short, ["conv_id"], None), ["conv_id"]))
    if dealt is None:
        return short_rows

    # One row a part: the tokens before it, the size of the last turn before it, the conversation's system turn.
    whole = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "size")
    sums = dealt.groupBy("conv_id", "run").agg(F.sum("size").alias("total"), F.min(whole).alias("opening"), F.max(whole)["size"].alias("closing"))
    parts = Window.partitionBy("conv_id").orderBy("run")
    opening = F.first("opening").over(parts)
    told = sums.select(
        F.col("conv_id").alias("c"), F.col("run").alias("r"),
        (F.sum("total").over(parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("offset"),
        "total",
        F.lag("closing").over(parts).alias("prior"),
        F.when(opening["role"] == "system", F.struct(opening["role"].alias("role"), opening["text"].alias("text"), opening["size"].alias("size"))).alias("system"),
    )
    told = common.durable(told, "parts")
    part_of = same & (F.col("run") == F.col("r"))

    # Windows that begin within the first ``history`` tokens of the parts, told to the parts before.
    divided = marked(dealt.join(told, part_of).drop("c", "r"), ["conv_id", "run"], F.col("system"))
    starts = divided.where(F.col("begins") & (F.col("before") - F.col("offset") < history)).groupBy("conv_id", "run").agg(F.collect_list(F.struct("before", "window")).alias("starts"))
    ends = told.join(starts, part_of, "left").select("c", "r", (F.col("offset") + F.col("total")).alias("end"), "starts")
    next_ = ends.withColumn("starts", F.lead("starts").over(Window.partitionBy("c").orderBy("r")))
    ahead = F.flatten(F.collect_list("starts").over(Window.partitionBy("c").orderBy("end").rangeBetween(0, history)))
    ahead = common.durable(next_.select("c", "r", ahead.alias("ahead")), "ahead")
    carried = F.filter("ahead", lambda x: x["before"] - F.col("before") <= history)
    long_rows = shown_later(divided, ["conv_id", "run"]).join(ahead, part_of, "left")
    long_rows = long_rows.withColumn("later", F.concat("later", F.coalesce(F.transform(carried, lambda x: x["window"]), F.array().cast("array<bigint>"))))
    return short_rows.unionByName(_formatted(long_rows))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The turns of long conversations with their ``run``, which rises with their order from 0; runs hold about the same number of turns."""
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("m"))
    sliced = alike.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / PART_TURNS))))
    # Bounds are sampled by Spark, so keys must be short.
    whole_role = F.length("role") < PREFIX
    keys = [F.substring("role", 1, PREFIX), F.when(whole_role, F.substring("text", 1, PREFIX)), F.when(whole_role & (F.length("text") < PREFIX), F.col("slice"))]
    ranged = sliced.repartitionByRange(parts, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), *keys)
    copies = F.sequence(F.lit(1).cast("bigint"), F.least(F.col("m") - F.col("slice") * PART_TURNS, F.lit(PART_TURNS)))
    found = ranged.select("*", F.spark_partition_id().cast("bigint").alias("run")).select(*rows.columns, "run", F.explode(copies).alias("copy"))
    found = common.durable(found.select("conv_id", "run", "turn", "role", "text", "size"), "dealt")
    least = found.groupBy("conv_id").agg(F.min("run").alias("least")).withColumnRenamed("conv_id", "c")
    return found.join(least, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("run", F.col("run") - F.col("least")).drop("c", "least")


def _formatted(turns: DataFrame) -> DataFrame:
    """The windows of turns that know their own ``window`` and those that show them ``later``."""

    def member(window: Column, part: int, place: Column, turn: str | None) -> Column:
        of = [F.col(f"{turn}.{c}" if turn else c).alias(c) for c in ("role", "text", "size")]
        return F.struct(window.alias("window"), F.lit(part).alias("part"), place.alias("place"), *of)

    opens = (F.col("place") == 1) & F.col("system").isNotNull()
    repeats = F.col("begins") & F.col("system").isNotNull() & (F.col("place") > 1)
    shown = F.concat(
        F.array(member(F.col("window"), 2, F.col("place"), None)),
        F.transform(F.filter("later", lambda w: ~opens), lambda w: member(w, 1, F.col("place"), None)),
        F.when(repeats, F.array(member(F.col("window"), 0, F.lit(1).cast("bigint"), "system"))).otherwise(F.array()),
    )
    # Windows of short conversations stay where these are: grouping by (conv_id, window) needs no other exchange.
    members = turns.select("conv_id", F.explode(shown).alias("m")).select("conv_id", "m.*")
    head = F.concat(F.lit(BEGIN + OPEN), escaped(F.col("role")), F.lit(SHUT))
    body = escaped(F.col("text"))
    pieces = members.select("conv_id", "window", "part", "place", "role", "size", F.length(head).alias("h"), F.length(body).alias("b"), F.concat(head, body, F.lit(END)).alias("piece"))
    own = Window.partitionBy("conv_id", "window").orderBy("part", "place")
    at = F.sum(F.length("piece")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")
    placed = pieces.withColumn("at", at)
    target = (F.col("part") == 2) & (F.col("role") == "assistant")
    return placed.groupBy("conv_id", "window").agg(
        F.min(F.when(F.col("part") == 2, F.col("place"))).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.count(F.when(F.col("part") < 2, 1)).alias("repeated"),
        F.array_sort(F.collect_list(F.when(target, F.struct((F.col("at") + F.col("h")).alias("start"), F.col("b").alias("size"))))).alias("loss"),
        F.sum("size").alias("tokens"),
    ).drop("window")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``first``, ``turns`` (array of role and text of the new turns) and ``targets`` (array of texts under the mask), from the output."""
    parts = F.split("formatted", END)
    every = F.slice(parts, F.lit(1), F.size(parts) - 1)
    new = F.slice(every, F.col("repeated").cast("int") + 1, F.size(every))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SHUT, 1)
        return F.struct(
            unescaped(F.substring(role, F.lit(len(BEGIN + OPEN) + 1), F.length(role))).alias("role"),
            unescaped(F.substring(piece, F.length(role) + len(SHUT) + 1, F.length(piece))).alias("text"),
        )

    targets = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return formatted.select("conv_id", "first", F.transform(new, turn).alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def digests(back: DataFrame) -> DataFrame:
    """Per conversation: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    told = back.select("conv_id", "first", F.size("turns").alias("n"), lines.alias("lines"), F.array_join("targets", "").alias("loss"), "chars")
    whole = told.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first", "lines", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["lines"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
