"""Chat formatting in windows of a token budget.

Turns of a conversation are laid end to end by the prefix sums of their tokens. A window takes the
turns that start in one stretch of half its room; a turn longer than half the room stands alone. So a
window holds whole turns and stays within its budget unless one turn (or the system turn) alone is
longer. Every window starts with the conversation's system turn, then repeats as many of the turns
before it as fit the history budget, then brings its own turns. Only the texts of its own assistant
turns are under the loss mask, so each is a target exactly once.

A turn is ``<|role|>\\n`` text ``<|end|>\\n``. Inside roles and texts the characters ``&``, ``<``, ``[``
and ``|`` are written as entities, so no text can contain a marker, and reading back is exact.

Order within a conversation is turn (nulls first), role, text. Null role or text: empty. A null conv_id
is a conversation of its own; repeated rows are turns of their own. A system turn counts as such only
in first place. All steps are DataFrame expressions. Prefix sums are taken in chunks of turns first,
so a very long conversation is not one task's work until its windows are read back as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 1024
HISTORY = 192
#: Turns whose prefix sums one task takes together.
CHUNK_TURNS = 64
#: What counts as a token of the budget: runs of letters or digits and single other characters.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Tokens of the markers of a turn.
MARKER_TOKENS = 8

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, tokens, and from the prefix sums: at (number of the turn) and start (tokens
    before it)."""
    t = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({
        "chunk": F.floor(F.col("turn") / CHUNK_TURNS),
        "tokens": F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKER_TOKENS,
    })
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    local = t.withColumns({
        "at": F.count(F.lit(1)).over(order), "start": F.coalesce(F.sum("tokens").over(order), F.lit(0)),
    })
    chunks = t.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        F.col("conv_id").alias("c_conv"), F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"),
    )
    return local.join(offsets, F.col("conv_id").eqNullSafe(F.col("c_conv")) & F.col("chunk").eqNullSafe(F.col("c_chunk"))).select(
        "conv_id", "role", "text", "tokens", (F.col("at") + F.col("n_before")).alias("at"), (F.col("start") + F.col("s_before")).alias("start"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, n_tokens, text, new_from (where its own turns begin), loss
    (array of start and length; code points of ``text``)."""
    rows = numbered(turns).withColumns({
        "head": F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n")), "body": escaped(F.col("text")),
        "is_system": (F.col("at") == 0) & (F.col("role") == "system"),
    })
    system = rows.filter("is_system").select(
        F.col("conv_id").alias("s_conv"), F.col("tokens").alias("s_tokens"), F.col("head").alias("s_head"), F.col("body").alias("s_body"))
    placed = rows.join(system.select("s_conv", "s_tokens"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").withColumn(
        "half", F.floor(F.greatest(F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)), F.lit(budget // 4)) / 2))
    # the system turn takes no room of its own stretch; what follows it is counted from 0
    placed = placed.withColumns({
        "start": F.greatest(F.col("start") - F.coalesce("s_tokens", F.lit(0)), F.lit(0)),
        "long_turn": ~F.col("is_system") & (F.col("tokens") > F.col("half")),
    }).withColumn("stretch", F.floor(F.col("start") / F.col("half")))
    # within a stretch only its last turn can be a long one
    own = placed.withColumn("window", 2 * F.col("stretch") + F.col("long_turn").cast("long")).select(
        "conv_id", "window", "stretch", "at", "start", "half", "tokens", "role", "head", "body", "is_system")
    windows = own.groupBy("conv_id", "window", "stretch").agg(F.min("at").alias("w_at"), F.min("start").alias("w_start")).select(
        F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), F.col("stretch").alias("w_stretch"), "w_at", "w_start")
    # a turn is history of the windows that begin within the history budget behind its start
    targets = F.explode(F.sequence("stretch", F.floor((F.col("start") + history) / F.col("half"))))
    repeated = own.filter("not is_system").withColumn("to", targets).join(
        windows, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("to") == F.col("w_stretch"))
        & (F.col("at") < F.col("w_at")) & (F.col("start") >= F.col("w_start") - history))
    again = windows.filter("w_at > 0").join(system, F.col("w_conv").eqNullSafe(F.col("s_conv")))

    def part(conv: str, window: str, rank, at, tokens: str, head: str, body: str, target) -> list[Column]:
        return [F.col(conv).alias("conv_id"), F.col(window).alias("window"),
                F.struct(F.lit(rank).alias("rank"), F.col(at).alias("at") if isinstance(at, str) else F.lit(at).cast("long").alias("at"),
                         F.col(tokens).alias("tokens"), F.col(head).alias("head"), F.col(body).alias("body"), target.alias("target")).alias("p")]

    parts = own.select(part("conv_id", "window", 2, "at", "tokens", "head", "body", F.col("role") == "assistant")).unionByName(
        repeated.select(part("conv_id", "w_window", 1, "at", "tokens", "head", "body", F.lit(False)))).unionByName(
        again.select(part("w_conv", "w_window", 0, -1, "s_tokens", "s_head", "s_body", F.lit(False))))
    grouped = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    size = lambda p: F.length(p.head) + F.length(p.body) + len(END)
    walk = F.aggregate(
        "ps", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda s, p: F.struct((s.at + size(p)).alias("at"), F.when(p.target, F.concat(s.loss, F.array(F.struct(
            (s.at + F.length(p.head)).alias("start"), F.length(p.body).alias("length"))))).otherwise(s.loss).alias("loss")))
    total = lambda of: F.aggregate(of, F.lit(0), lambda s, p: s + size(p))
    return grouped.select(
        "conv_id", "window", F.aggregate("ps", F.lit(0).cast("long"), lambda s, p: s + p.tokens).alias("n_tokens"),
        F.array_join(F.transform("ps", lambda p: F.concat(p.head, p.body, F.lit(END))), "").alias("text"),
        total(F.filter("ps", lambda p: p["rank"] < 2)).alias("new_from"), walk.loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: conv_id, turns (array of role, text), loss_text,
    formatted_chars."""
    parts = windows.select("conv_id", F.struct(
        "window", F.expr("substring(text, new_from + 1)").alias("own"), F.length("text").cast("long").alias("chars"),
        F.array_join(F.transform("loss", lambda x: unescaped(F.substring("text", x.start + 1, x.length))), "").alias("loss")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    segments = F.split(F.array_join(F.transform("ws", lambda w: w.own), ""), r"<\|end\|>\n")
    turns = F.transform(F.slice(segments, 1, F.size(segments) - 1), lambda s: F.struct(
        unescaped(F.regexp_extract(s, r"(?s)^<\|([^|]*)\|>\n(.*)$", 1)).alias("role"),
        unescaped(F.regexp_extract(s, r"(?s)^<\|([^|]*)\|>\n(.*)$", 2)).alias("text")))
    return whole.select(
        "conv_id", turns.alias("turns"), F.array_join(F.transform("ws", lambda w: w.loss), "").alias("loss_text"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w.chars).alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
