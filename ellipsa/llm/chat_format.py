"""Conversations as one training text each, with a loss mask, in Spark expressions only.

The template of a block, one for each run of adjacent turns of one role::

    <|turn|>ROLE<|text|>TEXT[<|also|>TEXT ...]<|end|>\\n

Control strings all start with ``<|``. Inside roles and texts a backslash becomes ``\\b`` and ``<|``
becomes ``\\l|``, so no text can hold a control string and both steps can be undone: after the
escape each backslash is followed by ``b`` or ``l``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, ALSO, END = "<|turn|>", "<|text|>", "<|also|>", "<|end|>\n"
RUN = 4096


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _chunks(values: Column) -> Column:
    """An array cut into about as many parts as each has elements."""
    n = F.size(values)
    width = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(values, k * width + 1, width))).otherwise(F.array())


def _running(values: Column) -> Column:
    """0, then the sums of the first one, two, ... values. An appending fold copies what it has, so folds must be short."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length in code points of ``formatted``).

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Turns are sorted by
    turn, then role, then text, so ties and repeated rows have one order and each is kept; a null
    turn comes first. Null roles and texts are empty. A row without a conv_id belongs to no other: it is a conversation of
    one turn, with a null conv_id. Adjacent turns of one role share a block. The spans cover each text of
    ``trained_role`` once and no control string. The work grows with turns to the power 1.5 at most. An empty table gives no rows.
    """
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = turns.select("conv_id", alone, turn.alias("t"))
    grouped = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Adjacent turns of one role merge: only the first of a run opens a block, only the next run or the end closes it. What a step needs of
    # another array comes in as an argument: an array named inside a function may be computed anew for each element.
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t.role)), 1, F.size("turns"))
    opening = lambda t: F.concat(F.lit(TURN), escape(t.role), F.lit(TEXT))
    head = lambda t, role: F.when(role.isNull(), opening(t)).when(role == t.role, F.lit(ALSO)).otherwise(F.concat(F.lit(END), opening(t)))
    piece = F.zip_with("turns", before, lambda t, role: F.struct(head(t, role).alias("head"), escape(t.text).alias("body"), (t.role == trained_role).alias("loss")))
    pieces = grouped.select("conv_id", piece.alias("pieces"))
    lengths = F.transform("pieces", lambda p: (F.length(p.head) + F.length(p.body)).cast("long"))
    summed = pieces.withColumn("lengths", lengths).select("conv_id", "pieces", F.transform(_chunks(F.col("lengths")), _running).alias("sums"))
    bases = _running(F.transform("sums", lambda s: F.element_at(s, -1)))
    begins = F.flatten(F.zip_with("sums", F.slice(bases, 1, F.size("sums")), lambda s, base: F.transform(F.slice(s, 1, F.size(s) - 1), lambda v: v + base)))
    span = lambda p, at: F.when(p.loss, F.struct((at + F.length(p.head)).alias("start"), F.length(p.body).cast("long").alias("length")))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body)), ""), F.lit(END))
    return summed.select("conv_id", formatted.alias("formatted"), F.array_compact(F.zip_with("pieces", begins, span)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), every original turn apart."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(F.substring_index(b, TEXT, -1), END, 1), r"<\|also\|>", -1),
                lambda t: F.struct(unescape(F.substring_index(b, TEXT, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, with nothing between.

    The text is cut into runs of ``RUN`` code points first: a place in one long text is found only by counting from its start.
    """
    runs = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))

    def under(runs: Column, s: Column) -> Column:
        first, last = F.floor(s.start / RUN), F.floor((s.start + s.length) / RUN)
        some = F.array_join(F.slice(runs, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescape(F.substring(some, (s.start - first * RUN + 1).cast("int"), s.length.cast("int")))

    # an array of one binds the runs to a name, so that they are computed once
    return F.get(F.transform(F.array(runs), lambda r: F.array_join(F.transform(spans, lambda s: under(r, s)), "")), F.lit(0))
