"""Chat formatting with DataFrame functions only: a grammar that survives its own round trip.

A turn is a header, a body and ``TURN_END``; a conversation is its turns, one
after the other.  Headers and ends hold control strings, and a body must hold
none that is not escaped.  Each turn is rendered as it is and read again by the
parser; where what comes back is not what went in (a text holds a control
string, or an escaped one), every control string in it gets one backslash in
front, and the parser takes one away.  The assembled conversation is read once
more and compared with its source: a difference ends the job.

The grammar is unambiguous: control strings neither overlap nor hold a line
feed, the ends begin with one, and headers end in a space, so that none can
arise where text and template meet.

Defined results: null text and null role count as empty; the roles of ``NAMED``
have headers of their own, any other role is written out, escaped like a text;
turns of one conversation stand by turn, null first, of one turn by role and
then text, repeated rows stay; rows without an id form one conversation; extra
columns are ignored; an empty table gives no conversation.  A conversation,
however long, is one string in one row (its digest is over all of it in
order), so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles with a header of their own.
NAMED = {"system": "System", "user": "User", "assistant": "Assistant"}
OTHER = "Role"
TURN_END, ROLE_END = "\n</turn>\n", "\n</role>\n"
#: What a text must not hold unless a backslash stands in front.
CONTROL = r"### (?:System|User|Assistant|Role):|</(?:turn|role)>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _clean(text: Column) -> Column:
    """Whether no control string stands without its backslash."""
    return ~text.rlike(rf"(?<!\\)(?:{CONTROL})")


def header(role: Column, written: Column) -> Column:
    """The header of a role; ``written`` is the role as other roles are written out."""
    out = F.concat(F.lit(f"### {OTHER}: "), written, F.lit(ROLE_END))
    for name, title in NAMED.items():
        out = F.when(role == name, F.lit(f"### {title}: ")).otherwise(out)
    return out


def _turn(piece: Column) -> Column:
    """(role, text) of one rendered turn without its end; both null where the grammar has no such turn."""
    title = F.regexp_extract(piece, rf"^### ({'|'.join([*NAMED.values(), OTHER])}): ", 1)
    rest = F.substr(piece, F.length(title) + 7)
    other, end = title == OTHER, F.instr(rest, ROLE_END)
    written = F.when(other, F.substr(rest, F.lit(1), end - 1)).otherwise("")
    body = F.when(other, F.substr(rest, end + len(ROLE_END))).otherwise(rest)
    ok = (title != "") & (~other | (end > 0)) & _clean(written) & _clean(body)
    return F.struct(F.when(ok, F.when(other, unescape(written)).otherwise(F.lower(title))).alias("role"), F.when(ok, unescape(body)).alias("text"))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, each without its end; text after the last end counts as one empty, wrong, turn."""
    cut = F.split(formatted, TURN_END, -1)
    ended = F.slice(cut, F.lit(1), F.size(cut) - 1)
    return F.when(F.element_at(cut, -1) == "", ended).otherwise(F.concat(ended, F.array(F.lit(""))))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    return F.transform(pieces(formatted), _turn)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, formatted, spans.

    ``spans`` holds a struct per turn: start, length, body_start, body_length (code
    points from 0; the end of a turn is part of its length) and loss, true where
    the body is under the loss mask (assistant turns).
    """
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = F.concat(header(F.col("role"), F.col("role")), F.col("text"), F.lit(TURN_END))
    same = parse(plain) == F.array(F.struct("role", "text"))
    tried = base.withColumn("same", F.coalesce(same, F.lit(False)))
    fit = lambda c: F.when(F.col("same"), F.col(c)).otherwise(escape(F.col(c)))
    written = tried.select("conv", "turn", "role", "text", header(F.col("role"), fit("role")).alias("head"), fit("text").alias("body"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    length = F.length("head") + F.length("body") + len(TURN_END)
    placed = written.withColumn("pos", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct(
        F.col("start"),
        length.cast("long").alias("length"),
        (F.col("start") + F.length("head")).alias("body_start"),
        F.length("body").cast("long").alias("body_length"),
        (F.col("role") == "assistant").alias("loss"),
    )
    turns = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(TURN_END)).alias("piece"), span.alias("span"), F.struct("role", "text").alias("source")))).alias("turns"))
    joined = turns.select("conv", F.array_join("turns.piece", "").alias("formatted"), F.col("turns.span").alias("spans"), F.col("turns.source").alias("source"))
    kept = F.when(F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not come back from its own format")))
    return joined.select(F.col("conv").alias(conv), kept.alias("formatted"), "spans")


def under_mask(formatted: str = "formatted", spans: str = "spans") -> Column:
    """All text under the loss mask, unescaped: the masked bodies in order, nothing between."""
    cut = lambda piece, s: F.when(s["loss"], unescape(F.substr(piece, (s["body_start"] - s["start"] + 1).cast("int"), s["body_length"].cast("int")))).otherwise("")
    return F.array_join(F.zip_with(pieces(F.col(formatted)), F.col(spans), cut), "")
