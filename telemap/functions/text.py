"""Column expressions on command lines, paths and labels.

All of them are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How an open quote is repaired, how long a hover text may get and
# how a cut is marked, the label of points without one, and the glyph-less
# character that keeps equal labels apart.
BROKEN = '" <broken>'
HOVER_CHARS = 100
HOVER_CUT = "[...]"
UNLABELLED = "Unlabelled"
INVISIBLE = "\u202d"

# One token of a non-POSIX shell split: a quoted run, a run that does not start
# with a quote, or a quote that is never closed.
SHELL_TOKEN = r"""'[^']*'|"[^"]*"|[^ \t\r\n"'][^ \t\r\n]*|["'][\s\S]*"""


def cmdline(path: Column, args: Column) -> Column:
    """Quoted program path followed by its arguments; null without a path."""
    return F.trim(F.concat(F.lit('"'), path, F.lit('" '), F.coalesce(args, F.lit(""))))


def _split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SHELL_TOKEN), F.lit(0))


def _left_open(tokens: Column) -> Column:
    """Does the last token start with a quote that is never closed?"""
    last = F.try_element_at(tokens, F.lit(-1))
    mark = F.left(last, F.lit(1))
    is_quote = mark.isin('"', "'")
    return F.coalesce(is_quote & (F.instr(F.substr(last, F.lit(2)), mark) == 0), F.lit(False))


def shell_tokens(text: Column) -> Column:
    """Split as a shell would, keeping quotes; null where the text cannot be split.

    Text with an open quote is tried again with a closing repair.  Use
    :func:`tokenize` on whole tables: it splits each text only once.
    """
    return _repaired(text, _split(text))


def _repaired(text: Column, tokens: Column) -> Column:
    again = _split(F.concat(text, F.lit(BROKEN)))
    return F.when(~_left_open(tokens), tokens).otherwise(F.when(~_left_open(again), again))


def tokenize(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Add the shell tokens of column ``text`` to ``df``."""
    return df.withColumn(out, _split(F.col(text))).withColumn(
        out, _repaired(F.col(text), F.col(out))
    )


def hover_text(n: Column, text: Column) -> Column:
    """Count prefix for repeated objects, then the text, cut after the prefix."""
    prefix = F.when(n > 1, F.concat(F.lit("("), n.cast("string"), F.lit("x) "))).otherwise("")
    whole = F.concat(prefix, text)
    return F.when(
        F.length(whole) > HOVER_CHARS,
        F.concat(F.substring(whole, 1, HOVER_CHARS), F.lit(HOVER_CUT)),
    ).otherwise(whole)


def base_name(path: Column, separator: str = "\\") -> Column:
    """Text after the last separator."""
    return F.substring_index(path, separator, -1)


def args_of(line: Column, name: Column) -> Column:
    """Program name followed by everything after the second quote of the line."""
    pieces = F.split(line, '"')
    tail = F.slice(pieces, F.lit(3), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.concat(name, F.array_join(tail, '"'))


def to_zone(ts: Column, zone: str = "-05:00") -> Column:
    """Wall-clock time in ``zone``; for display only."""
    return F.from_utc_timestamp(ts, zone)


def host_time_text(host: Column, ts: Column, zone: str = "-05:00") -> Column:
    return F.concat(host, F.lit(", "), F.date_format(to_zone(ts, zone), "MMM dd, HH:mm"))


def bits_text(name: Column, bits: Column) -> Column:
    """Name and bits to one decimal, halves going to the even digit of the exact value.

    ``format_string`` rounds the printed decimal half up; here the double is
    widened to its exact decimal value first, so 2.25 gives 2.2 and 0.35 gives 0.3.
    """
    return F.concat(name, F.lit(" "), one_decimal(bits).cast("string"))


def one_decimal(value: Column) -> Column:
    tenths = value * 10
    low = F.floor(tenths)
    # The product's rounding error decides cases such as 0.35, whose exact value
    # lies below the half; the remainder below recovers that error exactly.
    half = low.cast("double") + 0.5
    error = _product_error(value, tenths)
    above = (tenths > half) | ((tenths == half) & (error > 0))
    below = (tenths < half) | ((tenths == half) & (error < 0))
    picked = F.when(above, low + 1).when(below, low).otherwise(
        F.when(F.pmod(low, F.lit(2)) == 0, low).otherwise(low + 1)
    )
    return (picked.cast("decimal(24,1)") / F.lit(10)).cast("decimal(24,1)")


def _product_error(value: Column, tenths: Column) -> Column:
    """Exact ``10 * value - tenths`` by splitting the double in two halves."""
    big = value * F.lit(134217729.0)
    high = big - (big - value)
    low = value - high
    return (high * 10 - tenths) + low * 10


def gap_sign(local: Column, base: Column) -> Column:
    return F.when(local > base, F.lit(">")).otherwise(F.lit("<"))


def join_lines(parts: Column) -> Column:
    """Join an array of ``struct(rank, text)`` by newline in rank order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "\n")


def unique_label(topic: Column, cluster: Column) -> Column:
    """Make equal topics of different clusters distinct without changing their look."""
    return F.when(
        F.coalesce(topic, F.lit("")) != "",
        F.concat(topic, F.repeat(F.lit(INVISIBLE), cluster.cast("int"))),
    ).otherwise(F.lit(UNLABELLED))
