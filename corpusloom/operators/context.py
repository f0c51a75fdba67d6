"""Context assembly: blocks packed into a token budget."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, CHARS_A_TOKEN, CONTEXT_LINES = 8000, 4, 3


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / CHARS_A_TOKEN).cast("long")


def pack_blocks(blocks: DataFrame, by: list[str], budget: int = BUDGET) -> DataFrame:
    """Greedy packing of blocks (rank, tokens) in rank order: the first always goes in, clipped to the budget; a later one
    that overflows is skipped and the next is tried.

    A size that once overflows always will, so of blocks of one size only the first budget / size by rank can go in; the
    fold is over these, a number that the budget bounds. Of blocks without tokens the fold sees the first; all go in.
    """
    size = F.least("tokens", F.lit(budget + 1))
    nth, most = "nth_of_its_size", F.when(size == 0, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(budget) / size)))
    counted = blocks.withColumn(nth, F.row_number().over(Window.partitionBy(*by, size).orderBy("rank")))
    empty = counted.filter((F.col("tokens") == 0) & (F.col(nth) > 1)).drop(nth).withColumn("packed_tokens", F.lit(0).cast("long"))
    blocks = counted.filter(F.col(nth) <= most).drop(nth)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "tokens", *[c for c in blocks.columns if c not in (*by, "rank", "tokens")])))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<i:int,tokens:long>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        first = F.size(s["kept"]) == 0
        n = F.when(first, F.least(x["b"]["tokens"], F.lit(budget))).otherwise(x["b"]["tokens"]).cast("long")
        fits = first | (s["used"] + n <= budget)
        return F.struct(F.when(fits, s["used"] + n).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(F.struct(x["i"].cast("int").alias("i"), n.alias("tokens"))))).otherwise(s["kept"]).alias("kept"))

    own = blocks.groupBy(*by).agg(ordered.alias("bs"))
    own = own.withColumn("state", F.aggregate(F.transform("bs", lambda b, i: F.struct(i.alias("i"), b.alias("b"))), start, step))
    rows = own.select(*by, "bs", F.explode("state.kept").alias("k"))
    packed = rows.select(*by, F.element_at("bs", F.col("k.i") + 1).alias("b"), F.col("k.tokens").alias("packed_tokens")).select(*by, "b.*", "packed_tokens")
    return packed.unionByName(empty)


def clip_around(lines: list[str], salient: int, max_bytes: int) -> tuple[int, int]:
    """First and last line (from 0) of a block cut to a size: the salient line, then lines after and before it by turns."""
    size = lambda i: len(lines[i].encode()) + 1
    low = high = salient
    used, down = size(salient), True
    open_low, open_high = low > 0, high + 1 < len(lines)
    while open_low or open_high:
        go_down = down and open_high or not open_low
        at = high + 1 if go_down else low - 1
        if used + size(at) > max_bytes:
            if go_down:
                open_high = False
            else:
                open_low = False
        else:
            used += size(at)
            low, high = (low, at) if go_down else (at, high)
            open_low, open_high = open_low and low > 0, open_high and high + 1 < len(lines)
        down = not go_down
    return low, high


def utf8_prefix(text: str, max_bytes: int) -> str:
    """The longest prefix of whole characters within a number of bytes."""
    return text.encode()[:max_bytes].decode("utf-8", "ignore")


def numbered_lines(lines: DataFrame, by: str) -> DataFrame:
    """Source lines with their numbers, as one text a document."""
    shown = F.transform(F.sort_array(F.collect_list(F.struct("line", "line_text"))), lambda x: F.concat(F.lpad(x["line"].cast("string"), 6, " "), F.lit("\t"), x["line_text"]))
    return lines.groupBy(by).agg(F.array_join(shown, "\n").alias("source"))


def expand_block(lines: list[str], first: int, last: int, pad: int = CONTEXT_LINES) -> tuple[int, int]:
    """A hit's block, lines from 1: padded, then grown to where its braces close or open, or over its indentation.

    Braces left open in the hit are followed down to the line that closes them, closed ones up to the line that opens
    them. A balanced hit grows over the neighbouring lines that are blank or indented as much, blank ends cut off, and
    takes in the less indented line above. A hit at the margin is only padded.
    """
    n = len(lines)
    first = min(max(first, 1), n)
    last = min(max(last, first), n)
    low, high = max(1, first - pad), min(n, last + pad)
    net = [0]
    for x in lines:
        net.append(net[-1] + x.count("{") - x.count("}"))
    hit = net[last] - net[first - 1]
    if hit > 0:
        return low, max(high, next((i for i in range(last, n + 1) if net[i] <= net[first - 1]), n))
    if hit < 0:
        return min(low, next((i for i in range(first, 0, -1) if net[last] >= net[i - 1]), 1)), high
    blank = lambda i: not lines[i - 1].strip()
    indent = lambda i: len(lines[i - 1]) - len(lines[i - 1].lstrip(" \t"))
    least = min((indent(i) for i in range(first, last + 1) if not blank(i)), default=0)
    if least:
        a = next((i + 1 for i in range(first - 1, 0, -1) if not blank(i) and indent(i) < least), 1)
        b = next((i - 1 for i in range(last + 1, n + 1) if not blank(i) and indent(i) < least), n)
        while a < b and blank(a):
            a += 1
        while b > a and blank(b):
            b -= 1
        a -= a > 1 and not blank(a - 1) and indent(a - 1) < least
        low, high = min(low, a), max(high, b)
    return low, high


def expand_scoped(lines: list[str], first: int, last: int, scope: tuple[int, int] | None, pad: int = CONTEXT_LINES) -> tuple[int, int]:
    """A hit's block as the definition around its first line: scope is its bytes (end exclusive), as symbols.enclosing
    finds it. Without one, or with an empty one, as expand_block."""
    if scope is None or scope[1] <= scope[0] or not lines:
        return expand_block(lines, first, last, pad)
    starts = [0]
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x.encode()) + 1)
    low, high = (max(1, bisect_right(starts, at)) for at in (scope[0], scope[1] - 1))
    return low, max(low, high)
