"""Line dedup: a suffix array over line ids by distributed prefix doubling; later copies of repeated runs are deleted.

Lines that occur once break every repeated run, so they are put aside: what is left are islands of consecutive lines
that each occur at least twice somewhere. Of islands with equal content the first takes part; the others are later
copies as wholes. Documents go by doc_id (nulls last), then by a hash of the text.

Doubling: a line's rank is its place in the order of line ids. A round pairs the rank of each suffix with that of the
suffix 2^k lines on, sorts the distinct pairs, and makes a pair's place the new rank, until no repeated pair can go on.
The last ranks order the suffixes. Suffixes with equal ranks of a round are an LCP interval of 2^k lines or more.

LCP intervals: from the longest rounds to the shortest, every suffix is moved into the interval that shares 2^k lines
more, if it is not the first of it. The interval's first suffix stays behind and its copy goes along as a witness, so
each suffix ends in the deepest interval in which an earlier one precedes it: its longest repeated run, unlimited in
length. A run of MIN_WORDS words or more is deleted, that is any run that is not blank; the first copy of its lines is
never among them.

Null and empty texts are one empty line. Empty lines have no words; they join runs but make none. Rows with equal
doc_id and text are one document. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, fresh, materialise, partitions, table

#: One: a line in a script without spaces is one word, and only runs of blank lines are left.
MIN_WORDS = 1
#: Parts into which the islands of one content are dealt where they meet their first.
SALTS = 64
MAX_ID = (1 << 63) - 1
KEY = ["doc", "t1", "t2"]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _keys() -> list[Column]:
    """What stands for a document and orders it."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("doc"), F.xxhash64(_text()).alias("t1"), F.xxhash64(F.lit("2"), _text()).alias("t2")]


def split_lines(docs: DataFrame) -> DataFrame:
    """doc, t1, t2, pos, l1, l2 (128 bits of a line's hash) and words of every line."""
    lines = docs.select(*_keys(), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    return lines.select(*KEY, "pos", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("2"), "line").alias("l2"), F.regexp_count("line", F.lit(r"[^\s]+")).alias("words"))


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with `name`: longs in the order of `by`, settled once they are written."""
    n = partitions(rows.sparkSession)
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def repeated(lines: DataFrame) -> DataFrame:
    """Lines that occur twice or more, with their rank. Counting sums a common line before it is shuffled, and of the join AQE splits it."""
    ids = materialise(_ranked(lines.groupBy("l1", "l2").count().filter("count > 1"), ["l1", "l2"], "rank"), "ids")
    ids = ids.select(F.col("l1").alias("k1"), F.col("l2").alias("k2"), "rank")
    return lines.join(ids, (F.col("l1") == F.col("k1")) & (F.col("l2") == F.col("k2"))).select(*KEY, "pos", "words", "rank")


def islands(lines: DataFrame) -> DataFrame:
    """doc, t1, t2, start, ranks and words of each island, and whether an equal one comes before it (copy)."""
    lines = lines.dropDuplicates([*KEY, "pos"])
    place = F.col("pos") - F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))
    own = lines.withColumn("island", place).groupBy(*KEY, "island").agg(F.sort_array(F.collect_list(F.struct("pos", "rank", "words"))).alias("ls"))
    own = own.select(*KEY, F.col("ls")[0]["pos"].alias("start"), F.col("ls.rank").alias("ranks"), F.col("ls.words").alias("words"))
    own = own.withColumn("content", F.sha2(F.array_join(F.col("ranks").cast("array<string>"), ","), 256))
    own = materialise(own.withColumn("salt", F.pmod(F.xxhash64(*KEY, "start"), F.lit(SALTS))), "islands")
    # the first of each part, of these the first of a content, which goes back to the parts that there are
    parts = own.groupBy("content", "salt").agg(F.min(F.struct(*KEY, "start")).alias("first"))
    first = parts.groupBy("content").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts")).select("content", "first", F.explode("salts").alias("salt"))
    return own.join(first, ["content", "salt"]).withColumn("copy", F.struct(*KEY, "start") != F.col("first")).drop("content", "salt", "first")


def suffixes(own: DataFrame) -> DataFrame:
    """A row for each line of the islands: at (consecutive in an island, ascending with documents), base and stop (an
    island's first at, and the one past its last), rank, before (words of the island before the line)."""
    n = partitions(own.sparkSession)
    rows = own.repartitionByRange(n, *KEY, "start").sortWithinPartitions(*KEY, "start")
    rows = rows.select(*KEY, "start", F.size("ranks").alias("size"), F.posexplode(F.arrays_zip("ranks", "words")).alias("i", "l")).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("base", F.col("at") - F.col("i"))
    before = F.sum("l.words").over(Window.partitionBy("base").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return materialise(rows, "suffixes").withColumn("before", F.coalesce(before, F.lit(0))).select(*KEY, "start", "i", "at", "base", (F.col("base") + F.col("size")).alias("stop"), F.col("l.ranks").alias("rank"), F.col("l.words").alias("words"), "before")


def doubled(rows: DataFrame) -> list[DataFrame]:
    """Ranks by round: tables (at, base, rank), the k-th by the first 2^k lines. The last orders the suffixes."""
    levels = [materialise(rows.select("at", "base", "rank"), "ranks")]
    while True:
        h = 1 << (len(levels) - 1)
        ahead = F.coalesce(F.lead("rank", h).over(Window.partitionBy("base").orderBy("at")), F.lit(-1))
        paired = materialise(levels[-1].withColumn("ahead", ahead), "paired")
        pairs = materialise(_ranked(paired.groupBy("rank", "ahead").count(), ["rank", "ahead"], "next"), "pairs")
        if pairs.filter("count > 1 AND ahead >= 0").isEmpty():
            drop_table(paired)
            return levels
        pairs = pairs.select(F.col("rank").alias("r"), F.col("ahead").alias("a"), "next")
        levels.append(materialise(paired.join(pairs, (F.col("rank") == F.col("r")) & (F.col("ahead") == F.col("a"))).select("at", "base", F.col("next").alias("rank")), "ranks"))
        drop_table(paired)


def longest_earlier(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """at, length: of each suffix's longest run that an earlier suffix begins with, where there is one."""
    state = rows.select("at", "stop", F.lit(0).cast("long").alias("length"), F.lit(-1).cast("long").alias("group"), F.lit(True).alias("asks"))
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        ranks = levels[k].select(F.col("at").alias("there"), F.col("rank").alias("x"))
        fits = F.col("at") + F.col("length") + size <= F.col("stop")
        met = state.withColumn("to", F.when(fits, F.col("at") + F.col("length"))).join(ranks, F.col("to") == F.col("there"), "left").drop("to", "there")
        met = materialise(met, "met")
        first = met.filter("x IS NOT NULL").groupBy("group", "length", "x").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("group").alias("g"), F.col("length").alias("l"), F.col("x").alias("y"), "first")
        first = materialise(first, "first")
        joined = met.join(first, (F.col("group") == F.col("g")) & (F.col("length") == F.col("l")) & (F.col("x") == F.col("y")), "left")
        on = F.col("first").isNotNull() & (F.col("at") != F.col("first"))
        moved = joined.select("at", "stop", F.when(on, F.col("length") + size).otherwise(F.col("length")).alias("length"), F.when(on, F.col("first")).otherwise(F.col("group")).alias("group"), "asks", (F.col("at") == F.col("first")).alias("leads"))
        copies = moved.filter("leads").select("at", "stop", (F.col("length") + size).alias("length"), F.col("at").alias("group"), F.lit(False).alias("asks"))
        old, state = state, materialise(moved.drop("leads").unionByName(copies), "state")
        for done in (met, first, *([old] if k < len(levels) - 1 else [])):
            drop_table(done)
    return state.filter("asks AND length > 0").select("at", "length")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, t1, t2 and removed (sorted line numbers, from 0) of the documents that lose lines."""
    lines = materialise(split_lines(docs), "lines")
    own = materialise(islands(materialise(repeated(lines), "repeated")), "own")
    whole = own.filter("copy").filter(F.aggregate("words", F.lit(0), lambda a, w: a + w) >= min_words)
    whole = whole.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.size("ranks") - 1)).alias("pos"))
    rows = materialise(suffixes(own.filter("NOT copy")), "rows")
    runs = longest_earlier(rows, doubled(rows))
    ends = rows.select(F.col("at").alias("last"), (F.col("before") + F.col("words")).alias("through"))
    long = rows.join(runs, "at").withColumn("end", F.col("at") + F.col("length")).join(ends, F.col("end") - 1 == F.col("last")).filter(F.col("through") - F.col("before") >= min_words).select(F.col("at").alias("from"), "end")
    covered = rows.join(long, rows["at"] == long["from"], "left").withColumn("reach", F.max("end").over(Window.partitionBy("base").orderBy("at")))
    parts = covered.filter("reach > at").select(*KEY, (F.col("start") + F.col("i")).cast("int").alias("pos"))
    return whole.unionByName(parts).groupBy(*KEY).agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def _spans(removed: Column) -> Column:
    """Runs of consecutive line numbers as structs (start, end), end exclusive."""
    starts = F.filter(removed, lambda p, i: (i == 0) | (F.get(removed, i - 1) != p - 1))
    ends = F.filter(removed, lambda p, i: (i == F.size(removed) - 1) | (F.get(removed, i + 1) != p + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, their texts without the removed lines, with docs' own columns."""
    names = {k: fresh(k, docs.columns) for k in KEY}
    gone = removed_lines(docs, min_words)
    gone = gone.select(*[F.col(k).alias(names[k] + "_gone") for k in KEY], F.col("removed").alias(fresh("removed", docs.columns)))
    keyed = docs.select("*", *[c.alias(names[k]) for k, c in zip(KEY, _keys(), strict=True)])
    met = keyed.join(gone, [F.col(names[k]) == F.col(names[k] + "_gone") for k in KEY], "left")
    out = gone.columns[-1]
    pieces = F.split(_text(), "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), out), lambda i: F.get(pieces, i)), "\n")
    return met.withColumn("text", F.when(F.col(out).isNotNull(), left).otherwise(F.col("text"))).select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and spans of every document: runs of removed lines as start-end (from 0, end exclusive), comma-joined."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).select(*[F.col(k).alias(k + "_") for k in KEY], "removed")
    keyed = docs.select("doc_id", F.size(F.split(_text(), "\n")).cast("long").alias("n_lines"), *_keys())
    met = keyed.join(gone, [F.col(k) == F.col(k + "_") for k in KEY], "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    spans = F.array_join(F.transform(_spans(gone), lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return met.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), spans.alias("spans"))


# A line with words goes if it occurs before. A blank one lies in a removed run if it is reached from the last line with
# words before it, or reaches the next one after it, by a run that occurs before: at `back` and `fore`. doc_id is unique.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
w AS (SELECT *, regexp_matches(line, '[^\s\x0B]')::INT AS word FROM l),
g AS (SELECT *, sum(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before, sum(word) OVER (PARTITION BY doc_id ORDER BY pos DESC) AS after FROM w),
s AS (SELECT doc_id, pos, before, after, string_agg(line, chr(10)) OVER (PARTITION BY doc_id, before ORDER BY pos) AS back,
  string_agg(line, chr(10)) OVER (PARTITION BY doc_id, after ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fore FROM g),
r AS (SELECT doc_id, pos, (before > 0 AND row_number() OVER (PARTITION BY before > 0, back ORDER BY doc_id, pos) > 1) OR (after > 0 AND row_number() OVER (PARTITION BY after > 0, fore ORDER BY doc_id, pos) > 1) AS gone FROM s),
i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM r WHERE gone),
p AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS b FROM i GROUP BY doc_id, island),
d AS (SELECT doc_id, sum(b - a)::BIGINT AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM p GROUP BY doc_id)
SELECT t.doc_id, len(string_split(coalesce(t.text, ''), chr(10))) AS n_lines, coalesce(d.n, 0) AS n_removed, coalesce(d.spans, '') AS spans FROM documents t LEFT JOIN d ON t.doc_id = d.doc_id
"""
