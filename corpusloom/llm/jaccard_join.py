"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class, stood for by
its least doc_id, so groups of copies cost one row. The classes are joined as follows.

1. Shingles are put into one global order, rare ones first: by their count in a sketch of fixed size to which every
   document adds, then by hash. Any total order gives right results; the sketch makes common shingles come last.
2. Two sets of the wanted similarity share a shingle among their first n - ceil(t n) + 1. Each class sends these prefix
   shingles, with its size, their positions and a 16-byte signature, to be sorted by shingle. Rows of a shingle that
   would fill more than a fair share of a task are salted.
3. Classes that meet at a shingle are candidates if they pass the length filter, the positional filter (what stands
   before the first common shingle is lost) and the suffix filter (how both sets fall into 16, and once more 256, parts
   of the hash space bounds their difference from below). Where a few meet, all their pairs are tested. Where many do,
   each is tried on a few leaders first: so that groups of near copies never make all pairs, classes are gathered into
   groups, each following the least class that passes the filters with it.
4. Groups, not classes, then meet at the shingles of many: filters are applied to a group's bounds (its sizes, its first
   position, its leader's signature less the members' greatest distance from it), so no pair of classes that passes the
   filters is lost. Shingles with many groups are dealt into salted blocks of which each two meet in one task. Where over
   DENSE pairs a group pass, no pairs of groups are made: the groups that they connect become one group.
5. A group's sets are packed into blocks: a core, and each member's difference from it. Each two blocks of a group, and
   of two groups that met, are compared in one worker, which verifies every pair of their classes once, on the whole
   sets, counts each class's links and gives one row a class that has any. Pairs themselves are never rows.

Null and empty texts have no shingles and link with nothing; texts with fewer words than a shingle have their whole
sequence as one. Rows with equal doc_id are one document with any of its texts. A row with a null doc_id takes no part
in links and has a null component. Extra columns are not read. An empty table gives no rows. component_id is the least
doc_id that links reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialise, partitions, table
from .components import components

#: Counters of the sketch: its whole size, 4 bytes each, is what is broadcast.
SKETCH = 1 << 20
CHUNK = 1 << 14
#: Parts of the sketch that are added in one worker.
FAN = 64
#: Bits of a filter of ids that is broadcast, at most: with more ids it lets more others through.
FILTER_BITS = 1 << 26
#: A salted shingle's rows in one task: the least, and as a share of all documents.
SALTED, SHARE = 512, 4096
#: Rows of a shingle whose pairs are all tested at once; leaders that those of others are tried on before they stay alone;
#: rows carried from one Arrow batch to the next.
FEW, LEADERS, CARRY = 4, 8, 1 << 17
#: Groups of a shingle that meet in one task; pairs a group, with more of which groups become one.
RUN, DENSE = 2048, 8
#: Classes of a block, and bytes of their sets, about; columns of the products that compare two blocks.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 2048
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles. Words are runs of characters other than [\\x20\\x09-\\x0D]."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _ODD[0] + w[i : n + i] * _ODD[1 + i % 6]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def spare(sizes: np.ndarray | int, threshold: int):
    """Members that two sets of so many together may have in one alone: 100 * shared >= threshold * union."""
    return sizes * (100 - threshold) // (100 + threshold)


def prefix_length(n: int, threshold: int) -> int:
    return n + (-threshold * n) // 100 + 1


def signature(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each of 256 parts, modulo 256."""
    return np.bincount((hashes >> np.uint64(20)).astype(np.int64) & 255, minlength=256).astype(np.uint8)


def folded(signatures: np.ndarray) -> np.ndarray:
    """The same of 16 parts, as two long integers a row."""
    return signatures.reshape(-1, 16, 16).sum(axis=1).astype(np.uint8).view(np.int64).reshape(-1, 2)


def unpacked(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    return np.stack([s1, s2], axis=1).astype(np.int64).view(np.uint8).reshape(-1, 16).astype(np.int16)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 256).astype(np.int16)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two signatures, row by row: no two sets are nearer to each other (in members that one alone has)."""
    apart = (a - b) & 255
    return np.minimum(apart, 256 - apart).sum(axis=1)


def scan_sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows with chunk -1: doc_id, n, digest (two halves) and signature of every row. Others: each task's part of the sketch, in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(SKETCH, np.int64)
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            for some in range(0, len(sets), 500):
                sketch += np.bincount(np.concatenate(sets[some : some + 500]).astype(np.int64) & (SKETCH - 1), minlength=SKETCH)
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "d1": halves[:, 0], "d2": halves[:, 1], "sig": [signature(s).tobytes() for s in sets], "chunk": -1, "part": 0, "counts": None})
        parts = sketch.reshape(-1, CHUNK)
        some = [i for i in range(len(parts)) if parts[i].any()]
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"doc_id": pd.array([None] * len(some), "Int64"), "n": 0, "d1": 0, "d2": 0, "sig": None, "chunk": some, "part": part, "counts": [np.minimum(parts[i], 2**31 - 1).astype(np.int32).tobytes() for i in some]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, d1 long, d2 long, sig binary, chunk int, part int, counts binary")


def whole_sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of all tasks' parts, FAN at a time; its size is fixed."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": pdf["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = scanned.filter("chunk >= 0").select("chunk", "part", "counts")
    tasks = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    while True:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("chunk", "part").applyInPandas(add, "chunk int, part int, counts binary")
        if tasks == 1:
            break
    out = np.zeros(SKETCH, np.int32)
    for r in parts.collect():  # SKETCH / CHUNK rows
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int32)
    return out


def among(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable[[pd.DataFrame], pd.DataFrame]]:
    """Rows of docs, and what a Python worker applies to a batch of them to leave doc_id and text of those with an id among
    ids, and of some others, whose rows the caller drops by a join: a broadcast bit filter of FILTER_BITS at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    bits = min(FILTER_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = ids.select(F.bitmap_bucket_number(bit + 1).alias("part"), F.bitmap_bit_position(bit + 1).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    whole = np.zeros(max(1, bits // 32768) * 4096, np.uint8)
    for r in maps:
        whole[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["bit"].to_numpy(np.int64)
        return pdf.loc[(shared.value[at >> 3] >> (at & 7)) & 1 == 1, ["doc_id", "text"]]

    return rows.withColumn("bit", bit), pick


def prefixes(docs: DataFrame, ids: DataFrame, sketch: np.ndarray, n_docs: int, k: int, threshold: int) -> DataFrame:
    """A row for each prefix shingle of each document with one of the ids, and of some others."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    rows, pick = among(docs, ids)
    usual, fair = int(np.median(sketch)), max(SALTED, n_docs // SHARE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in map(pick, batches):
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(text, k)
                if len(s):
                    counts = shared.value[s.astype(np.int64) & (SKETCH - 1)]
                    first = np.argsort(counts, kind="stable")[: prefix_length(len(s), threshold)]
                    salts = 1 + np.maximum(counts[first] - usual, 0) // fair
                    # 0: not salted, so that all its rows are in one task
                    salt = np.where(salts > 1, 1 + ((doc_id * 0x9E3779B1 >> 7) & 0x7FFFFFFF) % salts, 0)
                    out.append((s[first].astype(np.int64), salt, len(s), doc_id, folded(signature(s))[0]))
            if out:
                many = [len(o[0]) for o in out]
                sig = np.repeat(np.array([o[4] for o in out]), many, axis=0)
                yield pd.DataFrame({"shingle": np.concatenate([o[0] for o in out]), "salt": np.concatenate([o[1] for o in out]), "n": np.repeat([o[2] for o in out], many), "doc_id": np.repeat([o[3] for o in out], many), "at": np.concatenate([np.arange(m) for m in many]), "s1": sig[:, 0], "s2": sig[:, 1]})

    return rows.mapInPandas(run, "shingle long, salt int, n int, doc_id long, at int, s1 long, s2 long")


def _ends(*keys: np.ndarray) -> np.ndarray:
    """Begin of each run of equal keys, and their whole length."""
    m = len(keys[0])
    new = np.zeros(max(0, m - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [m]]) if m else np.zeros(1, np.int64)


def _whole_runs(batches: Iterator[pd.DataFrame], keys: list[str], carry: int | None = None) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut where a key ends, so that a key's rows stay together (but for more than carry of them)."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        begin = int(_ends(*[pdf[k].to_numpy() for k in keys])[-2]) if len(pdf) else 0
        if carry and len(pdf) - begin > carry:
            begin = len(pdf)
        rest = pdf.iloc[begin:]
        if begin:
            yield pdf.iloc[:begin]
    if rest is not None and len(rest):
        yield rest


def stars(rows: DataFrame, threshold: int) -> DataFrame:
    """What meets at prefix shingles. Kind 0: two classes (doc_id, and other of lesser id) that pass the filters: all such
    where FEW meet, else those with a leader. Kind 1: the rows of other shingles that more than one have, as they came."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in _whole_runs(batches, ["shingle"], CARRY):
            key, salt, n, ids, at = (pdf[c].to_numpy(np.int64) for c in ("shingle", "salt", "n", "doc_id", "at"))
            sig = unpacked(pdf["s1"].to_numpy(), pdf["s2"].to_numpy())

            def passing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & (at[i] + at[j] <= spare(n[i] + n[j], threshold))
                ok[ok] = distance(sig[i[ok]], sig[j[ok]]) <= spare(n[i[ok]] + n[j[ok]], threshold)
                return ok

            ends = _ends(key)
            many = np.repeat(np.diff(ends), np.diff(ends))
            # runs that went on, and salted ones, of which other rows are elsewhere, count as many
            many[(salt > 0) | ((key == before) if before is not None else False)] = FEW + 1
            before = key[-1]
            end, found = np.repeat(ends[1:], np.diff(ends)), [np.zeros((2, 0), np.int64)]
            few = np.flatnonzero((many > 1) & (many <= FEW))
            for step in range(1, FEW):
                few = few[few + step < end[few]]
                ok = passing(few + step, few)
                found.append(np.stack([few[ok] + step, few[ok]]))
            yield pdf.loc[many > FEW, ["shingle", "n", "doc_id", "at", "s1", "s2"]].assign(kind=1, other=0)
            begin = _ends(key, salt)
            run_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            left = np.flatnonzero(many > FEW)
            for _ in range(LEADERS):
                if not len(left):
                    break
                r = run_of[left]
                first = np.concatenate([[True], r[1:] != r[:-1]])
                lead = left[first][np.cumsum(first) - 1]
                ok = passing(left, lead)
                found.append(np.stack([left, lead])[:, ok & ~first])
                left = left[~ok & ~first]
            f = np.concatenate(found, axis=1)
            f = f[:, ids[f[0]] != ids[f[1]]]
            yield pd.DataFrame({"doc_id": ids[f[0]], "other": ids[f[1]]}).drop_duplicates().assign(kind=0, shingle=0, n=0, at=0, s1=0, s2=0)

    dealt = rows.repartition(partitions(rows.sparkSession), "shingle", "salt").sortWithinPartitions("shingle", "salt", "doc_id")
    return dealt.mapInPandas(run, "kind int, shingle long, n int, doc_id long, other long, at int, s1 long, s2 long")


def again(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (doc_id, other) of classes those that the suffix filter with 256 parts passes: with their distance by it and
    by 16 parts (far, apart), and the signature of the other by both (sig; c1, c2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = _bytes(pdf["x"]), _bytes(pdf["y"])
            far, f, g = distance(a, b), folded(a), folded(b)
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "other": pdf["other"], "far": far, "apart": distance(unpacked(f[:, 0], f[:, 1]), unpacked(g[:, 0], g[:, 1])), "sig": pdf["y"], "c1": g[:, 0], "c2": g[:, 1]})
            yield out[far <= spare(pdf["m"] + pdf["n"], threshold)]

    side = lambda i, n, sig: classes.select(F.col("rep").alias(i), F.col("n").alias(n), F.col("sig").alias(sig))
    met = pairs.join(side("doc_id", "m", "x"), "doc_id").join(side("other", "n", "y"), "other")
    return met.mapInPandas(run, "doc_id long, other long, far int, apart int, sig binary, c1 long, c2 long")


def groups(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n, sig, center, and for the classes that follow another: apart and far (no member is farther from the center
    by signatures of 16 and 256 parts), c1, c2, c (the center's signatures).

    A class follows its least leader; where that follows one itself, both have that one. Ids with several texts stay alone.
    """
    alone = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("texts"), F.max("several").alias("several")).filter("texts = 1 AND NOT several").select(F.col("rep").alias("doc_id"))
    least = edges.groupBy("doc_id").agg(F.min(F.struct("other", "apart", "far", "c1", "c2", "sig")).alias("p"))
    least = least.join(alone, "doc_id", "left_semi").select("doc_id", "p.*").join(alone.select(F.col("doc_id").alias("other")), "other", "left_semi")
    least = materialise(least, "leaders")
    upper = least.select(F.col("doc_id").alias("other"), F.struct("other", "apart", "far", "c1", "c2", "sig").alias("u"))
    joined = least.join(upper, "other", "left")
    pick = lambda name: F.coalesce(F.col(f"u.{name}"), F.col(name))
    add = lambda name: F.col(name) + F.coalesce(F.col(f"u.{name}"), F.lit(0))
    follows = joined.select("doc_id", pick("other").alias("to"), add("apart").alias("apart"), add("far").alias("far"), pick("c1").alias("c1"), pick("c2").alias("c2"), pick("sig").alias("c"))
    own = classes.select(F.col("rep").alias("doc_id"), "n", "sig").join(follows, "doc_id", "left")
    out = materialise(own.select("doc_id", "n", "sig", F.coalesce("to", "doc_id").alias("center"), F.coalesce("apart", F.lit(0)).alias("apart"), F.coalesce("far", F.lit(0)).alias("far"), "c1", "c2", "c"), "groups")
    drop_table(least)
    return out


def _joined(to: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """to: of each place the least one that it is connected with; what it is when x and y are connected too."""
    while True:
        a, b = to[x], to[y]
        apart = a != b
        if not apart.any():
            return to
        np.minimum.at(to, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (to != to[to]).any():
            to = to[to]


def crossed(met: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Groups a and b that meet at a shingle of many and may hold two classes that pass the filters: all such pairs (one
    false) where there are at most DENSE a group, else a forest of them (one true), of fewer rows than come to the task."""
    rows = met.join(members.select("doc_id", "center", "apart", "far", F.coalesce("c", "sig").alias("sig")).distinct(), "doc_id")
    # a center's signature is one value, but for ids with several texts: all of theirs are kept apart
    by = rows.groupBy("shingle", "center", "sig").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("at").alias("at"), F.max("apart").alias("apart"), F.max("far").alias("far"))
    by = materialise(by, "met")
    per = by.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("blocks"), F.min("center").alias("x"), F.max("center").alias("y")).filter("x < y").drop("x", "y")
    dealt = by.join(per, "shingle").withColumn("own", F.pmod(F.xxhash64("center"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shingle", F.least("own", "to").alias("one"), F.greatest("own", "to").alias("two"), "own", "blocks", "center", "sig", "low", "high", "at", "apart", "far")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_runs(batches, ["shingle", "one", "two"]):
            key, one, two, own, blocks, ids, low, high, at, apart, far = (pdf[c].to_numpy(np.int64) for c in ("shingle", "one", "two", "own", "blocks", "center", "low", "high", "at", "apart", "far"))
            large = _bytes(pdf["sig"])
            small = unpacked(*folded(large).T)
            ends = _ends(key, one, two)
            size, most_pairs = np.diff(ends), DENSE * np.diff(ends) // blocks[ends[:-1]]  # a group is in so many tasks
            end, run_of, to = np.repeat(ends[1:], size), np.repeat(np.arange(len(size)), size), np.arange(len(pdf))
            count, dense = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
            i, step, found = np.arange(len(pdf)), 1, [np.zeros((2, 0), np.int64)]
            while len(i := i[i + step < end[i]]):  # each row with the next, the one after it, and so on
                j = i + step
                most = spare(high[i] + high[j], threshold)
                ok = (100 * np.minimum(high[i], high[j]) >= threshold * np.maximum(low[i], low[j])) & (at[i] + at[j] <= most) & (ids[i] != ids[j])
                ok &= (one[i] == two[i]) | (own[i] != own[j])
                ok &= ~dense[run_of[i]] | (to[i] != to[j])
                x, y, most = i[ok], j[ok], most[ok]
                for sig, radius in ((small, apart), (large, far)):
                    ok = distance(sig[x], sig[y]) <= most + radius[x] + radius[y]
                    x, y, most = x[ok], y[ok], most[ok]
                count += np.bincount(run_of[x], minlength=len(size))
                dense = count > most_pairs
                ok = dense[run_of[x]]
                to = _joined(to, x[ok], y[ok])
                found.append(np.stack([x[~ok], y[~ok]]))
                step += 1
            x, y = np.concatenate(found, axis=1)
            ok = dense[run_of[x]]
            to = _joined(to, x[ok], y[ok])
            few, tree = np.stack([ids[x[~ok]], ids[y[~ok]]]), np.stack([ids[to], ids])
            for pairs, whole in ((few, False), (tree[:, tree[0] != tree[1]], True)):
                pairs = np.unique(np.sort(pairs, axis=0), axis=1)
                yield pd.DataFrame({"a": pairs[0], "b": pairs[1], "one": whole})

    dealt = dealt.repartition(partitions(met.sparkSession), "shingle", "one", "two").sortWithinPartitions("shingle", "one", "two")
    out = materialise(dealt.mapInPandas(run, "a long, b long, one boolean").distinct(), "crossed")
    drop_table(by)
    return out


PACKED = "center long, block int, ids binary, sizes binary, core binary, many binary, apart binary"


def packed(docs: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """A row for each block (center, block) of the classes placed (doc_id, center, block): ids, sizes, a core, and each
    member's difference from it. The texts are read once more for this, for the sets of these classes alone."""
    rows, pick = among(docs, placed.select("doc_id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in map(pick, batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "own": [shingle_set(t, k).tobytes() for t in pdf["text"]]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_runs(batches, ["center", "block"]):
            pdf = pdf[~pdf.duplicated(["doc_id", "own"])]  # repeated rows
            ids, ends, out = pdf["doc_id"].to_numpy(np.int64), _ends(pdf["center"].to_numpy(), pdf["block"].to_numpy()), []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                own = [np.frombuffer(x, np.uint64) for x in pdf["own"].iloc[s:e]]
                core, apart = own[0], []
                if e - s > 1:
                    value, times = np.unique(np.concatenate(own), return_counts=True)
                    core = value[2 * times > e - s]
                    apart = [np.setxor1d(x, core, assume_unique=True) for x in own]
                sizes = np.array([len(x) for x in own], np.int64)
                out.append((pdf["center"].iloc[s], pdf["block"].iloc[s], ids[s:e].tobytes(), sizes.tobytes(), core.tobytes(), np.array([len(x) for x in apart] or [0], np.int64).tobytes(), b"".join(x.tobytes() for x in apart)))
            yield pd.DataFrame(out, columns=["center", "block", "ids", "sizes", "core", "many", "apart"])

    whole = rows.mapInPandas(sets, "doc_id long, own binary").join(placed, "doc_id")
    whole = whole.repartition(partitions(docs.sparkSession), "center", "block").sortWithinPartitions("center", "block", "doc_id")
    return materialise(whole.mapInPandas(pack, PACKED), "packed")


def _read(row: tuple) -> dict:
    ids, sizes, core, many, apart = row
    many = np.frombuffer(many, np.int64)
    return {"ids": np.frombuffer(ids, np.int64), "n": np.frombuffer(sizes, np.int64), "core": np.frombuffer(core, np.uint64), "row": np.repeat(np.arange(len(many)), many), "many": many, "apart": np.frombuffer(apart, np.uint64)}


def differences(a: dict, b: dict) -> np.ndarray:
    """Members that one alone has, for each class of a and each of b. With e the difference of the cores, x and y those of
    the classes from theirs: |e ^ x ^ y| = |e| + |x| - 2|e & x| + |y| - 2|e & y| - 2|x & y| + 4|e & x & y|."""
    e = np.setxor1d(a["core"], b["core"], assume_unique=True) if a is not b else a["core"][:0]
    alone = [z["many"] - 2 * np.bincount(z["row"][np.isin(z["apart"], e)], minlength=len(z["n"])) for z in (a, b)]
    out = (len(e) + alone[0][:, None] + alone[1][None, :]).astype(np.float64)
    columns, times = np.unique(a["apart"], return_counts=True)
    columns = columns[times > 1] if a is b else np.intersect1d(columns, b["apart"])
    weight = np.where(np.isin(columns, e), 2.0, -2.0).astype(np.float32)
    placed = []
    for z in (a, b):
        at = np.searchsorted(columns, z["apart"])
        real = at < len(columns)
        real[real] = columns[at[real]] == z["apart"][real]
        order = np.argsort(at[real], kind="stable")
        placed.append((at[real][order], z["row"][real][order], len(z["n"])))
    for start in range(0, len(columns), COLUMNS):
        dense = []
        for at, row, m in placed:
            s, t = np.searchsorted(at, [start, start + COLUMNS])
            has = np.zeros((m, min(COLUMNS, len(columns) - start)), np.float32)
            has[row[s:t], at[s:t] - start] = 1
            dense.append(has)
        out += (dense[0] * weight[start : start + COLUMNS]) @ dense[1].T
    return out


def compared(a: dict, b: dict, threshold: int) -> pd.DataFrame | None:
    """doc_id, n, to of the classes of two blocks (or one, if they are the same) that have links there: how many, and the
    least id that these links reach."""
    ok = (100 + threshold) * differences(a, b) <= (100 - threshold) * (a["n"][:, None] + b["n"][None, :])
    ok &= a["ids"][:, None] != b["ids"][None, :]
    i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    if not len(i):
        return None
    ok = ok[np.ix_(i, j)]
    x, y, most = a["ids"][i], b["ids"][j], np.iinfo(np.int64).max
    to_x = x
    while True:
        to_y = np.minimum(y, np.where(ok, to_x[:, None], most).min(axis=0))
        last, to_x = to_x, np.minimum(to_x, np.where(ok, to_y[None, :], most).min(axis=1))
        if (last == to_x).all():
            break
    found = pd.DataFrame({"doc_id": x, "n": ok.sum(axis=1), "to": to_x})
    return found if a is b else pd.concat([found, pd.DataFrame({"doc_id": y, "n": ok.sum(axis=0), "to": to_y})])


LINKED = "doc_id long, n long, to long"


def within(blocks: DataFrame, threshold: int) -> DataFrame:
    """Links between the classes of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [compared(z, z, threshold) for z in map(_read, pdf.itertuples(index=False))]
            yield from (f for f in found if f is not None)

    return blocks.filter(F.octet_length("ids") > 8).select("ids", "sizes", "core", "many", "apart").mapInPandas(run, LINKED)


def between(blocks: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """Links between the classes of each two blocks of a group, and of two groups that met."""
    of = blocks.groupBy("center").agg((F.max("block") + 1).alias("blocks"))
    same = of.filter("blocks > 1").select(F.col("center").alias("a"), F.col("center").alias("b"), F.col("blocks").alias("p"), F.col("blocks").alias("q"))
    other = pairs.join(of.select(F.col("center").alias("a"), F.col("blocks").alias("p")), "a").join(of.select(F.col("center").alias("b"), F.col("blocks").alias("q")), "b").select("a", "b", "p", "q")
    todo = same.unionByName(other).select("a", "b", "q", F.explode(F.sequence(F.lit(0), (F.col("p") - 1).cast("int"))).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.lit(0), (F.col("q") - 1).cast("int"))).alias("j")).filter("a <> b OR i < j")
    names = ("ids", "sizes", "core", "many", "apart")
    side = lambda c, i, mark: blocks.select(F.col("center").alias(c), F.col("block").alias(i), *[F.col(x).alias(f"{mark}{x}") for x in names])
    met = todo.join(side("a", "i", "x"), ["a", "i"]).join(side("b", "j", "y"), ["b", "j"]).select(*[f"x{x}" for x in names], *[f"y{x}" for x in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [f for r in pdf.itertuples(index=False) if (f := compared(_read(r[:5]), _read(r[5:]), threshold)) is not None]
            if found:
                yield pd.concat(found)

    return met.mapInPandas(run, LINKED)


def jaccard_links(docs: DataFrame, k: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, d1, d2); class representatives (d1, d2, rep); doc_id, n, to of classes with links, once for each two
    blocks compared: the number of links found there, and the least id that these reach."""
    scanned = materialise(scan_sets(docs, k), "scanned")
    rows = scanned.filter("chunk < 0").select("doc_id", "n", "d1", "d2")
    # of an id with several texts: whether it stands for classes by one of them alone is not asked
    several = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.countDistinct("d1", "d2") > 1).alias("several")).filter("several")
    classes = scanned.filter("chunk < 0 AND n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = materialise(classes.join(several.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("several", F.coalesce("several", F.lit(False))), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    # the bit filters let some other ids through, copies too: joins with the classes' ids drop their rows
    got = materialise(stars(prefixes(docs, reps, whole_sketch(scanned), rows.count(), k, threshold), threshold), "stars")
    edges = materialise(again(got.filter("kind = 0").select("doc_id", "other").distinct(), classes, threshold), "edges")
    members = groups(edges, classes)
    of = lambda c, i: members.select(F.col("doc_id").alias(i), F.col("center").alias(c)).distinct()
    direct = edges.select("doc_id", "other").join(of("p", "doc_id"), "doc_id").join(of("q", "other"), "other").filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    met = crossed(got.filter("kind = 1").select("shingle", "n", "doc_id", "at"), members, threshold)
    whole = components(met.filter("one").select("a", "b"))
    top = lambda df, c: df.join(whole.select(F.col("node").alias(c), F.col("component").alias("top")), c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
    pairs = top(top(direct.unionByName(met.filter("NOT one").select("a", "b")), "a"), "b").filter("a <> b")
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    alone, members = members, materialise(top(members.select("doc_id", "n", "center"), "center"), "whole groups")
    for t in (got, met, whole, alone):
        drop_table(t)
    sizes = members.groupBy("center").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("center")).distinct().withColumn("cross", F.lit(1))
    places = sizes.join(wanted, "center", "left").filter("m > 1 OR cross = 1").select("center", "blocks")
    placed = materialise(members.select("doc_id", "center").distinct().join(places, "center").select("doc_id", "center", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")), "placed")
    blocks = packed(docs, placed, k)
    found = materialise(within(blocks, threshold).unionByName(between(blocks, pairs, threshold)), "links")
    for t in (edges, members, pairs, placed, blocks):
        drop_table(t)
    return rows, classes, found


def jaccard_components(docs: DataFrame, k: int = 3, threshold: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row; n_links: of its class to classes with other sets."""
    rows, classes, found = jaccard_links(docs, k, threshold)
    own = components(found.filter("doc_id <> to").select(F.col("doc_id").alias("a"), F.col("to").alias("b")))
    degree = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n").alias("count"))
    named = classes.join(own, F.col("rep") == F.col("node"), "left").join(degree, "rep", "left")
    named = materialise(named.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("count", F.lit(0)).alias("n_links")), "named")
    out = rows.join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    alone = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group, and those with a null one, with docs' own columns."""
    gone = jaccard_components(docs, k, threshold).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END AS sh
  FROM w),
d AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS h, sh FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM d WHERE n > 0 GROUP BY h),
g AS (SELECT rep, n, unnest(sh) AS x FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS rep, min(b) AS least FROM r GROUP BY a),
l AS (SELECT a AS rep, count(*) AS n_links FROM p GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(k.least, d.doc_id) AS component_id, coalesce(l.n_links, 0) AS n_links
FROM d LEFT JOIN c ON c.h = d.h LEFT JOIN k ON k.rep = c.rep LEFT JOIN l ON l.rep = c.rep
"""
