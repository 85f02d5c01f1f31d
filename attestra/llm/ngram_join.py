"""N-gram Jaccard join by vertical partitioning, and the groups that its links form.

Texts with one shingle set form a class, and only classes are compared. Candidates come from prefix
filtering under a global order of shingles; overlaps are counted by cutting the global order
into fragments, counting each pair's partial overlap per fragment and adding up.

Large groups and frequent passages never unfold into all pairs:

1. Order. The first pass over the texts also counts all shingles in a sketch of fixed size. Those
   that the sketch shows to be frequent stand at the end of the global order, so prefixes hold rare ones.
2. Star round. Every class is verified against the smallest class that shares one of its first
   shingles. Groups of near copies collapse into few components, linear in their size.
3. Exact rounds. A shingle only yields pairs of classes from different components, and within
   a shingle the largest component is only compared with the others, not with itself. Groups
   held together by a shingle are contracted around pivots. Where a shingle that the sketch took for
   rare is held by many components, the shingles of all texts that hold it are counted, frequent ones
   move to the end of the order too, for all texts alike, and these texts take further shingles into
   their prefix. The order does not affect the result, only the number of candidates.

A pair of classes skipped because both lie in one component cannot change a component.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .lean import lean
from .shingle_sets import fingerprint, sets
from .store import read, stage, unstage
from .words import keep_ids

PERCENT = 75
FRAGMENTS = 8
#: Components that may share a shingle before they are contracted around pivots; texts beyond the sketch's
#: noise that may share it before it moves to the end of the order.
HOT = 64
#: Cells of each of the two rows of the count sketch, and parts it travels in. The noise of a count is the root of
#: the number of shingles per cell.
CELLS = 1 << 20
BLOCKS = 16
#: Names of sets that a task remembers, to pass over copies.
SEEN = 1_000_000
#: Moved shingles held in memory at once; with more, only those of the most components move.
MOST_HOT = 500_000
#: First shingles of a class that are used in the star round.
STARS = 2
#: Classes that a large group is compared with before its pairs are.
PIVOTS = 32
#: Bits of a set's parity sketch, in 64-bit words.
SKETCH_WORDS = 8
#: Shingles handled at once on an executor, beyond which a text is handled alone.
PIECE = 500_000
#: After this many rounds no shingle moves any more; all their pairs are compared.
HOT_ROUNDS = 2


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of ``n`` of which one at least is shared by any set linked to it."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _frame(docs: DataFrame, key: str, text: str | Column) -> DataFrame:
    return docs.select(F.col(key).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list array of the given 64-bit parts."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _in_pieces(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their shingle sets, a bounded number of rows and of shingles at a time."""
    for batch in batches:
        first, held, size = 0, [], 0
        for found in sets(batch.column(1), seed):
            held.append(found)
            size += len(found)
            if size >= PIECE:
                yield batch.slice(first, len(held)), held
                first, held, size = first + len(held), [], 0
        if held:
            yield batch.slice(first, len(held)), held


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the set's shingles falls on it."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _cell(shingles: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of each shingle in a row of the count sketch."""
    return (shingles >> (20 * row)) & (CELLS - 1), 1 - 2 * ((shingles >> (40 + row)) & 1)


def _packed(cells: np.ndarray) -> bytes:
    """32-bit counts, most of them small, as bytes."""
    return zlib.compress(cells.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _blocks(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    parts = cells.reshape(BLOCKS, -1)
    return list(range(BLOCKS)), [_packed(p) for p in parts]


def _summaries(docs: DataFrame, kind: str, seed: int) -> DataFrame:
    """(id, n, s1, s2, first, sketch) of every text's set: size, fingerprint, first shingles and parity sketch;
    s1 names the class. Besides, one row per block of the task's count sketch (block, cells)."""
    schema = pa.schema([("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("first", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("block", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counted, kind = np.zeros((2, CELLS), np.int32), set(), None
        for batch, found in _in_pieces(batches, seed):
            kind = batch.schema.field(0).type
            marks = [fingerprint(s, seed) for s in found]
            fresh = []
            for mark, s in zip(marks, found, strict=True):
                if mark[0] not in counted:
                    counted.add(mark[0])
                    fresh.append(s)
            if len(counted) > SEEN:
                counted.clear()
            shingles = np.concatenate([np.empty(0, np.int64), *fresh])
            for row in range(2):
                at, sign = _cell(shingles, row)
                np.add.at(cells[row], at, sign.astype(np.int32))
            none = [None] * len(found)
            columns = [[len(s) for s in found], [m[0] for m in marks], [m[1] for m in marks], _lists([s[:STARS] for s in found]), _lists([_sketch(s) for s in found]), none, none]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)]], ["id", *schema.names])
        if kind is not None:
            blocks, parts = _blocks(cells)
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, kind), *[pa.nulls(BLOCKS, f.type) for f in schema][:5], pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], ["id", *schema.names])

    return docs.mapInArrow(lean(run), f"id {kind}, n int, s1 long, s2 long, first array<long>, sketch array<long>, block int, cells binary")


@dataclass
class Order:
    """The global order of shingles: those that the sketch counts over ``limit`` times, or that are among ``moved``
    (sorted), stand at the end; all else goes by hash value."""

    cells: np.ndarray
    limit: float
    moved: np.ndarray

    def late(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles), bool)
        for row in range(2):
            at, sign = _cell(shingles, row)
            out &= self.cells[row][at] * sign > self.limit
        if len(self.moved):
            out |= self.moved[np.minimum(np.searchsorted(self.moved, shingles), len(self.moved) - 1)] == shingles
        return out


def _order(whole: DataFrame) -> Order:
    """The count sketches of all tasks, added up on the executors; ``2 * CELLS`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _unpacked(data)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], ["block", "cells"])

    parts = whole.where("block IS NOT NULL").select("block", "cells").mapInArrow(lean(run), "block int, cells binary")
    cells = np.zeros((BLOCKS, 2 * CELLS // BLOCKS), np.int32)
    for r in parts.repartition(BLOCKS, "block").mapInArrow(lean(run), "block int, cells binary").collect():
        cells[r["block"]] = _unpacked(bytes(r["cells"]))
    cells = cells.reshape(2, CELLS)
    return Order(cells, HOT + 4 * float(np.median(np.abs(cells))) / 0.6745, np.empty(0, np.int64))


def _fragments(docs: DataFrame, seed: int) -> DataFrame:
    """(s1, frag, part): every text's set cut at fixed places of the global order."""
    cuts = np.array([k * ((1 << 64) // FRAGMENTS) - (1 << 63) for k in range(1, FRAGMENTS)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _in_pieces(batches, seed):
            names = np.repeat(np.array([fingerprint(s, seed)[0] for s in found], np.int64), FRAGMENTS)
            frags = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(found))
            parts = [p for s in found for p in np.split(s, np.searchsorted(s, cuts))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(frags), _lists(parts)], ["s1", "frag", "part"])

    return docs.mapInArrow(lean(run), "s1 long, frag int, part array<long>")


def _reordered(docs: DataFrame, order: Order, seed: int) -> DataFrame:
    """(s1, n, f, head, late): prefixes under the global order, once per task for each set.

    ``head`` is the prefix, ``late`` the moved shingles at its end and ``f`` the number of moved
    shingles in the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, found in _in_pieces(batches, seed):
            names, sizes, heads, moved, late = [], [], [], [], []
            for s in found:
                name = fingerprint(s, seed)[0]
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                at_end = order.late(s)
                most, first = prefix_length(len(s)), s[~at_end]
                late.append(s[at_end][: max(0, most - len(first))])
                names.append(name)
                sizes.append(len(s))
                moved.append(int(at_end.sum()))
                heads.append(np.concatenate((first[:most], late[-1])))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(moved, pa.int32()), _lists(heads), _lists(late)], ["s1", "n", "f", "head", "late"]
            )

    return docs.mapInArrow(lean(run), "s1 long, n int, f int, head array<long>, late array<long>")


def _frequent(docs: DataFrame, seed: int) -> DataFrame:
    """(token, c): shingles that more than ``HOT`` of the rows hold anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _in_pieces(batches, seed):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["token"])

    tokens = docs.mapInArrow(lean(run), "token long")
    return tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > HOT)


def _shared(postings: DataFrame) -> DataFrame:
    """The distinct (token, s1) whose token occurs with more than one s1.

    One shuffle by token, of these two columns alone; runs of equal tokens are found on sorted batches, holding one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)  # the last row so far, and whether its token came before it
        repeated = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((held, [batch.column(0).to_numpy(), batch.column(1).to_numpy()]), axis=1)
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, fresh]
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.zeros(rows.shape[1], bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= repeated
            repeated, held = bool(keep[-1]), rows[:, -1:]
            out = rows[:, :-1][:, keep[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["token", "s1"])
        if repeated:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["token", "s1"])

    spark = postings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = postings.select("token", "s1").repartition(parts, "token")
    return postings.sortWithinPartitions("token", "s1").mapInArrow(lean(run), "token long, s1 long")


def _close(n1: str, n2: str) -> str:
    """Sizes of two sets that can be linked."""
    return f"100 * least({n1}, {n2}) >= {PERCENT} * greatest({n1}, {n2})"


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that their parity sketches leave possible.

    Sketches differ in at most as many bits as the sets do in shingles, and two linked sets differ
    in at most (100 - PERCENT) / (100 + PERCENT) of their sizes' sum; so no link is lost.
    """
    marks = classes.select("s1", "sketch")
    for side in "ab":
        pairs = pairs.join(marks.select(F.col("s1").alias(side), F.col("sketch").alias(f"_{side}")), side)
    apart = " + ".join(f"bit_count(_a[{k}] ^ _b[{k}])" for k in range(SKETCH_WORDS))
    return pairs.where(f"{100 + PERCENT} * ({apart}) <= {100 - PERCENT} * (na + nb)").select("a", "b", "na", "nb")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """The (a, b) whose sets are linked: partial overlaps are counted per fragment and summed.

    ``pairs``, a staged table that goes, has a, b and the sizes na, nb; ``classes`` tells on which
    smallest id a class lives. Other rows with that id, or copies of it, do no harm: a pair's overlap
    in a fragment counts once.
    """
    whole, pairs = pairs, stage(_sketched(pairs, classes), "possible")
    unstage(whole)
    nodes = pairs.select(F.col("a").alias("s1")).unionAll(pairs.select(F.col("b").alias("s1"))).distinct()
    ids = stage(classes.join(nodes, "s1", "left_semi").select("min_id").distinct(), "ids")
    parts = stage(_fragments(keep_ids(docs, "id", ids), seed), "fragments")
    left = pairs.join(parts.withColumnRenamed("s1", "a"), "a").withColumnRenamed("part", "_left")
    both = left.join(parts.withColumnRenamed("s1", "b"), ["b", "frag"])
    partial = both.select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("_left", "part")).alias("overlap")).distinct()
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    out = stage(total.where(f"100 * overlap >= {PERCENT} * (na + nb - overlap)").select("a", "b"), "links")
    for done in (pairs, ids, parts):
        unstage(done)
    return out


def _star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, na, nb): each class with the smallest class of the groups that its first shingles form."""
    tokens = classes.select("s1", "n", F.explode("first").alias("token"))
    tops = tokens.groupBy("token").agg(F.min(F.struct("s1", "n")).alias("top"), F.count("*").alias("c")).where("c > 1")
    tops = stage(tops.select("token", F.col("top.s1").alias("b"), F.col("top.n").alias("nb")), "tops")
    pairs = tokens.join(tops, "token").where("s1 != b").where(_close("n", "nb"))
    return pairs.select(F.col("s1").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()


def _placed(postings: DataFrame, about: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with what is known of their class and its component so far; per token of several components
    their number, the largest, and whether the token has moved."""
    about = about.join(known.withColumnRenamed("node", "s1"), "s1", "left").withColumn("comp", F.coalesce("root", "s1")).drop("root")
    moved = F.coalesce(F.array_contains("late", F.col("token")), F.lit(False))
    placed = stage(postings.join(about, "s1").withColumn("moved", moved), "placed")
    per = placed.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("moved").alias("moved"))
    tokens = per.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"), F.max("moved").alias("moved")).where("comps > 1")
    return placed, stage(tokens.select("token", "comps", F.col("top.comp").alias("major"), "moved"), "tokens")


def _met(rest: DataFrame, moved: bool) -> DataFrame:
    """(a, b, na, nb, unseen, once): a row per shingle in which two classes meet, among moved ones or the others."""
    extra = ("f", "late") if moved else ()
    sides = [[F.col(c).alias(c + side) for c in ("s1", "n", "comp", "k", *extra)] for side in "xy"]
    minor = rest.where("comp != major").select("token", *sides[0])
    every = rest.select("token", "major", *sides[1])
    # Two rows outside the largest component meet once, in the order of their classes.
    met = F.expr("compx != compy AND (compy = major OR s1x < s1y)") & F.expr(_close("nx", "ny"))
    if moved:
        bound = F.expr(f"{100 + PERCENT} * least(fx, fy) >= {PERCENT} * (nx + ny)")
        met = F.when(met & bound, F.get(F.array_intersect("latex", "latey"), F.lit(0)) == F.col("token"))
    return minor.join(every, "token").where(met).select(
        F.expr("if(s1x < s1y, s1x, s1y)").alias("a"),
        F.expr("if(s1x < s1y, s1y, s1x)").alias("b"),
        F.expr("if(s1x < s1y, nx, ny)").alias("na"),
        F.expr("if(s1x < s1y, ny, nx)").alias("nb"),
        F.least("kx", "ky").alias("unseen"),
        F.lit(0 if moved else 1).alias("once"),
    )


def _cross_pairs(placed: DataFrame, tokens: DataFrame, left_out: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs of classes that share one of ``tokens`` across components.

    A prefix that reaches moved shingles holds all others of its text. A pair that meets in a moved
    shingle therefore either meets in another one too, or has nothing but moved shingles in common, at
    most the smaller ``f``; and of the moved shingles it meets in, the first alone yields it.

    The shingles up to the end of the prefix that ends first are all known, so a pair can share no
    more than those it meets in, those not looked at (moved ones, and ``left_out`` ones) and what
    follows that prefix, at most what follows the larger set's.
    """
    rest = placed.join(tokens.select("token", "major"), "token")
    met = [_met(rest.where("NOT moved"), False), _met(rest.where("moved"), True)]
    pairs = met[0].unionByName(met[1]).groupBy("a", "b", "na", "nb").agg(F.max("unseen").alias("unseen"), F.sum("once").alias("c"))
    skipped = placed.where(~F.col("moved")).join(left_out.select("token"), "token").groupBy("s1").agg(F.count("*").alias("h"))
    skipped = stage(skipped, "skipped")
    for side in "ab":
        pairs = pairs.join(skipped.select(F.col("s1").alias(side), F.col("h").alias(f"h{side}")), side, "left")
    most = F.expr(f"c + unseen + least(coalesce(ha, 0), coalesce(hb, 0)) + ({PERCENT} * greatest(na, nb) + 99) div 100 - 1")
    return pairs.where((100 + PERCENT) * most >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _pivot_pairs(placed: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b, na, nb): for each hot token, its classes with two pivots, one of all and one of the largest component;
    equal pivots recur across tokens, so a group of copies gets ``2 * PIVOTS`` of them at most."""
    rows = placed.join(hot.select("token", "major"), "token")
    drawn = F.xxhash64("s1", F.pmod("token", F.lit(PIVOTS)))
    one = F.struct("s1", "n", "comp")
    tops = rows.groupBy("token").agg(F.min_by(one, drawn).alias("p"), F.min_by(one, F.when(F.col("comp") == F.col("major"), -drawn)).alias("q"))
    tops = tops.select("token", F.explode(F.array_distinct(F.array("p", "q"))).alias("top"))
    tops = stage(tops.select("token", F.col("top.s1").alias("b"), F.col("top.n").alias("nb"), F.col("top.comp").alias("cb")), "tops")
    pairs = rows.join(tops, "token").where("comp != cb").where(_close("n", "nb"))
    return pairs.select(F.col("s1").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()


def _add(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if links.isEmpty():
        return known
    return components(links.select("a", "b").unionAll(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _classes(rows: DataFrame) -> DataFrame:
    return rows.where("n > 0").groupBy("s1").agg(
        F.min("id").alias("min_id"), F.any_value("n").alias("n"), F.any_value("first").alias("first"), F.any_value("sketch").alias("sketch"), F.min("n").alias("_n1"), F.max("n").alias("_n2"), F.min("s2").alias("_s1"), F.max("s2").alias("_s2")
    )


def _postings(docs: DataFrame, order: Order, seed: int, concerned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(token, s1) for the shared shingles of the prefixes, and (s1, n, f, late, k) for each class; both staged.
    ``late`` is null where no moved shingle is in the prefix, ``k`` is how many are."""
    heads = _reordered(docs, order, seed)
    heads = stage(heads if concerned is None else heads.join(concerned, "s1", "left_semi"), "heads")
    late = F.when(F.size("late") > 0, F.col("late")).alias("late")
    about = stage(heads.select("s1", "n", "f", late, F.size("late").alias("k")).dropDuplicates(["s1"]), "about")
    shared = stage(_shared(heads.select(F.explode("head").alias("token"), "s1")), "shared")
    unstage(heads)
    return shared, about


def groups(docs: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key reachable by links).

    Null and blank texts have no shingles and are their own component. Rows with one key but
    different texts are told apart by their texts; a null key never is the smallest unless all are. Copies
    are one class. An empty table gives an empty result. Other columns are ignored.
    """
    docs = _frame(docs, key, text)
    kind = dict(docs.dtypes)["id"]
    for seed in range(1, 9):
        whole = stage(_summaries(docs, kind, seed), "sets")
        each = whole.where("block IS NULL")
        classes = stage(_classes(each), "classes")
        # Two sets with one 64-bit name would be merged; another seed tells them apart.
        if classes.where("_n1 != _n2 OR _s1 != _s2").isEmpty():
            break
        for done in (whole, classes):
            unstage(done)
    else:
        raise RuntimeError("fingerprints collide under every seed")
    order = _order(whole)
    rows = stage(each.select("id", "n", "s1"), "rows")
    unstage(whole)

    if classes.isEmpty():
        return rows.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    pairs = stage(_star_pairs(classes), "stars")
    known = components(verified(pairs, docs, classes, seed))
    postings, about = _postings(docs, order, seed)
    for turn in range(HOT_ROUNDS + 1):
        placed, tokens = _placed(postings, about, known)
        hot = tokens.where(F.col("comps") > HOT)
        if not hot.isEmpty():
            pairs = stage(_pivot_pairs(placed, hot), "pivots")
            links = verified(pairs, docs, classes, seed)
            if not links.isEmpty():
                known = _add(known, links)
                for done in (placed, tokens):
                    unstage(done)
                placed, tokens = _placed(postings, about, known)
        many = (F.col("comps") > 4 * order.limit) & ~F.col("moved")
        hot = tokens.where(many)
        last = turn == HOT_ROUNDS or hot.isEmpty()
        # Where only moved shingles are left, or after the last turn, all are compared.
        some, others = (tokens, tokens.limit(0)) if last else (tokens.where(~many), hot)
        pairs = stage(_cross_pairs(placed, some, others), "pairs")
        known = _add(known, verified(pairs, docs, classes, seed))
        if not last:
            # Pairs that share nothing but hot shingles so far lie among the texts that hold one.
            concerned = stage(placed.join(hot, "token", "left_semi").select("s1").distinct(), "concerned")
        for done in (placed, tokens, postings, about):
            unstage(done)
        if last:
            break
        ids = stage(classes.join(concerned, "s1", "left_semi").select("min_id").distinct(), "ids")
        again = keep_ids(docs, "id", ids)
        top = _frequent(again, seed).orderBy(F.desc("c"), "token").limit(MOST_HOT).collect()
        order = Order(order.cells, order.limit, np.union1d(order.moved, np.array([r["token"] for r in top], np.int64)))
        postings, about = _postings(again, order, seed, concerned)
        for done in (ids, concerned):
            unstage(done)

    roots = classes.select("s1", "min_id").join(known.withColumnRenamed("node", "s1"), "s1", "left")
    roots = roots.withColumn("root", F.coalesce("root", "s1"))
    least = roots.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = stage(roots.join(least, "root").select("s1", "component_id"), "named")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1")).join(named, "s1", "left")
    return out.select(
        F.col("id").alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id != y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
