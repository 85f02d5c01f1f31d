"""The items that a text covers best, worked out inside the text's row.

The items' grams are indexed once on the driver and sent to the executors: a gram's number, and which items
hold it how often. A text's grams are looked up there and counted in its row, so only its best items leave it.
Grams are told apart exactly: characters are numbered, then pairs of them, pairs of pairs, and those with one more
character. What no item holds has the number 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Keys that a table may have room for; beyond, they are searched for.
MOST_CELLS = 1 << 22


class _Known:
    """The different keys of the given ones, all below ``cells``, numbered from 1."""

    def __init__(self, keys: list[np.ndarray], cells: int, tables: bool):
        self.keys = np.unique(np.concatenate([np.empty(0, np.int64), *keys]))
        self.table = None
        if tables and cells <= MOST_CELLS:
            self.table = np.zeros(cells, np.int32)
            self.table[self.keys] = np.arange(1, len(self.keys) + 1)

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers, 0 for others."""
        if self.table is not None:
            return self.table[keys]
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class _Postings:
    """Per gram from 1 on the items that hold it, and how often."""

    def __init__(self, grams: list[np.ndarray], most: int):
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pairs, self.counts = np.unique(np.concatenate([np.empty(0, np.int64), *grams]) * (len(grams) + 1) + owner, return_counts=True)
        self.items = pairs % (len(grams) + 1)
        self.starts = np.searchsorted(pairs // (len(grams) + 1), np.arange(most + 2))

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of these grams, and how many each has."""
        sizes = self.starts[grams + 1] - self.starts[grams]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[grams] - (ends - sizes), sizes), sizes


class Index:
    """Items (id, texts in normal form, numbers), in the order that decides between equal scores. ``tables`` pay where many
    texts are held against the same items."""

    def __init__(self, items: Sequence[tuple[object, list[str], list[str]]], tables: bool = True):
        self.ids = [i for i, _, _ in items]
        texts = [[_codes(t) for t in ts] for _, ts, _ in items]
        every = [t for ts in texts for t in ts]
        self.chars = _Known(every, 0x110000, tables)
        self.end = len(self.chars) + 1  # what follows the one character of a text that has no other
        self.two = _Known([self._pairs(t) for t in every], (self.end + 1) ** 2, tables)
        self.four = _Known([self._fours(self._twos(t))[0] for t in every], (len(self.two) + 1) ** 2, tables)
        self.five = _Known([self._fives(t, self._by_place(t, self._twos(t))) for t in every], (len(self.four) + 1) * (self.end + 1), tables)
        found = [[self.grams(t) for t in ts] for ts in texts]
        some = lambda k: [np.concatenate([np.empty(0, np.int64), *[f[k][f[k] > 0] for f in fs]]).astype(np.int64) for fs in found]
        self.by = [_Postings(some(k), len(known)) for k, known in enumerate((self.two, self.four, self.five))]
        self.sizes = np.array([sum(max(len(t) - 1, 1) for t in ts) for ts in texts], np.int64)
        self.numbers: dict[str, list[int]] = {}
        for k, (_, _, nums) in enumerate(items):
            for x in set(nums):
                self.numbers.setdefault(x, []).append(k)

    def _pairs(self, codes: np.ndarray) -> np.ndarray:
        """A number for each pair of characters; 0 and those with an unknown character belong to no item."""
        at = self.chars.numbers(codes).astype(np.int64)
        after = at[1:] if len(at) > 1 else np.full(len(at), self.end)
        return at[: len(after)] * (self.end + 1) + after

    def _fours(self, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of runs of four characters whose two pairs are known, and where they start."""
        at = np.flatnonzero((two[:-2] > 0) & (two[2:] > 0))
        return two[at].astype(np.int64) * (len(self.two) + 1) + two[at + 2], at

    def _fives(self, codes: np.ndarray, four: np.ndarray) -> np.ndarray:
        """Keys of runs of five characters that start with a known run of four."""
        at = np.flatnonzero(four[:-1])
        return four[at].astype(np.int64) * (self.end + 1) + self.chars.numbers(codes[at + 4])

    def _twos(self, codes: np.ndarray) -> np.ndarray:
        return self.two.numbers(self._pairs(codes))

    def _by_place(self, codes: np.ndarray, two: np.ndarray) -> np.ndarray:
        keys, at = self._fours(two)
        four = np.zeros(max(len(codes) - 3, 0), np.int64)
        four[at] = self.four.numbers(keys)
        return four

    def grams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a text's pairs and runs of four by place, and of its runs of five."""
        two = self._twos(codes)
        four = self._by_place(codes, two)
        return two, four, self.five.numbers(self._fives(codes, four))

    def scores(self, texts: list[str], nums: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How far one document covers each item, and whether they share anything."""
        codes = [_codes(t) for t in texts if t]
        size = sum(max(len(t) - 1, 1) for t in codes)
        found = [self.grams(t) for t in codes]
        n = len(self.ids)
        held = np.zeros(len(self.two) + 1, np.int64)
        run, common, number = np.zeros(n), np.zeros(n), np.zeros(n)
        for f in found:
            held += np.bincount(f[0], minlength=len(held))
        grams = np.flatnonzero(held[1:]) + 1
        at, sizes = self.by[0].of(grams)
        common += np.bincount(self.by[0].items[at], np.minimum(self.by[0].counts[at], np.repeat(held[grams], sizes)), n)
        for kind, bonus in ((1, 0.10), (2, 0.25)):
            seen = np.zeros(len(self.by[kind].starts) - 1, bool)
            for f in found:
                seen[f[kind]] = True
            run[self.by[kind].items[self.by[kind].of(np.flatnonzero(seen[1:]) + 1)[0]]] = bonus
        for x in set(nums):
            number[self.numbers.get(x, [])] = 0.10
        score = np.minimum(1.0, np.maximum(common / self.sizes, 2 * common / (self.sizes + size)) + run + number)
        return score, (common > 0) | (number > 0)

    def best(self, texts: list[str], nums: list[str], top: int) -> list[tuple[int, float]]:
        """(place of the item, score) of the best items for one document."""
        score, shared = self.scores(texts, nums)
        some = np.flatnonzero(shared)
        return [(int(k), float(score[k])) for k in some[np.argsort(-score[some], kind="stable")[:top]]]


def _indexed(norms: list[str], nums: list[list[str]]) -> Index:
    """An index of one group's items; an empty one shares nothing."""
    return Index([(None, [t] if t else [], x if t else []) for t, x in zip(norms, nums, strict=True)], tables=False)


def kept_of(ords: list, norms: list[str], nums: list[list[str]], threshold: float) -> list[int]:
    """Places of those items of a group, in order, that are not too similar to an earlier kept one."""
    if len(norms) < 2:
        return list(range(len(norms)))
    known, gone = _indexed(norms, nums), np.zeros(len(norms), bool)
    for k, t in enumerate(norms):
        if not gone[k] and t:
            score, shared = known.scores([t], nums[k])
            later = np.array([x > ords[k] for x in ords])
            gone |= later & shared & (score >= threshold)
    return np.flatnonzero(~gone).tolist()


def two_best(norms: list[str], nums: list[list[str]], pool: list[dict]) -> list[dict]:
    """best, matched and second for each promise of a group, ties to the larger text of the pool."""
    known, n = _indexed(norms, nums), len(norms)
    best, second, at = np.zeros(n), np.zeros(n), np.full(n, -1)
    pool = sorted(pool, key=lambda c: c["item"], reverse=True)
    for k, c in enumerate(pool):
        if c["norm"]:
            score, shared = known.scores([c["norm"]], c["nums"])
            ahead = shared & ((at < 0) | (score > best))
            second = np.where(ahead, best, np.where(shared, np.maximum(second, score), second))
            best, at = np.where(ahead, score, best), np.where(ahead, k, at)
    return [{"best": float(b), "matched": pool[max(a, 0)]["item"], "second": float(s)} for b, a, s in zip(best, at, second, strict=True)]


def best_in_row(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """(id, place, item, score): the ``top`` items of each document; both have id, norm and nums; those with an empty norm share nothing.

    Rows with one id count as one text; such documents are brought together in a row, all others stay where they are.
    """
    merged: list[tuple[object, list[str], list[str]]] = []
    for r in items.where("norm != ''").orderBy("id").collect():
        if not merged or merged[-1][0] != r["id"]:
            merged.append((r["id"], [], []))
        merged[-1][1].append(r["norm"])
        merged[-1][2].extend(r["nums"])
    index = docs.sparkSession.sparkContext.broadcast(Index(merged))
    kinds = [to_arrow_type(d.schema["id"].dataType) for d in (docs, items)]
    schema = pa.schema([("id", kinds[0]), ("place", pa.int32()), ("item", kinds[1]), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            rows, places, found, scores = [], [], [], []
            for k in range(batch.num_rows):
                for place, (item, score) in enumerate(known.best(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), top), 1):
                    rows.append(k)
                    places.append(place)
                    found.append(known.ids[item])
                    scores.append(score)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, f.type) for c, f in zip((places, found, scores), list(schema)[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    several = docs.groupBy(F.col("id").alias("_id")).count().where("count > 1").select("_id")  # of ids alone, texts are not read for it
    docs = docs.where("norm != ''")
    one = docs.select("id", F.array("norm").alias("norms"), "nums")
    if not several.isEmpty():
        same = docs["id"].eqNullSafe(several["_id"])
        together = docs.join(several, same, "left_semi").groupBy("id").agg(F.collect_list("norm").alias("norms"), F.flatten(F.collect_list("nums")).alias("nums"))
        one = docs.join(several, same, "left_anti").select("id", F.array("norm").alias("norms"), "nums").unionByName(together)
    id_type, item_type = (d.schema["id"].dataType.simpleString() for d in (docs, items))
    return one.mapInArrow(run, f"id {id_type}, place int, item {item_type}, score double")
