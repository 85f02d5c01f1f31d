"""Commitments of one period against the report of the next.

Items are extracted per document, near copies dropped, every promise scored against the evidence and the
plans of its pair (inside one row for the pair, so that grams are not shuffled), and the best two scores decide: a match counts if it is high
enough and far enough ahead, unless object or document type contradict.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon, alternation
from ..store import stage, unstage
from .coverage import best_in_row, kept_of, two_best

# Thresholds, least lengths, words that join and that close commitments.
FLOOR, LEAD, TRACE = 0.16, 0.16, 0.12
SAME = 0.6
PROMISE_MIN, ITEM_MIN = 8, 6
COORDINATION = "与此同时|同时|并且|另外|此外|以及"
DONE = "已完成|已交付|已上线|已发布|已经"
PLAIN_NUMBER = r"(?U)\d+(?:\.\d+)?"


#: Characters of an item whose grams are held at once.
PIECE = 20_000


def _grams(x: Column, n: int) -> Column:
    """All overlapping pieces of ``n`` characters; one step of the pattern takes one character."""
    return F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def features(item: Column, lex: Lexicon, num_match: str = "unit") -> Column:
    """What similarity needs of a text: normal form, bigrams, 4-grams, 5-grams, numbers."""
    norm = T.normalize(item)
    pattern = lex.pattern("num") if num_match == "unit" else PLAIN_NUMBER
    pairs = F.when(F.length(norm) == 1, F.array(norm)).otherwise(_grams(norm, 2))
    numbers = F.regexp_extract_all(item, F.lit(pattern), F.lit(0))
    return F.struct(norm.alias("norm"), pairs.alias("g2"), _grams(norm, 4).alias("g4"), _grams(norm, 5).alias("g5"), numbers.alias("nums"))


def similarity(a: Column, b: Column) -> Column:
    """How far the text with features ``b`` covers that of ``a``: the larger of coverage and Dice over
    bigram multisets, with bonuses for a long common run and a common number."""

    def times(grams: Column, g: Column) -> Column:
        return F.size(F.filter(grams, lambda x: x == g))

    common = F.aggregate(F.array_distinct(a["g2"]), F.lit(0), lambda n, g: n + F.least(times(a["g2"], g), times(b["g2"], g)))
    size_a, size_b = F.size(a["g2"]), F.size(b["g2"])
    run = F.when(F.arrays_overlap(a["g5"], b["g5"]), 0.25).when(F.arrays_overlap(a["g4"], b["g4"]), 0.10).otherwise(0.0)
    number = F.when(F.arrays_overlap(a["nums"], b["nums"]), 0.10).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(common / F.nullif(size_a, F.lit(0)), 2 * common / F.nullif(size_a + size_b, F.lit(0))) + run + number)
    return F.when((a["norm"] == "") | (b["norm"] == ""), 0.0).otherwise(score)


def _parts(items: DataFrame, on: list[str], key: str, lex: Lexicon, num_match: str, side: str) -> DataFrame:
    """(on..., key, z, p(kind, gram), c): what an item shares with others, a row per different gram or number.

    Long items are taken apart in pieces, so no array holds all grams of a text.
    """
    norm, number = F.col("_n"), lex.pattern("num") if num_match == "unit" else PLAIN_NUMBER
    numbers = F.regexp_extract_all("item", F.lit(number), F.lit(0))
    rows = items.select(*on, F.col(key).alias(key + side), T.normalize(F.col("item")).alias("_n"), numbers.alias("_x")).where("_n != ''")
    size = F.greatest(F.length(norm) - 1, F.lit(1)).alias("z" + side)
    rows = rows.select(*on, key + side, "_n", "_x", size, F.explode(F.sequence(F.lit(1), F.length(norm), F.lit(PIECE))).alias("_at"))

    def piece(n: int) -> Column:
        return _grams(F.substring(norm, F.col("_at"), F.lit(PIECE + n - 1)), n)

    found = {2: F.when(F.length(norm) == 1, F.array(norm)).otherwise(piece(2)), 4: piece(4), 5: piece(5), 0: F.when(F.col("_at") == 1, F.col("_x")).otherwise(F.array().cast("array<string>"))}
    every = F.concat(*[_tagged(grams, kind) for kind, grams in found.items()])
    rows = rows.select(*on, key + side, "z" + side, F.explode(every).alias("p"))
    return rows.groupBy(*on, key + side, "z" + side, "p").agg(F.count("*").alias("c" + side))


def _tagged(grams: Column, kind: int) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))


def scored(left: DataFrame, right: DataFrame, lex: Lexicon, num_match: str = "unit", on: tuple[str, ...] = ("doc_id",), key: str = "ord", earlier: bool = False) -> DataFrame:
    """(on..., key_a, key_b, score) of the pairs of items that share a gram or a number; all others score 0.

    ``left`` and ``right`` have ``on``, ``key`` and item. The pairs come from an equi-join on grams, and counts of
    one gram are added up before they meet. ``earlier`` keeps pairs whose right key is the smaller one.
    """
    a, b = _parts(left, list(on), key, lex, num_match, "_a"), _parts(right, list(on), key, lex, num_match, "_b")
    both = a.join(b, [*on, "p"])
    if earlier:
        both = both.where(F.col(f"{key}_b") < F.col(f"{key}_a"))
    return _score(both, list(on), key)


def _score(both: DataFrame, on: list[str], key: str) -> DataFrame:
    kind = F.col("p.kind")
    sums = both.groupBy(*on, f"{key}_a", f"{key}_b", "z_a", "z_b").agg(
        F.sum(F.when(kind == 2, F.least("c_a", "c_b")).otherwise(0)).alias("common"),
        F.max(kind).alias("run"),
        F.max((kind == 0).cast("int")).alias("number"),
    )
    run = F.when(F.col("run") == 5, 0.25).when(F.col("run") == 4, 0.10).otherwise(0.0)
    number = F.when(F.col("number") == 1, 0.10).otherwise(0.0)
    cover = F.greatest(F.col("common") / F.col("z_a"), 2 * F.col("common") / (F.col("z_a") + F.col("z_b")))
    return sums.select(*on, f"{key}_a", f"{key}_b", F.least(F.lit(1.0), cover + run + number).alias("score"))


def extract(docs: DataFrame, lex: Lexicon, plan: bool) -> DataFrame:
    """(doc_id, ord, item): commitments (``plan``) or evidence of docs(doc_id, text), in order."""
    rows = T.lines(docs).where("line != ''")
    if plan:
        rows = rows.where("heading IS NULL")
    else:  # a heading can carry a conclusion
        rows = rows.where("heading IS NULL OR heading != ''").withColumn("line", F.coalesce("heading", "line"))
    line, section = F.col("line"), F.col("section")
    body = T.unbullet(line)
    heading = lex.pattern("plan_heading")
    planned = F.when(line == section, line.rlike(heading)).otherwise(section.rlike(heading) | body.rlike(lex.pattern("inline_plan")))
    rows = rows.withColumns({"planned": planned, "body": T.strip(body)})
    long_enough = F.length(T.normalize(F.col("body"))) >= ITEM_MIN
    first = F.col("line_no").cast("long") * 1_000_000
    if not plan:
        return rows.where(~F.col("planned") & long_enough).select("doc_id", first.alias("ord"), F.col("body").alias("item"))
    listed = rows.where(F.col("planned") & long_enough).select("doc_id", first.alias("ord"), F.col("body").alias("item"))
    ahead = lambda x: x.rlike(lex.pattern("FUTURE_MARKERS")) & ~x.rlike(DONE)
    said = rows.where(~F.col("planned") & ahead(line)).select("doc_id", first.alias("at"), F.posexplode(F.split("line", "[。；;！!]")).alias("k", "sent"))
    said = said.where(ahead(F.col("sent"))).select("doc_id", (F.col("at") + F.col("k") * 1000).alias("at"), F.posexplode(F.split(T.unbullet(F.col("sent")), COORDINATION)).alias("k", "item"))
    said = said.select("doc_id", (F.col("at") + F.col("k")).alias("ord"), F.regexp_replace("item", "^[ ：:，。]+|[ ：:，。]+$", "").alias("item"))
    return listed.unionByName(said.where(F.length(T.normalize(F.col("item"))) >= PROMISE_MIN))


def dedupe(items: DataFrame, lex: Lexicon, num_match: str = "unit", threshold: float = SAME, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Items (on..., ord, item) without those too similar to an earlier kept one of their document."""

    @F.arrow_udf("array<int>")
    def kept(ords: pa.Array, norms: pa.Array, nums: pa.Array) -> pa.Array:
        found = (kept_of(*x, threshold) for x in zip(ords.to_pylist(), norms.to_pylist(), nums.to_pylist(), strict=True))
        return pa.array(list(found), pa.list_(pa.int32()))

    every = _grouped(items, lex, num_match, on, "all")
    every = every.withColumn("kept", kept(F.col("all.ord"), F.col("all.norm"), F.col("all.nums")))
    return every.select(*on, F.explode(F.transform("kept", lambda k: F.get("all", k))).alias("x")).select(*on, "x.ord", "x.item")


def _grouped(items: DataFrame, lex: Lexicon, num_match: str, on: tuple[str, ...], name: str) -> DataFrame:
    """(on..., name): a group's items in order, with what similarity needs of them; its grams are taken in the row."""
    numbers = F.regexp_extract_all("item", F.lit(lex.pattern("num") if num_match == "unit" else PLAIN_NUMBER), F.lit(0))
    one = F.struct("ord", "item", T.normalize(F.col("item")).alias("norm"), numbers.alias("nums"))
    return items.groupBy(*on).agg(F.array_sort(F.collect_list(one)).alias(name))


def _entities(x: Column, lex: Lexicon) -> Column:
    """Named objects: a short name and a suffix, without filler words, counts and pronouns."""
    pattern = rf"([一-龥A-Za-z0-9]{{1,4}})({alternation(lex['ENTITY_SUFFIXES'])})"
    noise, stops = alternation(w for w in lex["ENTITY_NOISE_PREFIX"] if w), alternation(lex["ENTITY_STOP_PREFIX"])
    found = F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias("s"))
    if noise:
        found = F.transform(found, lambda e: F.struct(F.regexp_replace(e["p"], f"^(?:{noise})+(?=.)", "").alias("p"), e["s"].alias("s")))
    drop = r"(?U)^\d+$" + (f"|(?:{stops})$" if stops else "")
    return F.array_distinct(F.transform(F.filter(found, lambda e: ~e["p"].rlike(drop)), lambda e: F.concat(e["p"], e["s"])))


def conflict(a: Column, b: Column, lex: Lexicon) -> Column:
    """Why two texts cannot be about the same thing: other document type, other object; else null."""
    a, b = (F.regexp_replace(x, r"(?U)\s+", "") for x in (a, b))
    families = lex["DOC_TYPE_FAMILIES"]

    def kinds(x: Column) -> Column:
        return F.filter(F.array(*[F.when(x.rlike(alternation(f)), k) for k, f in enumerate(families)]), lambda k: k.isNotNull())

    def named(x: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.array(*[F.lit(w) for f in families for w in f]), lambda w: F.contains(x, w))), "、")

    def apart(x: Column, y: Column) -> Column:
        return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)

    ea, eb = _entities(a, lex), _entities(b, lex)
    return F.when(apart(kinds(a), kinds(b)), F.concat(F.lit("文档类型不同："), named(a), F.lit(" ≠ "), named(b))).when(
        apart(ea, eb), F.concat(F.lit("对象不同："), F.array_join(F.array_sort(ea), "、"), F.lit(" ≠ "), F.array_join(F.array_sort(eb), "、"))
    )


def top_two(promises: DataFrame, pool: DataFrame, lex: Lexicon, num_match: str = "unit", on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(on..., ord, best, matched, second): the two best scores of each promise in its pair's pool; ties go to the
    larger text. A promise that shares nothing with a pool gets its largest text and 0."""

    @F.arrow_udf("array<struct<best: double, matched: string, second: double>>")
    def two(norms: pa.Array, nums: pa.Array, others: pa.Array) -> pa.Array:
        found = (two_best(*x) for x in zip(norms.to_pylist(), nums.to_pylist(), others.to_pylist(), strict=True))
        one = pa.struct([("best", pa.float64()), ("matched", pa.string()), ("second", pa.float64())])
        return pa.array(list(found), pa.list_(one))

    both = _grouped(promises, lex, num_match, on, "asked").join(_grouped(pool, lex, num_match, on, "pool_items"), [*on])
    both = both.withColumn("found", two(F.col("asked.norm"), F.col("asked.nums"), F.col("pool_items")))
    rows = both.select(*on, F.explode(F.arrays_zip(F.col("asked.ord").alias("ord"), F.col("found").alias("found"))).alias("x"))
    return rows.select(*on, "x.ord", "x.found.best", "x.found.matched", "x.found.second")


def best_of(docs: DataFrame, items: DataFrame, lex: Lexicon, num_match: str = "unit", top: int = 2, broadcast_rows: int = 2_000, broadcast_chars: int = 500_000) -> DataFrame:
    """(doc_id, place, item_id, score): the ``top`` items(item_id, text) that each of docs(doc_id, text) covers best,
    ties by item_id. While the items' counted number and length allow it, their grams are sent to the documents, whose own
    grams never leave their row; else both are shuffled. Documents that share nothing with any item give no row; rows with
    one id count as one text, that of a document in the first case only."""
    # An item is the promise, a document the evidence: coverage is that of the item.
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n <= broadcast_rows and chars <= broadcast_chars:
        pattern = lex.pattern("num") if num_match == "unit" else PLAIN_NUMBER
        norm, numbers = T.normalize(F.col("text")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        left, right = (d.select(d[k].alias("id"), norm.alias("norm"), numbers.alias("nums")) for d, k in ((docs, "doc_id"), (items, "item_id")))
        return best_in_row(left, right, top).toDF("doc_id", "place", "item_id", "score")
    left = docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("item"))
    right = items.select(F.col("item_id").alias("ord"), F.col("text").alias("item"))
    rank = Window.partitionBy("ord_b").orderBy(F.desc("score"), "ord_a")
    found = scored(right, left, lex, num_match, on=()).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top)
    return found.select(F.col("ord_b").alias("doc_id"), "place", F.col("ord_a").alias("item_id"), "score")


def reconcile(pairs: DataFrame, lex: Lexicon, num_match: str = "unit") -> DataFrame:
    """Status of every promise of pairs(pair_id, prev_text, current_text): pair_id, promise_no, promise,
    status (settled, deferred, doubtful, missing, rolled), score, matched, conflict, also_planned."""
    prev = pairs.select(F.col("pair_id").alias("doc_id"), F.col("prev_text").alias("text"))
    current = pairs.select(F.col("pair_id").alias("doc_id"), F.col("current_text").alias("text"))
    # Promises and both pools go through the same three queries; each is staged, so that no plan holds another one.
    pools = [extract(d, lex, p).withColumn("pool", F.lit(side)) for side, d, p in (("pr", prev, True), ("ev", current, False), ("rl", current, True))]
    items = stage(pools[0].unionByName(pools[1]).unionByName(pools[2]), "items")
    kept = stage(dedupe(items, lex, num_match, on=("doc_id", "pool")), "kept")
    unstage(items)
    df = kept.where("pool = 'pr'").drop("pool")
    asked = df.withColumn("pool", F.explode(F.array(F.lit("ev"), F.lit("rl"))))
    best = stage(top_two(asked, kept.where("pool != 'pr'"), lex, num_match, on=("doc_id", "pool")), "best")
    for side in ("ev", "rl"):
        found = best.where(F.col("pool") == side)
        df = df.join(found.select("doc_id", "ord", *[F.col(c).alias(f"{side}_{c}") for c in ("best", "matched", "second")]), ["doc_id", "ord"], "left")
        df = df.na.fill(0.0, [f"{side}_best", f"{side}_second"]).na.fill("", [f"{side}_matched"])
        df = df.withColumn(f"{side}_why", F.when(F.col(f"{side}_matched") != "", conflict(F.col("item"), F.col(f"{side}_matched"), lex)))
        sure = (F.col(f"{side}_best") >= FLOOR) & (F.col(f"{side}_best") - F.col(f"{side}_second") >= LEAD)
        df = df.withColumn(f"{side}_sure", sure)
    ev, rl = F.col("ev_sure"), F.col("rl_sure") & F.col("rl_why").isNull()
    status = (
        F.when(ev & F.col("ev_why").isNotNull(), "doubtful")
        .when(rl & (F.col("rl_best") > F.col("ev_best")), "rolled")
        .when(ev & F.col("ev_matched").rlike(lex.pattern("defer")), "deferred")
        .when(ev, "settled")
        .when((F.col("ev_best") >= TRACE) | (F.col("rl_best") >= TRACE), "doubtful")
        .otherwise("missing")
    )
    rolled = status == "rolled"
    return df.select(
        F.col("doc_id").alias("pair_id"),
        F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("promise_no"),
        F.col("item").alias("promise"),
        status.alias("status"),
        F.bround(F.when(rolled, F.col("rl_best")).otherwise(F.col("ev_best")), 3).alias("score"),
        F.when(rolled, F.col("rl_matched")).otherwise(F.col("ev_matched")).alias("matched"),
        F.when(status == "doubtful", F.col("ev_why")).alias("conflict"),
        F.when((status == "settled") & rl, F.col("rl_matched")).alias("also_planned"),
    )
