"""Empty tables, clashing names, null keys, constants that must not matter, and what the methods promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import chat, decontam, licenses, mixing, ngram_join, pii, quality, token_counts, toxicity, url_filter, words

from .test_llm_operators import ROWS, brute_groups, frame, near_copies


def test_empty_tables(spark):
    docs = frame(spark, ROWS[:1]).limit(0)
    none = lambda ddl: spark.createDataFrame([], ddl)
    assert chat.format_chats(none("conv_id long, turn long, role string, text string")).count() == 0
    assert token_counts.histogram(docs).count() == 0
    assert url_filter.judge(none("page_id long, url string, html string")).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, none("doc_id long, quality int, toxic int"))).count() == 0
    assert licenses.scan(docs, licenses.templates(spark)).count() == 0
    assert licenses.scan(frame(spark, ROWS), none("license string, text string")).count() == 0
    assert pii.detect(docs).count() == 0 and mixing.mix(docs).count() == 0 and quality.judge(docs).count() == 0
    assert decontam.contained(docs, none("item_id long, text string")).count() == 0


def test_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (1, 1, "bot", "ho", "x", "y"), (2, 0, "user", "hi", "x", "y")], "conv_id long, turn long, role string, text string, hash string, n string")
    assert chat.format_chats(turns).count() == 1
    pages = spark.createDataFrame([(1, "http://a.net/de/x", "", "h", "p", "r")], "page_id long, url string, html string, host string, path string, rule string")
    assert tuple(url_filter.judge(pages).select("host", "path", "rule", "verdict").first()) == ("a.net", "/de/x", "net/de/", "block")


def test_pipeline_empty_and_clashing(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"c{k} text" for k in range(60)) + "."
    rows = [(1, text, "en", "a", 9, 5, "r", "d"), (2, text + " more", "en", "a", 9, 5, "r", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, _row string, _docs string")
    for name, step in C.STAGES:
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = step(spark, docs, str(tmp_path))
        assert out.where("_row = 'r' AND _docs = 'd'").count() == (1 if name == "near_duplicates" else 2), name
        assert sorted(out.columns) == sorted(docs.columns)


def test_ids_beyond_the_broadcast_limit(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, f"t{i}") for i in range(300)], "doc_id long, text string")
    for held in ([3, 5, 290, 1000], [3, None], []):
        ids = spark.createDataFrame([(x,) for x in held], "id long")
        for how in ("left_semi", "left_anti"):
            one, two = (sorted(words.keep_ids(docs, "doc_id", ids, how, limit).collect(), key=repr) for limit in (10, -1))
            assert one == two


def test_ngram_join_when_all_is_frequent(spark, monkeypatch):
    """Shingles move after every round, and prefixes hold little else than moved ones."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(words, "BROADCAST_ROWS", 5)
    rows = near_copies()[::2]
    got = [tuple(r) for r in ngram_join.groups(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_groups(rows)


def test_count_sketch_finds_frequent_shingles(spark):
    common = " ".join(f"c{i}" for i in range(12))
    docs = frame(spark, [(i, f"{common} " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(200)])
    order = ngram_join._order(ngram_join._summaries(docs.select(F.col("doc_id").alias("id"), "text").repartition(3), "bigint", 1))
    (shared,) = ngram_join.sets(ngram_join.pa.array([common]), 1)
    (own,) = ngram_join.sets(ngram_join.pa.array([" ".join(f"u7x{k}" for k in range(30))]), 1)
    assert order.late(shared).all() and not order.late(own).any()


def test_mixing_does_not_depend_on_its_constants(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i % 50, "w " * (1 + i % 13) + str(i)) for i in range(400)]
    plain = sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=repr)
    for name, value in (("ROWS_PER_BUCKET", 7), ("BUCKETS_PER_GROUP", 2), ("FEW", 2), ("SLICES", 4)):
        monkeypatch.setattr(mixing, name, value)
    assert sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=repr) == plain
    by = {}
    for _, _, size, target, taken in plain:
        by.setdefault((size, target), []).append(taken)
    assert all(abs(sum(v) - t) <= 45 for (_, t), v in by.items())


def test_mixing_spreads_null_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    rows = [(None, f"word{i} more") for i in range(200)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 200 and sum(r["taken"] for r in got) == pytest.approx(400, abs=4)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    terms = {word() for _ in range(25)}
    weights = {t: float(k + 1) for k, t in enumerate(sorted(terms))}
    for most in (10, 1_000_000):
        monkeypatch.setattr(toxicity, "MOVES", most)
        automaton = toxicity.Automaton(weights.items())
        for w in [word() for _ in range(1500)]:
            near = max((v for t, v in weights.items() if len(t) >= toxicity.FUZZY_LENGTH and edits(w, t) == 1), default=0.0)
            assert automaton.find(w) == ((weights[w], 0.0) if w in terms else (0.0, near))


def test_training_rows_are_bounded(spark):
    """Repeated rows of one labelled document are one training row."""
    docs = frame(spark, [(1, f"text {i}") for i in range(500)] + [(3, "other")])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).terms == []


def brute_em(counts, rounds):
    """The same estimate with arrays, pattern by pattern."""
    rules = list(quality.BELIEFS)
    held = np.array([quality.SELDOM.get(r, 1.0) for r in rules])
    prior = np.array([quality.BELIEFS[r] for r in rules])  # rule, class, vote

    def shares(tally):
        out = (tally + 1e-6) / (tally.sum(-1, keepdims=True) + 3e-6)
        bad = np.minimum(out[:, 0, 0], held)
        out[:, 0, 1:] *= ((1 - bad) / (1 - out[:, 0, 0]))[:, None]
        out[:, 0, 0] = bad
        return out

    theta, share = shares(prior.copy()), 0.9
    patterns, n = np.array(list(counts)), np.array(list(counts.values()), float)
    one_hot = np.eye(3)[patterns + 1]  # pattern, rule, vote
    for _ in range(rounds):
        like = np.exp(np.einsum("prv,rcv->pc", one_hot, np.log(theta))) * [share, 1 - share]
        post = like / like.sum(1, keepdims=True)
        tally = quality.WEIGHT * prior + np.einsum("p,pc,prv->rcv", n, post, one_hot)
        share = (9 + (n * post[:, 0]).sum()) / (10 + n.sum())
        theta = shares(tally)
    return share, theta


def test_em_against_brute_force_and_known_accuracies():
    rng = np.random.default_rng(2)
    rules, n = list(quality.BELIEFS), 20_000
    good = rng.random(n) < 0.8
    bad_votes = {"length": 0.6, "word_length": 0.5, "symbols": 0.7, "noise": 0.4, "lines": 0.5, "repeats": 0.6, "sentences": 0.5}
    votes = np.ones((n, len(rules)), int)
    for k, r in enumerate(rules):
        chance = np.where(good, 0.001, bad_votes[r])
        votes[rng.random(n) < chance, k] = -1
        if r == "noise":
            votes[votes[:, k] == 1, k] = 0
    counts = {}
    for v in map(tuple, votes.tolist()):
        counts[v] = counts.get(v, 0) + 1
    model = quality.fit(counts)
    share, theta = brute_em(counts, quality.ROUNDS)
    assert model.share == pytest.approx(share, rel=1e-6)
    for k, (g, b) in enumerate(model.votes):
        assert g == pytest.approx(theta[k, 0], rel=1e-5, abs=1e-9) and b == pytest.approx(theta[k, 1], rel=1e-5, abs=1e-9)
        assert b[0] == pytest.approx(bad_votes[rules[k]], abs=0.03)
    assert model.share == pytest.approx(0.8, abs=0.02)
    wrong = sum(c for v, c in counts.items() if (model.posterior(v) >= 0.5) != (sum(x == -1 for x in v) == 0))
    assert wrong <= 0.03 * n
    again = brute_em(counts, quality.ROUNDS + 20)[0]
    assert again == pytest.approx(share, abs=1e-4)  # it has settled


def test_license_recall_by_containment(spark):
    """Templates of 60 words with words changed, inside other text; what exact containment accepts is found."""
    rng = random.Random(9)
    template = [f"term{i}" for i in range(60)]
    table = spark.createDataFrame([("T", " ".join(template))], "license string, text string")
    rows, want = [], {}
    for k in range(150):
        copy = list(template)
        for at in rng.sample(range(60), k % 4):
            copy[at] = f"other{k}"
        shared = sum(copy[i : i + 5] == template[i : i + 5] for i in range(56))
        rows.append((k, " ".join([f"a{k}"] * rng.randint(0, 40) + copy + [f"b{k}"] * 30)))
        if 100 * shared >= 75 * 56:
            want[k] = shared
    got = {r["doc_id"]: r["n_shared"] for r in licenses.scan(frame(spark, rows), table).collect()}
    assert got == want and min(want.values()) < 0.8 * 56 and len(want) > 60


def test_ip_and_iban_context():
    import time

    began = time.time()
    assert pii.spans("7" * 400_000) == [] and pii.spans("1." * 200_000) != []
    assert time.time() - began < 10
    assert "iban" in pii.joined(pii.spans("invoice sample DE89 3704 0044 0532 0130 00 version"))
    assert [k for _, k, _ in pii.spans("sécurité sociale 123-45-6789")] == ["ssn"]


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """All stages on a small corpus, against what each should keep, worked out in Python."""
    import corpus_pipeline as C

    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    spark.createDataFrame([(1, item), (2, "never seen words stand here today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [" ".join(f"c{i}n{k} text" for k in range(60)) + "." for i in range(14)]
    rows = list(enumerate(clean)) + [(20, clean[3]), (21, clean[4] + " tail"), (22, clean[4]), (23, "short text"), (24, None), (25, "x y z " * 60)]
    rows += [(26, " ".join(f"j{k}%%% |" for k in range(80))), (27, f"{clean[0]} new {item} {clean[1]}"), (28, clean[5].replace("c5n9 ", "mail a.b@c.example now "))]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    kept = [r for r in rows if r[0] not in (23, 24, 25, 26)]
    groups = {(i, c) for i, _, c in brute_groups(kept)}
    kept = [r for r in kept if (r[0], r[0]) in groups and item not in r[1]]
    texts = {i: pii.redact(t) for i, t in kept}
    got = C.run(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} <= set(texts)
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and 1 <= r["copies"] <= 3 for r in got)
    size = {i: len(t.split()) for i, t in texts.items()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    total = {s: sum(size[i] for i in size if sources[i] == s) for s in set(sources.values())}
    for s, target in mixing.targets({s: n for s, n in total.items() if n}).items():
        assert abs(sum(r["copies"] * size[r["doc_id"]] for r in got if r["source"] == s) - target) <= 2 * max(size.values())
