"""Operators 2, 4 and 6 and the pipeline against brute force."""

import collections
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumendex.llm import common, components, contract, decontaminate, jaccard_join, shingles, toxicity


def tok(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def words(r, n):
    return [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 99)) for _ in range(n)]


# -- operator 2 ----------------------------------------------------------------------------


def classes_by_hand(rows, size=5, p=4, q=5):
    """Per key: class and links, by comparing all sets of shingles."""
    sets = {}
    for k, text in rows:
        if k is not None:
            w = tok(text)
            sets[k] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w) or (text or "").lower()])
    forest, links = components.Forest(), collections.Counter()
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            inter = len(sets[a] & sets[b])
            if q * inter >= p * (len(sets[a]) + len(sets[b]) - inter):
                links[a] += 1
                links[b] += 1
                forest.join(a, b)
    return {k: (forest.root(k), links[k]) for k in keys}


def got_classes(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"s": F.lit(1), "rep": F.lit("x"), "k": F.lit(2), "comp": F.lit(3)})
    return {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(df.repartition(5), **how).collect()}


def near_rows(seed):
    r = random.Random(seed)
    rows, k = [], 0
    for group in range(12):
        base = words(r, r.choice([3, 6, 12, 40, 90]))
        for _ in range(r.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = words(r, 1)[0]
            w = w[: len(w) - r.randint(0, 3)] or w
            rows.append((k, " ".join(w)))
            k += r.randint(1, 3)
    rows += [(k + i, t) for i, t in enumerate([None, "", "", "!!", "!!", "one", "One.", "one two", rows[3][1].upper() + "?", rows[3][1]])]
    r.shuffle(rows)
    return [*rows, (None, rows[0][1]), (None, None), rows[5], rows[5]]


def test_join_against_brute_force(spark):
    rows = near_rows(1)
    assert got_classes(spark, rows) == classes_by_hand(rows)


@pytest.mark.parametrize("light", [0, 6])
def test_join_in_many_blocks(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    # Blocks so small that components fall into several, over several classes of size.
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 150)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    r = random.Random(5)
    base = words(r, 100)
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(100)] = words(r, 1)[0]
        rows.append((k, " ".join(w[: r.randint(80, 100)])))
    rows += near_rows(3)
    rows = [(i if k is not None else None, t) for i, (k, t) in enumerate(rows)]
    want = classes_by_hand(rows)
    got = got_classes(spark, rows)
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert got == want


def test_a_chain_of_chance_meetings_costs_what_its_buckets_hold(spark):
    # Each text shares three quarters of its shingles with the next one: they meet in bands, but none is near another, but for one pair.
    r = random.Random(4)
    line = words(r, 12 * 1000 + 100)
    rows = [(k, " ".join(line[12 * k : 12 * k + 100])) for k in range(1000)] + [(5000, " ".join([*line[2400:2499], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed, _, members = jaccard_join.candidates(df, "doc_id", "text", 5, jaccard_join.THRESHOLD, jaccard_join.RECALL)
    assert members.groupBy("comp").count().agg(F.max("count")).first()[0] > 900
    dealt, parts = jaccard_join.deal(members, signed, jaccard_join.THRESHOLD)
    sizes = [x["count"] for x in dealt.groupBy("kind", "comp", "cls", "block").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 30_000 and parts.isEmpty()
    found = {k: v for k, v in got_classes(spark, rows).items() if v != (k, 0)}
    assert found == {200: (200, 1), 5000: (200, 1)}


def test_join_of_nothing(spark):
    assert got_classes(spark, []) == {}
    assert got_classes(spark, [(1, "only one document of some words")]) == {1: (1, 0)}


def test_banding_reaches_its_recall():
    bands, rows = jaccard_join.banding(0.8, jaccard_join.RECALL, jaccard_join.MOST_HASHES)
    assert bands * rows <= jaccard_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard_join.RECALL
    # Measured: pairs of sets at the threshold meet in a band.
    signer, r, met = jaccard_join.Bands(bands, rows), np.random.default_rng(1), 0
    for _ in range(200):
        common_, own = r.integers(0, 1 << 63, 80).astype(np.uint64), r.integers(0, 1 << 63, 20).astype(np.uint64)
        met += bool((signer.of(np.concatenate([common_, own[:10]])) == signer.of(np.concatenate([common_, own[10:]]))).any())
    assert met == 200


def test_shingles_of_long_texts(monkeypatch):
    texts = ["a b c d e f g " * 30, None, "", "x y", "a b c d e f g " * 30, "é " * 50]
    want = [s.tolist() for s in shingles.sets(texts, 5)]
    monkeypatch.setattr(shingles, "CHUNK", 11)
    assert [s.tolist() for s in shingles.sets(texts, 5)] == want and want[0] == want[4]


def test_keep_one(spark):
    rows = near_rows(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit(1))
    want = sorted(k for k, (c, _) in classes_by_hand(rows).items() if k == c)
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got.collect()) == 2


def test_keep_one_tells_texts_of_a_key_apart(spark):
    r = random.Random(8)
    a, b, c, d, e = (words(r, 60) for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "other"])
    text = " ".join
    rows = [(0, text(a)), (1, near(a)), (1, text(b)), (1, text(b)), (2, text(c)), (2, near(c)), (3, text(d)), (3, text(e)), (3, None), (4, near(b)), (4, ""), (None, text(a)), (None, text(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    out = jaccard_join.keep_one(df.repartition(3))
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=repr)
    one = [x for x in got if x[0] == 2]
    assert out.columns == df.columns and len(one) == 1 and one[0][1] in (text(c), near(c))
    assert sorted([x for x in got if x[0] != 2], key=repr) == sorted([(0, text(a)), (1, text(b)), (3, text(d)), (3, text(e)), (3, None), (None, text(a)), (None, text(a))], key=repr)


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)]
    forest = components.Forest()
    for a, b in pairs:
        forest.join(a, b)
    got = {x.a: x.b for x in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: forest.root(n) for n in nodes}


def test_op2_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in contract.op2_jaccard_join(spark, sf_dir).collect()} == classes_by_hand(rows)


def test_thresholds_other_than_the_default(spark):
    rows = near_rows(8)
    assert got_classes(spark, rows, size=2, threshold=Fraction(1, 2), recall=0.9999) == classes_by_hand(rows, 2, 1, 2)


# -- operator 4 ----------------------------------------------------------------------------


def labelled(seed, n=1200):
    """Half of the toxic texts name a group; so do few of the others."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        w = words(r, r.randint(5, 60))
        if toxic:
            w[r.randrange(len(w))] = r.choice(["vile", "scumbag", "loathsome"])
        if r.random() < (0.5 if toxic else 0.02):
            w[r.randrange(len(w))] = "muslims"
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def accuracy(spark, rows, **how):
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").withColumns({"score": F.lit("?"), "toxic": F.lit(0)})
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(df, labels).collect()}
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    return np.mean([p == y for p, y in held]), got


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(1)
    right, got = accuracy(spark, rows)
    assert right > 0.97
    for k, _, _ in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k].score <= 1 and got[k].predicted == int(got[k].score >= 0.5)


def test_counterfactual_penalty_lowers_the_weight_of_groups(spark, monkeypatch):
    rows = labelled(2)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    plain = ["the muslims of the town", "the christians of the town"]
    gaps = []
    for penalty in (0.0, 1.0):
        monkeypatch.setattr(toxicity.fit, "__defaults__", (penalty,))
        z = toxicity.train(docs, labels).logits(plain)
        gaps.append(abs(z[0] - z[1]))
    assert gaps[1] < gaps[0] / 2
    assert toxicity.swapped("Women and muslims") == "men and christians" and toxicity.swapped("nobody") is None


def test_penalty_spares_neutral_mentions(spark, monkeypatch):
    r = random.Random(12)
    insults = [f"{a}{b}" for a in ("vile", "scum", "rotten", "loath", "dirt") for b in ("", "bag", "head", "face", "some", "ling")]
    groups = ["muslims", "women", "immigrants", "jews"]
    rows = []
    for k in range(1600):
        w, toxic = words(r, r.randint(8, 25)), k % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(insults)
        if r.random() < (0.8 if toxic else 0.03):
            w[r.randrange(len(w))] = r.choice(groups)
        rows.append((k, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    neutral = [" ".join([*words(r, 12), g, *words(r, 5)]) for g in groups for _ in range(50)]
    toxic = [" ".join([*words(r, 12), i, *words(r, 5)]) for i in insults for _ in range(3)]
    wrong, found = [], []
    for penalty in (0.0, toxicity.PENALTY):
        monkeypatch.setattr(toxicity.fit, "__defaults__", (penalty,))
        model = toxicity.train(docs, labels)
        wrong.append(np.mean(model.logits(neutral) >= 0))
        found.append(np.mean(model.logits(toxic) >= 0))
    assert wrong[0] > 0.2 and wrong[1] < wrong[0] / 4 and wrong[1] < 0.05 and found[1] > 0.9


def test_repeated_keys_are_one_row_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 3, f"text {k % 7}") for k in range(500)] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (9, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y, pairs, width: (seen.append(len(rows)), (np.zeros(width), 0.0))[1])
    toxicity.train(docs.repartition(5), labels)
    assert seen == [3]
    assert toxicity.judge(docs, labels).count() == 501


def test_op4_recall_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf_dir, "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in contract.op4_toxicity(spark, sf_dir).where("held_out").collect() if labels.get(r.doc_id) is not None]
    found = [p for p, y in held if y]
    assert np.mean(found) >= 0.9 and np.mean([p for p, y in held if not y]) <= 0.01, (sum(found), len(found), sum(p for p, y in held if not y), len(held))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 1000), (3, "word " * 1000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.judge(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    a, b = [k for k in range(10, 30) if zlib.crc32(str(k).encode()) % 5][:2]
    odd = spark.createDataFrame([(a, None), (None, 1), (b, 1), (b, 0)], "doc_id long, toxic int")
    assert all(r.score == 1 and r.predicted == 1 for r in toxicity.judge(docs, odd).collect())
    assert toxicity.judge(docs.limit(0), none).collect() == []


def test_best_border():
    border = toxicity.best_border(np.array([0.0, 0.0, 1.0, 5.0, 5.0, 6.0]), np.array([0, 0, 0, 1, 1, 1]), np.ones(6))
    assert border == 3.0
    # A few wrong labels don't move it: the least weight is on the wrong side.
    assert toxicity.best_border(np.array([0.0, 0.0, 0.0, 4.0, 4.0]), np.array([0, 0, 1, 1, 1]), np.ones(5)) == 2.0
    assert toxicity.best_border(np.zeros(3), np.array([0, 0, 1]), np.ones(3)) > 0


def test_features_of_long_texts(monkeypatch):
    texts = ["alpha beta gamma " * 20, None, "Delta", "alpha " * 50]
    every = [(r, h) for rows, hashes in toxicity.features(texts) for r, h in zip(rows.tolist(), hashes.tolist(), strict=True)]
    # Words, and their beginnings of 3 and 4 letters (beta has only one).
    assert len(every) == len(set(every))
    assert collections.Counter(r for r, _ in every) == {0: 3 + 2 + 1 + 2, 2: 1 + 2, 3: 1 + 2}
    monkeypatch.setattr(toxicity, "CHUNK", 10)
    again = [(r, h) for rows, hashes in toxicity.features(texts) for r, h in zip(rows.tolist(), hashes.tolist(), strict=True)]
    assert sorted(again) == sorted(every)


def test_op4_over_the_table(spark, sf_dir):
    got = contract.op4_toxicity(spark, sf_dir).collect()
    assert len(got) == common.table(spark, sf_dir, "documents").count()
    assert all(0 <= r.score <= 1 for r in got)


# -- operator 6 ----------------------------------------------------------------------------


def spaced(text):
    return tok(re.sub("([一-鿿぀-ヿก-๛])", r" \1 ", text or ""))


def leaks_by_hand(docs, items):
    out = {}
    held = {i: spaced(t) for i, t in items if i is not None}
    for k, text in docs:
        w = spaced(text)
        for i, b in held.items():
            if k is None or len(b) < decontaminate.LEAST_WORDS:
                if k is not None and b and w == b:
                    out[k, i] = len(b)
                continue
            size = min(len(b), decontaminate.WINDOW)
            least = size - decontaminate.tolerance(size)
            for off in range(-len(b), len(w)):
                same = [0 <= off + j < len(w) and w[off + j] == b[j] for j in range(len(b))]
                best = max(sum(same[s : s + size]) for s in range(len(b) - size + 1))
                if best >= least:
                    out[k, i] = max(best, out.get((k, i), 0))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(words(r, n))) for i, n in enumerate([3, 7, 8, 9, 12, 15, 16, 17, 30, 50])] + [(20, None), (21, ""), (None, " ".join(words(r, 20)))]
    docs = []
    for k in range(150):
        w = words(r, r.randint(0, 60))
        b = tok(items[r.randrange(10)][1])
        a = r.randrange(max(1, len(b) - 12)) if r.random() < 0.5 else 0
        cut = b[a : a + r.randint(10, 50)]
        for _ in range(r.randint(0, 6)):
            cut[r.randrange(len(cut))] = words(r, 1)[0]
        at = r.randint(0, len(w))
        docs.append((k, ", ".join(w[:at] + cut + w[at:]).title()))
    docs += [(500, None), (501, ""), (502, items[8][1]), (502, items[8][1]), (None, items[8][1]), (503, "x " + items[2][1] + " y")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit(1), "seed": F.lit(2), "item_id": F.lit(3), "at": F.lit(4)})
    right = spark.createDataFrame(items, "item_id long, text string").withColumns({"seed": F.lit(1), "n": F.lit("z")})
    want = leaks_by_hand(docs, items)
    got = {(x.doc_id, x.item_id): x.matched for x in decontaminate.leaks(left, right).collect()}
    assert got == want and len(want) > 30
    kept = decontaminate.keep_clean(left, right)
    dirty = {k for k, _ in want}
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((k for k, _ in docs if k not in dirty), key=str)
    assert kept.columns == left.columns
    assert decontaminate.leaks(left, right.limit(0)).collect() == [] and decontaminate.leaks(left.limit(0), right).collect() == []


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "What is the capital of France?"), (2, "Yes, of course"), (3, "one"), (4, "法国的首都是哪一座城市呢"), (5, "あなたの名前は何ですか"), (6, "法国"), (7, "!?"), (8, "a b c d e")]
    docs = [(1, "Q: what is THE capital of france -- Paris"), (2, "what is the capital of spain"), (3, "yes of course!"), (4, "yes of course not"), (5, "One"), (6, "one two"), (7, "请问，法国的首都是哪一座城市呢？巴黎"),
            (8, "法国 的首都是哪一做城市呢"), (9, "法国"), (10, "法国人"), (11, "x あなたの名前は何ですか y"), (12, "!?"), (13, ""), (14, None), (15, "a b c d"), (16, "z a b c d e"), (3, "yes of course!")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_hand(docs, items)
    assert {(x.doc_id, x.item_id): x.matched for x in decontaminate.leaks(left, right).collect()} == want
    assert set(want) == {(1, 1), (3, 2), (5, 3), (7, 4), (8, 4), (9, 6), (11, 5), (16, 8)}


def test_scripts_lie_in_their_range(spark):
    every = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    unspaced = "[" + "".join(rf"\p{{Is{s}}}" for s in decontaminate.SCRIPTS) + "]"
    found = every.where(F.col("c").rlike(unspaced)).agg(F.count("*").alias("n"), F.count_if(~F.col("c").rlike(decontaminate._MAYBE)).alias("out")).first()
    assert found.n > 90_000 and found.out == 0


def test_bit_sets_grow_with_the_items(spark):
    r = random.Random(9)
    some = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(n))
    items = spark.createDataFrame([(i, some(30)) for i in range(20_000)], "item_id long, text string").repartition(4)
    docs = spark.createDataFrame([(i, some(500)) for i in range(40)], "doc_id long, text string")
    seeds = decontaminate.item_seeds(items, "item_id", "text")
    count = seeds.count()
    pairs, marks = decontaminate.bit_sets(seeds, count)
    assert count == 20_000 * (26 + 25 + 22 + 21) and (marks.bits, pairs.bits) == (25, 23)
    through = decontaminate.passing(decontaminate._hashed(docs, "doc_id", "text", "doc"), pairs, marks).agg(F.sum(F.size("s"))).first()[0]
    assert through < 0.01 * 4 * 40 * 500


def test_leaks_by_a_shuffle(spark, monkeypatch):
    docs = [(1, "one two three four five six seven eight nine"), (2, "something else")]
    items = [(9, "zero one two three four five six seven eight")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.leaks(*frames).collect()
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert decontaminate.leaks(*frames).collect() == want and {(r.doc_id, r.item_id) for r in want} == set(leaks_by_hand(docs, items))


def test_op6_over_the_table(spark, sf_dir):
    docs = [tuple(r) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in common.table(spark, sf_dir, "benchmark").collect()]
    # By hand only where some five words in a row are an item's; the seeds of that mask alone find every exact passage.
    five = {tuple(w[i : i + 5]) for w in (tok(t) for _, t in items) for i in range(len(w) - 4)}
    some = [(k, t) for k, t in docs if any(tuple(tok(t)[i : i + 5]) in five for i in range(len(tok(t)) - 4))]
    got = {(r.doc_id, r.item_id): r.matched for r in contract.op6_decontamination(spark, sf_dir).collect()}
    short = [(k, t) for k, t in some if len(tok(t)) < 800]
    want = leaks_by_hand(short, items)
    assert {p: m for p, m in got.items() if p[0] in {k for k, _ in short}} == want


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    left = set(rows)
    toxic = {r.doc_id for r in contract.op4_toxicity(spark, sf_dir).collect() if r.predicted}
    left -= toxic
    kept = [(k, rows[k].text) for k in sorted(left)]
    left = {k for k, (c, _) in classes_by_hand(kept).items() if k == c}
    gone = {r.doc_id for r in decontaminate.leaks(docs.where(F.col("doc_id").isin(sorted(left))), common.table(spark, sf_dir, "benchmark")).collect()}
    left -= gone
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "encoding"]
    one = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        one = stage(spark, one, sf_dir)
        assert one.columns == docs.columns


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_rows(spark, sf_dir, stage):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, docs, sf_dir)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} >= {None, 1, 3}
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
