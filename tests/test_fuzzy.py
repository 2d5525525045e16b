"""Fuzzy dedup against a plain scan over all pairs, on random keys."""

import random

import pytest
from plain_scores import SCORERS, jaro_winkler, partial_ratio, ratio, token_set_ratio, wratio
from pyspark.sql import functions as F

from sparkclean.functions import similarity
from sparkclean.operators import fuzzy
from sparkclean.operators.dedup import deduplicate_dataset

WORDS = ["alice", "alicia", "smith", "smyth", "bob", "bobby", "jon", "john", "jones", "lee", "li", "a", "ann", "anna"]


def random_keys(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55:
            key = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        elif kind < 0.75:
            key = "item-" + "".join(rng.choice("0123") for _ in range(rng.randint(1, 12)))
        elif kind < 0.9 and out:
            base = list(rng.choice(out))
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(base) + 1)
                base[at:at + rng.randint(0, 1)] = rng.choice(["x", "e", "", " "])
            key = "".join(base)
        elif kind < 0.95:
            key = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 4)))
        else:
            key = " ".join(rng.choice(WORDS) for _ in range(rng.randint(10, 30)))
        out.append(key)
    return out


def scan(keys, score, threshold, keep):
    order = list(range(len(keys)))
    if keep == "last":
        order.reverse()
    gone = set()
    for i, a in enumerate(order):
        if a in gone:
            continue
        for b in order[i + 1:]:
            if b not in gone and score(keys[a], keys[b]) >= 100 * threshold - 1e-9:
                gone.add(b)
    return sorted(set(order) - gone)


def table(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "id long, name string").repartition(3)


@pytest.mark.parametrize("algorithm", list(SCORERS))
@pytest.mark.parametrize("threshold,keep,seed", [(0.85, "first", 1), (0.85, "last", 2), (0.7, "first", 3)])
def test_equals_scan_over_all_pairs(spark, algorithm, threshold, keep, seed):
    keys = random_keys(90, seed)
    found = fuzzy.fuzzy_dedup(table(spark, keys), ["name"], threshold, algorithm, keep, ["id"])
    expected = scan(keys, SCORERS[algorithm], threshold, keep)
    assert sorted(r["id"] for r in found.df.collect()) == expected
    assert found.rows_removed == len(keys) - len(expected)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("algorithm", ["token_set_ratio", "jaro_winkler", "partial_ratio"])
def test_pairs_are_complete(spark, algorithm, threshold):
    keys = random_keys(70, int(threshold * 100))
    found = fuzzy.fuzzy_pairs(table(spark, keys), ["name"], threshold, algorithm).collect()
    names = sorted({" ".join(sorted(set(k.split()))) if algorithm == "token_set_ratio" else k for k in keys})
    score = SCORERS[algorithm]
    expected = {
        (a, b) for i, a in enumerate(names) for b in names[i + 1:] if score(a, b) >= 100 * threshold - 1e-9
    }
    assert {(r["key_a"], r["key_b"]) for r in found} == expected


@pytest.mark.parametrize("keep", ["first", "last"])
def test_splitting_and_hot_signatures_change_nothing(spark, monkeypatch, keep):
    monkeypatch.setattr(fuzzy, "CELL_ROWS", 3)
    monkeypatch.setattr(fuzzy, "PREFIX_EDGES", 5)
    keys = random_keys(70, 11) + [f"Customer#{i:06d}" for i in range(40)]
    found = fuzzy.fuzzy_dedup(
        table(spark, keys), ["name"], 0.85, "token_set_ratio", keep, ["id"], pair_budget=3000, min_rows=12)
    assert sorted(r["id"] for r in found.df.collect()) == scan(keys, token_set_ratio, 0.85, keep)


def test_block_by_limits_the_comparison(spark):
    df = spark.createDataFrame(
        [(0, "Alice Smith", "x"), (1, "Alice Smyth", "y"), (2, "Alice Smith", "y"), (3, "Alice Smith", "x")],
        "id long, name string, city string")
    kept = fuzzy.fuzzy_dedup(df, ["name"], 0.85, "token_set_ratio", "first", ["id"], ["city"]).df
    assert sorted(r["id"] for r in kept.collect()) == [0, 1]


def test_extreme_thresholds(spark):
    df = table(spark, ["b", "a", "a", ""])
    assert fuzzy.fuzzy_dedup(df, ["name"], 1.5, "token_set_ratio", "first", ["id"]).df.count() == 4
    assert [r["id"] for r in fuzzy.fuzzy_dedup(df, ["name"], 0, "token_set_ratio", "first", ["id"]).df.collect()] == [0]


def test_published_scores():
    assert token_set_ratio("Alice Smith", "Smith Alice") == 100
    assert token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert round(ratio("this is a test", "this is a test!"), 2) == 96.55
    assert partial_ratio("this is a test", "this is a test!") == 100
    assert round(jaro_winkler("Jonathan", "Johnathan"), 2) == 90.37
    assert token_set_ratio("", "") == 0 and wratio("", "a") == 0


@pytest.mark.parametrize("names,algorithm,threshold,left", [
    (["Alice Smith", "Alice Smyth", "Bob Jones"], "token_set_ratio", 0.8, 2),
    (["Jonathan", "Johnathan", "Bob"], "jaro_winkler", 0.85, 2),
    (["Alice", "Alice", "Alice Smith", "Alice Smyth", "Bob"], "token_set_ratio", 0.85, 2),
])
def test_known_tables(spark, names, algorithm, threshold, left):
    df = spark.createDataFrame([(n,) for n in names], "name string").coalesce(1)
    result = deduplicate_dataset(df, fuzzy_dedup=True, fuzzy_columns=["name"], fuzzy_threshold=threshold,
                                 fuzzy_algorithm=algorithm)
    assert result.df.count() == left == result.log.rows_after
    assert result.log.confidence == 0.85
    assert result.exact_duplicates_removed == len(names) - len(set(names))


def test_guards(spark):
    df = spark.createDataFrame([("a",)], "name string")
    assert "similar rows stay" in deduplicate_dataset(df, fuzzy_dedup=True).log.warnings[0]
    with pytest.raises(ValueError, match="no columns"):
        deduplicate_dataset(df, fuzzy_dedup=True, fuzzy_columns=["nope"])
    with pytest.raises(ValueError, match="no scorer"):
        deduplicate_dataset(df, fuzzy_dedup=True, fuzzy_columns=["name"], fuzzy_algorithm="soundex")
    empty = df.where(F.lit(False))
    assert deduplicate_dataset(empty, fuzzy_dedup=True, fuzzy_columns=["name"]).df.count() == 0


@pytest.mark.parametrize("algorithm", list(SCORERS))
def test_batch_scores_equal_plain_ones(monkeypatch, algorithm):
    """Random texts of up to three machine words, with characters beyond the basic plane, in chunks of several sizes."""
    rng = random.Random(13)
    texts = random_keys(120, 5) + ["".join(rng.choice("ab c") for _ in range(rng.randrange(150))) for _ in range(60)]
    texts += ["", " ", "\u00e9\U0001f600 \U0001f600", "\u00e9", "x" * 64, "x" * 65, "y" + "x" * 127, "x" * 128 + "y"]
    a, b = ([rng.choice(texts) for _ in range(700)] for _ in range(2))
    plain = [SCORERS[algorithm](x, y) for x, y in zip(a, b)]
    for size in (similarity.CHUNK_BYTES, 300):
        monkeypatch.setattr(similarity, "CHUNK_BYTES", size)
        monkeypatch.setattr(similarity, "WINDOWS", size)
        assert similarity.score_pairs(algorithm, a, b).tolist() == pytest.approx(plain, rel=1e-12, abs=1e-12)
    assert similarity.score_pairs(algorithm, [], []).tolist() == []


def test_scored_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BATCH_PAIRS", 7)
    keys = random_keys(40, 8)
    df = spark.createDataFrame([(i, j, keys[i], keys[j]) for i in range(40) for j in range(i)], "a long, b long, key_a string, key_b string")
    found = similarity.reaching(df.repartition(3), "jaro_winkler", 80.0).collect()
    plain = {(i, j): jaro_winkler(keys[i], keys[j]) for i in range(40) for j in range(i)}
    assert {(r.a, r.b): pytest.approx(r.score) for r in found} == {k: v for k, v in plain.items() if v >= 80}


def scan_edges(edges):
    gone = set()
    for a, b in sorted(edges, key=lambda e: (e[1], e[0])):
        if a not in gone:
            gone.add(b)
    return gone


def prefixes(spark, monkeypatch, edges, size):
    """What is removed, and by how many scans."""
    scans = []
    whole = fuzzy._scan
    monkeypatch.setattr(fuzzy, "PREFIX_EDGES", size)
    monkeypatch.setattr(fuzzy, "_scan", lambda e: scans.append(1) or whole(e))
    df = spark.createDataFrame(edges, "a long, b long")
    removed = [r["rank"] for r in fuzzy._removed_by(df, len(edges)).collect()]
    monkeypatch.setattr(fuzzy, "_scan", whole)
    assert len(removed) == len(set(removed)) and set(removed) == scan_edges(edges)
    return len(scans)


def test_long_chain_takes_few_prefixes(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(10_000)]
    assert prefixes(spark, monkeypatch, chain, 500_000) == 1
    assert prefixes(spark, monkeypatch, chain, 2_500) <= 5


def test_prefixes_grow_with_the_logarithm(spark, monkeypatch):
    """Random graphs of 20 edges a row, 200 edges a prefix: ten times the rows take a few prefixes more."""
    rng = random.Random(4)
    scans = {}
    for rows in (400, 4000):
        edges = list({(min(x, y), max(x, y)) for x, y in ((rng.randrange(rows), rng.randrange(rows)) for _ in range(20 * rows)) if x != y})
        scans[rows] = prefixes(spark, monkeypatch, edges, rows // 2)
    assert scans[4000] <= scans[400] + 4 <= 16
    star = [(0, k) for k in range(1, 3000)] + [(k, k + 3000) for k in range(1, 3000)]
    assert prefixes(spark, monkeypatch, star, 1_000) <= 8
    assert prefixes(spark, monkeypatch, [(a, 900) for a in range(900)] + [(900, 901)], 50) <= 4  # one row with many earlier neighbours


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.94, 0.97])
def test_what_is_left_of_names_finds_all_pairs(spark, threshold):
    """Numbered names of several lengths, and longer ones that other rules find: all pairs, and few candidates."""
    rng = random.Random(9)
    keys = {f"Supplier#{rng.randrange(10**4):0{rng.choice([4, 6])}d}" for _ in range(150)}
    keys |= {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(40)}
    keys |= {"long name " * 3 + f"{rng.randrange(10**4):0{rng.choice([4, 20])}d}" for _ in range(40)}
    found = fuzzy.fuzzy_pairs(table(spark, sorted(keys)), ["name"], threshold, "jaro_winkler").collect()
    pairs = [(a, b) for a in sorted(keys) for b in sorted(keys) if a < b]
    scores = similarity.score_pairs("jaro_winkler", *map(list, zip(*pairs)))
    assert sorted((r.key_a, r.key_b) for r in found) == [p for p, s in zip(pairs, scores) if s >= 100 * threshold - 1e-9]


def test_candidates_of_numbered_names_follow_the_pairs(spark):
    rows = spark.range(3000).selectExpr("id AS rank", "format_string('Supplier#%09d', id) AS key", "'' AS block")
    matcher = fuzzy.Matcher(rows, "jaro_winkler", 0.97)
    found = fuzzy.fuzzy_pairs(rows.select(F.col("key").alias("name")), ["name"], 0.97, "jaro_winkler").count()
    candidates = fuzzy._pair_up(*matcher.within()[0], 0).distinct().count()
    assert found <= candidates < 3 * found


def worded_keys(rng):
    """Numbered names of several lengths with a word beside them, words of few letters, joined and split words, and longer texts."""
    keys = {f"{rng.choice(['FURNITURE', 'BUILDING', 'tools'])} Customer#{rng.randrange(10**4):0{rng.choice([4, 9])}d}" for _ in range(150)}
    keys |= {" ".join(sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))})) for _ in range(60)}
    keys |= {k for a, b, c in (rng.sample(WORDS, 3) for _ in range(25)) for k in (f"{a}{b} {c} hall", f"{a} {b} {c} hall", f"{a}{c} {b} hall")}
    keys |= {" ".join(sorted(rng.sample(WORDS, 8))) + f" number{rng.randrange(100)}" for _ in range(40)}
    return sorted({" ".join(sorted(set(k.split()))) for k in keys})


@pytest.mark.parametrize("threshold,shapes", [(0.75, 200), (0.85, 200), (0.9, 200), (0.9, 0), (0.95, 200), (0.95, 0)])
def test_what_is_left_of_words_finds_all_pairs(spark, monkeypatch, threshold, shapes):
    monkeypatch.setattr(fuzzy, "MAX_SHAPES", shapes)
    keys = worded_keys(random.Random(17))
    found = fuzzy.fuzzy_pairs(table(spark, keys), ["name"], threshold, "token_set_ratio").collect()
    pairs = [(a, b) for a in keys for b in keys if a < b]
    scores = similarity.score_pairs("token_set_ratio", *map(list, zip(*pairs)))
    assert sorted((r.key_a, r.key_b) for r in found) == [p for p, s in zip(pairs, scores) if s >= 100 * threshold - 1e-9]


@pytest.mark.parametrize("threshold", [0.95, 1.0])
def test_candidates_of_numbered_names_with_words_follow_the_pairs(spark, threshold):
    rows = spark.range(6000).selectExpr(
        "id AS rank", "concat(if(id % 3 = 0, 'AUTOMOBILE', if(id % 3 = 1, 'BUILDING', 'FURNITURE')), ' Customer#', lpad(id, 9, '0')) AS key", "'' AS block")
    rows = rows.union(spark.createDataFrame([(6000, "src1", ""), (6001, "en src1", "")], rows.schema))
    matcher = fuzzy.Matcher(rows, "token_set_ratio", threshold)
    found = fuzzy.fuzzy_pairs(rows.select(F.col("key").alias("name")), ["name"], threshold, "token_set_ratio").count()
    candidates = fuzzy._pair_up(*matcher.within()[0], 0).distinct().count()
    assert 0 < found <= candidates < 3 * found
