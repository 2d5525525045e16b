"""Periodic runs against brute force, and the query against a plain version of its contract."""

import hashlib
import random
import time
from zlib import crc32

from sparkclean.llm import queries, word_runs
from sparkclean.llm.word_runs import Squares, find_runs, kept_words, maximal_runs, runs_of


def plain_runs(words, least):
    """All maximal stretches of each period, without those that a smaller period has."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.add((i, j - i + q, q))
            i = max(j, i + 1)
    smallest = [(s, n, q) for s, n, q in found if not any(all(words[k] == words[k + p] for k in range(s, s + n - p)) for p in range(1, q))]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def random_words(rng):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 6]))).encode() for _ in range(rng.randrange(70))]
    if len(words) > 8 and rng.random() < 0.5:
        a, p = rng.randrange(len(words) // 2), rng.randint(1, 9)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        batch = [random_words(rng) for _ in range(3)]
        for least in (2, 5, 12):
            assert runs_of(batch, least) == [plain_runs(w, least) for w in batch], batch


def test_squares_of_a_fibonacci_word_and_of_one_word():
    a, b = [1], [1, 2]
    while len(b) < 600:
        a, b = b, b + a
    assert sorted(maximal_runs(b)) == sorted(plain_runs(b, 2))
    assert maximal_runs([1] * 500) == [(0, 500, 1)] and maximal_runs([]) == [] and maximal_runs([3]) == []
    squares = Squares(4)
    assert [squares.append(w) for w in (1, 2, 1, 2)] == [[], [], [], [2]]


def test_long_texts_take_time_in_proportion():
    """200,000 words with a period, without one, and all alike."""
    rng = random.Random(2)
    base = [b"%d" % rng.randrange(300) for _ in range(100_000)]
    began = time.time()
    (found,) = runs_of([base + base], 12)
    assert (0, 200_000, 100_000) in found
    assert runs_of([[b"%d" % k for k in range(200_000)]], 12) == [[]]
    assert runs_of([[b"a"] * 200_000], 12) == [[(0, 200_000, 1)]]
    assert time.time() - began < 60


def digests(key, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (key, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_its_contract(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(150))), "x") for k in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n\t ", "x"), (None, "a " * 30, "x"), (1003, "\x1fa b\x0bc d " * 9, "x"), rows[3], rows[3]]
    rows += [(k, "one", "x") for k in range(2000, 2040)] + [(k, " lead two\n", "x") for k in range(2040, 2080)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_find_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((digests(k, t) for k, t, _ in rows), key=str)
    assert sum(r.n_runs for r in found) > 8


def test_operator_on_odd_rows(spark, odd_documents):
    found = find_runs(odd_documents.withColumnRenamed("spans", "runs")).collect()
    assert len(found) == odd_documents.count()
    texts = {r.doc_id: r.text for r in odd_documents.collect() if r.doc_id is not None}
    for r in found:
        if r.doc_id is None:
            continue
        words = (texts[r.doc_id] or "").encode().split()
        assert r.n_words == len(words) and r.collapsed.encode() == b" ".join(kept_words(words, [tuple(x) for x in r.runs]))
    assert find_runs(odd_documents.limit(0)).count() == 0
    assert word_runs.find_runs(spark.createDataFrame([(1, "a b " * 6)], "doc_id long, text string")).first().collapsed == "a b"
