"""The stages one after the other against plain versions of what they decide."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sparkclean.llm import quality
from sparkclean.llm.queries import QUERIES
from test_secrets import plain
from test_texts import families, plain_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(4), str(tmp_path_factory.mktemp("tables"))
    texts = families(7, 6, 4, 60) + ["a token = \"abcdef1234567890\" in words of its own", None, "", "x" * 300]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click###", "%%%win"]) for _ in range(60)) for _ in range(30)]
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts + bad)]
    rows += [rows[3], (5, "another text under an id that is taken by a first one", None, None, None), (None, texts[0], "en", "src", 1), (None, "a text without id " * 5, None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < len(texts)), 0) for k in range(len(rows) - 4) if k not in (len(texts) - 2, len(texts) - 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    good = corpus_pipeline.keep_good(spark, docs, tables)
    scored = quality.score_quality(docs, model, score_col="s").collect()
    kept = [tuple(r)[:5] for r in scored if r.s >= 0.5]
    assert good.columns == docs.columns and sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, kept)) and 0 < len(kept) < len(scored)

    one = corpus_pipeline.keep_one_of_copies(spark, docs, tables)
    rows = [tuple(r) for r in docs.collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    component = {k: c for k, _, c in plain_components([(n, rows[k][1]) for n, k in enumerate(order)], 5, 80)}
    want = [rows[k] for n, k in enumerate(order) if component[n] == n]
    got = [tuple(r) for r in one.collect()]
    assert one.columns == docs.columns
    assert len(got) == len(want) and sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in want)

    clean = corpus_pipeline.mask_secrets(spark, docs, tables)
    assert clean.count() == docs.count() and clean.columns == docs.columns
    assert all(not plain(r.text or "") and (r.text is None or r.n_chars == len(r.text)) for r in clean.collect())


def test_rows_keep_their_numbers(spark, tables, tmp_path, monkeypatch):
    """The stored table is cut otherwise after the links are found, as when executors come and go."""
    spark.read.parquet(f"{tables}/documents.parquet").repartition(5, "text").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(str(tuple(r)) for r in corpus_pipeline.keep_one_of_copies(spark, docs, tables).collect())
    join = corpus_pipeline.shingle_join.join_shingles

    def join_then_cut(*args, **named):
        groups = corpus_pipeline.written(join(*args, **named), "groups")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        return groups

    monkeypatch.setattr(corpus_pipeline.shingle_join, "join_shingles", join_then_cut)
    try:
        got = sorted(str(tuple(r)) for r in corpus_pipeline.keep_one_of_copies(spark, docs, tables).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_run(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, tables).collect()
    texts = {library.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist(), skip_special_tokens=False) for r in rows}
    assert any("[SECRET]" in t for t in texts) and not any("$$$" in t for t in texts)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "packing"]


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
