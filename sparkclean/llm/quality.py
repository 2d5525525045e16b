"""Quality classifier: compressed sizes under dictionaries of good and of bad text, turned into a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import byte_slices, mapped

#: Texts are compressed in blocks of so many bytes, so a dictionary counts as much in a long text as in a short one.
BLOCK, LEVEL, DICTIONARY = 1024, 3, 112_640
#: Bounds of the training sample: labelled rows, and blocks of a row, spread evenly over its text.
SAMPLE_ROWS, SAMPLE_BLOCKS = 6000, 8
#: Bytes that both sizes are shrunk by, so that very short texts get scores near the average.
SHRINK = 64

#: Fixed value: the first bytes of a trained dictionary.
TRAINED = b"\x37\xa4\x30\xec"


class Sizes:
    """Compressed sizes of texts under two dictionaries, without what each frame costs."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT
            table = zstandard.ZstdCompressionDict(data, dict_type=kind)
            table.precompute_compress(level=LEVEL)
            packer = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.pair.append((packer.compress, len(packer.compress(b""))))

    def inputs(self, text: bytes) -> tuple[float, float]:
        """Difference and smaller of the two sizes, each by the length of the text."""
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        good, bad = (sum(map(len, map(pack, blocks))) - frame * len(blocks) for pack, frame in self.pair)
        return (bad - good) / (len(text) + SHRINK), (min(good, bad) + SHRINK / 2) / (len(text) + SHRINK)


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration of what they give. Without dictionaries the score is always `base`."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    base: float

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        at = self.weights[0] + inputs @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples to train from, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def calibrated(inputs: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Weights of a logistic regression by Newton's method, with standardised inputs while it is fitted."""
    mean, scale = inputs.mean(0), inputs.std(0) + 1e-9
    x = np.column_stack([np.ones(len(inputs)), (inputs - mean) / scale])
    penalty, w = ridge * len(x) * np.array([0.0, 1, 1]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + penalty * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), slope)
    weights = w[1:] / scale
    return float(w[0] - weights @ mean), float(weights[0]), float(weights[1])


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most `sample_rows` labelled rows, those with the smallest hash of their id, then of their text.

    `use` is a condition on `id_col` that labelled rows must meet. From each text at most SAMPLE_BLOCKS blocks are taken,
    spread evenly. Two thirds of the rows make the dictionaries, the others the calibration. Rows with a null id, text or
    label are left out; labels other than 0 and 1 too. With labels of one kind only, the model is their smoothed share.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col(id_col).isNotNull())
    known = (known if use is None else known.where(use)).orderBy(F.xxhash64(id_col), id_col, "_label").limit(sample_rows)
    block, n = BLOCK // 2, F.length(text_col)  # characters; most have one or two bytes
    count = F.greatest(F.lit(1), F.least(F.lit(SAMPLE_BLOCKS), F.ceil(n / block))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(
        F.col(text_col), (F.floor((n - block) * k / F.greatest(count - 1, F.lit(1))) + 1).cast("int"), F.lit(block)))
    parts = F.when(n <= block * SAMPLE_BLOCKS, F.array(F.col(text_col))).otherwise(blocks)
    rows = (
        docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(known), id_col)
        .select(F.xxhash64(id_col).alias("_h"), F.xxhash64(text_col).alias("_t"), "_label", parts.alias("_parts"))
        .orderBy("_h", "_t", "_label").limit(sample_rows).collect())
    texts, marks = [[p.encode() for p in r["_parts"]] for r in rows], np.array([r["_label"] for r in rows])
    fit = np.arange(len(rows)) % 3 < 2
    base = (marks.sum() + 1) / (len(marks) + 2)
    if any(not (group == k).any() for group in (marks[fit], marks[~fit]) for k in (0, 1)):
        return QualityModel(b"", b"", (float(np.log(base / (1 - base))), 0.0, 0.0), float(base))
    samples = [[p[i : i + 2 * BLOCK] for r in np.flatnonzero(fit & (marks == k)) for p in texts[r] for i in range(0, len(p), 2 * BLOCK)] for k in (1, 0)]
    good, bad = map(dictionary, samples)
    sizes = Sizes(good, bad)
    inputs = np.array([sizes.inputs(b"".join(texts[r])) for r in np.flatnonzero(~fit)])
    return QualityModel(good, bad, calibrated(inputs, marks[~fit]), float(base))


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The table with `score_col` (double, 0 to 1; higher: good is likelier), from the whole of each text alone.

    All rows and columns stay; a column named `score_col` is replaced. Null counts as the empty text, and empty texts are
    scored, too.
    """
    names = [c for c in df.columns if c != score_col]
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 110 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sizes = Sizes(fitted.good, fitted.bad) if fitted.good and fitted.bad else None
        for batch in byte_slices(batches, text_col):
            texts = batch.column(text_col).cast(pa.large_binary()).to_pylist()
            inputs = np.array([sizes.inputs(x or b"") if sizes else (0.0, 0.0) for x in texts])
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fitted.scores(inputs), pa.float64())], [*names, score_col])

    fields = df.select(names).schema.add(score_col, "double")
    return mapped(df.select(names), run, fields)
