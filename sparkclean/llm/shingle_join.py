"""Jaccard join on word shingles by prefixes: single rare tokens, pairs of frequent ones, then verification.

Tokens are hashed shingles in one global order, the rarer class first. Two sets that reach the threshold share at least
k tokens in prefixes extended for k. If one of the shared tokens is rare, both sets stand under it; if all are frequent,
both stand under a combination of two frequent tokens. So every link has a candidate, and verification is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import byte_slices, drop_written, label_components, mapped, utf8_views, written
from sparkclean.llm.shingles import distinct_by_text, mix, shingle_sets

#: A token that stands in more prefixes is frequent; a rarer one makes at most FREQUENT / 2 pairs a row.
FREQUENT = 32
#: Tokens of a set for each group of its frequent ones: more groups make fewer combinations and longer prefixes.
GROUP = 32
#: Near sets share most of their combinations, so only combinations of at most so many sets make pairs; sets under a larger
#: one are compared with one of them first, then in chunks what that hasn't connected.
PAIRED = 4
#: Bytes of text that are cut into shingles at a time; arrays take some fifty times as much.
SLICE = 1 << 20
#: Buckets of the frequency sketch and its parts. It sets the order of tokens, so it can't change the result.
SKETCH_BITS, SKETCH_PARTS = 24, 64
#: Sets of a chunk when all sets under one combination are compared, two chunks a task.
CHUNK = 512
#: Links are verified under hashes of another seed than those that found the candidates.
VERIFY_SEED = 1
#: Bits of the filter that keeps texts of no candidate from being moved.
FILTER_BITS = 20


@dataclass(frozen=True)
class Threshold:
    """Sets link when `parts` * intersection >= `least` * union."""

    least: int
    parts: int = 100

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """Fewest tokens that a set of n tokens shares with a set that it links to."""
        return -(-n * self.least // self.parts)

    def both(self, sizes: str) -> str:
        """SQL of the fewest shared tokens of two linked sets of `sizes` tokens in all."""
        return f"({self.least} * {sizes} + {self.parts + self.least - 1}) div {self.parts + self.least}"

    def behind(self, n: str) -> str:
        """SQL of the number of tokens behind the longest extended prefix of a set of n tokens."""
        return f"greatest(({self.least} * {n} + {self.parts - 1}) div {self.parts} - 1 - shiftleft(1, length(bin({n} div {GROUP})) - 1), 0)"

    def alone(self, n: np.ndarray) -> np.ndarray:
        """Whether a set of n tokens is too small to link to another one."""
        return n * self.parts < self.least * (n + 1)


def levels(n: np.ndarray) -> np.ndarray:
    """Size class: frequent tokens of sets of GROUP * 2^level tokens are dealt into 2^level groups."""
    return np.maximum(np.frexp(n // GROUP)[1] - 1, 0)


def _packed(counts: np.ndarray) -> bytes:
    """Counts below 255 as a byte each, then the places and numbers of the larger ones; compressed."""
    large = np.flatnonzero(counts >= 255)
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + np.concatenate([large, counts[large]]).astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    counts = np.frombuffer(raw, np.uint8, size).astype(np.uint32)
    at, n = np.frombuffer(raw, "<u4", offset=size).reshape(2, -1)
    counts[at] = n
    return counts


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per document its number of shingles n and the 128-bit key of its set; then rows of the frequency sketch."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n", "node", "check", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(1 << SKETCH_BITS, np.uint16), None
        for batch in byte_slices(batches, text_col, SLICE):
            hashed, sizes = shingle_sets(*utf8_views(batch, text_col), width)
            bucket, more = np.unique((hashed >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
            counts[bucket] = np.minimum(counts[bucket] + more, np.iinfo(np.uint16).max)
            keys = _keys(hashed, sizes)
            nothing, rows, id_type = pa.nulls(len(sizes)), len(sizes), batch.column(0).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 nothing.cast(pa.int32()), nothing.cast(pa.binary())], names)
        if id_type is not None:
            blobs = [_packed(x) for x in np.split(counts, SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_PARTS, id_type), *[pa.nulls(SKETCH_PARTS, pa.int64())] * 3, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(blobs, pa.binary())], names)

    schema = f"id {kind}, n long, node long, check long, part int, counts binary"
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)), run, schema)


def _keys(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends, raw = np.cumsum(sizes).tolist(), hashed.tobytes()
    digests = b"".join(blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip([0, *ends], ends))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _classes(sets: DataFrame) -> np.ndarray:
    """Logarithm of the number of shingles in each bucket of the sketch: 16 MB, whatever the input."""
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(part, np.zeros(size, np.uint32))
                more = _unpacked(blob, size)
                own += np.minimum(more, ~own)  # counts stop at the largest number
        for part, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(own)], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    merged = mapped(sets.where("part is not null").select("part", "counts"), merge, schema)
    out = np.zeros((SKETCH_PARTS, size), np.uint8)
    for row in mapped(merged.repartition(SKETCH_PARTS, "part"), merge, schema).collect():  # SKETCH_PARTS rows
        out[row["part"]] = np.log2(np.maximum(_unpacked(row["counts"], size), 1))
    return out.ravel()


def _prefixes(docs: DataFrame, text_col: str, width: int, limit: Threshold, classes: np.ndarray) -> DataFrame:
    """Per distinct set that can link: node, n, and the tokens of its longest extended prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in byte_slices(batches, text_col, SLICE):
            hashed, sizes = shingle_sets(*utf8_views(batch, text_col), width)
            keys = _keys(hashed, sizes)
            tokens = (order[(hashed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(hashed) >> np.uint64(6))
            tokens, sizes = distinct_by_text(tokens, sizes)
            able = np.flatnonzero(~limit.alone(sizes) & (sizes > 0))
            ends = np.cumsum(sizes)
            length = np.minimum(sizes, sizes - limit.overlap(sizes) + 1 + (1 << levels(sizes)))
            starts = (ends - sizes)[able].tolist()
            lists = [tokens[a : a + n].astype(np.int64) for a, n in zip(starts, length[able].tolist())]
            offsets = np.concatenate([[0], np.cumsum(length[able])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[able, 0]), pa.array(keys[able, 1]), pa.array(sizes[able], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                ["node", "check", "n", "tokens"])

    rows = mapped(docs.select(text_col), run, "node long, check long, n long, tokens array<long>")
    return rows.groupBy("node", "check").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")).drop("check")


def _pairs_under(postings: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs of sets under the same token, of sizes that can link. Only for tokens of few sets."""
    a, b = postings.alias("a"), postings.alias("b")
    fit = f"a.token = b.token and a.node < b.node and {limit.parts} * least(a.n, b.n) >= {limit.least} * greatest(a.n, b.n)"
    return a.join(b, F.expr(fit)).selectExpr("a.node as a", "b.node as b", "a.n as na", "b.n as nb")


def _possible(rare: DataFrame, further: DataFrame, frequent: DataFrame, limit: Threshold) -> DataFrame:
    """Those of all candidate pairs that share so many prefix tokens that their sets can reach the threshold.

    `rare` has a row for each rare token that a pair shares. Of frequent tokens, a pair shares at most as many as either
    set has. Tokens behind the prefix that ends first can all be shared, others not.
    """
    counted = rare.withColumn("c", F.lit(1)).union(further.withColumn("c", F.lit(0))).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    tokens = frequent.groupBy("node").agg(F.count("*").alias("f"))
    known = counted.join(tokens.withColumnsRenamed({"node": "a", "f": "fa"}), "a", "left").join(tokens.withColumnsRenamed({"node": "b", "f": "fb"}), "b", "left")
    most = f"c + if(fa is null or fb is null, 0, least(fa, fb)) + greatest({limit.behind('na')}, {limit.behind('nb')})"
    return known.where(f"{most} >= {limit.both('(na + nb)')}").select("a", "b")


def _combinations(frequent: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs of frequent tokens of the same group, hashed to one token, for the levels of all sets it can link to.

    At a level of g groups, two linked sets share g + 1 prefix tokens, so two of those are of the same group.
    """
    lists = frequent.groupBy("node", "n").agg(F.collect_list(F.struct("pos", "token")).alias("x"))  # within one set's prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for node, n, items in zip(nodes, ns, batch.column(2).to_pylist()):
                pos = np.array([x["pos"] for x in items])
                token = np.array([x["token"] for x in items], np.int64).view(np.uint64)
                found = []
                for level in {int(levels(np.array(m))) for m in (n, int(limit.overlap(np.array(n))))}:
                    inside = np.sort(token[pos < n - limit.overlap(n) + 1 + (1 << level)])
                    group = (mix(inside) % np.uint64(1 << level)).astype(np.int64)
                    for g in range(1 << level):
                        own = inside[group == g]
                        i, j = np.triu_indices(len(own), 1)
                        found.append(mix(own[i] * np.uint64(3) + mix(own[j] + np.uint64(level))))
                found = np.unique(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), node)), pa.array(np.full(len(found), n))], ["token", "node", "n"])

    return mapped(lists.select("node", "n", "x"), run, "token long, node long, n long")


def _counted(postings: DataFrame, label: str, least: bool) -> DataFrame:
    """Postings under tokens of two sets or more, with the number c of those sets and, if asked for, the smallest, lo.

    `postings` is read twice: counts are formed before the shuffle, so a token that very many sets share is one row a task,
    and in the join that brings them back Spark splits the partition of such a token.
    """
    lowest = [F.min(F.struct("node", "n")).alias("least")] if least else []
    counts = postings.groupBy("token").agg(F.count("*").alias("c"), *lowest).where("c > 1")
    lo = [F.col("least.node").alias("lo"), F.col("least.n").alias("lo_n")] if least else []
    return written(postings.join(counts, "token").select("token", *[x for x in postings.columns if x != "token"], "c", *lo), label)


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Node and text of the given sets. Documents outside a filter of fixed size stay where they are."""
    wanted = sets.where("part is null").groupBy("node").agg(F.min("id").alias("id")).join(nodes, "node")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)).cast("int")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r[0] for r in wanted.select(bit("id").alias("bit")).distinct().collect()]] = True  # at most 2^FILTER_BITS numbers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        for batch in byte_slices(batches, text_col, SLICE):
            batch = batch.filter(pa.array(keep[batch.column("bit").to_numpy()]))
            if batch.num_rows:
                keys = _keys(*shingle_sets(*utf8_views(batch, text_col), width))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), batch.column(text_col)], ["node", "text"])

    found = mapped(docs.select(bit(F.col(id_col)).alias("bit"), text_col), run, "node long, text string")
    return written(found.join(nodes, "node").groupBy("node").agg(F.min("text").alias("text")), "shingle-texts")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """Those of the pairs a, b whose sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text_a", SLICE):
            (x, nx), (y, ny) = (shingle_sets(*utf8_views(batch, c), width, VERIFY_SEED) for c in ("text_a", "text_b"))
            rows = np.arange(len(nx))
            tokens, owner = np.concatenate([x, y]), np.concatenate([np.repeat(rows, nx), np.repeat(rows, ny)])
            order = np.lexsort((tokens, owner))
            tokens, owner = tokens[order], owner[order]
            same = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
            both = np.bincount(owner[1:][same], minlength=len(nx))
            yield batch.filter(pa.array(limit.parts * both >= limit.least * (nx + ny - both))).select(["a", "b"])

    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return mapped(rows.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def linked_within(tokens: np.ndarray, sizes: np.ndarray, limit: Threshold, columns: int = 4096) -> np.ndarray:
    """Matrix of which sets link. Tokens of one set only are left out; the others are counted `columns` at a time."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    number, counts = np.unique(tokens, return_inverse=True, return_counts=True)[1:]
    number = number.ravel()
    often = counts > 1
    rank = np.cumsum(often) - 1
    keep = often[number]
    owner, number = owner[keep], rank[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    for first in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(number, [first, first + columns])
        part = np.zeros((len(sizes), columns), np.float32)
        part[owner[a:b], number[a:b] - first] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return limit.parts * both >= limit.least * (sizes[:, None] + sizes[None, :] - both)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects, at most one fewer than rows."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(linked[i] & left)
            left[near] = False
            out += [(i, int(j)) for j in near]
            todo += near.tolist()
    return out


def _dense_links(postings: DataFrame, known: DataFrame, texts: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """Links among sets under the same combination of more than PAIRED sets, where `known` links leave several parts.

    Sets that such combinations connect make a family, cut into chunks; a large part that is already connected has
    chunks of its own, and two chunks of the same part are not compared. Every other two chunks meet in one task.
    """
    comp = label_components(known)
    rows = postings.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_tokens = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    rows = written(rows.join(open_tokens, "token").select("node", "lo", "component"), "shingle-open")
    family = label_components(rows.select(F.col("node").alias("a"), F.col("lo").alias("b")).union(rows.select("node", F.col("component"))))
    members = rows.select("node", "component").distinct().join(family.withColumnRenamed("component", "family"), "node")
    members = written(members, "shingle-family")
    parts = members.groupBy("family", "component").count()
    parts = parts.select("family", "component", F.when(F.col("count") >= CHUNK, F.ceil(F.col("count") / CHUNK)).alias("own"), "count")
    rest = parts.where("own is null").groupBy("family").agg(F.ceil(F.sum("count") / CHUNK).alias("rest"))
    dealt = members.join(parts, ["family", "component"]).join(rest, "family", "left").select(
        "family", "node", F.when(F.col("own").isNotNull(), F.col("component")).alias("part"),
        F.pmod(F.xxhash64("node"), F.coalesce("own", "rest")).alias("slot"))
    dealt = written(dealt.withColumn("chunk", F.xxhash64("family", F.coalesce("part", "family"), F.col("part").isNull(), "slot")), "shingle-chunks")
    chunks = dealt.select("family", "part", "chunk").distinct()
    a, b = chunks.alias("a"), chunks.alias("b")
    cells = a.join(b, F.expr("a.family = b.family and a.chunk <= b.chunk and (a.part is null or b.part is null or a.part <> b.part)"))
    cells = cells.select(F.xxhash64("a.chunk", "b.chunk").alias("cell"), F.explode(F.array_distinct(F.array("a.chunk", "b.chunk"))).alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(nodes, texts):
            data = pa.RecordBatch.from_arrays([pa.concat_arrays(texts)], ["text"])
            tokens, sizes = shingle_sets(*utf8_views(data, "text"), width, VERIFY_SEED)
            ids = np.concatenate(nodes)
            found = np.array(spanning(linked_within(tokens, sizes, limit)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], ["a", "b"])

        cell, nodes, texts = None, [], []
        for batch in batches:  # sorted by cell
            cells = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if nodes and cells[x] != cell:
                    yield compared(nodes, texts)
                    nodes, texts = [], []
                cell = cells[x]
                nodes.append(batch.column(1).to_numpy()[x:y])
                texts.append(batch.column(2).slice(x, y - x))
        if nodes:
            yield compared(nodes, texts)

    rows = cells.join(dealt.select("chunk", "node"), "chunk").join(texts, "node").select("cell", "node", "text")
    return mapped(rows.repartition("cell").sortWithinPartitions("cell", "node"), run, "a long, b long")


def join_shingles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, least: int = 85, parts: int = 100) -> DataFrame:
    """Per document: `id_col`, n_shingles long, component_id (smallest id reachable by links, itself included).

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a set holds the distinct shingles of `width`
    words, or the whole sequence of fewer. Two documents link when parts * intersection >= least * union. Null, empty
    and wordless texts have empty sets and link with nothing. Every input row gives one row, repeated rows and ids too; a
    null id stays null, and a component of null ids alone has the component null. An empty table gives no rows. Other
    columns are not read. Sets and shingles are told apart by hashes of 64 bits and more.
    """
    limit = Threshold(least, parts)
    docs = df.select(F.col(id_col), F.col(text_col))
    sets = written(_sets(docs, id_col, text_col, width), "shingle-sets")
    prefix = written(_prefixes(docs, text_col, width, limit, _classes(sets)), "shingle-prefixes")
    postings = _counted(prefix.select("node", "n", F.posexplode("tokens").alias("pos", "token")), "shingle-postings", False)
    drop_written(prefix)
    rare, frequent = postings.where(f"c <= {FREQUENT}"), postings.where(f"c > {FREQUENT}")
    combinations = written(_combinations(frequent, limit), "shingle-combinations")
    combined = _counted(combinations, "shingle-combined", True)
    drop_written(combinations)
    dense = combined.where(f"c > {PAIRED}")
    stars = dense.where("node <> lo").selectExpr("lo as a", "node as b", "lo_n as na", "n as nb")
    further = _pairs_under(combined.where(f"c <= {PAIRED}"), limit).union(stars)
    pairs = written(_possible(_pairs_under(rare, limit), further, frequent, limit), "shingle-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(docs, sets, nodes, id_col, text_col, width)
    linked = written(_verified(pairs, texts, width, limit), "shingle-links")
    links = written(linked.union(_dense_links(dense, linked, texts, width, limit)), "shingle-links")
    drop_written(postings, combined, pairs, texts, linked)
    own = sets.where("part is null").select("id", "n", "node", "check")
    least_id = own.groupBy("node", "check").agg(F.min("id").alias("least_id"))
    comp = least_id.join(label_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = comp.where("least_id is not null").groupBy("component").agg(F.min("least_id").alias("component_id"))
    comp = comp.join(smallest, "component", "left").select("node", "check", "component_id")
    filled = own.where("n > 0").join(comp, ["node", "check"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = own.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return filled.union(empty)
