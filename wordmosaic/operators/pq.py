"""Product quantisation: codebook, codes, k-means in code space, bags from codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmosaic.operators.centers import as_lists, matrix, nearest
from wordmosaic.operators.runs import whole_runs
from wordmosaic.session import written

#: Sub-vectors and codes per sub-vector by default.
SUBSPACES, CODES = 8, 256
#: Vectors the codebook is trained on by default (a bounded sample).
TRAIN_SIZE = 100_000
#: Largest vocabulary of code centres that is broadcast.
MAX_BROADCAST_CODES = 4_000_000


def training_sample(points: DataFrame, n: int = TRAIN_SIZE, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by a hash of the id: the same in any engine and partitioning.

    Counts by the first hexadecimal digits of the hash tell below which of them all rows are in, so
    that only the rows of one such prefix are sorted, not the sample.
    """
    key = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))
    keyed = points.withColumn("_k", key)
    head = F.substring("_k", 1, 4)
    counts = keyed.groupBy(head.alias("h")).count().orderBy("h").collect()  # 65,536 rows at most
    whole, edge, left = "", None, n
    for h, c in counts:
        if c > left:
            edge = h
            break
        whole, left = h, left - c
    if edge is None:
        return points
    last = keyed.filter(head == edge).orderBy("_k", "id").limit(left)
    return keyed.filter(head <= whole).unionAll(last).drop("_k")


def _train(ks: int, iters: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = matrix(table.column("sub"))
        c = x[:ks].copy()
        for _ in range(iters):
            at, _ = nearest(x, c, np.arange(len(c)))
            n = np.bincount(at, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, at, x)
            used = n > 0
            c[used] = np.floor(total[used] / n[used, None])
        m = table.column("m")[0].as_py()
        return pa.table([pa.array(np.full(len(c), m, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), as_lists(c, pa.float64())], names=["m", "code", "subvector"])

    return run


def train_codebook(sample: DataFrame, subspaces: int = SUBSPACES, ks: int = CODES, iters: int = 10) -> DataFrame:
    """``(m, code, subvector)``: one k-means per sub-space, whole-number centres, started from the smallest ids.

    ``sample (id, v)`` is bounded by its size, so each of the ``subspaces`` groups fits a task.
    """
    width = F.size("v") / subspaces
    parts = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda m: F.slice("v", (m * width + 1).cast("int"), width.cast("int")))
    rows = sample.select("id", F.posexplode(parts).alias("m", "sub"))
    return rows.groupBy("m").applyInArrow(_train(ks, iters), "m int, code int, subvector array<double>")


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """The codebook as (subspaces, codes, width); its size is that of the model, not of the data."""
    table = codebook.orderBy("m", "code").toArrow()
    m = table.column("m").to_numpy()
    return matrix(table.column("subvector")).reshape(len(np.unique(m)), -1, len(table.column("subvector")[0]))


def _encode_pass(book: np.ndarray):
    subspaces, ks, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            codes = np.stack([nearest(x[:, m * width : (m + 1) * width], book[m], np.arange(ks))[0] for m in range(subspaces)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(codes.astype(np.int32), pa.int32())], names=["id", "pq"])

    return run


def encode(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(id, pq)``: the nearest code of each sub-vector (ties: smallest code); a narrow pass."""
    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v").mapInArrow(_encode_pass(codebook_array(codebook)), f"id {kind}, pq array<int>")


def distance_tables(book: np.ndarray) -> np.ndarray:
    """Squared distances between the codes of each sub-space: (subspaces, codes, codes)."""
    return ((book[:, :, None] - book[:, None]) ** 2).sum(axis=3)


def distance_table_rows(codebook: DataFrame) -> DataFrame:
    """``(m, code_a, code_b, d2)`` as rows."""
    a = codebook.select("m", F.col("code").alias("code_a"), F.col("subvector").alias("u"))
    b = codebook.select("m", F.col("code").alias("code_b"), F.col("subvector").alias("w"))
    d2 = F.aggregate(F.zip_with("u", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "m").select("m", "code_a", "code_b", d2.alias("d2"))


def _decode(book: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([book[m][codes[:, m]] for m in range(len(book))], axis=1)


def _predict_pass(book: np.ndarray, vocab: np.ndarray, words: np.ndarray):
    centres = _decode(book, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, d2 = nearest(_decode(book, matrix(batch.column(1), np.int64)), centres, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(who.astype(np.int32)), pa.array(d2)], names=["id", "pq", "word", "d2"])

    return run


def _predicted(codes: DataFrame, vocab: DataFrame, codebook: DataFrame) -> DataFrame:
    if vocab.count() > MAX_BROADCAST_CODES:
        raise ValueError("the vocabulary is too large to broadcast; decode it and use nearest_center, which joins blocks")
    table = vocab.orderBy("word").toArrow()
    kind = codes.schema["id"].dataType.simpleString()
    fn = _predict_pass(codebook_array(codebook), matrix(table.column("pq"), np.int64), table.column("word").to_numpy())
    return codes.select("id", "pq").mapInArrow(fn, f"id {kind}, pq array<int>, word int, d2 double")


def predict(codes: DataFrame, vocab: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(id, word, d2)``: the nearest code centre of ``vocab (word, pq)`` (ties: smallest word).

    The sum of the sub-space table entries of two codes is the squared distance of the decoded
    vectors, so one matrix product over a block of vectors and the vocabulary gives all of them.
    """
    return _predicted(codes, vocab, codebook).select("id", "word", "d2")


def _update_pass(tables: np.ndarray):
    """Per word and sub-space the code of least total distance: one product of its histogram with the distance table."""
    subspaces, ks, _ = tables.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["word"]):
            word = table.column("word").to_numpy()
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            row = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(word)]))
            m, code, n = (table.column(c).to_numpy() for c in ("m", "code_b", "n"))
            new = np.zeros((len(start), subspaces), np.int32)
            for k in range(subspaces):
                own = m == k
                hist = np.zeros((len(start), ks))
                hist[row[own], code[own]] = n[own]
                new[:, k] = (hist @ tables[k]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(word[start]), as_lists(new, pa.int32())], names=["word", "new"])

    return run


def code_kmeans_step(codes: DataFrame, vocab: DataFrame, codebook: DataFrame) -> DataFrame:
    """New ``vocab (word, pq)``: per centre and sub-space the code of least total distance to its members' codes.

    The update needs only how often each code occurs per centre and sub-space, a histogram
    that is combined on the map side. Ties go to the smallest code; an empty centre stays.
    """
    hist = _predicted(codes, vocab, codebook).select("word", F.posexplode("pq").alias("m", "code_b")).groupBy("word", "m", "code_b").agg(F.count(F.lit(1)).alias("n"))
    best = hist.repartition("word").sortWithinPartitions("word").mapInArrow(_update_pass(distance_tables(codebook_array(codebook))), "word int, new array<int>")
    return vocab.join(best, "word", "left").select("word", F.coalesce("new", "pq").alias("pq"))


def first_code_centers(codes: DataFrame, k: int) -> DataFrame:
    """The codes of the ``k`` smallest ids as the first vocabulary."""
    first = codes.orderBy("id").limit(k).withColumn("word", F.row_number().over(Window.orderBy("id")) - 1)
    return written(first.select(F.col("word").cast("int").alias("word"), "pq"), "vocab")


def code_kmeans(codes: DataFrame, k: int, codebook: DataFrame, iters: int = 5, vocab: DataFrame | None = None) -> DataFrame:
    """``(word, pq)``: a vocabulary of ``k`` code centres after ``iters`` rounds, each written to the shared folder."""
    vocab = first_code_centers(codes, k) if vocab is None else vocab
    for _ in range(iters):
        vocab = written(code_kmeans_step(codes, vocab, codebook), "vocab")
    return vocab


def decoded(vocab: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(cid, center)``: the code centres as vectors."""
    rows = vocab.select("word", F.posexplode("pq").alias("m", "code")).join(codebook, ["m", "code"])
    return rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("m", "subvector"))).alias("p")).select(F.col("word").alias("cid"), F.flatten("p.subvector").alias("center"))


def bags_from_codes(codes: DataFrame, owners: DataFrame, vocab: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(image_name, words)``: the distinct nearest words of each image's vectors, ascending.

    The words of an image are made distinct before they are collected.
    """
    words = predict(codes, vocab, codebook).join(owners.select("id", "image_name"), "id").select("image_name", "word").distinct()
    return words.groupBy("image_name").agg(F.array_sort(F.collect_list("word")).alias("words"))


