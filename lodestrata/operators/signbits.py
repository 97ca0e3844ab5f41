"""Nearest vectors by sign bits first: Hamming distance of packed bits in the scan, exact cosine of what is left."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as rel
from .retrieval import SCORES, Best, cosine, in_blocks, small

#: Candidates for each wanted neighbour.
OVERSAMPLE = 16


def packed(vector: Column) -> Column:
    """Signs of an array's components as bits, 64 to a word; the first component is the highest bit."""
    signs = F.transform(vector, lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    word = lambda i: F.aggregate(F.slice(signs, i * 64 + 1, 64), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(vector) / 64).cast("int") - 1), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def knn(vectors: DataFrame, queries: DataFrame, id_col: str, query_id: str, vector: str, query_vector: str, k: int, oversample: int = OVERSAMPLE) -> DataFrame:
    """(query_id, id, score, rank): the k greatest cosines among the k * oversample nearest by sign bits.

    Queries are a stated set and come in blocks, each broadcast with its bits. A task goes over its rows in slices and
    holds no more than a slice's distances and the nearest candidates of each query; only candidates are shuffled and
    joined with their vectors. Null and empty vectors are near nothing, nor are those of another number of
    words of bits than most queries'. Ties go to the smaller id.
    """
    rows = vectors.where(F.size(vector) > 0).select(id_col, packed(F.col(vector)).alias("_bits"))
    asked = queries.where(F.size(query_vector) > 0).select(query_id, F.col(query_vector).alias("_q"), packed(F.col(query_vector)).alias("_qbits"))

    kinds = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{id_col}` {vectors.schema[id_col].dataType.simpleString()}, score double"

    def search(block: DataFrame) -> DataFrame:
        got = block.select(query_id, "_qbits").toPandas()
        words = int(got["_qbits"].map(len).mode().min()) if len(got) else 0
        got = got[got["_qbits"].map(len) == words]
        shared = block.sparkSession.sparkContext.broadcast((got[query_id].to_numpy(), np.array(got["_qbits"].tolist(), np.int64).reshape(len(got), words)))

        def nearest(batches):
            names, ask = shared.value
            best, step = Best(k * oversample), max(1, SCORES // max(1, len(names)))
            for whole in batches:
                whole = whole.filter(pc.equal(pc.list_value_length(whole.column(1)), words))
                for i in range(0, whole.num_rows if len(names) else 0, step):
                    part = whole.slice(i, step)
                    bits = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, words)
                    far = np.zeros((len(names), part.num_rows))
                    for w in range(words):
                        far += np.bitwise_count((ask[:, w, None] ^ bits[None, :, w]).view(np.uint64))
                    best.add(-far, part.column(0).to_numpy(zero_copy_only=False))
            yield from best.batch(names, query_id, id_col)

        near = rows.mapInArrow(nearest, kinds).withColumn("_far", -F.col("score"))
        near = rel.top_per_key(near, [query_id], ["_far", id_col], k * oversample, "_r").select(query_id, id_col)
        exact = vectors.select(id_col, vector).join(small(near), id_col).join(F.broadcast(block.select(query_id, "_q")), query_id)
        score = F.round(cosine(F.col(vector), F.col("_q")), 6)
        return rel.top_per_key(exact.select(query_id, id_col, score.alias("score")), [query_id], [F.desc("score"), id_col], k, "rank")

    return in_blocks(asked, query_id, search)
