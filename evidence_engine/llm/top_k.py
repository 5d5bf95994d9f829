"""Exact top-k search by distributed histogram selection.

Vectors become blocks of whole numbers, candidates and queries alike. Every block of candidates meets
every block of queries, in one job a round: tasks score all pairs of a block pair at once and count scores
in bins, coarse at first; the bins' global sums tell for each query the bin that holds its k-th score.
The next round counts finer bins inside that bin only, until bins are single scores. A last round emits
what scores more, and of what scores as much the smallest vec_ids. What a block pair emits is bounded: of
its bins those from the top until they hold k candidates, of ties at most k, since no others can matter.

What is known of a query between rounds (the range that holds its k-th score, and how many are above) is a
row of a table. Nothing is collected, and rounds are few: bits of the largest score over BITS.

Defined results: vectors that are null or hold null or non-finite components take no part. Rows with
the query's own vec_id are its own; of a query's repeated rows the smallest vector asks. Repeated
candidate rows are ranked each. Only vectors of the query's own length are its candidates. Scores
beyond a long are cut to its range. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.common import written

BLOCK = "dim int, n int, ids binary, xs binary, most double"
BITS = 11


def blocks(vectors: DataFrame, scale: float = 256.0, rows: int = 4096) -> DataFrame:
    """vec_id and embedding as blocks: ids (int64) and floor(scale * x) (doubles, row by row), by length."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                part = part.filter(pc.and_(pc.is_valid(part.column(0)), pc.is_valid(part.column(1))))
                lists = part.column(1)
                ids, lengths = part.column(0).to_numpy(zero_copy_only=False).astype("<i8"), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                flat = pc.fill_null(pc.list_flatten(lists).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype("int64")
                out = []
                for dim in np.unique(lengths):
                    of = np.flatnonzero(lengths == dim)
                    xs = flat[(starts[of][:, None] + np.arange(dim)).astype("int64")].reshape(len(of), int(dim)) if dim else np.zeros((len(of), 0))
                    keep = np.isfinite(xs).all(axis=1)
                    with np.errstate(over="ignore"):
                        xs = np.clip(np.floor(xs[keep] * scale), -1e300, 1e300)
                    if keep.any():
                        out.append((int(dim), int(keep.sum()), ids[of][keep].tobytes(), xs.astype("<f8").tobytes(), float(np.abs(xs).max()) if xs.size else 0.0))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()))], ["dim", "n", "ids", "xs", "most"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(pack, BLOCK)


def scores(ids, xs, own, qs):
    """Integer inner products of candidates and queries, and which are no query's own; exact."""
    import numpy as np

    bound = (np.abs(xs).max() if xs.size else 0.0) * (np.abs(qs).max() if qs.size else 0.0) * max(1, xs.shape[1])
    if bound < 2**53:
        found = (xs @ qs.T).astype("int64")
    else:
        whole = np.vectorize(int, otypes=[object])
        exact = whole(xs).dot(whole(qs).T) if xs.size else np.zeros((len(xs), len(qs)), object)
        found = np.vectorize(lambda v: max(-(2**63) + 1, min(2**63 - 1, v)), otypes=["int64"])(exact)
    return found, ids[:, None] != own[None, :]


ASKED = "array<struct<query_id:long,x:array<double>,low:long,high:long>>"
MOST = 2**63 - 1


def per_pair(pairs: DataFrame, emit, schema: str) -> DataFrame:
    """emit(ids, scores, allowed, low, high, own) over pairs of blocks; yields columns named as in schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                n, dim, ids, xs = (batch.column(c)[k].as_py() for c in ("n", "dim", "ids", "xs"))
                asked = batch.column("asked")[k].values
                own, low, high = (asked.field(c).to_numpy() for c in ("query_id", "low", "high"))
                qs = pa.concat_arrays([asked.field("x").flatten()]).to_numpy().reshape(len(own), dim)
                ids = np.frombuffer(ids, "<i8")
                found, allowed = scores(ids, np.frombuffer(xs, "<f8").reshape(n, dim), own, qs)
                for columns in emit(ids, found, allowed, low, high, own):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return pairs.select("dim", "n", "ids", "xs", "asked").mapInArrow(run, schema)


def counted(k: int, shift: int):
    """Histograms: bins of 2**shift scores inside each query's range, from the top until they hold what is needed."""

    def emit(ids, found, allowed, low, high, own):
        import numpy as np

        inside = allowed & (found >= low[None, :]) & (found <= high[None, :])
        bins = np.where(inside, found >> shift, np.iinfo("int64").min)
        need = min(k, len(ids))
        least = np.partition(bins, len(ids) - need, axis=0)[len(ids) - need]
        row, col = np.nonzero(inside & (bins >= least[None, :]))
        pair = np.stack([col, bins[row, col]])
        if pair.size:
            kinds, n = np.unique(pair, axis=1, return_counts=True)
            yield own[kinds[0]], kinds[1].astype("int64"), n.astype("int64")

    return emit


def chosen(k: int):
    """Candidates above each query's k-th score, and of those with that score the k smallest vec_ids."""

    def emit(ids, found, allowed, low, high, own):
        import numpy as np

        row, col = np.nonzero(allowed & (found > low[None, :]))
        ties_row, ties_col = np.nonzero(allowed & (found == low[None, :]))
        order = np.lexsort((ids[ties_row], ties_col))
        ties_row, ties_col = ties_row[order], ties_col[order]
        nth = np.arange(len(ties_col)) - np.searchsorted(ties_col, ties_col)
        row, col = np.concatenate([row, ties_row[nth < k]]), np.concatenate([col, ties_col[nth < k]])
        if len(row):
            yield own[col], ids[row], found[row, col]

    return emit


def narrowed(bins: DataFrame, state: DataFrame, k: int, shift: int) -> DataFrame:
    """state with each query's range cut to the bin that holds its k-th score; with fewer than k candidates nothing is left to count."""
    falling = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.join(state.select("query_id", "above"), "query_id").withColumn("upto", F.col("above") + F.sum("n").over(falling)).where(F.col("upto") >= k)
    reached = upto.groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("r"))
    low = F.shiftleft(F.col("r.bin"), shift)
    rows = state.join(reached, "query_id", "left")
    return rows.select(
        "query_id",
        F.when(F.col("r").isNull(), F.col("low")).otherwise(F.greatest("low", low)).alias("low"),
        F.when(F.col("r").isNull(), F.col("low") - 1).otherwise(F.least("high", low + F.lit((1 << shift) - 1))).alias("high"),
        F.coalesce("r.above", "above").alias("above"),
    )


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, block_queries: int = 512) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each row for which is_query (a condition) holds."""
    candidates = written(blocks(vectors, scale), "vector-blocks")
    asking = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("x"))
    asking = asking.where(F.col("query_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    # as blocks() has them, and of repeated rows one
    whole = F.transform("x", lambda v: F.least(F.lit(1e300), F.greatest(F.lit(-1e300), F.when(F.abs(v) < 1e15, F.floor(v * F.lit(scale)).cast("double")).otherwise(v * F.lit(scale)))))
    asking = asking.groupBy("query_id").agg(F.min("x").alias("x")).select("query_id", F.size("x").alias("dim"), whole.alias("x"))
    asking = written(asking, "queries")
    n_blocks = max(1, -(-asking.count() // block_queries))
    most, dim = candidates.agg(F.max("most"), F.max("dim")).first()
    bound = (most or 0.0) * (most or 0.0) * max(1, dim or 0)
    edge = int(bound) + 1 if bound < 2**62 else MOST
    state = asking.select("query_id", F.lit(-edge).cast("long").alias("low"), F.lit(edge).cast("long").alias("high"), F.lit(0).cast("long").alias("above"))

    def pairs(state: DataFrame) -> DataFrame:
        """Every block of candidates with every block of the queries of its length."""
        row = F.struct("query_id", "x", "low", "high")
        asked = asking.join(state, "query_id").groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(row).cast(ASKED).alias("asked"))
        asked = written(asked.select(F.col("dim").alias("of"), "asked"), "query-blocks")
        # a join on the length would put all vectors of one length into one task
        return candidates.crossJoin(asked).where("dim <= of and dim >= of")

    shift = max(0, edge.bit_length() + 1 - BITS)
    while True:
        bins = per_pair(pairs(state), counted(k, shift), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        state = written(narrowed(bins, state, k, shift), "query-ranges")
        if shift == 0:
            break
        shift = max(0, shift - BITS)
    found = per_pair(pairs(state), chosen(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
