"""New users folded into a fitted factor model.

With the item vectors fixed, a user's vector is the solution of a ridge least-squares problem over the user's own ratings:
(sum v v^T + reg I) x = sum v (r - b). Both sums are grouped aggregates with map-side combine (k (k + 1) / 2 + k
numbers a user, however many ratings), and the k x k systems are solved in batches. Only arriving users are computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import resolve
from marquee.operators.factor import vsum
from marquee.operators.interactions import build_interactions
from marquee.operators.topk import ItemIndex
from marquee.session import checkpoint
from marquee.sources.bucketed import BucketedTable


#: Vectors up to this length are summed number by number in a hash aggregate over the users (k (k + 1) / 2 + k sums); longer ones
#: as whole buffers, which are sorted by user.
PLAIN_RANK = 8


class NothingMatched(ValueError):
    """No rating of the batch could be matched to the catalogue."""


def _triangle(v):
    """v v^T from the diagonal on, row by row."""
    return F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda b: a * b)))


def fold_in(ratings: DataFrame, item_vectors: DataFrame, reg: float = 0.1) -> DataFrame:
    """(user, factors, n_ratings) for each user of ``ratings`` (user, item, rating) with an item in
    ``item_vectors`` (item, factors[, bias]). Ratings of unknown items are left out; repeated pairs count each time."""
    bias = F.col("bias").cast("double") if "bias" in item_vectors.columns else F.lit(0.0)
    v = item_vectors.select(F.col("item").alias("_i"), F.col("factors").cast("array<double>").alias("v"), bias.alias("b"))
    j = ratings.where(F.col("rating").isNotNull()).join(v, F.col("item") == F.col("_i"))
    sizes = v.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] == sizes[1] and 0 < (sizes[0] or 0) <= PLAIN_RANK:
        k = sizes[0]
        null = F.raise_error(F.lit("null in a vector to be summed")).cast("double")
        cells = [F.col("v")[a] * F.col("v")[b] for a in range(k) for b in range(a, k)] + [F.col("v")[a] * (F.col("rating") - F.col("b")) for a in range(k)]
        plain = j.groupBy("user").agg(*[F.sum(F.coalesce(x, null)).alias(f"_s{n}") for n, x in enumerate(cells)], F.count(F.lit(1)).alias("n_ratings"))
        sums = plain.select("user", F.array(*[F.col(f"_s{n}") for n in range(len(cells))]).alias("s"), "n_ratings")
    else:
        sums = j.select("user", F.concat(_triangle(F.col("v")), F.transform("v", lambda x: x * (F.col("rating") - F.col("b")))).alias("s")) \
            .groupBy("user").agg(vsum(F.col("s")).alias("s"), F.count(F.lit(1)).alias("n_ratings"))

    def solve(batches):
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            s = np.stack(b.column(1).to_numpy(zero_copy_only=False))
            k = int((np.sqrt(9 + 8 * s.shape[1]) - 3) / 2 + 0.5)  # k (k + 1) / 2 + k numbers
            gram = np.zeros((len(s), k, k))
            upper = np.triu_indices(k)
            gram[:, upper[0], upper[1]] = s[:, :-k]
            gram[:, upper[1], upper[0]] = s[:, :-k]
            x = np.linalg.solve(gram + reg * np.eye(k), s[:, -k:, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)], names=["user", "factors", "n_ratings"])

    return sums.mapInArrow(solve, f"user {dict(sums.dtypes)['user']}, factors array<double>, n_ratings long")


def ingest_users(ratings: BucketedTable, factors: BucketedTable, item_vectors: DataFrame | ItemIndex, batch: DataFrame, catalogue: DataFrame,
                 top: int = 25, mode: str = "replace", reg: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The whole flow for a batch of collected ratings (username, title, year, rating, seq, ...): match to the catalogue (J13), put
    into the rating table, fold the arriving users in, put their vectors into the factor table, recommend.

    ``ratings`` is a table by ``username`` with the batch's columns and tmdb_id, ``factors`` one by ``user`` (user,
    factors, n_ratings). 'replace' drops the users' older ratings; 'append' keeps them, and they count in the fit. Users without a
    match keep what they had. Returns (recommendations: user, item, score, rank among unseen items; report: username, n_ratings,
    n_matched). Raises ``NothingMatched`` before anything is written when no row matches.

    Reads and writes the buckets of the arriving users only; items are scored for those users only.
    """
    matched = checkpoint(resolve.match_case_insensitive(batch, catalogue))
    known = matched.where(F.col("tmdb_id").isNotNull())
    if known.isEmpty():
        raise NothingMatched("no rating of the batch matches the catalogue")
    report = matched.groupBy("username").agg(F.count(F.lit(1)).alias("n_ratings"), F.count("tmdb_id").alias("n_matched"))
    ratings.change(known, mode)
    own = build_interactions(ratings.rows_of(known.select("username")))
    own = checkpoint(own)
    vectors = item_vectors if isinstance(item_vectors, DataFrame) else item_vectors.vectors()
    users = checkpoint(fold_in(own, vectors, reg))
    factors.change(users)
    index = item_vectors if isinstance(item_vectors, ItemIndex) else ItemIndex(item_vectors)
    return index.top(users.select("user", "factors"), top, seen=own.select("user", "item")), report
