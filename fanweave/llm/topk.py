"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

The index is a table with one row for each block of candidates, written once. It holds the
block's postings (row and value, by dimension) in segments of descending quantised impact,
the power of two below the absolute value, and after each segment the norm of what is
left of every vector. A block of queries takes the segments one after another and adds
their exact products to its accumulators. By the Cauchy-Schwarz inequality, what is left
bounds the missing score. A vector leaves the search only when its accumulated score and
that bound together fall short of the query's threshold; the search of a query stops when
few vectors are left, and these are scored exactly from all their components.

The threshold of a query is a score that k candidates are proven to reach: first the k-th
best exact score in one block of candidates, which is searched ahead of all others, then
the k-th best of what a task has found so far. Blocks meet in groups: a task takes the
blocks of a lane for one block of queries and hands its thresholds on from block to block. So a
task holds two blocks of bounded size whatever the table's size. A pair returns at most k
rows a query, and none below the threshold; the best of them are taken by a window.

Defined results: components become ``floor(scale * x)``. Vectors that are null or hold a
null or non-finite component, and rows with a null id, take no part. Vectors of unequal
length are as if filled up with zeros. Every row with another id than the query's is a
candidate, also rows whose ids repeat; a repeated query id is answered once a row.
Components beyond 2**53 after scaling are clipped, and scores beyond the range of a long.
Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fanweave.session import stage

#: rows of a block of candidates, of a block of queries, and of the queries searched at once
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
SLICE_ROWS = 512
#: lanes that the candidates' blocks are dealt into for a block of queries, at most
LANES = 64
#: the search of a query stops when so many vectors, in multiples of k, are left
REST = 16
#: bounds are looked at once so much of the vectors' norms is left; before, they exclude
#: next to nothing
LOOK = 0.5
EXACT = 2.0**53
LONG = 2**63 - 1

HIT_SCHEMA = "query_row long, query_id long, vec_id long, vec_row long, score long"


# --- one block -------------------------------------------------------------------------------


@dataclass
class Segment:
    """Postings of one impact: those of dimension d lie at ``starts[d]:starts[d + 1]``.

    ``left`` is the norm of each vector without this and all earlier segments.
    """

    starts: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    left: np.ndarray

    def matrix(self, count: int) -> np.ndarray:
        """The postings as vectors, in the dimensions that have any."""
        sizes = np.diff(self.starts)
        dense = np.zeros((count, int((sizes > 0).sum())))
        dense[self.rows, np.repeat(np.arange(dense.shape[1]), sizes[sizes > 0])] = self.values
        return dense

    def used(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.starts))


def segments(vectors: np.ndarray) -> list[Segment]:
    """The postings of a block by descending quantised impact."""
    impact = np.zeros(vectors.shape, np.int16)
    filled = vectors != 0
    impact[filled] = np.frexp(np.abs(vectors[filled]))[1]
    left, found = vectors.astype(np.float64), []
    for level in sorted(set(np.unique(impact)) - {0}, reverse=True):
        chosen = impact == level
        dims, rows = np.nonzero(chosen.T)
        left = np.where(chosen, 0.0, left)
        starts = np.searchsorted(dims, np.arange(vectors.shape[1] + 1))
        found.append(Segment(starts, rows, vectors[rows, dims], np.sqrt((left**2).sum(1))))
    return found


def _exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of whole numbers beyond the precision of doubles, clipped to longs."""
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    # negating the least long would overflow
    return np.lexsort((ids, -np.maximum(scores, -LONG)))[:k]


def search_block(
    queries: np.ndarray, own: np.ndarray, index: list[Segment], ids: np.ndarray, k: int,
    floors: np.ndarray | None = None,
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the places and scores of its k best vectors whose id is not its own.

    Vectors that score below a query's floor may be missing. The number of
    (query, segment) pairs that were processed comes second.
    """
    count, width = len(ids), queries.shape[1]
    vectors = np.zeros((count, width))
    for segment in index:
        vectors[:, segment.used()] += segment.matrix(count)
    largest = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0)
    if largest * max(1, width) >= EXACT:
        found = []
        for q, name in zip(queries, own):
            open_ = np.flatnonzero(ids != name)
            scores = _exact_scores(q[None, :], vectors[open_])[0]
            top = _best(scores, ids[open_], k)
            found.append((open_[top], scores[top]))
        return found, len(queries) * len(index)
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    done = np.zeros((len(queries), count))
    done[own[:, None] == ids[None, :]] = -np.inf
    length = np.sqrt((queries**2).sum(1))
    norm = np.sqrt((vectors**2).sum(1)).mean() if count else 0.0
    alive = np.arange(len(queries))  # queries that still need segments
    members: list[np.ndarray | None] = [None] * len(queries)
    need, work = min(k, count), 0
    for n, segment in enumerate(index):
        if not len(alive):
            break
        used = segment.used()
        done[alive] += queries[np.ix_(alive, used)] @ segment.matrix(count).T
        work += len(alive)
        if segment.left.mean() > LOOK * norm or n == len(index) - 1:
            continue
        # rounding of the roots must not lower a bound
        miss = np.outer(length[alive], segment.left * (1 + 1e-9)) + 1e-6
        proven = floors[alive]
        open_ = np.flatnonzero(np.isneginf(proven))
        if len(open_):
            sure = done[alive[open_]] - miss[open_]
            proven = proven.copy()
            proven[open_] = np.partition(sure, count - need, axis=1)[:, count - need]
        miss += done[alive]
        possible = miss >= proven[:, None]
        finished = possible.sum(1) <= REST * k
        for n_alive in np.flatnonzero(finished):
            members[alive[n_alive]] = np.flatnonzero(possible[n_alive])
        alive = alive[~finished]
    found = []
    for n, name in enumerate(own):
        place = members[n]
        if place is None:  # every segment is in: the accumulators are the scores
            place, scores = np.arange(count), done[n]
        else:
            scores = vectors[place] @ queries[n]
        fit = (ids[place] != name) & (scores >= floors[n])
        place, scores = place[fit], scores[fit]
        if len(place) > 4 * k:
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            place, scores = place[scores >= bar], scores[scores >= bar]
        top = _best(scores, ids[place], k)
        found.append((place[top], scores[top].astype(np.int64)))
    return found, work


# --- tables ----------------------------------------------------------------------------------


QUERY_PARTS = "ids binary, nos binary, floors binary, vectors binary, width int, kind string"
INDEX_PARTS = (
    "ids binary, nos binary, width int, places string, "
    "segments array<struct<starts: binary, rows: binary, values: binary, left: binary>>"
)
SEGMENT_TYPE = pa.list_(pa.struct([(n, pa.binary()) for n in ("starts", "rows", "values", "left")]))


def _names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split("<")[0].split(", ")]


def _dense(vectors: list[np.ndarray]) -> np.ndarray:
    data = np.zeros((len(vectors), max(map(len, vectors))))
    for n, vector in enumerate(vectors):
        data[n, : len(vector)] = vector
    return data


def _kind(data: np.ndarray) -> str:
    """The narrowest type that holds the numbers."""
    return "<i2" if np.abs(data).max(initial=0.0) < 2**15 else "<f8"


def _longs(values: list) -> bytes:
    return np.asarray(values, np.int64).tobytes()


def _query_block(rows: list[tuple]) -> list[pa.Array]:
    ids, nos, floors, vectors = zip(*rows)
    data = _dense(vectors)
    bars = np.array([-np.inf if f is None else f for f in floors])
    kind = _kind(data)
    values = [_longs(ids), _longs(nos), bars.tobytes(), data.astype(kind).tobytes()]
    return [*(pa.array([v], pa.binary()) for v in values), pa.array([data.shape[1]], pa.int32()),
            pa.array([kind])]


def _index_block(rows: list[tuple]) -> list[pa.Array]:
    ids, nos, _, vectors = zip(*rows)
    data = _dense(vectors)
    places = "<u2" if len(ids) <= 1 << 16 else "<i4"
    kind = _kind(data)
    index = [
        {"starts": s.starts.astype("<i4").tobytes(), "rows": s.rows.astype(places).tobytes(),
         "values": s.values.astype(kind).tobytes(), "left": s.left.tobytes()}
        for s in segments(data)
    ]
    return [pa.array([_longs(ids)], pa.binary()), pa.array([_longs(nos)], pa.binary()),
            pa.array([data.shape[1]], pa.int32()), pa.array([places + kind]),
            pa.array([index], SEGMENT_TYPE)]


def _pack(
    rows: DataFrame, blocks: int, make: Callable[[list[tuple]], list[pa.Array]], parts: str
) -> DataFrame:
    """The rows dealt by a hash into ``blocks`` blocks; one row, with its ``key``, a block."""
    key = F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("key")
    # the order inside a block is fixed, so that a task which runs again makes the same block
    dealt = rows.select("id", "no", "floor", "v", key).repartition("key").sortWithinPartitions(
        "key", "no")
    names = [*_names(parts), "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_rows = None, []

        def closed() -> pa.RecordBatch:
            columns = [*make(open_rows), pa.array([open_key], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            lists = batch.column("v")
            values, sizes = lists.flatten().to_numpy(), np.asarray(lists.value_lengths())
            vectors = np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []
            rest = (batch.column(c).to_pylist() for c in ("id", "no", "floor", "key"))
            for id_, no, floor, key_, vector in zip(*rest, vectors):
                if key_ != open_key and open_rows:
                    yield closed()
                    open_rows = []
                open_key = key_
                open_rows.append((id_, no, floor, vector))
        if open_rows:
            yield closed()

    return dealt.mapInArrow(run, f"{parts}, key long")


def _read_index(block: dict, width: int) -> tuple[np.ndarray, np.ndarray, list[Segment]]:
    places, kind = block["places"][:3], block["places"][3:]
    index = []
    for s in block["segments"]:
        starts = np.frombuffer(s["starts"], "<i4").astype(np.int64)
        # dimensions that only the queries have
        starts = np.concatenate([starts, np.full(width + 1 - len(starts), starts[-1])])
        index.append(Segment(
            starts, np.frombuffer(s["rows"], places).astype(np.int64),
            np.frombuffer(s["values"], kind).astype(np.float64), np.frombuffer(s["left"])))
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["nos"], np.int64), index


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floors, best = None, np.zeros(0), []
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                q, c = row["q"], row["c"]
                width = max(q["width"], c["width"])
                own, own_no = (np.frombuffer(q[x], np.int64) for x in ("ids", "nos"))
                if row["asked"] != asked:
                    asked, floors = row["asked"], np.frombuffer(q["floors"]).copy()
                    best = [np.zeros(0, np.int64)] * len(own)
                queries = np.zeros((len(own), width))
                queries[:, : q["width"]] = np.frombuffer(
                    q["vectors"], q["kind"]).reshape(len(own), -1)
                ids, nos, index = _read_index(c, width)
                for begin in range(0, len(own), SLICE_ROWS):
                    part = slice(begin, begin + SLICE_ROWS)
                    hits, _ = search_block(
                        queries[part], own[part], index, ids, k, floors[part])
                    for place, (_, scores) in enumerate(hits, begin):
                        merged = np.concatenate([best[place], scores])
                        best[place] = np.sort(merged)[-k:]
                        if len(best[place]) == k:
                            floors[place] = max(floors[place], float(best[place][0]))
                    counts = [len(places) for places, _ in hits]
                    at = np.concatenate([p for p, _ in hits]).astype(np.int64)
                    score = np.concatenate([s for _, s in hits])
                    columns = [np.repeat(own_no[part], counts), np.repeat(own[part], counts),
                               ids[at], nos[at], score]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in columns], _names(HIT_SCHEMA))

    return run


def whole_components(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null if one is null or not finite."""
    wide = F.col(vector).cast("array<double>")
    fit = F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )

    def component(x: Column) -> Column:
        scaled = F.least(F.greatest(x * F.lit(float(scale)), F.lit(-EXACT)), F.lit(EXACT))
        return F.floor(scaled).cast("double")

    return F.when(fit, F.transform(wide, component))


def _hits(
    asked: DataFrame, index: DataFrame, n_asked: int, lanes: int, k: int
) -> DataFrame:
    """The best of every block of queries in these blocks of candidates, lane by lane."""
    lane = F.pmod("key", F.lit(lanes))
    blocks = index.select(
        lane.alias("lane"), F.struct(*_names(INDEX_PARTS)).alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("asked"))
    questions = asked.select(
        F.col("key").alias("asked"), F.struct(*_names(QUERY_PARTS)).alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    pairs = questions.join(blocks, ["asked", "lane"])
    return pairs.select("asked", "q", "c").mapInArrow(_searcher(k), HIT_SCHEMA)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id",
    vector: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best candidates of every query.

    ``is_query`` is a condition on the columns of ``vectors``.
    """
    named = vectors.select(
        F.col(id).cast("long").alias("id"), whole_components(vector, scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.monotonically_increasing_id().alias("no"),
    ).filter("id is not null and v is not null").withColumn("floor", F.lit(None).cast("double"))
    # written once: the row numbers must be the same on both sides
    placed = stage(named, "vectors")
    sizes = placed.agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("is_query"), 1)).alias("asked")
    ).first()
    n_blocks = max(1, -(-sizes["all"] // block_rows))
    n_asked = max(1, -(-sizes["asked"] // query_rows))
    index = stage(_pack(placed, n_blocks, _index_block, INDEX_PARTS), "segments")
    queries = placed.filter("is_query")

    def search(asked: DataFrame, blocks: DataFrame, lanes: int) -> DataFrame:
        return _hits(_pack(asked, n_asked, _query_block, QUERY_PARTS), blocks, n_asked, lanes, k)

    # one block ahead of all others gives every query a threshold
    first = stage(search(queries, index.filter("key = 0"), 1), "first-hits")
    bars = first.groupBy(F.col("query_row").alias("no")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    known = queries.drop("floor").join(bars, "no", "left")
    hits = first.unionByName(search(known, index.filter("key > 0"), min(LANES, n_blocks)))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return (
        hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
