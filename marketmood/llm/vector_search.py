"""Exact top-k search by inner product with a pivot-distance index.

Vectors become integers, floor(SCALE * x). A further coordinate gives all of them one
length, so the order by inner product with a query is the order by distance from it.
Each vector is keyed by its nearest pivot and its distance to that pivot; the distances
of a pivot's vectors are cut into annuli, the annuli into blocks of sorted rows.

A query visits the annuli around it, nearest first: the first visit finds k neighbours
and so a distance beyond which nothing counts; each further visit takes the annuli that
the triangle inequality (and the pivot's half-space) leaves within that distance, and the
last one takes all of them. So nothing is missed, whatever the data.

Neighbouring annuli make a cell; a query visits a cell once a turn, with a bit for each of
its annuli, and meets it where the cell lies. So the rows that move grow with queries times
cells, not times annuli, however little the bounds rule out. A cell that many queries visit
is copied for every VISITORS of them, and an annulus larger than a cell is dealt in pieces,
so neither a common vector nor a common query is a task's lot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmood.llm.common import if_small, sliced, stored

SCALE = 1024
EVERY = 100
K = 10
# The index is fitted on at most this many vectors; every vector is then indexed.
SAMPLE = 8192
# Pivots are the square root of the rows, within these; each has so many annuli.
LEAST_PIVOTS, MOST_PIVOTS = 8, 512
ANNULI = 32
# Numbers of a block of vectors and of a cell, and queries that meet one copy of a cell.
BLOCK_VALUES = 1 << 17
CELL_VALUES = 1 << 20
VISITORS = 2048
# Vectors a query visits at first, and how many times as many each time after that.
FIRST_VISIT, GROWTH, VISITS = 512, 8, 3
# Rows whose distances from all pivots are held at once.
BATCH = 4096
# Bounds of queries from annuli, and products of queries with vectors, held at once.
BOUNDS, PRODUCTS = 1 << 19, 1 << 21
# Relative slack of the bounds, which are doubles.
SLACK = 1e-9
# Sums of products up to here are exact in doubles.
EXACT = float(1 << 53)


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact 64-bit inner products of integers held as doubles.

    Raises OverflowError where one does not fit into 64 bits.
    """
    largest = np.sqrt((queries**2).sum(axis=1).max(initial=0) * (vectors**2).sum(axis=1).max(initial=0))
    if largest < EXACT / 2:
        return (queries @ vectors.T).astype(np.int64)
    one = [[int(x) for x in row] for row in queries.tolist()]
    two = [[int(x) for x in row] for row in vectors.tolist()]
    return np.array([[sum(a * b for a, b in zip(q, v)) for v in two] for q in one], np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("embedding").isNotNull() & good)


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Centres of a sample: spread-out members, moved to the mean of their nearest by some rounds."""
    draw = np.random.default_rng(7)
    near = np.full(len(sample), np.inf)
    chosen = [0]
    for _ in range(min(count, len(sample)) - 1):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not near.sum():
            break
        chosen.append(int(draw.choice(len(sample), p=near / near.sum())))
    centres = sample[chosen]
    for _ in range(rounds):
        owner = distances(sample, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (owner == c).any():
                centres[c] = sample[owner == c].mean(axis=0)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all points from all centres."""
    square = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(square, 0))


class PivotSpace:
    """The pivots and what places a vector among them; its size is bounded by parameters.

    A vector's code is its integers, padded with zeros to ``dim``, of the narrowest type
    that holds all vectors'.
    """

    def __init__(self, dim: int, longest: float, largest: float):
        self.dim, self.longest, self.pivots = dim, longest, np.zeros((1, dim + 1))
        self.kind = next((k for k, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**53)) if largest < top), "<f8")

    def codes(self, values: pa.Array) -> pa.Array:
        """The codes of arrays of doubles."""
        lengths = np.diff(values.offsets.to_numpy())
        out = np.zeros((len(values), self.dim), self.kind)
        out[np.arange(self.dim) < lengths[:, None]] = np.floor(SCALE * values.flatten().to_numpy())
        raw, width = out.tobytes(), out.itemsize * self.dim
        return pa.array([raw[i * width : (i + 1) * width] for i in range(len(values))], pa.binary())

    def vectors(self, codes: pa.Array) -> np.ndarray:
        """Integers as doubles, a row per code."""
        return np.frombuffer(b"".join(codes.to_pylist()), self.kind).reshape(-1, self.dim).astype(np.float64)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """With the coordinate that gives every vector the length of the longest."""
        rest = np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0)
        return np.c_[vectors, np.sqrt(rest)]

    @property
    def slack(self) -> float:
        """What a computed distance may be off at most."""
        size = self.longest**2 + (self.pivots**2).sum(axis=1).max(initial=0)
        return float(np.sqrt(SLACK * size))

    def from_pivots(self, queries: np.ndarray) -> np.ndarray:
        """A query's distances from all pivots; to the last bit the same in whatever batch it comes."""
        points = np.c_[queries, np.zeros(len(queries))]
        square = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * np.einsum("ij,kj->ik", points, self.pivots)
        return np.sqrt(np.maximum(square, 0))

    def radius(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far from a query a vector of this score lies."""
        square = (queries**2).sum(axis=1) + self.longest**2 - 2 * scores
        return np.sqrt(np.maximum(square, 0)) + self.slack


def fit_space(rows: DataFrame, sample_rows: int = SAMPLE) -> PivotSpace:
    """Pivots out of a sample by hash of about ``sample_rows`` vectors."""
    scaled = F.transform("embedding", lambda x: x * SCALE)
    whole = F.transform(scaled, lambda x: x - F.pmod(x, F.lit(1.0)))
    sums = rows.select(F.size("embedding").alias("dim"), whole.alias("whole")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("dim").alias("dim"),
        F.max(F.array_max(F.transform("whole", F.abs))).alias("largest"),
        F.max(F.aggregate("whole", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
    ).first()
    space = PivotSpace(max(1, sums["dim"] or 1), float(np.sqrt(sums["square"] or 0.0)) * (1 + SLACK), sums["largest"] or 0.0)
    part = 1 << 30
    kept = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(part)) < int(part * min(1.0, sample_rows / max(1, sums["n"])))
    sample = rows.filter(kept).limit(2 * sample_rows).select("embedding").toArrow().column("embedding").combine_chunks()
    if len(sample):
        count = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, np.sqrt(sums["n"]))))
        space.pivots = fit_pivots(space.lifted(space.vectors(space.codes(sample))), count)
    return space


def _keyed(rows: DataFrame, space: PivotSpace) -> DataFrame:
    """(vec_id, code, pivot, distance): every vector's nearest pivot and distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                codes = space.codes(part.column("embedding"))
                far = distances(space.lifted(space.vectors(codes)), space.pivots)
                pivot = far.argmin(axis=1)
                own = far[np.arange(len(far)), pivot]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), codes, pa.array(pivot, pa.int32()), pa.array(own)], ["vec_id", "code", "pivot", "distance"])

    return rows.mapInArrow(sliced(run), "vec_id long, code binary, pivot int, distance double")


def _blocks(keyed: DataFrame, space: PivotSpace, annuli: int, parts: int) -> DataFrame:
    """(block, pivot, annulus, low, high, n, ids, codes): the index, a row per block.

    A block holds sorted neighbours of one annulus, and as many as BLOCK_VALUES allows.
    """
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("distance", [i / annuli for i in range(1, annuli)], 1000).alias("cuts"))
    # At most MOST_PIVOTS rows of ANNULI numbers.
    edges = {r["pivot"]: np.array(sorted(set(r["cuts"]))) for r in cuts.collect()}
    rows_per_block = max(1, BLOCK_VALUES // space.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["pivot", "annulus", "low", "high", "n", "ids", "codes"]

        def block(group: list[pa.RecordBatch]) -> tuple:
            table = pa.Table.from_batches(group)
            distance, ids = table.column("distance").to_numpy(), table.column("vec_id").combine_chunks()
            codes = b"".join(table.column("code").to_pylist())
            return (*place, float(distance.min()), float(distance.max()), len(distance), ids.to_pylist(), codes)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        place, waiting = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots, far = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
            annulus = np.empty(len(far), np.int64)
            for p in np.unique(pivots).tolist():
                own = pivots == p
                annulus[own] = np.searchsorted(edges[p], far[own], "left")
            starts = np.flatnonzero(np.r_[True, (pivots[1:] != pivots[:-1]) | (annulus[1:] != annulus[:-1])]).tolist()
            for s, e in zip(starts, [*starts[1:], len(far)]):
                at = s
                while at < e:
                    if place != (int(pivots[s]), int(annulus[s])) or waiting == rows_per_block:
                        if held:
                            yield batch_of([block(held)])
                        place, held, waiting = (int(pivots[s]), int(annulus[s])), [], 0
                    took = min(e - at, rows_per_block - waiting)
                    held.append(batch.slice(at, took))
                    at, waiting = at + took, waiting + took
        if held:
            yield batch_of([block(held)])

    # The id as a last key deals equal vectors, at one distance from one pivot, to many ranges.
    ordered = keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    blocks = ordered.mapInArrow(sliced(run), "pivot int, annulus int, low double, high double, n long, ids array<long>, codes binary")
    return blocks.withColumn("block", F.monotonically_increasing_id())


class Annuli:
    """Bounds of all annuli, at most MOST_PIVOTS times ANNULI of them, and the cells they make."""

    def __init__(self, rows: list, space: PivotSpace):
        columns = list(zip(*((r["pivot"], r["annulus"], r["low"], r["high"], r["n"]) for r in rows)))
        self.pivot, self.annulus = (np.array(c, np.int64) for c in columns[:2])
        self.low, self.high, self.n = (np.array(c) for c in columns[2:])
        self.space = space
        self.cell, self.pieces = self._cells(max(1, CELL_VALUES // space.dim))
        # A cell's annuli are starts[cell] up to starts[cell + 1].
        self.starts = np.searchsorted(self.cell, np.arange(self.cell[-1] + 2)).tolist()

    def _cells(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Per annulus its cell, which holds neighbours of at most ``most`` rows in all, and the pieces of that cell."""
        cell, rows = np.zeros(len(self.n), np.int64), []
        for i, n in enumerate(self.n.tolist()):
            if not rows or rows[-1] + n > most:
                rows.append(0)
            rows[-1] += n
            cell[i] = len(rows) - 1
        return cell, -(-np.array(rows)[cell] // most)

    def placed(self, blocks: DataFrame) -> DataFrame:
        """``blocks`` with their cell, the piece of it they are in, its pieces and the annulus' place in it."""
        place = np.arange(len(self.n)) - np.array(self.starts)[self.cell]
        rows = list(zip(*(c.tolist() for c in (self.pivot, self.annulus, self.cell, place, self.pieces))))
        where = blocks.sparkSession.createDataFrame(rows, "pivot int, annulus int, cell int, place int, pieces int")
        piece = F.pmod(F.xxhash64("block"), F.col("pieces")).cast("int")
        return blocks.join(F.broadcast(where), ["pivot", "annulus"]).withColumn("piece", piece)

    def least_distances(self, queries: np.ndarray) -> np.ndarray:
        """Per query and annulus a distance that none of its vectors can be nearer than."""
        far = self.space.from_pivots(queries)
        nearest = far.min(axis=1)[:, None]
        own = far[:, self.pivot]
        # Nothing is nearer to another pivot than to its own, so at least half the difference away.
        return np.maximum(np.maximum(own - self.high, self.low - own), (own - nearest) / 2) - self.space.slack

    def wanted(self, queries: np.ndarray, radius: np.ndarray, turn: int, last: bool, first_visit: int, growth: int) -> np.ndarray:
        """Per query and annulus whether it is visited in this turn."""
        bounds = self.least_distances(queries)
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        # An annulus, nearest first, is among those of the turns up to some step.
        now = np.ones(order.shape, bool) if last else before < first_visit * growth**turn
        if turn:
            now &= before >= first_visit * growth ** (turn - 1)
        out = np.empty(order.shape, bool)
        np.put_along_axis(out, order, now, 1)
        return out & (bounds <= radius[:, None])


def _visits(queries: DataFrame, annuli: Annuli, turn: int, last: bool, first_visit: int, growth: int) -> DataFrame:
    """(query, query_id, code, worst, cell, pieces, places) of the cells that the queries visit in this turn.

    ``places`` has a bit for each annulus of the cell. Visited are those nearest first that
    hold first_visit * growth ** turn vectors in all, less those already visited, less
    those beyond the k-th neighbour found so far; in the last turn all that are left.
    """
    names = ["query", "query_id", "code", "worst"]
    step = max(1, BOUNDS // len(annuli.n))
    parts = max(2, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = annuli.space.vectors(part.column("code"))
                worst = part.column("worst").to_pylist()
                scores = np.array([0 if w is None else w for w in worst], np.float64)
                radius = np.where([w is None for w in worst], np.inf, annuli.space.radius(vectors, scores))
                wanted = annuli.wanted(vectors, radius, turn, last, first_visit, growth)
                rows, cells, places = [], [], []
                for cell, (s, e) in enumerate(zip(annuli.starts, annuli.starts[1:])):
                    callers = np.flatnonzero(wanted[:, s:e].any(axis=1))
                    rows.append(callers)
                    cells.append(np.full(len(callers), cell))
                    places += [bits.tobytes() for bits in np.packbits(wanted[callers, s:e], axis=1)]
                of, cell = np.concatenate(rows), np.concatenate(cells)
                own = part.select(names).take(pa.array(of))
                pieces = annuli.pieces[np.array(annuli.starts)[cell]]
                added = [pa.array(cell, pa.int32()), pa.array(pieces, pa.int32()), pa.array(places, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own.columns, *added], [*names, "cell", "pieces", "places"])

    # The few rows of queries are much work each, so all tasks get some.
    dealt = queries.select(*names).repartition(parts, "query")
    return dealt.mapInArrow(sliced(run), "query binary, query_id long, code binary, worst long, cell int, pieces int, places binary")


class _Cell:
    """The vectors of a piece of a cell in order of their ids, null ids last."""

    def __init__(self, blocks: list[pa.RecordBatch], space: PivotSpace):
        table = pa.Table.from_batches(blocks)
        known = table.column("ids").combine_chunks()
        ids = known.flatten()
        nameless = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((ids, nameless))
        place = np.repeat(table.column("place").to_numpy(), np.diff(known.offsets.to_numpy()))
        self.ids, self.nameless, self.place = ids[order], nameless[order], place[order]
        self.vectors = space.vectors(table.column("code"))[order]
        self.space = space

    def best(self, callers: pa.RecordBatch, k: int) -> list[pa.Array]:
        """The callers' rows and, for each, the id and score of its k best vectors here."""
        places = np.frombuffer(b"".join(callers.column("places").to_pylist()), np.uint8).reshape(len(callers), -1)
        wanted = np.unpackbits(places, axis=1).astype(bool)
        scores = inner_products(self.space.vectors(callers.column("code")), self.vectors)
        query_id = callers.column("query_id").to_numpy()
        hit = wanted[:, self.place]
        hit &= (self.ids != query_id[:, None]) | self.nameless
        least = np.iinfo(np.int64).min
        worst = np.array([least if w is None else w for w in callers.column("worst").to_pylist()], np.int64)
        hit &= scores >= worst[:, None]
        many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
        if len(many):
            # Ties at the k-th place stay until they are ordered by id.
            some = np.where(hit[many], scores[many], least)
            at = some.shape[1] - k
            hit[many] &= scores[many] >= np.partition(some, at, axis=1)[:, at][:, None]
        caller, vector = np.nonzero(hit)
        found = scores[caller, vector]
        # Stable, so equal scores stay in the order of ids; ~ reverses the order without overflow.
        order = np.lexsort((~found, caller))
        rank = np.arange(len(order)) - np.searchsorted(caller, caller[order])
        order = order[rank < k]
        own, vector = callers.select(["query", "query_id"]).take(pa.array(caller[order])), vector[order]
        return [*own.columns, pa.array(self.ids[vector], pa.int64(), mask=self.nameless[vector]), pa.array(found[order], pa.int64())]


def _scored(visits: DataFrame, blocks: DataFrame, space: PivotSpace, k: int, visitors: int) -> DataFrame:
    """(query, query_id, vec_id, score): per piece of a cell and query visiting it, the k best rows there."""
    parts = max(2, int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = if_small(stored(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("int").alias("splits")), "splits"))
    none = {"query": "binary", "query_id": "long", "worst": "long", "places": "binary", "place": "int", "ids": "array<long>"}
    names = ["cell", "piece", "split", "query", "query_id", "code", "worst", "places", "place", "ids"]
    copies = blocks.join(counts, "cell").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).withColumnRenamed("codes", "code")
    copies = copies.withColumns({c: F.lit(None).cast(none[c]) for c in ("query", "query_id", "worst", "places")})
    callers = visits.join(counts, "cell").withColumn("split", F.pmod(F.xxhash64("query"), F.col("splits")).cast("int"))
    callers = callers.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    callers = callers.withColumns({c: F.lit(None).cast(none[c]) for c in ("place", "ids")})
    most = PRODUCTS
    kinds = pa.schema([("query", pa.binary()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, cell = None, [], None
        for batch in batches:
            out: list[pa.RecordBatch] = []
            key = np.array([batch.column(c).to_numpy() for c in names[:3]])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]).tolist() if batch.num_rows else []
            calls = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                if here != key[:, s].tolist():
                    here, held, cell = key[:, s].tolist(), [], None
                first = s + int((~calls[s:e]).sum())
                if s < first:
                    held.append(batch.slice(s, first - s).select(["code", "place", "ids"]))
                # A piece of a cell can be empty, as its blocks are dealt by hash.
                if first < e and (held or cell is not None):
                    if cell is None:
                        cell, held = _Cell(held, space), []
                    step = max(1, most // len(cell.ids))
                    for at in range(first, e, step):
                        own = cell.best(batch.slice(at, min(step, e - at)), k)
                        out.append(pa.RecordBatch.from_arrays(own, schema=kinds))
            yield from pa.Table.from_batches(out, kinds).combine_chunks().to_batches()

    rows = copies.select(*names).unionByName(callers.select(*names))
    # A cell's vectors come first, its queries stream past them.
    ordered = rows.repartition(parts, *names[:3]).sortWithinPartitions(*names[:3], F.col("query").isNotNull(), "query")
    return ordered.mapInArrow(sliced(run), "query binary, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; lists are limited before they move."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    annuli: int = ANNULI,
    visits: int = VISITS,
    first_visit: int = FIRST_VISIT,
    growth: int = GROWTH,
    visitors: int = VISITORS,
) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score of the k best rows for each query.

    Queries are the rows whose vec_id is divisible by ``every``; a query's candidates are
    all rows but those of its own id. The score is the inner product of the vectors'
    integers floor(SCALE * x); equal scores are ordered by vec_id, null ids last. Vectors
    that are null or hold null or non-finite components take no part. Shorter vectors
    count as ending in zeros, an empty one as all zeros. Rows with a null id are
    candidates only; equal rows of a query's id ask once, unlike ones each for itself;
    repeated rows of other ids are each found. A score beyond 64 bits is an error.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = usable(vectors)
    space = fit_space(rows)
    keyed = stored(_keyed(rows, space), "keyed")
    blocks = stored(_blocks(keyed, space, annuli, parts), "blocks")
    bounds = blocks.groupBy("pivot", "annulus").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("pivot", "annulus").collect()
    name = F.unhex(F.sha2(F.concat(F.col("vec_id").cast("string").cast("binary"), F.lit(b","), "code"), 256))
    asked = keyed.filter(F.col("vec_id") % every == 0).select(F.substring(name, 1, 16).alias("query"), F.col("vec_id").alias("query_id"), "code")
    queries = stored(asked.dropDuplicates(["query"]), "queries")
    found = spark.createDataFrame([], "query binary, query_id long, vec_id long, score long, rank int")
    if not bounds:
        return found.select("query_id", "rank", "vec_id", "score")
    rings = Annuli(bounds, space)
    placed = rings.placed(blocks)
    for turn in range(visits):
        worst = found.filter(F.col("rank") == k).select("query", F.col("score").alias("worst"))
        open_queries = queries.join(if_small(worst), "query", "left")
        wanted = stored(_visits(open_queries, rings, turn, turn == visits - 1, first_visit, growth), "visits")
        scored = _scored(wanted, placed, space, k, visitors)
        found = stored(_best(found.drop("rank").unionByName(scored), k), "found")
    return found.select("query_id", "rank", "vec_id", "score")
