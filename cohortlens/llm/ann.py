"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact inner products.

Nearness is the largest inner product.  A vector x is lifted to
(x, sqrt(M^2 - |x|^2)), M the largest norm, and a query q to (M q / |q|, 0): the
lifted distance falls as the inner product grows, so a Euclidean hash serves.

1. Equal vectors are one class: its smallest ids (one more than are asked for)
   are all that can ever be answered, so a vector held by a third of all rows is
   one entry of the index.
2. Hash: ``HASHES`` Gaussian projections per table, floor((a.x + b) / w) with w
   the spread of the projection, clamped to ``CELLS`` cells; a bucket is a tuple
   of cells.  ``TABLES`` tables.  The directory (bucket, count) has at most
   CELLS ** HASHES rows per table, whatever the data, and goes to every task.
3. Fit on at most ``SAMPLE`` queries, whose exact neighbours among *all* vectors
   are found by one scan: the neighbour's projection is taken as normal around
   slope x the query's.  The chance that a neighbour lies in a bucket is then a
   product over its cells; perturbed buckets are visited in falling order of that
   chance.  A query stops when the chances visited so far (as a share of those of
   all buckets that hold vectors) reach the level at which ``RECALL`` of the
   sample's neighbours lay in a visited bucket of some table.
4. Buckets are packed into parts of at most ``PART_ROWS`` vectors, a larger
   bucket into several.  A part's vectors and the queries that visit one of its
   buckets meet in one task: vectors first (bounded), then queries as a stream.
   The task scores visited buckets in blocks and sends on the best k of each
   query, so what is merged per query is k rows per part, not its candidates.

No bucket or candidate is capped: a query scores every vector of every bucket it
visits, with exact inner products in double precision.  On vectors without any
structure (uniform on a sphere in 64 dimensions) most buckets must be visited for
that recall; on clustered ones few.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither do rows with a null id; among lengths, the most
frequent one (ties: the shortest) is indexed and others take no part; a row
repeated with the same id counts once, all rows with the query's id are its own,
and an id with several vectors asks with the smallest of them; with fewer candidates than k all are returned; ties go to the smaller id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C

TABLES = 2
HASHES = 16             # even
CELLS = 2
SAMPLE = 256
RECALL = 0.95
PART_ROWS = 65_536
MIN_PARTS = 16          # per table
SEED = 13
CHUNK = 512             # queries scored at a time
TILE = 2_048            # vectors scored at a time

_GRID = np.linspace(-8, 8, 4001)
_PHI = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def _phi(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _GRID, _PHI)


@dataclass
class Hash:
    """Projections, cells and success estimate of all tables."""

    directions: np.ndarray      # (dimension + 1, tables * hashes), scaled so that w = 1
    shift: np.ndarray
    top: float                  # the largest norm
    tables: int
    hashes: int
    cells: int
    slope: float = 1.0
    spread: float = 1.0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.hstack([x * (self.top / norm)[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.top ** 2 - norm ** 2, 0))[:, None]])

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(rows, tables, hashes); cell c ranges from c - cells / 2 to c + 1 - cells / 2, the outer ones without end."""
        return (self.lift(x, query) @ self.directions + self.shift).reshape(len(x), self.tables, self.hashes)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): bucket numbers."""
        cell = np.clip(np.floor(self.project(x) + self.cells / 2), 0, self.cells - 1).astype(np.int64)
        return cell @ (self.cells ** np.arange(self.hashes - 1, -1, -1, dtype=np.int64))

    def halves(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Log chances of every combination of cells of the first and of the second half of the hashes, per query."""
        f = self.slope * self.project(x, query=True)[:, table] - self.slope * self.shift.reshape(self.tables, -1)[table]
        f = f + self.shift.reshape(self.tables, -1)[table]
        edges = np.arange(1, self.cells) - self.cells / 2
        below = _phi((edges[None, None, :] - f[:, :, None]) / self.spread)
        one = np.ones((*f.shape, 1))
        chance = np.diff(np.concatenate([0 * one, below, one], axis=2), axis=2)
        logs = np.log(np.maximum(chance, 1e-30))
        out = []
        for part in (logs[:, :self.hashes // 2], logs[:, self.hashes // 2:]):
            total = np.zeros((len(x), 1))
            for i in range(part.shape[1]):
                total = (total[:, :, None] + part[:, i, None, :]).reshape(len(x), -1)
            out.append(total)
        return out[0], out[1]

    def success(self, x: np.ndarray, table: int, codes: np.ndarray) -> np.ndarray:
        """(queries, codes): log of the estimated chance that a neighbour lies in the bucket."""
        a, b = self.halves(x, table)
        half = self.cells ** (self.hashes // 2)
        return a[:, codes // half] + b[:, codes % half]


@dataclass
class Directory:
    """Buckets of one table that hold vectors, and the parts that hold them (part p: entries at[p] to at[p + 1])."""

    codes: np.ndarray
    part: np.ndarray        # first part of a bucket
    slices: np.ndarray      # parts of a bucket
    entries: np.ndarray     # bucket (index into codes), ordered by part
    at: np.ndarray

    @classmethod
    def pack(cls, codes: np.ndarray, counts: np.ndarray, rows: int) -> Directory:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        part, slices, entries, at, held = [], [], [], [0], 0
        for i, n in enumerate(counts.tolist()):
            if held and held + n > rows:
                at.append(len(entries))
                held = 0
            part.append(len(at) - 1)
            slices.append(max(1, -(-n // rows)))
            for _ in range(slices[-1] - 1):
                entries.append(i)
                at.append(len(entries))
            entries.append(i)
            held += n if slices[-1] == 1 else rows      # a split bucket shares its last part with no other
        at.append(len(entries))
        return cls(codes, np.array(part), np.array(slices), np.array(entries), np.array(at))


def _levels(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(visiting order, share of all chances visited before each bucket in that order), per query."""
    order = np.argsort(-logs, axis=1, kind="stable")
    chance = np.exp(np.take_along_axis(logs, order, 1))
    total = np.cumsum(chance, axis=1)
    return order, (total - chance) / total[:, -1:]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of every row, ties to smaller ids; -inf is no score. Sorted."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[col] if ids.ndim == 1 else ids[row, col], -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


class Part:
    """The vectors of one part, ready to be searched."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        self.x, self.code, self.first = _matrix(t["vec"]), t["code"].to_numpy(), t["id"].to_numpy()
        ids = t["ids"].combine_chunks()
        self.ids, self.at = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
        self.buckets, self.bucket = np.unique(self.code, return_inverse=True)

    def search(self, q: np.ndarray, own: np.ndarray, visit: np.ndarray | None, k: int) -> pa.RecordBatch:
        """Best k of each query among the buckets it visits (queries x buckets; None: all)."""
        keep = k + 1        # the query's own class may be one of them
        best_s = np.full((len(q), keep), -np.inf)
        best_c = np.zeros((len(q), keep), np.int64)
        for a in range(0, len(self.x), TILE):
            inside = self.bucket[a:a + TILE]
            seen = None if visit is None else visit[:, inside]
            some = np.arange(len(q)) if seen is None else np.flatnonzero(seen.any(axis=1))
            if not len(some):
                continue
            s = q[some] @ self.x[a:a + TILE].T
            if seen is not None:
                s[~seen[some]] = -np.inf
            s = np.hstack([best_s[some], s])
            c = np.hstack([best_c[some], np.broadcast_to(np.arange(a, a + len(inside)), (len(some), len(inside)))])
            row, col = _best(s, self.first[c], keep)
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            fresh_s, fresh_c = np.full((len(some), keep), -np.inf), np.zeros((len(some), keep), np.int64)
            fresh_s[row, nth], fresh_c[row, nth] = s[row, col], c[row, col]
            best_s[some], best_c[some] = fresh_s, fresh_c
        row, nth = np.nonzero(best_s > -np.inf)
        cls = best_c[row, nth]
        exact = (q[row] * self.x[cls]).sum(axis=1)      # the same sum wherever the pair is met
        n = self.at[cls + 1] - self.at[cls]
        row, exact = np.repeat(row, n), np.repeat(exact, n)
        member = np.repeat(self.at[cls] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(row))
        ids = self.ids[member] if len(member) else np.zeros(0, np.int64)
        other = ids != own[row]
        row, exact, ids = row[other], exact[other], ids[other]
        order = np.lexsort((ids, -exact, row))
        row, exact, ids = row[order], exact[order], ids[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, exact, ids = row[top], exact[top], ids[top]
        at = pa.array(np.searchsorted(row, np.arange(len(q) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((ids, pa.int64()), (exact, pa.float64()))]
        return pa.record_batch([pa.array(own, pa.int64()), *lists], schema=FOUND)


def _meet(model: Hash, k: int):
    """Tasks over rows sorted by part, vectors (kind 0) before queries (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index = None, [], None
        for batch in batches:
            parts, kinds = batch["part"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero(np.diff(parts * 2 + kinds, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True):
                if parts[a] != part:
                    part, held, index = parts[a], [], None
                rows = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(rows)
                    continue
                if index is None:
                    index, held = Part(held), []
                q, own, floor = _matrix(rows["vec"]), rows["id"].to_numpy(), rows["floor"].to_numpy()
                table = int(rows["code"][0].as_py())
                for i in range(0, len(q), CHUNK):
                    at = slice(i, i + CHUNK)
                    visit = model.success(q[at], table, index.buckets) >= floor[at, None]
                    yield index.search(q[at], own[at], visit, k)
    return run


def _scan(q: np.ndarray, own: np.ndarray, k: int):
    """Tasks that find the exact neighbours of a few queries among their classes, with the neighbours' vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, first = _matrix(batch["vec"]), batch["id"].to_numpy()
            s = q @ x.T
            s[own[:, None] == first[None, :]] = -np.inf
            row, col = _best(s, first, k)
            yield pa.record_batch([pa.array(row, pa.int32()), pa.array(s[row, col]), pa.array(first[col]),
                                   batch["vec"].take(pa.array(col)).cast(pa.list_(pa.float64()))],
                                  names=["q", "score", "id", "vec"])
    return run


def usable(vec: Column) -> Column:
    """Whether a vector can be searched: its components finite and not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row: id (the smallest), ids (the k + 1 smallest), vec."""
    rows = rows.withColumn("h", F.xxhash64("vec"))
    nth = F.dense_rank().over(Window.partitionBy("h", "vec").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return few.groupBy("h", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(
        F.col("ids")[0].alias("id"), "ids", "vec")


def _hashed(model: Hash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = model.codes(_matrix(batch["vec"]))
                flat = pa.array(codes.astype(np.int32).ravel(), pa.int32())
                at = pa.array(np.arange(len(batch) + 1) * model.tables, pa.int32())
                yield batch.append_column("codes", pa.ListArray.from_arrays(at, flat))
    return run


def _probes(model: Hash, directories: list[Directory], stop: float):
    """Tasks that turn a query into one row per part that holds a bucket it visits."""
    firsts = np.concatenate(([0], np.cumsum([len(d.at) - 1 for d in directories])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                rows = batch.slice(i, 64)
                q = _matrix(rows["vec"])
                for t, d in enumerate(directories):
                    logs = model.success(q, t, d.codes)
                    order, level = _levels(logs)
                    last = (level <= stop).sum(axis=1) - 1
                    floor = np.take_along_axis(logs, np.take_along_axis(order, last[:, None], 1), 1)
                    best = np.maximum.reduceat(logs[:, d.entries], d.at[:-1], axis=1)
                    who, part = np.nonzero(best >= floor)
                    yield pa.record_batch(
                        [pa.array(firsts[t] + part, pa.int32()), pa.array(np.ones(len(who)), pa.int32()),
                         rows["id"].take(pa.array(who)), pa.array(np.full(len(who), t), pa.int32()),
                         rows["vec"].take(pa.array(who)), pa.array([[]] * len(who), pa.list_(pa.int64())),
                         pa.array(floor[who, 0])], names=MEET)
    return run


MEET = ["part", "kind", "id", "code", "vec", "ids", "floor"]


def fit(rows: DataFrame, queries: DataFrame, k: int, tables: int, hashes: int, cells: int, sample: int,
        recall: float) -> tuple[Hash, DataFrame, list[Directory], float] | None:
    """Hash, hashed classes (checkpointed), directories and the stopping level; None without vectors or queries."""
    drawn = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()     # bounded by ``sample``
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    groups = C.cut_lineage(classes(rows, k))
    n, top = groups.agg(F.count("*"), F.max(squares)).first()
    if not n or not drawn:
        return None
    q, own = np.array([r.vec for r in drawn], np.float64), np.array([r.id for r in drawn])
    found = groups.mapInArrow(_scan(q, own, k), "q int, score double, id long, vec array<double>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    near = found.withColumn("nth", nth).filter(F.col("nth") <= k).collect()     # at most sample * k rows
    rng = np.random.default_rng(SEED)
    size = q.shape[1] + 1
    model = Hash(rng.standard_normal((size, tables * hashes)), rng.uniform(-0.5, 0.5, tables * hashes), math.sqrt(top),
                 tables, hashes, cells)
    seen = np.array([r.vec for r in near], np.float64) if near else q
    # w is the spread of a projection over queries and neighbours; cells lie around its mean
    spread = model.lift(np.vstack([q, seen]), False) @ model.directions
    width = np.maximum(spread.std(axis=0), 1e-9 * math.sqrt(top))
    model.directions = model.directions / width
    model.shift = (model.shift / 2 if cells == 2 else model.shift) - spread.mean(axis=0) / width
    hashed = C.cut_lineage(groups.mapInArrow(
        _hashed(model), f"id long, ids array<long>, vec {dict(groups.dtypes)['vec']}, codes array<int>"))
    counts = hashed.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").count().collect()
    rows_per_part = max(1, min(PART_ROWS, -(-n // MIN_PARTS)))
    directories = []
    for t in range(tables):     # at most cells ** hashes buckets
        mine = [(r["code"], r["count"]) for r in counts if r["t"] == t]
        directories.append(Directory.pack(*(np.array(x, np.int64) for x in zip(*mine, strict=True)), rows_per_part))
    if not near:
        return model, hashed, directories, 1.0
    whose = np.array([r.q for r in near])
    base = model.shift.reshape(tables, hashes)
    a, b = model.project(q, True)[whose] - base, model.project(seen) - base
    model.slope = float((a * b).sum() / max((a * a).sum(), 1e-30))
    model.spread = float(max(np.sqrt(((b - model.slope * a) ** 2).mean()), 1e-3))
    least = np.full(len(near), np.inf)
    codes = model.codes(seen)
    for t, d in enumerate(directories):
        for i in range(len(q)):
            mine = np.flatnonzero(whose == i)
            order, level = _levels(model.success(q[i:i + 1], t, d.codes))
            at = np.empty(len(d.codes))
            at[order[0]] = level[0]
            least[mine] = np.minimum(least[mine], at[np.searchsorted(d.codes, codes[mine, t])])
    return model, hashed, directories, float(np.quantile(least, recall, method="higher"))


def search(vectors: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vec: str = "embedding",
           tables: int = TABLES, hashes: int = HASHES, cells: int = CELLS, sample: int = SAMPLE,
           recall: float = RECALL) -> DataFrame:
    """The k nearest found of every row for which ``queries`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    own = F.col(f"`{vec_id}`").cast("long")
    kind = dict(vectors.dtypes)[vec]
    x = F.col(f"`{vec}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vec}`").cast("array<double>")
    rows = vectors.select(own.alias("id"), x.alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.filter(F.size("vec") == lengths["d"])
    # a query is much work for few bytes: its task count is not left to the size of the table
    asking = rows.filter("asks").repartition(C.partitions(spark), "id").groupBy("id").agg(F.min("vec").alias("vec"))
    fitted = fit(rows.select("id", "vec"), asking, k, tables, hashes, cells, sample, recall)
    if fitted is None:
        return empty
    model, hashed, directories, stop = fitted
    firsts = np.concatenate(([0], np.cumsum([len(d.at) - 1 for d in directories])))
    placed = spark.createDataFrame(     # the directory: at most tables * cells ** hashes rows
        [(t, int(c), int(firsts[t] + p), int(s)) for t, d in enumerate(directories)
         for c, p, s in zip(d.codes, d.part, d.slices, strict=True)], "t int, code int, first int, slices int")
    index = (hashed.select("id", "ids", "vec", F.posexplode("codes").alias("t", "code"))
             .join(F.broadcast(placed), ["t", "code"])
             .select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).alias("part"),
                     F.lit(0).alias("kind"), "id", "code", "vec", "ids", F.lit(0.0).alias("floor")))
    meet = ", ".join(f"{n} {t}" for n, t in zip(MEET, ("int", "int", "long", "int", dict(asking.dtypes)["vec"], "array<long>",
                                                       "double"), strict=True))
    probes = asking.mapInArrow(_probes(model, directories, stop), meet)
    both = index.unionByName(probes).repartition(int(firsts[-1]), "part").sortWithinPartitions("part", "kind", "code")
    found = both.mapInArrow(_meet(model, k), "query_id long, ids array<long>, scores array<double>")
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # a pair that several tables found has one rank
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).distinct().select("query_id", "rank", "vec_id", "score")


def op13_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id 20 divides."""
    return search(C.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
