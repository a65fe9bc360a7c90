"""Nearest neighbours of vectors: over all rows, over the cells of an inverted index, and over product codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairograph.functions.vectors import DESCENDING, METRICS
from kairograph.sources.shared import written

#: Queries up to which one broadcast holds them all; more are dealt in blocks of this size, and corpora in tiles of TILE_ROWS.
QUERY_BLOCK, TILE_ROWS = 4096, 50_000
#: Rows on which cells and codebooks are fitted at most; every row is indexed.
IVF_SAMPLE, CODE_SAMPLE = 500_000, 100_000
#: Copies of queries, one a cell, that a task makes at once.
COPIES = 1 << 15
#: Rows that are compared with queries at once, and queries whose tables of distances are held at once.
STEP, QUERY_STEP = 1024, 256

#: From a block of query vectors, what gives their distances to a batch of stored values: a row for each query.
Measure = Callable[[np.ndarray], Callable[[pa.Array], np.ndarray]]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is nearer."""
    if metric in ("l2", "l2sq"):
        d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
        return np.sqrt(d) if metric == "l2" else d
    if metric == "cosine":
        q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (q, x))
    return -(q @ x.T)


def exact_measure(metric: str) -> Measure:
    return lambda q: lambda column: distances(q, matrix(column), metric)


class _Nearest:
    """The k nearest rows of each query so far, ties by id: k rows a query, whatever has been added."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.limit = k, np.full(queries, np.inf)
        self.query, self.id, self.score = np.empty(0, np.int64), None, np.empty(0)

    def add(self, ids: np.ndarray, d: np.ndarray) -> None:
        limit = self.limit
        if d.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        query, row = np.nonzero(d <= limit[:, None])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, d[query, row]])
        found = ids[row] if self.id is None else np.concatenate([self.id, ids[row]])
        order = np.lexsort((found, score, query))
        query, score, found = query[order], score[order], found[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], found[kept]
        full = place == self.k - 1
        self.limit[query[full]] = score[full]

    def scan(self, ids: pa.Array, values: pa.Array, measured: Callable[[pa.Array], np.ndarray]) -> None:
        for at in range(0, len(ids), STEP):
            self.add(np.array(ids.slice(at, STEP).to_pylist()), measured(values.slice(at, STEP)))

    def rows(self, names: pa.Array, id_type: pa.DataType) -> list[pa.Array]:
        ids = [] if self.id is None else self.id.tolist()
        return [names.take(pa.array(self.query)), pa.array(ids, id_type), pa.array(self.score)]


class _Blocks:
    """``_Nearest`` of all queries, QUERY_STEP of them at a time: what a measure holds for a query is held for so many only."""

    def __init__(self, names: list, q: np.ndarray, k: int, measure: Measure) -> None:
        self.names, self.measure = names, measure
        self.parts = [(at, q[at : at + QUERY_STEP], _Nearest(len(names[at : at + QUERY_STEP]), k)) for at in range(0, len(names), QUERY_STEP)]

    def scan(self, ids: pa.Array, values: pa.Array) -> None:
        for _, q, best in self.parts:
            best.scan(ids, values, self.measure(q))

    def batches(self, kind: pa.DataType, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at, q, best in self.parts:
            yield pa.RecordBatch.from_arrays(best.rows(pa.array(self.names[at : at + len(q)], kind), id_type), _FOUND)


_FOUND = ["query_id", "id", "score"]


def _found_schema(queries: DataFrame, rows: DataFrame) -> StructType:
    return StructType([queries.schema["query_id"], rows.schema["id"], *StructType.fromDDL("score double").fields])


def _scan(queries: DataFrame, rows: DataFrame, value: str, k: int, measure: Measure) -> DataFrame:
    """At most QUERY_BLOCK queries, broadcast: each partition keeps its own k best for each."""
    held = queries.select("query_id", "embedding").toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((held.column(0).to_pylist(), matrix(held.column(1).combine_chunks())))
    kind = held.schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best, id_type = _Blocks(names, q, k, measure), None
        for batch in batches if names else ():
            id_type = batch.schema.field(0).type
            best.scan(batch.column(0), batch.column(1))
        if id_type is not None:
            yield from best.batches(kind, id_type)

    return rows.select("id", value).mapInArrow(run, _found_schema(queries, rows))


def _grid(asked: DataFrame, rows: DataFrame, value: str, k: int, measure: Measure, block: int = QUERY_BLOCK, tile: int = TILE_ROWS) -> DataFrame:
    """Queries (cell, query_id, embedding) against the rows (cell, id, value) of their cell.

    A cell with many queries or rows is dealt as a grid: blocks of queries, a copy for each tile of rows, and tiles of rows, a
    copy for each block. A task holds one block and one tile and gives k rows for each query; no query passes through the
    driver, and no cell is one task.
    """
    size = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    shapes = size(asked, block, "blocks").join(size(rows, tile, "tiles"), "cell")
    return _dealt(asked.join(shapes, "cell"), rows.join(shapes, "cell"), value, k, measure)


def _dealt(asked: DataFrame, rows: DataFrame, value: str, k: int, measure: Measure) -> DataFrame:
    """``_grid`` of rows that know their cell's numbers of blocks and tiles."""
    part = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  columns of their own, where both sides come from one table
    left = asked.select(*own("cell"), part("query_id", "blocks").alias("block"), copies("tiles").alias("tile"), *own("query_id"), F.col("embedding").alias("asked"))
    right = rows.select(*own("cell"), copies("blocks").alias("block"), part("id", "tiles").alias("tile"), *own("id"), F.col(value).alias("value"))

    def run(queries: pa.Table, tiles: pa.Table) -> pa.Table:
        names, ids = (t.column(c).combine_chunks() for t, c in ((queries, "query_id"), (tiles, "id")))
        best = _Blocks(names.to_pylist(), matrix(queries.column("asked").combine_chunks()), k, measure)
        if len(names):
            best.scan(ids, tiles.column("value").combine_chunks())
        return pa.Table.from_batches(best.batches(names.type, ids.type), pa.schema(zip(_FOUND, (names.type, ids.type, pa.float64()), strict=True)))

    place = ["cell", "block", "tile"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(run, _found_schema(asked, rows))


def _nearest(queries: DataFrame, rows: DataFrame, value: str, k: int, measure: Measure, block: int) -> DataFrame:
    n = queries.count()
    if n <= min(block, QUERY_BLOCK):
        return _scan(queries, rows, value, k, measure)
    shape = {"cell": F.lit(0), "blocks": F.lit(-(-n // block)), "tiles": F.lit(max(1, -(-rows.count() // TILE_ROWS)))}
    return _dealt(queries.select("query_id", "embedding").withColumns(shape), rows.select("id", value).withColumns(shape), value, k, measure)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, rank, id, distance): the k least scores of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy("score", "id")
    distance = -F.col("score") if metric in DESCENDING else F.col("score")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", distance.alias("distance"))


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2sq", block: int = QUERY_BLOCK) -> DataFrame:
    """V5: (query_id, rank, id, distance): the k nearest of (id, embedding) for each of (query_id, embedding); ties by id.

    Up to ``block`` queries are broadcast and each partition of the corpus keeps k rows for each; more meet the corpus as a
    grid of blocks and tiles. Either way the corpus is read once, and k rows a query and task are shuffled, never the pairs.
    """
    return ranked(_nearest(queries, corpus, "embedding", k, exact_measure(metric), block), k, metric)


def knn_sql(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2sq") -> DataFrame:
    """V5 as plain expressions for a small query set: the twin that tests compare with."""
    score = METRICS[metric](F.col("q"), F.col("embedding"))
    score = -score if metric in DESCENDING else score
    pairs = corpus.select("id", "embedding").crossJoin(F.broadcast(queries.select("query_id", F.col("embedding").alias("q"))))
    return ranked(pairs.select("query_id", "id", score.alias("score")), k, metric)


# --- inverted lists (V6, V8) ---


def ivf_index(corpus: DataFrame, nlist: int = 4096, seed: int = 42, sample: int = IVF_SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """V6: (id, embedding, cell) of every row, and the cells' centres, fitted on at most about ``sample`` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = corpus.count()
    used = corpus if n <= sample else corpus.sample(sample / n, seed=seed)
    model = KMeans(k=nlist, seed=seed, featuresCol="features").fit(used.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    placed = model.transform(corpus.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))))
    return placed.select("id", "embedding", F.col("prediction").alias("cell")), np.array(model.clusterCenters())


def write_cells(index: DataFrame, path: str) -> DataFrame:
    """The index as one folder a cell, read back. Ranges of cells and ids keep the files of a cell few and split a large cell."""
    index.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(path)
    return index.sparkSession.read.parquet(path)


def ivf_search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, nprobe: int = 64, metric: str = "l2sq", block: int = QUERY_BLOCK) -> DataFrame:
    """V6: queries go to their ``nprobe`` nearest cells and are compared with the rows there.

    The cells asked for, one narrow row each and no more than there are centres, are broadcast to pick the index' rows: of
    an index of ``write_cells`` only these cells' folders are read.
    """
    if nprobe >= len(centres):  # every cell is asked for: no copy of a query a cell
        return knn_exact(queries, index, k, metric, block)
    shared = queries.sparkSession.sparkContext.broadcast(centres)
    schema = StructType([queries.schema["query_id"], queries.schema["embedding"], *StructType.fromDDL("cell int").fields])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, COPIES // max(nprobe, len(centres) // 4))
        for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            if batch.num_rows:
                d = distances(matrix(batch.column(1)), shared.value, metric)
                near = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
                own = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(near.reshape(-1).astype(np.int32))], schema.names)

    asked = written(queries.select("query_id", "embedding").mapInArrow(cells, schema), "probes")
    rows = index.join(F.broadcast(asked.select("cell").filter("cell >= 0").distinct()), "cell", "left_semi")
    return ranked(_grid(asked, rows.select("cell", "id", "embedding"), "embedding", k, exact_measure(metric), block), k, metric)


def recall_by_probes(queries: DataFrame, corpus: DataFrame, index: DataFrame, centres: np.ndarray, probes: list[int], k: int = 10, metric: str = "l2sq") -> list[tuple[int, float]]:
    """(nprobe, recall) of the search by cells against the exact one, for each number of probes."""
    exact = written(knn_exact(queries, corpus, k, metric).select("query_id", "id"), "exact")
    n = exact.count()
    return [(p, ivf_search(queries, index, centres, k, p, metric).join(exact, ["query_id", "id"], "left_semi").count() / max(n, 1)) for p in probes]


def use_exact(n: int, nlist: int) -> bool:
    """V8: too few vectors for cells."""
    return n < max(nlist, 256)


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, nlist: int = 4096, nprobe: int = 64, metric: str = "l2sq", seed: int = 42) -> DataFrame:
    """V8: exact search where the vectors are too few for ``nlist`` cells, or all cells are asked for; else through the cells."""
    if nprobe >= nlist or use_exact(corpus.count(), nlist):
        return knn_exact(queries, corpus, k, metric)
    index, centres = ivf_index(corpus, nlist, seed)
    return ivf_search(queries, index, centres, k, nprobe, metric)


# --- product codes (V7) ---


def _nearest_code(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    weight = (book * book).sum(1)
    return np.concatenate([(weight - 2 * x[at : at + 4096] @ book.T).argmin(1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _codebook(x: np.ndarray, codes: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of at most ``codes`` groups of the rows; a group that empties keeps its centre."""
    x = np.asarray(x, np.float64)
    distinct = np.unique(x, axis=0)
    book = np.random.default_rng(seed).permutation(distinct)[:codes]
    for _ in range(rounds if len(distinct) > codes else 0):
        near = _nearest_code(x, book)
        n = np.bincount(near, minlength=len(book))
        sums = np.stack([np.bincount(near, x[:, j], minlength=len(book)) for j in range(x.shape[1])], axis=1)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def product_codes(corpus: DataFrame, parts: int = 8, codes: int = 256, seed: int = 42, sample: int = CODE_SAMPLE) -> tuple[DataFrame, list[np.ndarray]]:
    """V7: (id, codes) of every row, a byte for each of ``parts`` parts, and the parts' codebooks.

    The codebooks are fitted side by side, one task a part, on the parts of at most about ``sample`` rows.
    """
    if codes > 256:
        raise ValueError("a code is one byte")
    n, width = corpus.count(), len(corpus.first()["embedding"]) // parts
    used = corpus if n <= sample else corpus.sample(sample / n, seed=seed)
    vector = F.col("embedding").cast("array<double>")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(vector, p * width + 1, width))
    pieces = used.select("id", F.posexplode(pieces).alias("part", "x"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # the same rows give the same book, in whatever order they came
        book = _codebook(matrix(table.column("x").combine_chunks()), codes, seed)
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([book.reshape(-1)])], ["part", "book"])

    books = {r.part: np.array(r.book).reshape(-1, width) for r in pieces.groupBy("part").applyInArrow(fit, "part int, book array<double>").collect()}
    books = [books[p] for p in range(parts)]
    shared = corpus.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                near = np.stack([_nearest_code(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(shared.value)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in near], pa.binary())], ["id", "codes"])

    return corpus.select("id", "embedding").mapInArrow(run, StructType([corpus.schema["id"], *StructType.fromDDL("codes binary").fields])), books


def code_measure(books: list[np.ndarray]) -> Measure:
    """Squared distances of queries to coded rows: for each query a table of its parts' distances to all codes, and for each
    row a look-up and a sum by its bytes. No row is decoded."""

    def measure(q: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
        width = books[0].shape[1]
        tables = [distances(q[:, p * width : (p + 1) * width], book, "l2sq").astype(np.float32) for p, book in enumerate(books)]

        def measured(column: pa.Array) -> np.ndarray:
            codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(books))
            d = np.zeros((len(q), len(column)), np.float32)
            for p, table in enumerate(tables):
                d += table[:, codes[:, p]]
            return d.astype(np.float64)

        return measured

    return measure


def pq_search(queries: DataFrame, coded: DataFrame, books: list[np.ndarray], k: int = 10, corpus: DataFrame | None = None, rerank: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """V7: the k nearest by distance tables over the codes: ``parts`` bytes and an id are read for each row.

    With ``corpus`` the ``rerank`` times k nearest by code are ranked by their exact distances, which are looked up by id.
    """
    found = _nearest(queries, coded, "codes", k * (1 if corpus is None else rerank), code_measure(books), block)
    if corpus is None:
        return ranked(found, k, "l2sq")
    near = ranked(found, k * rerank, "l2sq").select("query_id", "id")
    pairs = near.join(corpus.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return ranked(pairs.select("query_id", "id", METRICS["l2sq"](F.col("q"), F.col("embedding")).alias("score")), k, "l2sq")


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """The index of ``write_cells``."""
    return spark.read.parquet(path)
