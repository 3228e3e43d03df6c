"""Compression of vectors to codes: one codebook per part of the vector, refined by exact integer k-means.

The parts of all vectors are laid out once in flat blocks, sorted along a Hilbert curve, so that a block holds parts that lie
close together. A block keeps the box around its parts and their sum. In every round the distances between the box and the
codebook's entries leave a shortlist: an entry further from the nearest point of the box than another is from its furthest
point serves no part of the block. A block with one entry on its list gives its sum and count at once; the others measure
their parts against the list. All arithmetic is on whole numbers and exact: in doubles while every intermediate value fits
their 53 bits, else in 64-bit integers, else in Python's integers.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placewise.session import broadcast_if_small

from .common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 256             # parts in a block
HILBERT_BITS = 4        # bits per component in the sorting key
LIMB = 32               # sums travel as limbs of so many bits, so that adding up tasks never overflows
LONG_MAX = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(u, id, label, ints) of the usable rows, written, and the length of a part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    rows = rows.where(v.isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    n = sizes["n"] if sizes else 0
    width = max(1, -(-n // parts))
    # floor() of a large double would be cut to a long; a large double is a whole number already
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0 ** 52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    padded = F.concat(whole, F.array_repeat(F.lit(0.0), width * parts - n))
    out = rows.where(F.size("v") == n).select(F.monotonically_increasing_id().alias("u"), "id", "label", padded.alias("ints"))
    return saved(out, "ints"), width


def hilbert_keys(grid: np.ndarray, bits: int) -> list[bytes]:
    """Position of each row of small integers (below 2**bits) on the Hilbert curve, as bytes that sort alike."""
    x = grid.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:                                    # from coordinates to the transposed index: undo the turns level by level
        low = q - 1
        for i in range(len(x)):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = ((x[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)      # component, row, bit
    return [r.tobytes() for r in np.packbits(planes.transpose(1, 2, 0).reshape(grid.shape[0], -1), axis=1)]


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _rows(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.ravel(), pa.float64()))


def blocks_of(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """(pos, us, parts, low, high, total): runs of at most BLOCK parts of one position along the Hilbert curve, written.

    Equal parts share a key and are parted by their row numbers, so a common vector spreads over tasks."""
    ends = kept.select(F.posexplode("ints").alias("i", "x")).groupBy("i").agg(F.min("x"), F.max("x")).collect()
    low, high = np.zeros(width * parts), np.ones(width * parts)
    for i, a, b in ends:
        low[i], high[i] = a, b
    step = np.maximum((high - low) / (1 << HILBERT_BITS), 1e-300)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _floats(b.column(1), width * parts)
            cells = np.clip((x - low) / step, 0, (1 << HILBERT_BITS) - 1).astype(np.int64)
            for p in range(parts):
                at = slice(p * width, (p + 1) * width)
                yield pa.record_batch([pa.array(np.full(len(x), p, np.int32)), pa.array(hilbert_keys(cells[:, at], HILBERT_BITS), pa.binary()), b.column(0),
                                       _rows(np.ascontiguousarray(x[:, at]))], names=["pos", "key", "u", "part"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks() if rest is not None else pa.Table.from_batches([b])
            pos = t["pos"].to_numpy()
            cuts, start = [], 0
            for end in [*(np.flatnonzero(np.diff(pos)) + 1).tolist(), len(pos)]:
                cuts += [(i, min(i + BLOCK, end)) for i in range(start, end, BLOCK)]
                start = end
            rest = t.slice(cuts.pop()[0]) if cuts else None
            if cuts:
                yield block_rows(t, cuts)
        if rest is not None and rest.num_rows:
            yield block_rows(rest, [(0, rest.num_rows)])

    def block_rows(t: pa.Table, cuts: list[tuple[int, int]]) -> pa.RecordBatch:
        t = t.combine_chunks()
        pos, us = t["pos"].to_numpy(), t["u"].to_numpy()
        x = _floats(t["part"].chunk(0), width)
        return pa.record_batch({
            "pos": pa.array([int(pos[a]) for a, _ in cuts], pa.int32()), "us": pa.array([us[a:b] for a, b in cuts], pa.list_(pa.int64())),
            "parts": pa.array([x[a:b].ravel() for a, b in cuts], pa.list_(pa.float64())), "low": pa.array([x[a:b].min(0) for a, b in cuts], pa.list_(pa.float64())),
            "high": pa.array([x[a:b].max(0) for a, b in cuts], pa.list_(pa.float64())), "total": pa.array([limbs_of(sum_exact(x[a:b])) for a, b in cuts], pa.list_(pa.int64()))})

    spread = kept.select("u", "ints").mapInArrow(cut, "pos int, key binary, u long, part array<double>")
    ordered = spread.repartitionByRange("pos", "key", "u").sortWithinPartitions("pos", "key", "u").drop("key")
    return saved(ordered.mapInArrow(gather, "pos int, us array<long>, parts array<double>, low array<double>, high array<double>, total array<long>"), "blocks")


def number_type(limit: float, width: int) -> type:
    """Type in which squared distances between values up to ``limit`` are exact."""
    worst = 4 * width * (int(limit) + 1) ** 2
    return np.float64 if worst < 1 << 53 else np.int64 if worst < 1 << 62 else object


def exact(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(kind)


def sum_exact(x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0.0) * len(x) < 1 << 53:
        return [int(v) for v in x.sum(0)]
    return [sum(int(v) for v in col) for col in x.T]


def limbs_of(values: list[int]) -> list[int]:
    """A count of limbs, then per value its limbs, lowest first, the last one signed."""
    n = max((v.bit_length() for v in values), default=0) // LIMB + 1
    return [n, *((v >> (LIMB * i)) & ((1 << LIMB) - 1) if i < n - 1 else v >> (LIMB * i) for v in values for i in range(n))]


def of_limbs(limbs: list[int], width: int) -> list[int]:
    n = limbs[0]
    return [sum(limbs[1 + d * n + i] << (LIMB * i) for i in range(n)) for d in range(width)]


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to a point of the box: at its nearest point not further than any entry at its furthest."""
    below, above = low - book, book - high
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(abs(below), abs(above))
    near, far = (near * near).sum(1), (far * far).sum(1)
    return np.flatnonzero(near <= far.min())


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties: the lower) and the squared distance, exactly."""
    squares = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]
    best = squares.argmin(1)
    return best, squares[np.arange(len(x)), best]


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], width: int, kind: type):
    """(row of the batch, position, entries on the shortlist, the position's codebook) of every block."""
    pos = batch.column("pos").to_pylist()
    for i, p in enumerate(pos):
        book = books[p]
        low, high = (exact(batch.column(c)[i].values.to_numpy(), kind) for c in ("low", "high"))
        listed = shortlist(low, high, book)
        yield i, p, listed, book


def refine(blocks: DataFrame, books: list[list[list[int]]], width: int, kind: type) -> list[list[list[int]]]:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean.

    A task sends one row of sums per entry it met; what comes back to the driver is the size of the codebooks."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [exact(np.array(b, object), kind) for b in books]
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], list[int]] = {}

        def add(p: int, e: int, n: int, more: list[int]) -> None:
            count[p, e] = count.get((p, e), 0) + n
            total[p, e] = [a + b for a, b in zip(total[p, e], more)] if (p, e) in total else more
        for b in batches:
            for i, p, listed, book in _assigned(b, held, width, kind):
                values = b.column("parts")[i].values.to_numpy().reshape(-1, width)
                if len(listed) == 1:
                    add(p, int(listed[0]), len(values), of_limbs(b.column("total")[i].as_py(), width))
                    continue
                best, _ = nearest(exact(values, kind), book[listed])
                for e in np.unique(best):
                    some = values[best == e]
                    add(p, int(listed[e]), len(some), sum_exact(some))
        keys = list(count)
        rows = [(p, e, slot, v) for p, e in keys for slot, v in enumerate([count[p, e], *_slots(total[p, e], kind)])]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))] if rows
                              else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], names=["pos", "entry", "slot", "v"])
    out = [[list(e) for e in b] for b in books]
    found: dict[tuple[int, int], dict[int, int]] = {}
    for p, e, slot, v in blocks.mapInArrow(sums, "pos int, entry int, slot int, v long").groupBy("pos", "entry", "slot").agg(F.sum("v").alias("v")).collect():
        found.setdefault((p, e), {})[slot] = v
    for (p, e), slots in found.items():
        per = (len(slots) - 1) // width
        value = [sum(slots[1 + d * per + i] << (LIMB * i) for i in range(per)) for d in range(width)]
        out[p][e] = [v // slots[0] for v in value]
    return out


def _slots(values: list[int], kind: type) -> list[int]:
    """Limbs of a fixed number, so that tasks add up: two for 64-bit parts, enough for sums of the largest doubles otherwise."""
    n = 36 if kind is object else 2
    return [(v >> (LIMB * i)) & ((1 << LIMB) - 1) if i < n - 1 else v >> (LIMB * i) for v in values for i in range(n)]


def codes_of(blocks: DataFrame, books: list[list[list[int]]], width: int, kind: type) -> DataFrame:
    """(u, pos, entry, error) of every part; errors beyond a long are cut to its largest value."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [exact(np.array(b, object), kind) for b in books]
        for b in batches:
            for i, p, listed, book in _assigned(b, held, width, kind):
                us = b.column("us")[i].values
                best, error = nearest(exact(b.column("parts")[i].values.to_numpy().reshape(-1, width), kind), book[listed])
                error = pa.array([min(int(e), LONG_MAX) for e in error], pa.int64()) if kind is object else pa.array(error.astype(np.int64))
                yield pa.record_batch([us, pa.array(np.full(len(us), p, np.int32)), pa.array(listed[best].astype(np.int32)), error], names=["u", "pos", "entry", "error"])
    return blocks.mapInArrow(assign, "u long, pos int, entry int, error long")


def fit(kept: DataFrame, blocks: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[list[list[list[int]]], type]:
    """Codebooks of whole numbers, [part][entry][component]; the vectors of the smallest ids are the start."""
    first = kept.where("id IS NOT NULL").orderBy("id", "ints", "u").limit(entries).select("ints").collect()
    whole = [[int(x) for x in r["ints"]] for r in first] or [[0] * (width * parts)]
    top = blocks.agg(F.max(F.greatest(F.array_max(F.transform("low", F.abs)), F.array_max(F.transform("high", F.abs))))).first()[0] or 0.0
    kind = number_type(top, width)
    books = [[v[p * width:(p + 1) * width] for v in whole] for p in range(parts)]
    for _ in range(rounds):
        books = refine(blocks, books, width, kind)
    return books, kind


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable row of ``vectors``.

    Rows whose vector is null or holds a null, a non-finite component, or one that overflows when scaled, are dropped. Vectors
    must have one length: rows of another than the most frequent (ties: the shorter) are dropped too; a length that ``parts``
    does not divide is filled up with zeros. Components become floor(scale * x). Rows without an id are coded but never start
    a codebook (without any id there is one entry of zeros); of rows that repeat an id, the smaller vector comes first. With
    fewer rows than entries there are that many entries. Errors that a long cannot hold become its largest value. An empty
    table gives an empty result; other columns are ignored."""
    kept, width = kept_vectors(vectors, id_col, vec_col, label_col, parts, scale)
    blocks = blocks_of(kept, width, parts)
    books, kind = fit(kept, blocks, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    wide = "decimal(38,0)"
    capped = lambda x: F.least(x, F.lit(LONG_MAX).cast(wide)).cast("long")
    hexed = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda s: F.lower(F.lpad(F.hex(s["entry"]), 2, "0"))))
    coded = codes_of(blocks, books, width, kind).groupBy("u").agg(hexed.alias("code"), capped(F.sum(F.col("error").cast(wide))).alias("error"))
    coded = saved(coded.join(kept.select("u", "id", "label"), "u"), "codes")
    group = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name")]
    by_label = coded.select(*group, "error").groupBy("none", "name").agg(capped(F.sum(F.col("error").cast(wide))).alias("label_error"))
    out = coded.select("*", *group).join(broadcast_if_small(by_label), ["none", "name"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in SQL: every part against every entry, four rounds unrolled. Distance and index share one integer, so that the
    smallest decides ties."""
    steps = ["""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, p::INT AS p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, range(4) r(p)),
b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, v FROM part QUALIFY e < 256)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part.p, min(list_sum(list_transform(list_zip(part.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT * 256 + e) AS de
  FROM part JOIN b{r} b USING (p) GROUP BY vec_id, part.p)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
  SELECT p, de % 256 AS e, i, sum(x)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT p, de, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN part USING (vec_id, p)) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return "WITH " + ",\n".join(steps) + f""",
c AS (SELECT vec_id, string_agg(lower(printf('%02x', de % 256)), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN kept USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM c JOIN kept USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM kept.label, h"""
