"""Vector codes: product quantisation in exact integers, entries found by exponion search.

Vectors become integers floor(4096 x) and are cut into 8 equal parts. Each part position has a codebook of 16 entries, which starts as
that part of the 16 vectors of smallest id and moves in 6 rounds to the floor of its parts' means; unused entries stay.

A search starts at the entry that the part had in the round before. If its squared distance is U, the nearest entry is no farther from
that entry than twice the root of U (triangle inequality), so of the entries, sorted by their squared distance D from it, only those
with D <= 4 U are looked at. All distances are whole numbers, and equal ones go to the lower index.

A round reads the vectors with their codes and writes them with the new ones, with one row of sums for each task beside them: the
next round's entries come from these rows, the codes from the table, and nothing is shuffled. Old tables are removed.

Rows whose vector is null, or holds null or non-finite components, are dropped, and so are those of another length than the first vector
(of least id; equal ids by their components, null ids first). Lengths must divide by 8, and components stay below 2**16 in size, else an
error is raised: beyond that sums of squares would no longer be exact. With fewer than 16 vectors codebooks are as much smaller; without any
there are no rows. Rows that repeat have equal codes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of vectors, after scaling.
MOST = 1 << 28


def whole_numbers(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is sound, with it as whole numbers."""
    number = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn(vector, F.transform(number, lambda x: F.floor(x * SCALE)))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def checked(numbers: np.ndarray) -> None:
    if numbers.size and (numbers.max() > MOST or numbers.min() < -MOST):
        raise ValueError(f"components must be below {MOST // SCALE} in size")


class Codebook:
    """The entries of one part position, and for each of them all entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = self.entries[:, None, :] - self.entries[None, :, :]
        self.apart = (apart * apart).sum(2)
        self.near = np.argsort(self.apart, axis=1, kind="stable")

    def distances(self, parts: np.ndarray, entry: int) -> np.ndarray:
        away = parts - self.entries[entry]
        return np.einsum("ij,ij->i", away, away)

    def search(self, parts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry, from the entries that they had."""
        code, least = before.astype(np.int64), np.zeros(len(parts), np.int64)
        for start in np.unique(before).tolist():
            rows = np.flatnonzero(before == start)
            own = parts[rows]
            first = self.distances(own, start)
            best, index = first.copy(), np.full(len(rows), start)
            live = np.arange(len(rows))
            for entry in self.near[start].tolist():
                live = live[self.apart[start, entry] <= 4 * first[live]]
                if not len(live):
                    break
                if entry == start:
                    continue
                found = self.distances(own[live], entry)
                nearer = (found < best[live]) | ((found == best[live]) & (entry < index[live]))
                best[live[nearer]], index[live[nearer]] = found[nearer], entry
            code[rows], least[rows] = index, best
        return code, least


def searched(rows: DataFrame, codebooks: np.ndarray, key: str, vector: str, label: str, sums: bool) -> DataFrame:
    """key, label, vector, code (bytes), error; with sums also rows with nothing but the sums and counts of a task's parts."""
    spark, width = rows.sparkSession, codebooks.shape[0] * codebooks.shape[2]
    held = spark.sparkContext.broadcast(codebooks)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, label)}
    first = "code" not in rows.columns

    def run(batches):
        books = [Codebook(x) for x in held.value]
        n, size = held.value.shape[1], held.value.shape[2]
        total = np.zeros((PARTS, n, size + 1), np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            parts = matrix(batch.column(vector), width).reshape(-1, PARTS, size)
            checked(parts)
            before = np.zeros((len(parts), PARTS), np.uint8) if first else np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            code, error = np.zeros((len(parts), PARTS), np.uint8), np.zeros(len(parts), np.int64)
            for p, book in enumerate(books):
                code[:, p], least = book.search(parts[:, p], before[:, p])
                error += least
                if sums:
                    total[p, :, size] += np.bincount(code[:, p], minlength=n)
                    for d in range(size):  # below 2**53 in a batch, so floats are exact
                        total[p, :, d] += np.bincount(code[:, p], parts[:, p, d], minlength=n).astype(np.int64)
            out = [batch.column(key), batch.column(label), batch.column(vector), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*out, pa.nulls(len(parts), pa.list_(pa.int64()))], names=names)
        if sums and schema is not None:
            out = [pa.nulls(1, schema.field(key).type), pa.nulls(1, schema.field(label).type), pa.nulls(1, schema.field(vector).type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=names)

    names = [key, label, vector, "code", "error", "sums"]
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, `{vector}` array<bigint>, code binary, error long, sums array<bigint>")


def moved(codebooks: np.ndarray, table: DataFrame) -> np.ndarray:
    """The entries at the floor of their parts' means, from a table's rows of sums."""
    each = table.where("sums is not null").select(F.posexplode("sums").alias("at", "x"))
    n = codebooks.shape[0] * codebooks.shape[1]
    held = np.zeros(n * (codebooks.shape[2] + 1), object)
    for r in each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # as many rows as the entries have components
        held[r["at"]] = int(r.x)
    held = held.reshape(n, -1)
    out = codebooks.reshape(n, -1).copy()
    for k, (*sums, count) in enumerate(held.tolist()):
        if count:
            out[k] = [s // count for s in sums]
    return out.reshape(codebooks.shape)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """A written table (key, label, code, error) of the sound vectors, and the codebooks (part, entry, component) that decode them."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors.select(key, label, vector), vector)
    start = [r[0] for r in rows.orderBy(key, vector).limit(ENTRIES).select(vector).collect()]
    width = len(start[0]) if start else 0
    start = [v for v in start if len(v) == width]
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    codebooks = np.array(start, np.int64).reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    table, old = rows.where(F.size(vector) == width), None
    if not start:
        return table.select(key, label, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), codebooks
    checked(codebooks)
    for _ in range(rounds):
        path = common.scratch_path(spark, "codes")
        made = common.write_at(searched(table, codebooks, key, vector, label, True), path)
        codebooks = moved(codebooks, made)
        if old:
            common.drop_path(spark, old)
        table, old = made.where("sums is null").select(key, label, vector, "code"), path
    final = searched(table, codebooks, key, vector, label, False).select(key, label, "code", "error")
    done = common.write_table(final, "codes-final")
    if old:
        common.drop_path(spark, old)
    return done, codebooks


def decoded(codes: DataFrame, codebooks: np.ndarray, key: str = "vec_id") -> DataFrame:
    """key, vector: the entries that the codes name, in the vectors' own scale."""
    held = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in book]) for book in codebooks.tolist()])
    index = [F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int") for p in range(PARTS)]
    return codes.select(key, F.flatten(F.array(*[F.get(F.get(held, F.lit(p)), i) for p, i in enumerate(index)])).alias("vector"))


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: the errors of the rows with the same label, nulls together."""
    sums = codes.groupBy(label).agg(F.sum("error").alias("label_error")).withColumnRenamed(label, "_label")
    return codes.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


# fmt: off
def oracle_sql() -> str:
    """The same in SQL, for small tables: rounds are unrolled, and each part meets all entries."""
    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
      f"k AS (SELECT unnest(range({PARTS})) AS part)",
      f"d AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS p FROM v, k)",
      f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS e FROM d QUALIFY entry < {ENTRIES})"]
    near = """a{n} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, any_value(p) AS p, min({{'q': q, 'entry': entry}}) AS m FROM (
      SELECT vec_id, label, d.part, p, entry, list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS q FROM d JOIN b{n} ON d.part = b{n}.part) GROUP BY vec_id, part)"""
    for n, m in pairwise(range(ROUNDS + 1)):
        steps += [near.format(n=n), f"""s{m} AS (SELECT part, entry, list(c ORDER BY i) AS e FROM (SELECT part, m.entry AS entry, i, floor(sum(p[i])::DECIMAL(38,0) / count(*))::BIGINT AS c
      FROM a{n}, (SELECT unnest(range(1, (SELECT max(len(p)) FROM d) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry)""",
      f"b{m} AS MATERIALIZED (SELECT b{n}.part, b{n}.entry, coalesce(s{m}.e, b{n}.e) AS e FROM b{n} LEFT JOIN s{m} ON b{n}.part = s{m}.part AND b{n}.entry = s{m}.entry)"]
    steps += [near.format(n=ROUNDS), f"h AS (SELECT sha256(string_agg(list_aggregate(e, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})",
      f"""r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.q)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)"""]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"
