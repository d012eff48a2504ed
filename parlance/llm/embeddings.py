"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are scaled to length 1, turned by a random orthogonal matrix and reduced to
the signs of their components.  With each code goes its correction factor, the
inner product of the code (scaled to length 1) and its vector.  Of a query only four
bits a component are kept, rounded at random, so that bit operations give the inner
product with a code; divided by the factor it is an unbiased estimate of the cosine,
and its error stays within a confidence bound that the factor fixes.  Where estimate
and bound together stay below the threshold a pair is left; all others are computed
anew in double precision, and that alone makes a link.

Candidates come from cells around centroids fitted on a bounded sample of
``sample`` rows; centroids that lie together (cosine of ``threshold`` less
``slack``, taken transitively) share one cell, so that a dense group is compared
with itself in full, however many centroids it draws.  Every vector is indexed in
its nearest cell and compared with all vectors of its ``probes`` nearest cells.  A
pair is found if either has the other's cell among its own; each pair counts once
for both.  Large cells are divided into blocks, so a task holds a bounded number of
vectors a side, and what leaves a task are counts and a spanning forest of its
links, not pairs.

Equal vectors are one from the start and counted with their number.  Vectors that
are null, zero or hold null or non-finite components link with nothing; vectors of
different dimensions do not link with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._spark import Workspace, components


class Codes:
    """Rotation, codes and estimates for vectors of one dimension."""

    def __init__(self, dim: int, seed: int = 7, bound: float = 3.0):
        self.dim, self.width, self.bound = dim, -(-dim // 64) * 64, bound
        rnd = np.random.Generator(np.random.PCG64(seed))
        q, r = np.linalg.qr(rnd.standard_normal((self.width, self.width)))
        self.turn = (q * np.sign(np.diag(r)))[:dim]

    def pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, words) and correction factors (n) of unit vectors."""
        turned = unit @ self.turn
        return self.pack(turned > 0), np.abs(turned).sum(1) / np.sqrt(self.width)

    def query(self, unit: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Four bit-planes (n, 4, words), lowest value, step and sum of the levels."""
        turned = unit @ self.turn
        low = turned.min(1, keepdims=True)
        step = np.maximum(turned.max(1, keepdims=True) - low, 1e-12) / 15
        level = np.clip(np.floor((turned - low) / step + rnd.random(turned.shape)), 0, 15).astype(np.uint8)
        planes = np.stack([self.pack((level >> b) & 1) for b in range(4)], 1)
        return planes, low[:, 0], step[:, 0], level.sum(1, dtype=np.int64)

    def estimates(self, queries, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of all inner products and the bounds of their errors."""
        planes, low, step, level = queries
        dot = np.zeros((len(low), len(codes)), np.float32)
        for b in range(4):
            both = np.bitwise_count(planes[:, b, None, :] & codes[None, :, :]).sum(2, dtype=np.int32)
            dot += both.astype(np.float32) * (1 << b)
        ones = np.bitwise_count(codes).sum(1)
        # <code, query> with code components +-1 / sqrt(width)
        product = 2 * (step[:, None] * dot + low[:, None] * ones[None, :]) - (step * level + low * self.width)[:, None]
        value = product / np.sqrt(self.width) / factors[None, :]
        spread = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / np.sqrt(max(self.width - 1, 1))
        return value, self.bound * (spread[None, :] + step[:, None] / (2 * factors[None, :]))


def centroids(sample: np.ndarray, k: int, steps: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors."""
    rnd = np.random.Generator(np.random.PCG64(seed))
    sample = sample.astype(np.float32)
    centre = sample[rnd.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(steps):
        near = np.concatenate([(sample[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return centre


def merged(centre: np.ndarray, cosine: float) -> np.ndarray:
    """For each centroid the smallest of those it reaches in steps of at least ``cosine``."""
    unit_centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    label = np.arange(len(centre))
    x, y = (np.concatenate(z) for z in zip(*((a + i, b) for i in range(0, len(centre), 512) for a, b in [np.nonzero(unit_centre[i : i + 512] @ unit_centre.T >= cosine)]), strict=True))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


FOUND = "vec_id bigint, links bigint, other bigint"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph of pairs, without the smallest themselves."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(names))
    return names[keep], names[label[keep]]


def compare(codes: Codes, threshold: float, homes: dict, members: dict) -> pa.RecordBatch | None:
    """Links between a block of a cell's own vectors and a block of vectors that probe the cell."""
    hv, mv = unit(homes["vector"]), unit(members["vector"])
    code, factor = codes.encode(hv)
    rnd = np.random.Generator(np.random.PCG64(int(members["vec_id"][0]) & 0xFFFFFFFF))
    member_n, home_n, ea, eb = np.zeros(len(mv), np.int64), np.zeros(len(hv), np.int64), [], []
    step = max(16, (1 << 19) // len(hv))
    for at in range(0, len(mv), step):
        part = slice(at, at + step)
        value, bound = codes.estimates(codes.query(mv[part], rnd), code, factor)
        m, h = np.nonzero(value + bound >= threshold)
        m = m + at
        keep = members["vec_id"][m] != homes["vec_id"][h]
        m, h = m[keep], h[keep]
        if len(m) * 16 > value.size:  # a dense block: all products at once, those on the edge again one by one
            exact = (mv[part] @ hv.T)[m - at, h]
            edge = np.flatnonzero(np.abs(exact - threshold) < 1e-12)
        else:
            exact, edge = np.zeros(len(m)), np.arange(len(m))
        for i in range(0, len(edge), 65536):
            e = edge[i : i + 65536]
            exact[e] = np.einsum("ij,ij->i", mv[m[e]], hv[h[e]])
        m, h = m[exact >= threshold], h[exact >= threshold]
        if not len(m):
            continue
        member_n += np.bincount(m, homes["copies"][h], len(mv)).astype(np.int64)
        # the other finds this one by itself unless it doesn't probe this one's cell
        same = homes["own"][h] == members["own"][m]
        back = np.flatnonzero(~same)
        for i in range(0, len(back), 65536):
            o = back[i : i + 65536]
            o = o[~(homes["near"][h[o]] == members["own"][m[o]][:, None]).any(1)]
            home_n += np.bincount(h[o], members["copies"][m[o]], len(hv)).astype(np.int64)
        node, root = forest(members["vec_id"][m], homes["vec_id"][h])
        ea.append(node)
        eb.append(root)
    if not ea:
        return None
    add_id, add_n = [members["vec_id"][member_n > 0], homes["vec_id"][home_n > 0]], [member_n[member_n > 0], home_n[home_n > 0]]
    ids, inverse = np.unique(np.concatenate(add_id), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(add_n)).astype(np.int64)
    node, root = forest(np.concatenate(ea), np.concatenate(eb))
    links = np.concatenate([n, np.zeros(len(node), np.int64)])
    other = pa.array(np.concatenate([np.zeros(len(ids), np.int64), root]), mask=np.concatenate([np.ones(len(ids), bool), np.zeros(len(node), bool)]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, node])), pa.array(links), other], ["vec_id", "links", "other"])


def blocks(batches: Iterator[pa.RecordBatch], dim: int, codes: Codes, threshold: float) -> Iterator[pa.RecordBatch]:
    """Runs ``compare`` on each (cell, h, b) of rows sorted so."""
    key, rows = None, []

    def close():
        table = pa.Table.from_batches(rows).combine_chunks()
        cols = {c: table[c].to_numpy(zero_copy_only=False) for c in ("home", "vec_id", "copies", "own")}
        cols["vector"] = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(-1, dim)
        near = table["near"].to_pylist()
        cols["near"] = np.frombuffer(b"".join(near), np.int64).reshape(len(near), -1)
        home = cols["home"].astype(bool)
        if home.any() and not home.all():
            return compare(codes, threshold, *({c: x[pick] for c, x in cols.items()} for pick in (home, ~home)))
        return None

    for batch in batches:
        cell, h, b = (batch.column(i).to_numpy() for i in range(3))
        if not len(cell):
            continue
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (h[1:] != h[:-1]) | (b[1:] != b[:-1])) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
            now = (cell[s], h[s], b[s])
            if now != key and rows:
                if (got := close()) is not None:
                    yield got
                rows = []
            key = now
            rows.append(batch.slice(s, e - s))
    if rows and (got := close()) is not None:
        yield got


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, probes: int = 16, cell_rows: int = 256, sample: int = 16384, most_cells: int = 4096, block: int = 2048, slack: float = 0.1) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    clean = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = rows.withColumn("embedding", F.when(fine & F.col("vec_id").isNotNull(), clean))
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding", F.lit(2)))
    rows = work.table(rows, "rows")
    live = rows.where("embedding is not null")
    reps = live.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "embedding")).alias("s"), F.count("*").alias("copies"))
    reps = work.table(reps.select("k1", "k2", "s.*", "copies"), "reps")
    found = None
    for dim, n in reps.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect():  # a row for each dimension
        own = reps.where(F.size("embedding") == dim)
        chosen = own.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)) + 1).select("embedding").limit(2 * sample).toArrow()["embedding"]
        fitted = np.array(chosen.to_pylist() or own.select("embedding").first()[:1], np.float64).reshape(-1, dim)
        centre = centroids(unit(fitted), int(min(most_cells, max(1, -(-n // cell_rows)))))
        cells = work.table(_assign(work, own, dim, centre, merged(centre, threshold - slack), probes, block), f"cells_{dim}")
        codes = Codes(dim)
        work_rows = cells.repartition("cell", "h", "b").sortWithinPartitions("cell", "h", "b")
        got = work_rows.mapInArrow(lambda it, dim=dim, codes=codes: blocks(it, dim, codes, threshold), FOUND)
        found = got if found is None else found.unionByName(got)
    out = rows.select("vec_id", "k1", "k2", F.col("embedding").isNotNull().alias("_live"))
    if found is None:
        return out.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = work.table(found, "found")
    roots = components(work, found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = reps.select("k1", "k2", "copies", F.col("vec_id").alias("rep"))
    known = known.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.join(known, ["k1", "k2"], "left")
    n_links = F.when(F.col("_live"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("bigint")
    component = F.when(F.col("_live"), F.coalesce("root", "rep")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _assign(work: Workspace, own: DataFrame, dim: int, centre: np.ndarray, label: np.ndarray, probes: int, block: int) -> DataFrame:
    """Rows for the cells: each vector at home in one and as a member of ``probes``, large cells cut into blocks."""
    order = np.argsort(label, kind="stable")  # the centroids of a cell stand together
    cell_of, first = np.unique(label[order], return_index=True)
    probes = min(probes, len(cell_of))
    held = work.spark.sparkContext.broadcast((centre[order], cell_of, first))  # most_cells vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = part.num_rows
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                centre, cell_of, first = held.value
                best = np.maximum.reduceat(unit(v) @ centre.T.astype(np.float64), first, axis=1)
                near = cell_of[np.argsort(-best, axis=1, kind="stable")[:, :probes]].astype(np.int64)
                ids, copies = part.column(0).to_numpy(), part.column(2).to_numpy()
                who = np.repeat(np.arange(n), probes + 1)
                cell = np.concatenate([near[:, :1], near], 1).ravel()
                home = np.tile(np.arange(probes + 1) == 0, n)
                vec, lists = [x.tobytes() for x in v], [x.tobytes() for x in near]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), pa.array(ids[who]), pa.array(copies[who]), pa.array(near[who, 0]), pa.array([lists[i] for i in who], pa.binary()), pa.array([vec[i] for i in who], pa.binary())], ["cell", "home", "vec_id", "copies", "own", "near", "vector"])

    rows = own.select("vec_id", "embedding", "copies").mapInArrow(run, "cell bigint, home boolean, vec_id bigint, copies bigint, own bigint, near binary, vector binary")
    rows = work.table(rows, f"assigned_{dim}")
    # larger blocks for large cells: each of a cell's vectors goes to as many tasks as the other side has blocks
    most = min(8 * block, max(block, (1 << 21) // dim))

    def pieces(n):
        return F.ceil(n / F.least(F.greatest(n / 8, F.lit(block)), F.lit(most))).cast("int")

    counts = rows.groupBy("cell").agg(pieces(F.count_if("home")).alias("_h"), pieces(F.count_if(~F.col("home"))).alias("_b"))
    rows = rows.join(counts, "cell").where("_h > 0 and _b > 0")
    spread = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
    h = F.when(F.col("home"), F.array(F.pmod(spread, F.col("_h")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_h") - 1))
    rows = rows.withColumn("h", F.explode(h))
    b = F.when(F.col("home"), F.sequence(F.lit(0), F.col("_b") - 1)).otherwise(F.array(F.pmod(spread, F.col("_b")).cast("int")))
    return rows.withColumn("b", F.explode(b)).select("cell", "h", "b", "home", "vec_id", "copies", "own", "near", "vector")
