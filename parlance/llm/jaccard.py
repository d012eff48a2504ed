"""N-gram Jaccard join by pigeonholes over a partition of the shingle universe.

Two sets of a and b shingles with Jaccard similarity >= t differ in at most
H = (1 - t) / (1 + t) * (a + b) shingles.  Set sizes fall into bands of ratio 1 / t^3.
In a band shingles are hashed into m segments, and each set gives one signature for
each segment that holds any of its shingles: the digest of that subset.  A pair
meets in the band of its smaller set, so a set is indexed in its own band and, if a
partner can lie there, in the one below.

A set is covered in a band if the errors that its segments withstand add up to more
than H.  An exact signature is worth one, and a set that has more filled segments than
that leaves out the last ones: of a pair, all that the side which stops first has up to
there is also among the other's.  Where a set has too few filled segments,
the allocation also pays for the one-deletion neighbourhoods of its segments of two
or more shingles, which are then worth two: if a pair differs there by one shingle,
one side's subset is a neighbour of the other's.  Of a pair, one covered side is
enough.  Shingles that more than a share of all sets hold cost too much as
signatures: they are left out of the universe (differences outside only grow
smaller).  Sets that are not covered by what is left, being made of such shingles,
meet one another in a second index over the whole universe, where empty segments
count as well if need be.  So no pair is lost, whatever the data.

What meets is verified by its exact sets.  Work for copies is spared, not results:
equal sets are one class from the start; a first round over few segments links each
set to one leader; a second, over an eighth of the signatures, tries neighbours in a
random order of each group.  The last round has all signatures and tries every pair
that is not yet in one component.  Small groups give their pairs at once.  Members
of a large group have many signatures in common and differ only in what each has of
its own, so that nearly all of its pairs would fail: they are compared by 1024-bit
parity bitmaps, which bound the difference from below, in blocks of bounded size,
and only what the bound lets through is a pair.  Components come from verified links
alone; links inside one component are not counted.

Sets are of 64-bit shingle hashes, compared only within a pair.  Documents without
words (null or blank texts) have an empty set and link with nothing; fewer words
than a shingle are one shingle.  Rows with equal doc_id count as one document in
components and keep their rows; a null doc_id keeps its row and has a null component
unless an equal text has an id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._bytes import as_long, give_back, mix, shingles, text_slices, word_hashes, words
from parlance.llm._spark import Workspace, components

U64 = np.uint64
BITMAP = 1024
#: A band spans so many steps of 1 / t.  Sets in its lowest step are indexed in the band below as well: the wider
#: the bands, the fewer sets are indexed twice, but the fewer shingles the smallest sets of a band have a segment.
STEPS = 3


def edges(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each of n documents begins among sorted ``owner``, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def doc_sets(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit shingle), sorted and distinct."""
    start, end, doc = words(data, offsets)
    hashed, owner, _ = shingles(word_hashes(data, start, end), doc, len(ids), k)
    if len(hashed) < 32 * len(ids):
        order = np.lexsort((hashed, owner))
        hashed, owner = hashed[order], owner[order]
    else:  # documents lie one after the other: each is sorted in its place
        edge = edges(owner, len(ids)).tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            hashed[a:b].sort()
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashed[new]


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


class Bands:
    """Bands of set sizes for a threshold of num / den, with each band's H and number of segments."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        low, self.low, self.high = 1, [], []
        while low <= largest:
            high = low
            for _ in range(STEPS):
                high = max(high, high * den // num)
            self.low.append(low)
            self.high.append(high)
            low = high + 1
        self.low, self.high = np.array(self.low, np.int64), np.array(self.high, np.int64)
        self.segments = np.ceil(self.need(self.high, np.arange(len(self.high))) * 1.15).astype(np.int64) + 1

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def need(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """One more than the most shingles in which a set and a partner that meets it in ``band`` differ."""
        partner = np.where(self.of(size) == band, size * self.den // self.num, self.high[band])
        return (self.den - self.num) * (size + partner) // (self.den + self.num) + 1


def signatures(owner: np.ndarray, tokens: np.ndarray, size: np.ndarray, bands: Bands, band: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of documents in the given band each (-1: none); hot: a sorted array of left-out shingles."""
    outs = []
    live = band >= 0
    warm = np.ones(len(tokens), bool)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        warm = hot[i] != tokens
    for full in (False, True):
        use = live[owner] if full else live[owner] & warm
        docs = np.flatnonzero(live)
        if not len(docs):
            break
        m = np.where(live, bands.segments[band], 0)
        need = bands.need(size, band)
        base = np.cumsum(m) - m
        own, tok = owner[use], tokens[use]
        salt = mix(band.astype(U64) * U64(2) + U64(full))
        mixed = mix(tok ^ salt[own])
        cell = base[own] + ((mixed >> U64(20)) % m[own].astype(U64)).astype(np.int64)
        content = mix(mixed)
        total, count = np.zeros(int(m.sum()), U64), np.zeros(int(m.sum()), np.int64)
        np.add.at(total, cell, content)
        np.add.at(count, cell, 1)
        holder = np.repeat(np.arange(len(m)), m)
        place = mix((np.arange(len(holder)) - base[holder]).astype(U64) * U64(3) + salt[holder])
        filled = np.bincount(holder[count > 0], minlength=len(m))
        pairs = np.bincount(holder[count > 1], minlength=len(m))
        short = live & (filled < need)
        bare = short & (filled + pairs < need)
        emit = count > 0
        if full:
            emit |= bare[holder]
        rank = np.cumsum(count > 0)
        rank -= np.concatenate([[0], rank])[base][holder]
        at = np.flatnonzero(emit & (short[holder] | (rank <= need[holder])))
        outs.append((holder[at], mix(total[at] ^ place[at])))
        cut = np.flatnonzero(short[own] & (count[cell] > 1))
        outs.append((own[cut], mix((total[cell[cut]] - content[cut]) ^ place[cell[cut]])))
        live = bare
    return np.concatenate([o for o, _ in outs]) if outs else np.zeros(0, np.int64), np.concatenate([s for _, s in outs]) if outs else np.zeros(0, U64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, size) of a batch's packed sets."""
    parts = [unpack(x.as_py()) for x in column]
    size = np.array([len(p) for p in parts], np.int64)
    return np.repeat(np.arange(len(parts)), size), np.concatenate(parts) if parts else np.zeros(0, U64), size


def _slices(batch: pa.RecordBatch, rows: int = 400):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digest_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offsets in text_slices(batch.column(0), batch.column(1)):
            owner, tokens = doc_sets(ids, data, offsets, k)
            edge, d = edges(owner, len(ids)), []
            for seed in range(2):
                total = np.zeros(len(tokens) + 1, U64)
                np.cumsum(mix(tokens + U64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)), out=total[1:])
                d.append(np.diff(total[edge]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(edge)), pa.array(as_long(d[0])), pa.array(as_long(d[1]))], ["doc_id", "n", "d1", "d2"])
    give_back()


def set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offsets in text_slices(batch.column(0), batch.column(1)):
            owner, tokens = doc_sets(ids, data, offsets, k)
            edge = edges(owner, len(ids))
            spot = (mix(tokens) % U64(BITMAP)).astype(np.int64)
            odd = np.bincount(owner * BITMAP + spot, minlength=len(ids) * BITMAP) & 1
            maps = np.packbits(odd.astype(bool).reshape(len(ids), BITMAP), axis=1)
            sets = [tokens[a:b].astype("<u8").tobytes() for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(edge)), pa.array(sets, pa.binary()), pa.array([m.tobytes() for m in maps], pa.binary())], ["doc_id", "n", "tokens", "bitmap"])
    give_back()


def heavy_rows(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Shingles that at least half of ``share`` of a task's sets hold, with their counts there."""
    key, count, docs = np.zeros(0, U64), np.zeros(0, np.int64), 0
    waiting, size = [], 0

    def merge():
        nonlocal key, count, waiting, size
        fresh, n = np.unique(np.concatenate([key[:0], *waiting]), return_counts=True)
        both, weight = np.concatenate([key, fresh]), np.concatenate([count, n])
        order = np.argsort(both, kind="stable")  # two sorted runs
        both, weight = both[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
        key, count = both[first], np.add.reduceat(weight, first) if len(first) else weight
        waiting, size = [], 0

    for batch in batches:
        for part in _slices(batch):
            _, tokens, n = _flat(part.column(0))
            docs += len(n)
            waiting.append(tokens)
            size += len(tokens)
            if size > 1 << 19:
                merge()
                if len(key) > 1 << 20:  # shingles seen once go, so that the table stays small; what stands out stays
                    keep = count > 1
                    key, count = key[keep], count[keep]
    merge()
    keep = count >= max(4, share / 2 * docs)
    yield pa.RecordBatch.from_arrays([pa.array(as_long(key[keep])), pa.array(count[keep])], ["token", "n"])
    give_back()


def ring_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (signature, root, doc_id) sorted by signature: neighbours of one signature and different roots."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        sig, root, doc = cols if last is None else (np.concatenate([a, b]) for a, b in zip(last, cols, strict=True))
        last = [c[-1:] for c in (sig, root, doc)]
        at = np.flatnonzero((sig[1:] == sig[:-1]) & (root[1:] != root[:-1]))
        if len(at):
            both = np.unique(np.stack([np.minimum(doc[at], doc[at + 1]), np.maximum(doc[at], doc[at + 1])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


MET = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def meet_rows(batches: Iterator[pa.RecordBatch], pairs_a_row: int = 8, most_rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """From (signature, root, doc_id) sorted by signature and root: what meets in each signature.

    Small groups give (null, a, b), pairs of different roots.  Of a group with more than
    ``pairs_a_row`` pairs for each of its rows, or more than ``most_rows`` rows, nothing is
    paired here: its rows go on as (signature, root, doc_id).
    """
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    passing = None  # the signature of a group whose rows already go on

    def group_rows(sig, root, doc) -> Iterator[pa.RecordBatch]:
        if not len(sig):
            return
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
        change = np.flatnonzero((sig[1:] == sig[:-1]) & (root[1:] != root[:-1])) + 1
        spot = np.searchsorted(edge, change, "right") - 1
        x, y, onward = [], [], []
        for g in np.unique(spot).tolist():
            s, e = edge[g], edge[g + 1]
            cut = change[np.searchsorted(spot, g, "left") : np.searchsorted(spot, g, "right")]
            after = e - cut
            before = np.diff(np.concatenate([[s], cut]))
            if int((before * after).sum()) > pairs_a_row * (e - s):
                onward.append(np.arange(s, e))
                continue
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), e], strict=True):
                x.append(np.repeat(doc[s:lo], hi - lo))
                y.append(np.tile(doc[lo:hi], lo - s))
        if x:
            u, v = np.concatenate(x), np.concatenate(y)
            both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=MET)
        if onward:
            at = np.concatenate(onward)
            yield rows_on(sig[at], root[at], doc[at])

    def rows_on(sig, root, doc) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(root), pa.array(doc)], schema=MET)

    for batch in batches:
        sig, root, doc = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
        if passing is not None and len(sig):
            end = int(np.searchsorted(sig != passing, True))
            if end:
                yield rows_on(sig[:end], root[:end], doc[:end])
            sig, root, doc = sig[end:], root[end:], doc[end:]
        if not len(sig):
            held = [sig, root, doc]
            continue
        passing = None
        last = int(np.searchsorted(sig, sig[-1], "left"))
        yield from group_rows(sig[:last], root[:last], doc[:last])
        held = [sig[last:], root[last:], doc[last:]]
        if len(held[0]) > most_rows:
            passing = held[0][0]
            yield rows_on(*held)
            held = [h[:0] for h in held]
    yield from group_rows(*held)


def block_rows(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """From (key, side, doc_id, root, n, bitmap) sorted by key: pairs of different roots that sizes and bitmaps allow.

    Sides 0 and 1 are compared with one another, side 2 with itself.
    """
    held = None

    def pairs_of(side, doc, root, n, bits) -> tuple[list, list]:
        a, b = [], []
        for one, other in ((0, 1), (2, 2)):
            left, right = np.flatnonzero(side == one), np.flatnonzero(side == other)
            step = max(1, (1 << 16) // max(1, len(right)))
            for at in range(0, len(left), step):
                i = left[at : at + step]
                near = (root[i][:, None] != root[right][None, :]) & (np.minimum(n[i][:, None], n[right][None, :]) * den >= np.maximum(n[i][:, None], n[right][None, :]) * num)
                x, y = np.nonzero(near)
                x, y = i[x], right[y]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                keep = apart * (den + num) <= (den - num) * (n[x] + n[y])
                a.append(doc[x[keep]])
                b.append(doc[y[keep]])
        return a, b

    def out(cols) -> Iterator[pa.RecordBatch]:
        key, *rest = cols
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist()
        a, b = [], []
        for s, e in zip(edge, edge[1:], strict=False):
            got = pairs_of(*(c[s:e] for c in rest))
            a += got[0]
            b += got[1]
        u, v = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns[:5]] + [np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITMAP // 64)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        yield from out([c[:last] for c in cols])
        held = [c[last:] for c in cols]
    if held is not None:
        yield from out(held)


def texts_of(texts: DataFrame, reps: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``texts`` whose doc_id is in ``reps``, dealt by doc_id.

    Both sides are dealt into the buckets before the join, which needs no other
    exchange then: texts are shuffled, and lie on disk, once.
    """
    return texts.repartition(buckets, "doc_id").join(reps.repartition(buckets, "doc_id"), "doc_id").select("doc_id", "text")


class Join:
    """One run over the distinct sets of a corpus."""

    def __init__(self, work: Workspace, num: int, den: int, k: int, share: float, seeds: int, block: int):
        self.work, self.bands, self.k, self.share, self.seeds, self.block = work, Bands(num, den), k, share, seeds, block
        self.num, self.den = num, den

    def load(self, texts: DataFrame, reps: DataFrame, size_bytes: int) -> None:
        """Writes the sets of one document of each class, bucketed so that no join moves them again."""
        spark, k = self.work.spark, self.k
        # never fewer than shuffle partitions: a join is dealt at least so fine, and each of its tasks would write a file a bucket
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_bytes // (24 << 20)))
        sets = texts_of(texts, reps, buckets).mapInArrow(lambda it: set_rows(it, k), "doc_id bigint, n bigint, tokens binary, bitmap binary")
        self.name = f"sets_{uuid.uuid4().hex[:12]}"
        with self.work.writing(512):
            sets.write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", f"{self.work.root}/sets").format("parquet").option("compression", "none").saveAsTable(self.name)
        self.sets = spark.table(self.name)
        n = self.n = self.sets.count()
        share = self.share
        heavy = self.sets.select("tokens").mapInArrow(lambda it: heavy_rows(it, share), "token bigint, n bigint")
        heavy = heavy.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(32, share / 2 * n)).select("token")
        # at most 2 / share times the mean size of a set
        self.hot = np.sort(heavy.toArrow()["token"].to_numpy().view(U64))
        self.held = spark.sparkContext.broadcast(self.hot)

    def close(self) -> None:
        """Drops the sets, which no later step reads."""
        self.work.spark.sql(f"drop table {self.name}")
        self.work.drop("sets")
        self.held.destroy()

    def leaders(self) -> DataFrame:
        """(a, b): each set with the set that leads most of its groups over the first segments."""
        bands, seeds = self.bands, self.seeds

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(batch):
                    owner, tokens, size = _flat(part.column(1))
                    band = bands.of(size)
                    salt = mix(band.astype(U64) * U64(2) + U64(1))
                    mixed = mix(tokens ^ salt[owner])
                    segment = ((mixed >> U64(20)) % bands.segments[band][owner].astype(U64)).astype(np.int64)
                    use = segment < seeds
                    total, count = np.zeros(len(size) * seeds, U64), np.zeros(len(size) * seeds, np.int64)
                    cell = owner[use] * seeds + segment[use]
                    np.add.at(total, cell, mix(mixed[use]))
                    np.add.at(count, cell, 1)
                    at = np.flatnonzero(count)
                    sig = mix(total[at] ^ salt[at // seeds] ^ mix((at % seeds).astype(U64)))
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(sig)), pa.array(part.column(0).to_numpy()[at // seeds])], ["sig", "doc_id"])

        rows = self.sets.select("doc_id", "tokens").mapInArrow(emit, "sig bigint, doc_id bigint")
        rows = self.work.table(rows, "seeds")
        lead = rows.groupBy("sig").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("sig", "a")
        votes = rows.join(lead, "sig").where("a < doc_id").groupBy("doc_id", "a").agg(F.count("*").alias("n"))
        return votes.groupBy("doc_id").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", F.col("doc_id").alias("b"))

    def signed(self, roots: DataFrame, low: int, high: int) -> DataFrame:
        """(sig, root, doc_id) of all sets, dealt by signature; roots: (node, root) of linked sets; low, high: from which to before which eighth of the signatures."""
        bands, held = self.bands, self.held

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in _slices(batch):
                    owner, tokens, size = _flat(rows.column(1))
                    ids, root = rows.column(0).to_numpy(), rows.column(2).to_numpy()
                    own = bands.of(size)
                    for band in (own, np.where((own > 0) & (size * bands.num <= bands.high[own - 1] * bands.den), own - 1, -1)):
                        doc, sig = signatures(owner, tokens, size, bands, band, held.value)
                        mine = (sig >> U64(61) >= low) & (sig >> U64(61) < high)
                        doc, sig = doc[mine], sig[mine]
                        yield pa.RecordBatch.from_arrays([pa.array(as_long(sig >> U64(16))), pa.array((root - ids)[doc]), pa.array(ids[doc])], ["sig", "up", "doc_id"])
            give_back()

        known = self.sets.select("doc_id", "tokens").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rows = known.select("doc_id", "tokens", F.coalesce("root", "doc_id").alias("root")).mapInArrow(emit, "sig bigint, up bigint, doc_id bigint")
        # the root goes as a difference, mostly 0, and 48 bits are enough for what is verified: a shuffle of few bytes.
        # A set has many signatures, so that they are dealt finer than other tables: less to sort at once in a task
        parts = 4 * int(self.work.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(parts, "sig").select("sig", (F.col("doc_id") + F.col("up")).alias("root"), "doc_id")

    def neighbours(self, roots: DataFrame) -> DataFrame:
        """(a, b): in each group of some signatures, in a random order, neighbours of different components."""
        rows = self.signed(roots, 0, 1).sortWithinPartitions("sig", F.xxhash64("sig", "doc_id"))
        return rows.mapInArrow(ring_rows, "a bigint, b bigint").distinct()

    def candidates(self, roots: DataFrame) -> DataFrame:
        """(a, b) of different components that the signatures bring together.

        Large groups are compared by bitmaps in blocks of at most about ``block`` rows,
        whatever their size: the members of the group's most frequent component with all
        others, and the others with each other.
        """
        num, den, block = self.num, self.den, self.block
        rows = self.signed(roots, 0, 8).sortWithinPartitions("sig", "root")
        met = self.work.table(rows.mapInArrow(meet_rows, "sig bigint, a bigint, b bigint"), "met")
        self.work.release()
        few = met.where("sig is null").select("a", "b")
        many = met.where("sig is not null").select("sig", F.col("a").alias("root"), F.col("b").alias("doc_id"))
        of_root = many.groupBy("sig", "root").agg(F.count("*").alias("n"))
        of_sig = of_root.groupBy("sig").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top")).where("top.n < all")
        of_sig = of_sig.select("sig", F.col("top.root").alias("top"), F.ceil(F.col("top.n") / block).alias("p"), F.ceil((F.col("all") - F.col("top.n")) / block).alias("q"))
        many = many.join(of_sig, "sig").join(self.sets.select("doc_id", "n", "bitmap"), "doc_id")
        spot = F.xxhash64("doc_id")
        is_top = F.col("root") == F.col("top")
        many = many.withColumn("own", F.when(is_top, F.pmod(spot, F.col("p"))).otherwise(F.col("p") + F.pmod(spot, F.col("q"))))
        many = many.withColumn("other", F.explode(F.sequence(F.when(is_top, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        many = many.select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("key"), side.alias("side"), "doc_id", "root", "n", "bitmap")
        many = many.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: block_rows(it, num, den), "a bigint, b bigint")
        return few.unionByName(many).distinct()

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose exact sets reach the threshold; sizes and parity bitmaps, which bound the difference from below, go first."""
        num, den = self.num, self.den
        light = self.sets.select("doc_id", "n", "bitmap")
        near = pairs.join(light.toDF("a", "na", "ma"), "a").join(light.toDF("b", "nb", "mb"), "b")
        near = near.where((F.least("na", "nb") * den) >= F.greatest("na", "nb") * num)

        def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITMAP // 64) for i in (4, 5))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                yield batch.select([0, 1]).filter(pa.array(apart * (den + num) <= (den - num) * (na + nb)))

        near = near.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(sieve, "a bigint, b bigint")
        near = self.work.table(near, f"near_{name}")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    u, v = unpack(x.as_py()), unpack(y.as_py())
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(den * both >= num * (len(u) + len(v) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            give_back()

        # the second join moves one set of each pair: in parts of a third of all sets' bytes or so
        full = self.sets.select("doc_id", "tokens")
        parts = max(1, -(-3 * near.count() // max(self.n, 1)))
        links = None
        for i in range(parts):
            own = near.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i) if parts > 1 else near
            joined = own.join(full.toDF("a", "ta"), "a").join(full.toDF("b", "tb"), "b")
            found = joined.select("a", "b", "ta", "tb").mapInArrow(exact, "a bigint, b bigint")
            found = self.work.table(found, f"links_{name}_{i}", rows=128)
            links = found if links is None else links.unionByName(found)
        return links


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, hot_share: float = 0.001, seeds: int = 8, block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets), component_id: the smallest doc_id reachable by links of similarity >= num / den."""
    work = Workspace(docs.sparkSession, "jaccard")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    digests = texts.mapInArrow(lambda it: digest_rows(it, k), "doc_id bigint, n bigint, d1 bigint, d2 bigint")
    digests = work.table(digests, "digests")
    classes = digests.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = work.table(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    join = Join(work, num, den, k, hot_share, seeds, block)
    join.load(texts, classes.select(F.col("class_id").alias("doc_id")), total * 8)
    links = None
    for step in range(3):
        work.release()
        if step == 0:
            pairs = join.leaders()
        else:
            roots = work.table(components(work, links, f"cc_{step}"), f"roots_{step}")
            pairs = join.neighbours(roots) if step == 1 else join.candidates(roots)
        more = join.verify(pairs, str(step))
        work.drop("seeds", f"near_{step}", "met", f"roots_{step}")
        links = more if links is None else links.unionByName(more)
    join.close()
    work.release()
    roots = work.table(components(work, links, "cc_3"), "roots_3")
    named = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("d1", "d2", F.col("n").alias("_n"), "class_id", F.coalesce("root", "class_id").alias("component_id"))
    out = digests.join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), own.alias("component_id"))
