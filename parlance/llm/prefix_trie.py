"""Conversation prefix trie: every distinct sequence of first turns is a node.

Turns become 128-bit digests of (role, text) where they are read; what stands for a
prefix is the digest of its parent's digest and its last turn, chained through the
turns of a conversation as they stream by in order.  Nodes are a hash aggregation by
that digest, so exact copies and common openings collapse before anything is dealt.

Along a path whose members stay the same a trie only repeats itself: such nodes are
one link (smallest member, number of members).  A link with one member is a tail and
has a closed form.  Links with more are dealt by the digest of the first turn; a task
builds pointer dictionaries over its links and sums leaves and savings in an iterative
postorder.  A first turn with more than ``most_links`` links is cut at its top link,
and the subtries below are dealt by their next turn, again and again until all fit;
the cut links are then summed from the results below them.  Nothing is capped.

Defined results: rows without conv_id belong to no conversation and are left out;
a null role or text is empty; a null turn comes before all others; equal turns are
ordered by role, then text, and repeated rows are turns of their own.  A conversation
whose rebuilt form has no turns is a member of the root, and ends there.  An empty
table has no nodes.  Other columns are not read.

The digests of ends are sequential by nature (SHA-256 of all members in order): ids
are joined to chunks in a range-partitioned sort, and one task streams the few chunks
of a node; it holds one chunk at a time.  One conversation's turns stream through one
task in order (their digests; texts spill in Spark's sort), held nowhere as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._spark import Workspace

ROOT = b"\0" * 16
EMPTY = hashlib.sha256(b"").hexdigest()
CHUNK = 4096


def head_length(key: str = "conv_id") -> Column:
    """How many turns a conversation takes over: crc32 of its id as text, modulo 4."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 4).cast("int")


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation in order, from 0."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    known = rows.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))))
    words = F.size(F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("bigint")
    known = known.withColumns({"digest": digest, "words": words})
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    return known.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words) of the rebuilt conversations: a head from conversation c - c % 20, then the own turns after it."""
    heads = turns.where("pos < 3").select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    taken = ids.where("h > 0").join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "words")
    size = heads.groupBy("base").agg(F.count("*").cast("int").alias("_have"))
    moved = ids.join(size, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("_have", F.lit(0))).alias("_at"))
    own = turns.join(moved, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("_at")).alias("pos"), "digest", "words")
    return taken.unionByName(own)


def prefixes(turns: DataFrame, parts: int) -> DataFrame:
    """(conv_id, depth, node, parent, first, words, last): a row for each conversation and depth of at least 1."""
    ordered = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "words")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("first", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])
        held: tuple | None = None
        for batch in batches:
            out = []
            for conv, digest, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = held is not None and held[0] == conv
                if held is not None:
                    out.append((*held, not same))
                before = held[2] if same else ROOT
                node = hashlib.blake2b(before + digest, digest_size=16).digest()
                held = (conv, held[1] + 1 if same else 1, node, before, held[4] if same else node, words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, True), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(chain, "conv_id bigint, depth bigint, node binary, parent binary, first binary, words bigint, last boolean")


def sum_links(part: pd.DataFrame) -> pd.DataFrame:
    """Leaves and savings of the subtries below and within each link of a task.

    part: node (the link's top), parent (the top of the link above), gain (of the
    link's own nodes), tails (children with one member), childless.  Children hang in
    pointer dictionaries; an explicit stack walks them in postorder, so depth has no limit.
    """
    children: dict[bytes, dict[bytes, dict]] = {}
    for node in part["node"]:
        children[node] = {}
    tops = []
    for node, parent in zip(part["node"], part["parent"], strict=True):
        above = children.get(parent)
        if above is None:
            tops.append(node)
        else:
            above[node] = children[node]
    own = {n: (t + c, g) for n, t, c, g in zip(part["node"], part["tails"], part["childless"], part["gain"], strict=True)}
    done: dict[bytes, tuple[int, int, int]] = {}
    for top in tops:
        stack = [(top, iter(children[top]))]
        while stack:
            node, left = stack[-1]
            below = next(left, None)
            if below is not None:
                stack.append((below, iter(children[below])))
                continue
            stack.pop()
            leaves, gain = own[node]
            below = 0
            for child in children[node]:
                more = done[child]
                leaves, below = leaves + more[0], below + more[1] + more[2]
            done[node] = (leaves, below, gain)
    found = [done[n] for n in part["node"]]
    return pd.DataFrame({"conv_id": part["conv_id"], "n_convs": part["n_convs"], "node": part["node"], "above": part["parent"], "leaves": [x[0] for x in found], "below": [x[1] for x in found], "saved": [x[1] + x[2] for x in found]})


def end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): SHA-256 of the ids in ascending order, joined by commas."""
    ordered = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        row = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "least": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})
        for batch in batches:
            for key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != node or len(ids) >= CHUNK):
                    yield row()
                    ids = []
                node = key
                ids.append(conv)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"node": pa.array([d[0] for d in done], pa.binary()), "ends_sha256": [d[1] for d in done]})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})

    joined = ordered.mapInArrow(chunks, "node binary, least bigint, ids string")
    return joined.repartition(parts, "node").sortWithinPartitions("node", "least").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, most_links: int = 20_000) -> DataFrame:
    """A row for each node of the trie over conversations (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and node_id (hex, the prefix's digest).
    most_links: of a task's group; a group with more is dealt by its next turn.
    """
    work = Workspace(rows.sparkSession, "trie")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = work.table(numbered_turns(rows), "turns")
    ids = turns.where("pos = 0").select("conv_id", head_length().alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    paths = work.table(prefixes(rebuilt(turns, ids), parts), "paths")

    found = paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("first").alias("first"),
        F.count("*").alias("n_convs"), F.first("words").alias("words"), F.sum(F.col("last").cast("bigint")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end_id"),
    )
    nodes = work.table(found.withColumn("gain", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    # what shared nodes need: their children, and the top and sums of their links
    below = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("bigint")).alias("tails"))
    shared = nodes.where("n_convs > 1").join(below, "node", "left").fillna(0, ["n_children", "tails"])
    run = Window.partitionBy("conv_id", "n_convs").orderBy(F.desc("depth"))
    shared = work.table(shared.withColumn("_within", F.sum("gain").over(run)), "shared")
    links = shared.groupBy("conv_id", "n_convs").agg(F.min_by("node", "depth").alias("node"), F.min_by("parent", "depth").alias("_parent"), F.max("depth").alias("bottom"), F.sum("gain").alias("gain"), F.max_by("tails", "depth").alias("tails"), F.max_by((F.col("n_children") == 0).cast("bigint"), "depth").alias("childless"), F.first("first").alias("key"))
    top = links.select("conv_id", "n_convs", F.col("node").alias("parent"))
    up = shared.select(F.col("node").alias("_parent"), "conv_id", "n_convs").join(top, ["conv_id", "n_convs"]).select("_parent", "parent")
    live = work.table(links.join(up, "_parent", "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT))).drop("_parent"), "links")

    cuts, step = [], 0
    while True:
        sized = live.groupBy("key").agg(F.count("*").alias("_n"), F.max(F.when(F.col("node") == F.col("key"), F.col("bottom"))).alias("_cut")).where(F.col("_n") > most_links)
        big = work.table(sized.drop("_n"), f"big_{step}")
        if big.isEmpty():
            break
        marked = live.join(big, "key", "left")
        cuts.append(work.table(marked.where("_cut is not null and node = key").drop("_cut"), f"cut_{step}"))
        turn = paths.select("conv_id", (F.col("depth") - 1).alias("_cut"), F.col("node").alias("_next"))
        deeper = marked.where("_cut is not null and node <> key").join(turn, ["conv_id", "_cut"]).drop("key", "_cut").withColumnRenamed("_next", "key")
        live = work.table(marked.where("_cut is null").drop("_cut").unionByName(deeper), f"live_{step}")
        step += 1

    total = live.count()
    buckets = max(parts, -(-total // max(most_links, 1)))
    sums = live.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).select("_bucket", "conv_id", "n_convs", "node", "parent", "gain", "tails", "childless")
    schema = "conv_id bigint, n_convs bigint, node binary, above binary, leaves bigint, below bigint, saved bigint"
    sums = work.table(sums.groupBy("_bucket").applyInPandas(lambda part: sum_links(part), schema), "sums")
    for i, cut in reversed(list(enumerate(cuts))):
        under = sums.groupBy(F.col("above").alias("node")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        mine = cut.join(under, "node", "left").select("conv_id", "n_convs", "node", F.col("parent").alias("above"), (F.col("tails") + F.col("childless") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), F.coalesce("_saved", F.lit(0)).alias("below"), (F.col("gain") + F.coalesce("_saved", F.lit(0))).alias("saved"))
        sums = work.table(sums.unionByName(mine), f"sums_{i}")

    # below a link's last node, and within the link from a node on
    several = end_digests(paths.where("last").join(shared.where("n_ends > 1").select("node"), "node", "left_semi").select("node", "conv_id"), parts)
    values = shared.join(sums.select("conv_id", "n_convs", "leaves", "below"), ["conv_id", "n_convs"])
    values = values.select("node", "n_children", F.col("leaves").alias("n_leaves"), (F.col("below") + F.col("_within")).alias("saved_tokens")).join(several, "node", "left")
    whole = ids.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    alone = F.when(F.col("n_ends") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    parent = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    inner = nodes.join(values, "node", "left").join(parent, "parent", "left").select(
        "conv_id", "depth", F.coalesce("_above", F.when(F.col("depth") == 1, F.lit(whole.least).cast("bigint")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", 1 - F.col("n_ends")).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", alone).alias("ends_sha256"), F.lower(F.hex("node")).alias("node_id"),
    )
    if not whole.n:
        return inner
    silent = end_digests(ids.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id"), parts).first()
    tops = nodes.where("depth = 1").agg(F.count("*").alias("children"), F.coalesce(F.sum((F.col("n_convs") == 1).cast("bigint")), F.lit(0)).alias("tails")).first()
    under = sums.where(F.col("above") == F.lit(ROOT)).agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    root = (whole.least, 0, None, whole.n, tops.children, tops.tails + under.leaves if tops.children else 1, under.saved, silent.ends_sha256 if silent else EMPTY, ROOT.hex())
    return inner.unionByName(rows.sparkSession.createDataFrame([root], inner.schema))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same nodes, straight from the definition, over (conv_id, turn, role, text); for tests."""
    import re
    import zlib

    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + ts[h:]
    members: dict[tuple, list] = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for node, cs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under) for x in under)
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in under if x)
        ends = hashlib.sha256(",".join(str(c) for c in cs if len(made[c]) == len(node)).encode()).hexdigest()
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(kids), leaves, saved, ends))
    return out


#: DuckDB: prefixes as lists; CRC-32 bit by bit, with its fixed reversed polynomial 0xEDB88320.
SQL = r"""
WITH RECURSIVE known AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM known),
bytes AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT conv_id FROM known)
  UNION ALL SELECT conv_id, s, i + 1, list_reduce(list_prepend(xor(crc, ascii(substr(s, i + 1, 1))::BIGINT), list_value(0, 0, 0, 0, 0, 0, 0, 0)::BIGINT[]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM bytes WHERE i < length(s)),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM bytes WHERE i = length(s)),
made AS (SELECT i.conv_id, 0 AS part, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base WHERE t.pos < i.h
  UNION ALL SELECT i.conv_id, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id WHERE t.pos >= i.h),
whole AS (SELECT i.conv_id, coalesce(list(struct_pack(role := m.role, text := m.text) ORDER BY part, pos) FILTER (WHERE m.pos IS NOT NULL), []) AS seq FROM ids i LEFT JOIN made m ON m.conv_id = i.conv_id GROUP BY i.conv_id),
paths AS (SELECT conv_id, d AS depth, sha256(CAST(seq[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(seq[1:d - 1] AS VARCHAR)) END AS parent, len(seq) = d AS last,
    CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM whole, unnest(range(len(seq) + 1)) AS u(d)),
nodes AS (SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM paths GROUP BY ALL),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n_convs - 1) * x.words) AS saved FROM above a JOIN nodes x ON x.node = a.node LEFT JOIN kids k ON k.node = a.node GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.top = n.node
"""
