"""The trie of conversations that share their first turns, built from sorted neighbours.

A conversation is its key: a 16-byte digest per turn, laid end to end. Keys are sorted over ranges; neighbours in the
sorted sequence share some number of first turns (LCP). Within a stretch of the sequence, the edges between neighbours
are taken in descending depth and joined by union-find: when two components join at depth d, each is first led up from its own depth
to d, which closes a chain of nodes with the same members, and the join makes the branching node at d. What the first
or the last key of a stretch passes through may go on in the next stretch and cannot be closed: a stretch is contracted
to these two paths, each node on them with what has been summed up for it. Such paths are keys again, with edges to their
neighbours, so stretches, partitions and groups of partitions are merged by the same step until one is left.

A path has a node per turn, so what is held beside a batch of rows is two paths. A conversation is one row of about 24
bytes per turn. Ids of conversations that end at an open node leave as chunks of text; their digest needs them in order
and is taken in a stream that holds one chunk.

Defined results: turns come by ``turn`` (null first), those of equal number by the digest of role and text; null role and
null text are empty; repeated rows are turns of their own; rows without a conversation id are left out; an empty table has
no nodes. Very long texts count by their characters; other columns are ignored. Negative ids belong to the hundred below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa.session import materialize, scratch_path

WIDTH = 16  # bytes of a turn's digest
GROUP = 64  # stretches merged at a time
STEP_ROWS = 4096
NODE, CHUNK, PATH = 0, 1, 2
FIELDS = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("part", pa.int64()), ("at", pa.int32()), ("lens", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])
SCHEMA = ("kind int, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
          "part long, at int, lens array<int>, sums array<bigint>")


def told(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns of a conversation in order, each with its number, digest (in hex) and characters."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.length(t).alias("len"))
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").alias("conv_id"), one.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(stories: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, key, lens``: the first h turns of the first conversation of its hundred, then its own after its first h.

    h is the checksum of the id modulo ``most``. Only the first turns of one conversation in a hundred are joined.
    """
    own = stories.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(hundred)))
    heads = stories.where(F.pmod("conv_id", F.lit(hundred)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = own.join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    turns = both.select("conv_id", F.concat(head, rest).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key"), F.transform("turns", lambda x: x["len"]).alias("lens"))


def common(a: bytes, b: bytes) -> int:
    """Number of first turns that two keys share."""
    n = min(len(a), len(b)) // WIDTH
    k = 0
    while k + 64 <= n and a[WIDTH * k:WIDTH * (k + 64)] == b[WIDTH * k:WIDTH * (k + 64)]:
        k += 64
    while k < n and a[WIDTH * k:WIDTH * (k + 1)] == b[WIDTH * k:WIDTH * (k + 1)]:
        k += 1
    return k


@dataclass
class Node:
    """What is known of a node so far."""

    n: int = 0  # members
    least: int | None = None  # smallest member
    kids: int = 0
    leaves: int = 0  # childless nodes below it
    saved: int = 0  # of the nodes below it
    ends: list[int] = field(default_factory=list)  # ids that end here and were not sent away yet
    sent: bool = False  # ids that end here went as chunks
    open: bool = False  # was on an open path, so its children may look for it by key
    waiting: list[int] = field(default_factory=list)  # rows of children that need its smallest member

    def add(self, other: Node) -> None:
        """Take in the part of the same node that lies to the right."""
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends.extend(other.ends)
        self.sent |= other.sent
        self.open |= other.open
        self.waiting.extend(other.waiting)


@dataclass
class Path:
    """A key with the nodes that have something summed up, by depth."""

    key: bytes
    lens: list[int]
    nodes: dict[int, Node]

    def keys(self, depths: list[int]) -> dict[int, bytes]:
        """Digests that name the nodes at some depths."""
        out, sofar, h = {}, 0, hashlib.blake2b(digest_size=WIDTH)
        for d in sorted(depths):
            h.update(self.key[WIDTH * sofar:WIDTH * d])
            sofar = d
            out[d] = h.copy().digest()
        return out


class Sink:
    """Rows of one batch, column by column."""

    def __init__(self) -> None:
        self.rows: list[list] = []

    def put(self, **values) -> int:
        self.rows.append([values.get(n) for n in FIELDS.names])
        return len(self.rows) - 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)


_PARENT, _PARENT_CONV = FIELDS.names.index("parent"), FIELDS.names.index("parent_conv_id")


def _flush_ends(node: Node, name: bytes, sink: Sink) -> None:
    if node.ends:
        sink.put(kind=CHUNK, key=name, conv_id=node.ends[0], ends=",".join(map(str, node.ends)))
        node.ends, node.sent = [], True


def _lead_up(path: Path, nodes: dict[int, Node], top: int, sink: Sink) -> None:
    """Close the nodes of a component that lie deeper than ``top``, each into its parent."""
    names: dict[int, bytes] = {}
    depth = max(nodes)
    if any(x.open for d, x in nodes.items() if d > top):
        names = path.keys([d for d in range(top + 1, depth + 1)])
    while depth > top:
        node = nodes.pop(depth)
        if node.sent:
            _flush_ends(node, names[depth], sink)
        node.leaves = node.leaves or 1
        if depth:
            node.saved += (node.n - 1) * path.lens[depth - 1]
        ends = None if node.sent else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        row = sink.put(kind=NODE, key=names[depth] if node.open else None, conv_id=node.least, depth=depth, n_convs=node.n, n_children=node.kids, n_leaves=node.leaves,
                       saved_tokens=node.saved, ends=ends)
        for child in node.waiting:
            sink.rows[child][_PARENT_CONV] = node.least
        depth -= 1
        if depth >= 0:
            parent = nodes.setdefault(depth, Node())
            parent.add(Node(n=node.n, least=node.least, kids=1, leaves=node.leaves, saved=node.saved, waiting=[row]))


def _open_nodes(path: Path, sink: Sink) -> None:
    """Send away what an open path must not hold: ids that end there and children that wait."""
    names = path.keys(list(path.nodes))
    for d, node in path.nodes.items():
        node.open = True
        _flush_ends(node, names[d], sink)
        for child in node.waiting:
            sink.rows[child][_PARENT] = names[d]
        node.waiting = []


def merge(paths: list[Path], sink: Sink, final: bool = False) -> list[Path]:
    """Join a sorted stretch of paths; closed nodes go to the sink, the one or two paths that stay open are returned.

    ``final`` closes these as well.
    """
    if not paths:
        return []
    last = len(paths) - 1
    root = list(range(len(paths)))
    nodes = [p.nodes for p in paths]
    bound = [not final and k in (0, last) for k in range(len(paths))]
    below: dict[int, Node] | None = None  # of the last path, deeper than it goes together with the first one

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    depths = [common(paths[k].key, paths[k + 1].key) for k in range(last)]
    for k in sorted(range(last), key=lambda k: -depths[k]):
        d, a, b = depths[k], find(k), find(k + 1)
        for c in (a, b):
            if not bound[c]:
                _lead_up(paths[c], nodes[c], d, sink)
        left, right = nodes[a], nodes[b]
        if bound[a] and bound[b]:
            below = {x: right.pop(x) for x in [x for x in right if x > d]}
        if len(left) >= len(right):
            joined = left
            for x, node in right.items():
                if x in left:
                    left[x].add(node)
                else:
                    left[x] = node
        else:
            joined = right
            for x, node in left.items():
                if x in right:
                    node.add(right[x])
                right[x] = node
        # a bound component is named by the path that stays open
        keep, gone = (b, a) if bound[b] and not bound[a] else (a, b)
        root[gone] = keep
        nodes[keep] = joined
    top = find(0)
    if final:
        _lead_up(paths[top], nodes[top], -1, sink)
        return []
    open_paths = [Path(paths[0].key, paths[0].lens, nodes[top])]
    if below:
        open_paths.append(Path(paths[last].key, paths[last].lens, below))
    for p in open_paths:
        _open_nodes(p, sink)
    return open_paths


def _put_paths(paths: list[Path], part: int, sink: Sink) -> None:
    for at, p in enumerate(paths):
        sums: list[int] = []
        for d, x in sorted(p.nodes.items()):
            # a node on the way that only has parts elsewhere has no smallest member yet
            sums += [d, x.n, x.least if x.least is not None else 0, int(x.least is not None), x.kids, x.leaves, x.saved, int(x.sent)]
        sink.put(kind=PATH, part=part, at=at, key=p.key, lens=p.lens, sums=sums)


def _got_path(key: bytes, lens: list[int], sums: list[int]) -> Path:
    nodes = {}
    for k in range(0, len(sums), 8):
        d, n, least, known, kids, leaves, saved, sent = sums[k:k + 8]
        nodes[d] = Node(n, least if known else None, kids, leaves, saved, sent=bool(sent), open=True)
    return Path(key, lens, nodes)


def _stretches(rows: DataFrame, raw: bool, final: bool) -> DataFrame:
    """Merge the sorted rows of each part; ``rows``: part, key, lens and the id of a conversation or the sums of a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held, part = Sink(), [], None
        for whole in batches:
            for start in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(start, STEP_ROWS)
                for now, key, lens, x in zip(*[c.to_pylist() for c in batch.columns]):
                    if now != part:
                        if part is not None:
                            _put_paths(merge(held, sink), part, sink)
                            held = []
                        part = now
                    held.append(Path(key, lens, {len(lens): Node(n=1, least=x, ends=[x])}) if raw else _got_path(key, lens, x))
                held = merge(held, sink)
                yield sink.batch()
        if part is not None:
            left = merge(held, sink, final)
            _put_paths(left, part, sink)
        yield sink.batch()

    return rows.mapInArrow(run, SCHEMA)


def _digests(chunks: DataFrame) -> DataFrame:
    """``key, ends``: digest of a node's chunks in the order of ids, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if key != name:
                    if h is not None:
                        done.append((name, h.hexdigest()))
                    name, h = key, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends"])

    return chunks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(run, "key binary, ends string")


def trie(stories: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per distinct sequence of first turns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``stories``: ``conv_id`` (distinct), ``key`` and ``lens`` from :func:`rebuilt`.
    """
    spark = stories.sparkSession
    sorted_rows = materialize(stories, "stories").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = sorted_rows.select(F.spark_partition_id().cast("long").alias("part"), "key", "lens", "conv_id")
    made: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "trie")
        df.write.partitionBy("kind").parquet(path)
        made.append(path)
        return of_kind(path, PATH).select("part", "at", "key", "lens", "sums")

    def of_kind(path: str, kind: int) -> DataFrame:
        return spark.read.schema(SCHEMA).option("basePath", path).parquet(path).where(F.col("kind") == kind)

    paths = step(_stretches(rows, raw=True, final=False))
    while True:
        most = paths.agg(F.max("part")).first()[0]
        if most is None:
            break
        final = most < group
        grouped = paths.select(F.expr(f"part div {group}").alias("g"), "part", "at", "key", "lens", "sums")
        ordered = (grouped.repartition(1) if final else grouped.repartition("g")).sortWithinPartitions("g", "part", "at")
        paths = step(_stretches(ordered.select(F.col("g").alias("part"), "key", "lens", "sums"), raw=False, final=final))
        if final:
            break

    def all_of(kind: int) -> DataFrame:
        out = of_kind(made[0], kind)
        for path in made[1:]:
            out = out.unionByName(of_kind(path, kind))
        return out

    nodes, chunks = all_of(NODE).drop("kind", "part", "at", "lens", "sums"), all_of(CHUNK)
    opened = nodes.where("key is not null")
    # nodes that were open at some time: two paths per stretch, so few beside all nodes
    parents = opened.select(F.col("key").alias("parent"), F.col("conv_id").alias("__conv"))
    found = nodes.where("parent is not null").join(parents, "parent", "left").withColumn("parent_conv_id", F.col("__conv")).drop("__conv")
    known = nodes.where("parent is null").unionByName(found)
    late = known.where("ends is null").drop("ends").join(_digests(chunks), "key", "left")
    out = known.where("ends is not null").unionByName(late)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
