"""The trie of conversation prefixes, as balanced parentheses per shard of sorted conversations.

A turn is known by 128 bits of SHA-256 of its role and text; texts never move. Conversations
are sorted by their turns over the whole cluster, so those with a common prefix are
neighbours, however many they are: a first turn that a third of all conversations share
simply takes many shards. A shard is a stretch of that order of bounded size. Its trie
is written as balanced parentheses in one pass, and everything about a subtree is read off between a
parenthesis and its partner, which range-minimum blocks over the excess find: leaves by the
rank of ``()`` pairs, members by the stretch of sorted conversations, savings by cumulative
sums in preorder. (Of the range min-max blocks only the minima are needed to find partners.)

Only nodes on the first or last path of a shard, its spine, can be in other shards too. Their counts are
merged by groups of the prefix's hash; what a merged node adds to its ancestors goes by
suffix sums along the one spine path that owns it. All other nodes are final where they are.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from claimtrace.sources import written

#: turns and conversations of a shard, at which it ends with the next batch
SHARD_ROWS = 500_000
BLOCK = 64
KEY = 32
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NOTHING = hashlib.sha256(b"").hexdigest()
_ROWS = (
    "shard bigint, side int, node string, parent string, depth bigint, words bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, first_end bigint"
)


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with minima of its excess by blocks and their tree."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-len(opens) // BLOCK))
        width = 1 << (blocks - 1).bit_length()
        level = np.full(width * BLOCK, len(opens) + 1)
        level[: len(opens)] = self.excess
        level = level.reshape(width, BLOCK).min(axis=1)
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).min(axis=1)
            levels.append(level)
        self.first = np.cumsum([0, *map(len, levels)])[:-1]
        self.minima = np.concatenate(levels)

    def _scan(self, at: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in the block, from ``at`` on, whose excess is under ``below``; or not found."""
        found, at = np.full(len(at), -1), at.copy()
        live = np.flatnonzero(at < len(self.opens))
        while len(live):
            here = self.excess[at[live]] < below[live]
            found[live[here]] = at[live[here]]
            live = live[~here]
            at[live] += 1
            live = live[(at[live] % BLOCK != 0) & (at[live] < len(self.opens))]
        return found, found >= 0

    def close(self, places: np.ndarray) -> np.ndarray:
        """The partner of each opening parenthesis: the next place where the excess is under its own."""
        below = self.excess[places]
        # a pair `()` that ends a block has its partner at the head of the next
        inside = (places + 1) % BLOCK != 0
        out, ok = np.full(len(places), -1), np.zeros(len(places), dtype=bool)
        out[inside], ok[inside] = self._scan(places[inside] + 1, below[inside])
        rest = np.flatnonzero(~ok)
        below = below[rest]
        block, level = places[rest] // BLOCK + 1, np.zeros(len(rest), dtype=np.int64)
        up = np.arange(len(rest))
        while len(up):
            # from a node without a place low enough to the next, in the widest tree node that starts there
            up = up[self.minima[self.first[level[up]] + block[up]] >= below[up]]
            block[up] += 1
            even = up
            while len(even := even[block[even] % 2 == 0]):
                block[even] //= 2
                level[even] += 1
        down = np.flatnonzero(level)
        while len(down):
            level[down] -= 1
            block[down] *= 2
            block[down] += self.minima[self.first[level[down]] + block[down]] >= below[down]
            down = down[level[down] > 0]
        out[rest] = self._scan(block * BLOCK, below)[0]
        return out


class _Minima:
    """Smallest value of any stretch, by stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(values) >= 1 << len(self.levels):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), dtype=np.int64)
        size = np.frexp((stop - start).astype(np.float64))[1] - 1
        size = np.minimum(size, len(self.levels) - 1)
        for k in np.unique(size):
            mine = size == k
            level = self.levels[k]
            out[mine] = np.minimum(level[start[mine]], level[stop[mine] - (1 << k)])
        return out


class Shard:
    """The trie of some sorted conversations; nodes are numbered in preorder, the root is 0."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, words: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        # turns in common with the conversation before
        owner = np.repeat(np.arange(len(ids)), sizes)
        depth = np.arange(len(keys)) - offsets[owner]
        prior = np.maximum(owner - 1, 0)
        comparable = (owner > 0) & (depth < sizes[prior])
        other = np.where(comparable, offsets[prior] + depth, 0)
        differs = ~comparable
        differs[comparable] = keys[comparable] != keys[other[comparable]]
        at = np.flatnonzero(differs)
        place = np.searchsorted(at, offsets[:-1])
        first = np.append(at, len(keys))[place]
        common = np.minimum(first, offsets[1:]) - offsets[:-1]
        new = depth >= common[owner]
        self.depth = np.append(0, depth[new] + 1)
        self.words = np.append(0, words[new])
        # parentheses: before each conversation those its predecessor does not share are closed
        closes = np.append(np.append(0, sizes[:-1] - common[1:]), sizes[-1] + 1)
        opens = np.append(sizes - common, 0)
        opens[0] += 1
        counts = np.stack([closes, opens], axis=1).ravel()
        self.tree = tree = Parentheses(np.repeat(np.tile([False, True], len(closes)), counts))
        self.at = np.flatnonzero(tree.opens)
        close = tree.close(self.at)
        self.size = (close - self.at + 1) // 2
        self.ids = ids
        self.end = np.cumsum(sizes - common)
        nodes = np.arange(len(self.at))
        self.member_from = np.searchsorted(self.end, nodes)
        self.member_to = np.searchsorted(self.end, nodes + self.size)
        self.n_convs = self.member_to - self.member_from
        self.conv_id = _Minima(ids)(self.member_from, self.member_to)
        # the parent is the last node one level up that was opened before
        by_level = np.lexsort((nodes, self.depth))
        ranks = self.depth[by_level] * len(nodes) + by_level
        self.parent = by_level[np.maximum(np.searchsorted(ranks, (self.depth - 1) * len(nodes) + nodes) - 1, 0)]
        self.parent[0] = -1
        last = np.searchsorted(ranks, (np.arange(sizes[-1] + 1) + 1) * len(nodes)) - 1
        self.first_path, self.last_path = nodes[: sizes[0] + 1], by_level[last]
        self.spine = np.zeros(len(nodes), dtype=bool)
        self.spine[self.first_path] = self.spine[self.last_path] = True
        # sums over subtrees, without the nodes of the spine
        leaf = tree.opens[:-1] & ~tree.opens[1:]
        leaf[self.at[self.spine]] = False
        ranked = np.append(0, np.cumsum(leaf))
        self.n_leaves = ranked[np.minimum(close, len(leaf))] - ranked[self.at]
        value = np.where(self.spine, 0, (self.n_convs - 1) * self.words)
        summed = np.append(0, np.cumsum(value))
        self.saved = summed[nodes + self.size] - summed[nodes]
        children = self.parent[~self.spine]
        self.n_children = np.bincount(children, minlength=len(nodes))

    def ends(self, node: int) -> np.ndarray:
        """Conversations that end at a node, in ascending order."""
        return self.ids[self.member_from[node] : np.searchsorted(self.end, node, side="right")]


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _rows(number: int, shard: Shard, first_keys: bytes, last_keys: bytes) -> Iterator[pa.RecordBatch]:
    """A shard's nodes: those within it are complete, those of its spine are shares to be merged."""
    paths = [(0, shard.first_path, first_keys)]
    if not np.array_equal(shard.first_path, shard.last_path):
        paths.append((1, shard.last_path, last_keys))
    names: dict[int, str] = {}
    spine = []
    for side, path, keys in paths:
        running, before = hashlib.sha256(), None
        for d, node in enumerate(path.tolist()):
            running.update(keys[(d - 1) * KEY : d * KEY] if d else b"")
            name = running.hexdigest()
            # a node of both paths counts once
            own = node not in names
            names[node] = name
            ends = shard.ends(node) if own else shard.ids[:0]
            counts = [int(x[node]) if own else 0 for x in (shard.n_convs, shard.n_children, shard.n_leaves, shard.saved)]
            conv = int(shard.conv_id[node]) if own else None
            listed, first_end = (_listed(ends), int(ends[0])) if len(ends) else (None, None)
            spine.append((number, side, name, before, d, int(shard.words[node]), conv, None, *counts, listed, first_end))
            before = name
    fields = [(f.split(" ")[0], {"string": pa.string(), "int": pa.int32()}.get(f.split(" ")[1], pa.int64())) for f in _ROWS.split(", ")]
    yield pa.RecordBatch.from_pylist([dict(zip([f for f, _ in fields], r, strict=True)) for r in spine], pa.schema(fields))
    rest = np.flatnonzero(~shard.spine)
    if not len(rest):
        return
    parent = shard.parent[rest]
    open_parent = shard.spine[parent]
    digests = np.full(len(rest), _NOTHING, dtype=object)
    has_ends = np.flatnonzero(np.isin(rest, shard.end))
    digests[has_ends] = [hashlib.sha256(_listed(shard.ends(n)).encode()).hexdigest() for n in rest[has_ends].tolist()]
    full = lambda value, kind: pa.array([value] * len(rest), kind)
    yield pa.RecordBatch.from_arrays(
        [
            full(number, pa.int64()),
            full(None, pa.int32()),
            full(None, pa.string()),
            pa.array([names[p] if o else None for p, o in zip(parent.tolist(), open_parent.tolist(), strict=True)], pa.string()),
            *(pa.array(x[rest], pa.int64()) for x in (shard.depth, shard.words, shard.conv_id)),
            pa.array(shard.conv_id[parent], pa.int64(), mask=open_parent),
            *(pa.array(x[rest], pa.int64()) for x in (shard.n_convs, shard.n_children, shard.n_leaves, shard.saved)),
            pa.array(digests, pa.string()),
            full(None, pa.int64()),
        ],
        [f for f, _ in fields],
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen, held = TaskContext.get().partitionId(), 0, []

    def finish():
        table = pa.Table.from_batches(held).combine_chunks()
        keys, words = table.column("keys").chunk(0), table.column("words").chunk(0)
        text = b"".join(k.encode() for k in keys.to_pylist())
        offsets = words.offsets.to_numpy().astype(np.int64)
        shard = Shard(
            table.column("conv_id").to_numpy(),
            np.frombuffer(text, dtype=f"S{KEY}"),
            words.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64),
            offsets - offsets[0],
        )
        return _rows(part << 32 | seen, shard, keys[0].as_py().encode(), keys[-1].as_py().encode())

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows + len(batch.column("words").flatten())
        if rows >= SHARD_ROWS:
            yield from finish()
            held, rows, seen = [], 0, seen + 1
    if held:
        yield from finish()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path: for each conversation its turns in order, as an array of (key, words).

    ``key`` is a hash of role and text, ``words`` the number of words of the text; null roles and texts
    are empty. Turns go by ``turn``, nulls first, and by key where that ties, so repeated rows are
    repeated turns. Rows without conv_id belong to no conversation and are left out; other
    columns are ignored. A conversation is one row, of some 50 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, KEY)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", key.alias("key"), words.alias("words")).alias("t")
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("path"))


def _merged(spine: DataFrame) -> DataFrame:
    """Nodes of the spines, merged over shards: node, parent, conv_id, counts, ends_sha256."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    nodes = spine.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in sums),
        F.min(F.struct("shard", "side")).alias("owner"),
    )
    inner = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("inner"))
    nodes = nodes.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    nodes = written(nodes.drop("inner"), "trie-spines")
    # each merged node adds its own value along the path that owns it, from there up to the root
    own = nodes.select(
        "node",
        F.col("owner.shard").alias("shard"),
        F.col("owner.side").alias("side"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("value"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
    )
    upward = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    shares = spine.select("shard", "side", "node", "depth").join(own, ["shard", "side", "node"], "left")
    shares = shares.select("node", F.sum("value").over(upward).alias("value"), F.sum("leaf").over(upward).alias("leaf"))
    added = shares.groupBy("node").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf"))
    lists = spine.where(F.col("ends").isNotNull()).select("node", "first_end", "ends")
    digests = lists.repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(_digests, "node string, ends_sha256 string")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(added, "node")
        .join(digests, "node", "left")
        .join(parents, "parent", "left")
        .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("leaf", F.lit(0)))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("value", F.lit(0)))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of each node joined in order, one list in memory at a time."""
    node, running = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], ["node", "ends_sha256"])
    for batch in batches:
        for name, ends in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
            if name != node:
                if running is not None:
                    yield done()
                node, running = name, hashlib.sha256(ends.as_py().encode())
            else:
                running.update(b"," + ends.as_py().encode())
    if running is not None:
        yield done()


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations' turns, from the empty one on.

    ``paths`` has conv_id and path as ``turn_paths`` gives them; a null path is an empty one and
    ids are distinct. Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes from the node on down), saved_tokens (from the node on down, words
    of the last turn for each member but one), ends_sha256 (of the ids of members that end here,
    ascending and joined by commas). Without conversations there are no rows.
    """
    flat = paths.select(
        F.col("conv_id"),
        F.coalesce(F.array_join(F.transform("path", lambda t: t["key"]), ""), F.lit("")).alias("keys"),
        F.coalesce(F.transform("path", lambda t: t["words"].cast("int")), F.array().cast("array<int>")).alias("words"),
    )
    in_order = flat.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    rows = written(in_order.mapInArrow(_shards, _ROWS), "trie-shards")
    spine = rows.where(F.col("node").isNotNull())
    merged = written(_merged(spine).select("node", *COLUMNS), "trie-merged")
    inner = rows.where(F.col("node").isNull()).withColumnRenamed("ends", "ends_sha256")
    # by shard and parent, so that the children of a hot node are many keys
    tops = spine.select("shard", "node").distinct().join(merged.select("node", "conv_id"), "node")
    tops = tops.select("shard", F.col("node").alias("parent"), F.col("conv_id").alias("top_conv_id"))
    below = inner.where(F.col("parent").isNotNull()).join(tops, ["shard", "parent"])
    below = below.withColumn("parent_conv_id", F.col("top_conv_id"))
    whole = inner.where(F.col("parent").isNull())
    return merged.select(COLUMNS).unionAll(below.select(COLUMNS)).unionAll(whole.select(COLUMNS))
