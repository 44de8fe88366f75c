"""N-gram Jaccard join: near copies by products of the document by n-gram incidence, in blocks.

Rows of the sparse incidence matrix are documents, columns are word shingles. The product of the
matrix with its transpose holds the overlap of every two documents; it is computed only where an
overlap can reach what the sizes ask for.

1. Documents with the same shingle set become one row.
2. Columns are ordered by how many documents hold them, rare ones first. A pair that links must
   share one of the first n - ceil(0.75 n) + 1 columns of both, so only those enter the product.
3. The columns are dealt over tasks in blocks. Rows of one column whose sizes can link are
   multiplied with one pivot each, which is linear in the column, and surviving pairs are verified by
   their whole sets; what they link becomes a component. Rounds with other pivots follow until
   hardly any component grows, so a large group of copies never becomes all its pairs. A round
   takes about STAR_COLUMNS columns of a row, as copies share most; step 4 takes all.
4. Products of rows that are in different components after that are accumulated over all
   columns; pairs whose overlap so far and whose rest cannot reach the bound are discarded, the
   others are verified. No link between different components is missed. Columns that begin with
   the same node are multiplied in one task, which adds up a pair's overlaps: a pair shares many
   columns, but few first nodes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimtrace.llm.graph import components
from claimtrace.llm.text import NOT_SPACE, SMALL_BYTES, Words, mix, shingles, slices, small_batches
from claimtrace.sources import written

WIDTH = 5
PERCENT = 75
FLUSH = 1 << 21
MAX_FREQUENT = 1 << 19
MIN_COUNT = 8
SALT_ROWS = 10_000
SEEN = 1 << 18
MIN_BITS, MAX_BITS = 1 << 8, 1 << 15
FOLDED = 8
STAR_COLUMNS = 8
MORE = 0.05
WANTED_BITS = 24
BLOCK = 4096
FOUND = 1 << 16
HOME_WORK = 1 << 26
PRODUCT = ["column", "lo", "hi", "own", "node", "n", "at", "label", "folded"]
PAIR = ["a", "b", "n", "o_n", "at", "o_at", "overlap"]


def need(size):
    """Shingles that a set of this size must share with any set it links to."""
    return -(-PERCENT * size // 100)


def jaccard_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets of ``width``-word
    shingles (fewer words: all of them as one shingle); component_id is the smallest doc_id that
    links reach. Texts without words, null ones too, have no shingles and only themselves. Rows
    that repeat an id are nodes of their own and all get a result. Rows with a null id take no
    part in links and get a null component. Further columns are ignored.
    """
    rows, named = _named(docs, width)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def _named(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the node of each, and the nodes with their component: label and component_id."""
    docs = docs.select("doc_id", "text")
    with small_batches(docs.sparkSession):
        return _found(docs, width)


def _found(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    rows = written(_signatures(docs, width), "ngram-rows")
    nodes = written(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.xxhash64(F.min("doc_id")).alias("key"), F.max("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("folded").alias("folded")),
        "ngram-nodes",
    )
    docs = docs.where("doc_id is not null")
    postings = _postings(docs, width, _frequent(docs, width))
    sets = _Sets(docs, nodes, width)
    labels, links, grown, number = None, None, 1.0, 0
    while grown > MORE:
        # stars of other pivots until hardly any component grows
        found = sets.linked(sets.near(_star_pairs(postings, labels, number)))
        links = found if links is None else links.union(found)
        before, labels, number = labels, written(components(links, rounds=2), "ngram-labels"), number + 1
        merges = [0 if x is None else x.where("node <> label").count() for x in (before, labels)]
        grown = (merges[1] - merges[0]) / max(1, merges[1])
    labels = components(links.union(sets.linked(_cross_pairs(postings, labels, nodes))))
    first = (
        nodes.join(labels, "node", "left")
        .select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    )
    lowest = first.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows, first.join(lowest, "label").select("node", "label", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id.

    Texts without words stay, as do rows with a null id. Rows that repeat an id are judged apart,
    by their sets; of those that repeat id and set one stays. All columns stay, whatever their names.
    """
    rows, named = _named(docs, width)
    ids = rows.where("doc_id is not null").select("doc_id", "node", "n_shingles").distinct()
    chosen = ids.where("n_shingles > 0").join(named, "node").where("doc_id = component_id").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("k"))
    kept = chosen.select("k.doc_id", "k.node").union(ids.where("n_shingles = 0").select("doc_id", "node"))
    kept_id, kept_node = _free("__kept", docs.columns), _free("__node", docs.columns)
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("node").alias(kept_node))
    # a row meets each kept set of its id; only its own one counts
    met = docs.join(kept, docs["doc_id"] == F.col(kept_id)).drop(kept_id)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SMALL_BYTES):
            found = np.array([_node(s) for s in _sets(part, width)], dtype=np.int64)
            yield part.rows.filter(pa.array(found == part.rows.column(kept_node).to_numpy()))

    one = met.mapInArrow(own, met.schema).dropDuplicates(["doc_id", kept_node]).drop(kept_node)
    return one.union(docs.where("doc_id is null"))


def _free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column is called so in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


# --- shingle sets --------------------------------------------------------------------------


def _sets(part, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = Words(part, NOT_SPACE)
    hashes, starts = shingles(words, width)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(hashes[a:b][starts[a:b]])


def _node(values: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(values ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _bitmap(values: np.ndarray) -> bytes:
    """Four to eight bits a shingle, at most MAX_BITS, the one of each shingle set.

    The number of bits is a power of two, so a longer bitmap folds to the length of a shorter one.
    """
    size = min(MAX_BITS, max(MIN_BITS, 1 << (4 * len(values)).bit_length()))
    bits = np.zeros(size, dtype=np.uint8)
    bits[(values >> np.uint64(13)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits).tobytes()


def _folded(values: np.ndarray) -> np.ndarray:
    """The same with as many bits as FOLDED numbers have, for comparison in Spark."""
    bits = np.zeros(64 * FOLDED, dtype=np.uint8)
    bits[(values >> np.uint64(13)).astype(np.int64) % (64 * FOLDED)] = 1
    return np.packbits(bits).view(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text", SMALL_BYTES):
            found = [(_node(s), len(s), _bitmap(s), _folded(s)) for s in _sets(part, width)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.rows.column("doc_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.binary()),
                    pa.array([f[3] for f in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "node", "n_shingles", "bits", "folded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, node bigint, n_shingles bigint, bits binary, folded array<bigint>")


def _frequent(docs: DataFrame, width: int):
    """(shingles sorted, number of documents) of the most frequent columns, for their order.

    Each task counts its documents in chunks of FLUSH shingles and reports those met twice in
    a chunk; Spark adds up. At most MAX_FREQUENT columns are kept. The order of columns decides
    how much work a product is, never what links, so a column missed here costs time only.
    """

    def run(batches):
        pending, size = [], 0
        for part in slices(batches, "text", SMALL_BYTES):
            for values in _sets(part, width):
                pending.append(values)
                size += len(values)
            if size >= FLUSH:
                yield _repeated(pending)
                pending, size = [], 0
        if pending:
            yield _repeated(pending)

    counts = docs.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= MIN_COUNT).orderBy(F.col("n").desc(), "shingle").limit(MAX_FREQUENT).toArrow()
    shingle, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(shingle)
    return docs.sparkSession.sparkContext.broadcast((shingle[order], n[order]))


def _repeated(pending: list[np.ndarray]) -> pa.RecordBatch:
    values = np.concatenate(pending)
    values.sort()
    same = values[1:] == values[:-1]
    first, last = same.copy(), same.copy()
    first[1:] &= ~same[:-1]
    last[:-1] &= ~same[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return pa.RecordBatch.from_arrays([pa.array(values[start].view(np.int64)), pa.array(end - start + 1)], ["shingle", "n"])


def _prefix(values: np.ndarray, frequent) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a set that may hold its first common one with a set it links to, and their counts."""
    shingle, n = frequent
    count = np.zeros(len(values), dtype=np.int64)
    if len(shingle):
        place = np.minimum(np.searchsorted(shingle, values), len(shingle) - 1)
        hit = shingle[place] == values
        count[hit] = n[place[hit]]
    # ties in the order of the hash, as the values come
    order = np.argsort(count, kind="stable")[: len(values) - need(len(values)) + 1]
    return values[order], count[order]


def _postings(docs: DataFrame, width: int, frequent) -> DataFrame:
    """Rows of the incidence matrix's prefix columns that two or more sets share.

    column, salt, node, n (size of the set), at (place of the column in its order). A set is
    sent once per task, whatever the number of its copies there. A column that SALT_ROWS or more
    documents hold is cut into blocks of rows by salt, so that no task gets all of it.
    """

    def run(batches):
        table = frequent.value
        seen: set[int] = set()
        for part in slices(batches, "text", SMALL_BYTES):
            columns = []
            for values in _sets(part, width):
                if not len(values):
                    continue
                node = _node(values)
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                chosen, count = _prefix(values, table)
                blocks = count // SALT_ROWS + 1
                salt = np.where(blocks > 1, 1 + (node & 0x7FFFFFFF) % blocks, 0)
                columns.append((chosen, salt, np.full(len(chosen), node), np.full(len(chosen), len(values)), np.arange(len(chosen))))
            if columns:
                joined = [np.concatenate(c) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(joined[0].view(np.int64)), pa.array(joined[1].astype(np.int32)), pa.array(joined[2]), pa.array(joined[3].astype(np.int32)), pa.array(joined[4].astype(np.int32))],
                    ["column", "salt", "node", "n", "at"],
                )

    schema = "column bigint, salt int, node bigint, n int, at int"
    sent = docs.mapInArrow(run, schema)
    dealt = sent.repartition("column", "salt").sortWithinPartitions("column", "salt", "n", "node")
    return written(dealt.mapInArrow(_shared, schema), "ngram-postings")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repeated rows and, unless the column is salted, columns with one row only.

    Rows come sorted by column, so the last column of a batch waits for the next one. Of a very
    long column what is there goes on, and its last row stays to meet what follows.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
        column = table.column("column").to_numpy()
        if not len(column):
            continue
        to = int(len(column) - (column[::-1] != column[-1]).argmax()) if column[0] != column[-1] else 0
        if len(column) - to > FLUSH:
            yield _several(table)
            to = len(column) - 1
        elif to:
            yield _several(table.slice(0, to))
        rest = table.slice(to).combine_chunks().to_batches()[0]
    if rest is not None:
        yield _several(pa.Table.from_batches([rest]))


def _several(table: pa.Table) -> pa.RecordBatch:
    column, salt, node = (table.column(c).to_numpy() for c in ("column", "salt", "node"))
    fresh = np.ones(len(column), dtype=bool)
    fresh[1:] = (column[1:] != column[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(fresh)
    column = column[at]
    same = column[1:] == column[:-1]
    keep = np.append(same, False) | np.append(False, same) | (salt[at] > 0)
    out = table.take(pa.array(at[keep])).combine_chunks().to_batches()
    return out[0] if out else pa.RecordBatch.from_pylist([], schema=table.schema)


# --- products ------------------------------------------------------------------------------


def _star_pairs(postings: DataFrame, labels: DataFrame | None, number: int) -> DataFrame:
    """Pairs of each row with a pivot of its size in a block of a column, linear in the rows.

    Which row is the pivot depends on a hash. In the first round it is the same for all columns,
    so few documents are pivots; later rounds differ by column and pair rows of different
    components only. The pivots of the blocks of a salted column meet its first pivot as well.
    """
    # a size class and the next hold all sizes that can link
    base = 100.0 / PERCENT
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(base)))
    wide = postings.select("column", "salt", "node", "n", "at", F.explode(F.array(size, size + 1)).alias("size"))
    # one column in so many, the same for all rows of a class; another one in each round
    share = F.greatest(F.lit(1), F.floor(F.pow(F.lit(base), "size") * ((100 - PERCENT) / (100 * STAR_COLUMNS))))
    wide = wide.where(F.pmod(F.xxhash64("column"), share) == F.pmod(F.lit(number), share))
    if labels is None:
        turn, wide = F.xxhash64("node"), wide.withColumn("label", F.col("node"))
    else:
        turn, wide = F.xxhash64("node", "column", F.lit(number)), _labelled(wide, labels)
    wide = wide.select("column", "salt", "size", F.struct(turn.alias("turn"), "node", "n", "at", "label").alias("q"))
    pivots = wide.groupBy("column", "salt", "size").agg(F.min("q").alias("p"), F.count("*").alias("rows"))
    pairs = wide.join(pivots.where("rows > 1").drop("rows"), ["column", "salt", "size"])
    salted = pivots.where("salt > 0").select("column", "size", F.col("p").alias("q"))
    tops = salted.groupBy("column", "size").agg(F.min("q").alias("p"))
    both = pairs.select("p", "q").union(salted.join(tops, ["column", "size"]).select("p", "q"))
    fits = both.where((F.col("p.label") != F.col("q.label")) & _may_link("p.n", "q.n", "p.at", "q.at"))
    return fits.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _only_in(x: str, y: str):
    """Bits of one set that the other lacks: at least as many shingles are not shared."""
    return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(FOLDED)), F.lit(0))


def _room_in_bits(n: str, folded: str, m: str, m_folded: str):
    """The short bitmaps of two sets allow a link."""
    least = _least_overlap(n, m)
    return (F.col(n) - _only_in(folded, m_folded) >= least) & (F.col(m) - _only_in(m_folded, folded) >= least)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of their node, the node itself where it has no links."""
    named = labels.select(F.col("node").alias("n_"), "label")
    return rows.join(named, rows["node"] == named["n_"], "left").select(*rows.columns, F.coalesce("label", "node").alias("label"))


def _mixed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with the component of each row, of the columns that hold several components.

    ``blocks`` names the blocks into which the column's rows are cut, about BLOCK rows each. A
    component with more rows than that has blocks of its own, for which its label stands in the
    array; a null is a block of several components. ``home`` is the least node of the column,
    ``part`` one of several parts of a home whose columns hold more than HOME_WORK pairs.
    """
    marked = _labelled(postings.drop("salt"), labels)
    each = marked.groupBy("column", "label").agg(F.count("*").alias("m"), F.min("node").alias("least"))
    own = F.when(F.col("m") > BLOCK, F.array_repeat("label", F.ceil(F.col("m") / BLOCK).cast("int")))
    columns = (
        each.groupBy("column")
        .agg(
            F.count("*").alias("labels"),
            F.coalesce(F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))), F.lit(0)).alias("rest"),
            F.flatten(F.collect_list(own)).alias("own"),
            F.min("least").alias("home"),
            # two blocks at most are one product
            F.pow(F.least(F.sum("m"), F.lit(2 * BLOCK)), F.lit(2)).alias("work"),
        )
        .where("labels > 1")
    )
    shared = F.array_repeat(F.lit(None).cast("bigint"), F.ceil(F.col("rest") / BLOCK).cast("int"))
    columns = written(columns.select("column", "home", "work", F.concat(shared, "own").alias("blocks")), "ngram-columns")
    parts = columns.groupBy("home").agg(F.ceil(F.sum("work") / HOME_WORK).alias("parts"))
    part = F.pmod(F.xxhash64("column"), "parts").cast("int").alias("part")
    columns = columns.join(parts, "home").select("column", "home", part, "blocks")
    return written(marked.join(columns, "column"), "ngram-mixed")


def _dealt(mixed: DataFrame) -> DataFrame:
    """A row for each pair of blocks (lo, hi) that a row of ``mixed`` meets in, with its own block.

    Two blocks of one component never meet, as nothing new can link there.
    """
    first = F.array_position("blocks", F.col("label"))
    size = F.size("blocks")
    spread = F.pmod(F.xxhash64("node"), F.size(F.filter("blocks", lambda x: x == F.col("label")))).cast("int")
    others = F.size(F.filter("blocks", lambda x: x.isNull()))
    own = F.when(first > 0, first.cast("int") - 1 + spread).otherwise(F.pmod(F.xxhash64("label"), others).cast("int"))
    placed = mixed.withColumn("own", F.when(size > 1, own).otherwise(0))
    met = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda j: F.coalesce(F.element_at("blocks", j + 1) != F.col("label"), F.lit(True)),
    )
    placed = placed.withColumn("other", F.explode(F.when(size > 1, met).otherwise(F.array(F.lit(0)))))
    lo, hi = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    return placed.select("home", "part", "column", lo, hi, "own", "node", "n", "at", "label")


def _least_overlap(n: str, m: str):
    return F.ceil(PERCENT * (F.col(n) + F.col(m)) / F.lit(100 + PERCENT))


def _may_link(n: str, m: str, at: str, m_at: str):
    """Sizes and places allow a link: no more than the lesser of what precedes the common column
    on either side, and of what follows, can be common."""
    room = F.least(at, m_at) + F.least(F.col(n) - F.col(at), F.col(m) - F.col(m_at))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (room >= _least_overlap(n, m))


def _cross_pairs(postings: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of rows of different components whose overlap may reach the bound.

    Only columns that hold several components take part. Each pair of a column's blocks is one
    product, made in a task; only pairs for which sizes, places and the bits that one set has alone
    leave room for a link become rows. Overlaps accumulate over columns; a pair is discarded when
    those in the prefixes and all that may follow the last of them are fewer than the sizes ask for.
    """
    dealt = _dealt(_mixed(postings, labels)).join(nodes.select("node", "folded"), "node")
    dealt = dealt.repartition("home", "part", "lo", "hi").sortWithinPartitions("home", "column", "lo", "hi", "n")
    met = dealt.select(*PRODUCT).mapInArrow(_summed, "a bigint, b bigint, n int, o_n int, at int, o_at int, overlap bigint")
    sums = met.groupBy("a", "b").agg(
        F.sum("overlap").alias("overlap"),
        F.max(F.struct("at", "o_at")).alias("last"),
        F.max("n").alias("n"),
        F.max("o_n").alias("o_n"),
    )
    rest = F.least(F.col("n") - F.col("last.at"), F.col("o_n") - F.col("last.o_at")) - 1
    return sums.where(F.col("overlap") + rest >= _least_overlap("n", "o_n")).select("a", "b")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of the products with the columns of a task that they share: their number and the last places.

    At most some FOUND pairs wait for more of their columns, which come together as columns are sorted by home.
    """
    waiting = None
    for batch in _products(batches):
        found = [batch.column(c).to_numpy() for c in PAIR[:-1]] + [np.ones(batch.num_rows, dtype=np.int64)]
        waiting = found if waiting is None else [np.concatenate(c) for c in zip(waiting, found, strict=True)]
        if len(waiting[0]) >= 4 * FOUND:
            waiting = _added(waiting)
            if len(waiting[0]) >= 2 * FOUND:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in waiting], PAIR)
                waiting = None
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(waiting)], PAIR)


def _added(pairs: list[np.ndarray]) -> list[np.ndarray]:
    """One row for each pair: its last places and the sum of its overlaps."""
    a, b, _, _, at, o_at, _ = pairs
    order = np.lexsort((o_at, at, b, a))
    pairs = [c[order] for c in pairs]
    new = (pairs[0][1:] != pairs[0][:-1]) | (pairs[1][1:] != pairs[1][:-1])
    last = np.flatnonzero(np.append(new, len(a) > 0)[: len(a)])
    overlap = np.add.reduceat(pairs[-1], np.append(0, last[:-1] + 1)) if len(last) else pairs[-1]
    return [c[last] for c in pairs[:-1]] + [overlap]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each (column, lo, hi) that may link; rows come sorted by these within a home, then by size.

    The last product of a batch waits for the next batch: some BLOCK rows of either block.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        if not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in ("column", "lo", "hi")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        to = int(new[-1]) if len(new) else 0
        rest = table.slice(to).to_batches()[0]
        if to:
            yield from _met(table.slice(0, to))
    if rest is not None:
        yield from _met(pa.Table.from_batches([rest]))


def _met(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each row meets the one after it, then the second after it, and so on within its product,
    until the sizes are too far apart to link."""
    column, lo, hi, own, node, n, at, label = (table.column(c).to_numpy() for c in PRODUCT[:-1])
    folded = table.column("folded").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, FOLDED)
    size, place = n.astype(np.int64), at.astype(np.int64)
    edge = np.flatnonzero((column[1:] != column[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
    starts, ends = np.append(0, edge), np.append(edge, len(column))
    end = np.repeat(ends, ends - starts)
    # a product of a block with itself takes all its pairs, one of two blocks those across
    within = lo == hi
    x, step, found, waiting = np.arange(len(column)), 0, [], 0
    while len(x):
        step += 1
        x = x[x + step < end[x]]
        x = x[100 * size[x] >= PERCENT * size[x + step]]
        y = x + step
        fits = (label[x] != label[y]) & (within[x] | (own[x] != own[y])) & (node[x] != node[y])
        p, q = x[fits], y[fits]
        least = -(-PERCENT * (size[p] + size[q]) // (100 + PERCENT))
        room = np.minimum(place[p], place[q]) + np.minimum(size[p] - place[p], size[q] - place[q])
        p, q, least = (v[room >= least] for v in (p, q, least))
        only_p = np.bitwise_count(folded[p] & ~folded[q]).sum(axis=1, dtype=np.int64)
        only_q = np.bitwise_count(folded[q] & ~folded[p]).sum(axis=1, dtype=np.int64)
        good = (size[p] - only_p >= least) & (size[q] - only_q >= least)
        if good.any():
            found.append((p[good], q[good]))
            waiting += len(found[-1][0])
        if found and (waiting >= FOUND or not len(x)):
            p, q = (np.concatenate(v) for v in zip(*found, strict=True))
            found, waiting = [], 0
            flip = node[p] > node[q]
            p, q = np.where(flip, q, p), np.where(flip, p, q)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[p], node[q], n[p], n[q], at[p], at[q])], ["a", "b", "n", "o_n", "at", "o_at"])


class _Sets:
    """Verifies pairs of nodes by their whole sets.

    Short bitmaps go first, long ones next. Of the pairs that these leave, the text of one document
    for each node is read again from ``docs`` and dealt by node.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int):
        self.docs, self.nodes, self.width = docs.select(F.xxhash64("doc_id").alias("key"), "text"), nodes, width

    def _with(self, pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            named = self.nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
            pairs = pairs.join(named, side)
        return pairs

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that short bitmaps leave."""
        return self._with(pairs, "n", "folded").where(_room_in_bits("a_n", "a_folded", "b_n", "b_folded")).select("a", "b")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link.

        Bitmaps go first: a bit of one set that the other lacks is a shingle that they do not
        share, so the bits bound the overlap from above. Of the pairs left both texts meet.
        """
        kept = "a bigint, b bigint, a_key bigint, b_key bigint"
        pairs = written(self._with(pairs.select("a", "b"), "n", "bits", "key").mapInArrow(_by_bits, kept), "ngram-pairs")
        keys = _node_bits(pairs.select(F.explode(F.array("a_key", "b_key")).alias("node")))
        nodes = _node_bits(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        width = self.width

        def run(batches):
            seen: set[int] = set()
            wanted = (b.filter(pa.array(_in_bits(b.column("key").to_numpy(), keys.value))) for b in batches)
            for part in slices(wanted, "text", SMALL_BYTES):
                own = np.array([_node(s) for s in _sets(part, width)], dtype=np.int64)
                take = _in_bits(own, nodes.value)
                for i in np.flatnonzero(take).tolist():
                    # copies in one task send one text
                    take[i] = int(own[i]) not in seen
                    seen.add(int(own[i]))
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(own[take]), part.rows.column("text").filter(pa.array(take))], ["node", "text"])

        texts = self.docs.mapInArrow(run, "node bigint, text string").dropDuplicates(["node"])
        both = (
            pairs.select("a", "b")
            .join(texts.select(F.col("node").alias("a"), "text"), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
            .select("a", "b", "text", "other")
        )
        return written(both.mapInArrow(self._verified, "a bigint, b bigint"), "ngram-links")

    @property
    def _verified(self):
        width = self.width

        def run(batches):
            for part in slices(batches, "text", SMALL_BYTES):
                (other,) = slices([part.rows], "other", size=1 << 62)
                good = []
                for x, y in zip(_sets(part, width), _sets(other, width), strict=True):
                    overlap = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * overlap >= PERCENT * (len(x) + len(y) - overlap))
                yield part.rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return run


def _by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose overlap may reach the bound by what their bitmaps say."""
    for batch in batches:
        sizes = zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)
        good = []
        for (n, m), x, y in zip(sizes, batch.column("a_bits"), batch.column("b_bits"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            short = min(len(x), len(y))
            x, y = (np.bitwise_or.reduce(v.reshape(-1, short)) for v in (x, y))
            most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
            good.append(100 * most >= PERCENT * (n + m - most))
        yield batch.select(["a", "b", "a_key", "b_key"]).filter(pa.array(good, pa.bool_()))


def _node_bits(nodes: DataFrame):
    """A bit array of fixed size with a bit for each node, packed by Spark and handed to the tasks.

    It only keeps texts from moving: a node it lets through by chance finds no pair in the join.
    """
    place = F.col("node").bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    packed = nodes.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (WANTED_BITS - 6), dtype=np.uint64)
    words[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return nodes.sparkSession.sparkContext.broadcast(words)


def _in_bits(nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = nodes & ((1 << WANTED_BITS) - 1)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
