"""Benchmark decontamination: which words of documents lie in windows taken from test items."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimtrace.llm.text import ALNUM, Slice, Words, randoms, shingles, slices
from claimtrace.sources import written

WINDOW = 10
TOKEN = 3
BLOCK_WORDS = 500_000


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Hits of item windows in documents: doc_id, n_words, n_hit, item_ids (sorted as strings).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. A
    window is ``window`` consecutive words of an item, or the whole of a shorter item; words
    are runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z. A document word
    inside any occurrence of a window is hit.

    A prefix-filtered join. The set tokens are shingles of three words (fewer where a window
    has fewer). One pass counts every item token over all documents; each window keeps its
    rarest token as prefix, since a document that lacks it cannot hold the window. Documents
    are probed for prefix tokens only; a match is kept if the window fits between the first
    and the last word around it (length and position), and then all words of the item-sized
    window are compared.

    Items are handed to tasks in blocks of at most ``block_words`` words (or one longer
    item), so what is broadcast is bounded by that; several blocks are several passes whose
    hits are united. Items that share a text keep all their ids. Null texts have no words;
    null item ids count as hits but are not listed; every document row gives one result row,
    repeated rows included. Without items nothing is hit.
    """
    blocks = _blocks(items, window, block_words)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    if len(blocks) == 1:
        index = _with_prefixes(docs, blocks[0])
        schema = f"doc_id {id_type}, n_words bigint, n_hit bigint, item_ids array<string>"
        return docs.mapInArrow(lambda batches: _totals(batches, [index], None), schema)
    # one pass per block over rows that carry a number of their own; spans are united by row
    indexes = [_with_prefixes(docs, block) for block in blocks]
    rows = written(docs.withColumn("row_no", F.monotonically_increasing_id()), "decontaminate")
    schema = f"doc_id {id_type}, row_no bigint, n_words bigint, spans array<int>, item_ids array<string>"
    found = None
    for index in indexes:
        one = rows.mapInArrow(lambda batches, index=index: _totals(batches, [index], "row_no"), schema)
        found = one if found is None else found.union(one)
    grouped = found.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    return grouped.select("doc_id", "n_words", F.size("spans").cast("bigint").alias("n_hit"), "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns, nulls and repeated rows stay."""
    for index in _blocks(items, window, block_words):
        index = _with_prefixes(docs, index)

        def run(batches, index=index):
            for part in slices(batches, "text"):
                text, _, _ = _occurrences(Words(part, ALNUM), index)
                clean = np.ones(len(part), dtype=bool)
                clean[text] = False
                yield part.rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


class _Index:
    """The windows of a block of items, by the hash of their words."""

    def __init__(self, ids: list, texts: list, window: int):
        part = Slice(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text")
        words = Words(part, ALNUM)
        self.window = window
        self.ids = [None if i is None else str(i) for i in ids]
        whole, starts = shingles(words, window)
        at = np.flatnonzero(starts)
        owner = words.text_of()[at]
        length = np.minimum(words.first[owner + 1] - at, window)
        # a window is known by its length and hash; several items may hold it
        order = np.lexsort((owner, whole[at], length))
        at, owner, length = at[order], owner[order], length[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (length[1:] != length[:-1]) | (whole[at[1:]] != whole[at[:-1]])
        self.owners = owner
        self.owner_first = np.append(np.flatnonzero(new), len(at))
        at, self.length = at[new], length[new]
        self.words = words.hash[np.minimum(at[:, None] + np.arange(window), max(0, len(words.hash) - 1))]
        # tokens of each window: width by its length, one row for each place
        self.width = np.minimum(TOKEN, self.length)
        places = np.arange(window)[None, :] <= (self.length - self.width)[:, None]
        self.tokens = np.zeros((len(at), window), dtype=np.uint64)
        for width in range(1, TOKEN + 1):
            sums = _token_hashes(words.hash, width)
            rows = self.width == width
            here = np.minimum(at[rows, None] + np.arange(window), max(0, len(sums) - 1))
            self.tokens[rows] = sums[here]
        self.places = places
        self.vocabulary = np.unique(self.tokens[places])

    def choose(self, counts: np.ndarray) -> None:
        """Keeps the rarest token of each window, the first of equally rare ones."""
        count = np.where(self.places, counts[np.searchsorted(self.vocabulary, self.tokens) % max(1, len(counts))], np.inf)
        self.offset = count.argmin(axis=1) if len(count) else np.zeros(0, dtype=int)
        self.prefix = self.tokens[np.arange(len(count)), self.offset]
        order = np.argsort(self.prefix, kind="stable")
        self.order, self.sorted_prefix = order, self.prefix[order]
        self.widths = sorted({int(w) for w in self.width})


def _token_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on; the last ones wrap and are never used."""
    total = np.zeros(len(hashes), dtype=np.uint64)
    for j, factor in enumerate(randoms(31 + width, width) | np.uint64(1)):
        total += np.roll(hashes, -j) * factor
    return total


def _blocks(items: DataFrame, window: int, block_words: int) -> list[_Index]:
    """The items in blocks of bounded size; the driver sees one block at a time."""
    blocks, ids, texts, size = [], [], [], 0
    for item in items.select("item_id", "text").where("text is not null").toLocalIterator():
        n = len(item.text.split()) + item.text.count("'") + 1
        if texts and size + n > block_words:
            blocks.append(_Index(ids, texts, window))
            ids, texts, size = [], [], 0
        ids.append(item.item_id)
        texts.append(item.text)
        size += n
    return [*blocks, _Index(ids, texts, window)]


def _with_prefixes(docs: DataFrame, index: _Index) -> _Index:
    """Counts the item tokens over all documents and chooses the rarest of each window."""
    vocabulary, widths = index.vocabulary, sorted({int(w) for w in index.width})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for part in slices(batches, "text"):
            words = Words(part, ALNUM)
            for width in widths:
                found = _lookup(vocabulary, _token_hashes(words.hash, width))
                totals += np.bincount(found, minlength=len(totals))
        seen = np.flatnonzero(totals[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], ["token", "n"])

    counts = np.zeros(len(vocabulary), dtype=np.int64)
    if len(vocabulary):
        found = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
        for row in found.toLocalIterator():
            counts[row.token] = row.n
    index.choose(counts)
    return index


def _lookup(vocabulary: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place in the sorted vocabulary, or its length where a value is not in it."""
    if not len(vocabulary):
        return np.zeros(len(values), dtype=np.int64)
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    at = np.full(len(values), len(vocabulary), dtype=np.int64)
    maybe = np.flatnonzero(bits[(values >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocabulary, values[maybe]), len(vocabulary) - 1)
    hit = vocabulary[place] == values[maybe]
    at[maybe[hit]] = place[hit]
    return at


def _occurrences(words: Words, index: _Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first word) of every occurrence of a window."""
    texts, windows, starts = [], [], []
    keys = np.unique(index.sorted_prefix)
    for width in index.widths:
        hashes = _token_hashes(words.hash, width)
        place = _lookup(keys, hashes)
        at = np.flatnonzero(place < len(keys))
        low = np.searchsorted(index.sorted_prefix, hashes[at], side="left")
        n = np.searchsorted(index.sorted_prefix, hashes[at], side="right") - low
        position = np.repeat(at, n)
        window = index.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        ok = index.width[window] == width
        position, window = position[ok], window[ok]
        text = np.searchsorted(words.first, position, side="right") - 1
        start = position - index.offset[window]
        fits = (start >= words.first[text]) & (start + index.length[window] <= words.first[text + 1])
        text, window, start = text[fits], window[fits], start[fits]
        same = np.ones(len(start), dtype=bool)
        for j in range(index.window):
            inside = j < index.length[window]
            there = words.hash[np.minimum(start + j, len(words.hash) - 1)] if len(words.hash) else start
            same &= ~inside | (there == index.words[window, j])
        texts.append(text[same])
        windows.append(window[same])
        starts.append(start[same])
    join = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return join(texts), join(windows), join(starts)


def _totals(batches: Iterator[pa.RecordBatch], indexes: list[_Index], row_column: str | None) -> Iterator[pa.RecordBatch]:
    """Per document the words hit: their number, or their places if several blocks are to be united."""
    (index,) = indexes
    for part in slices(batches, "text"):
        words = Words(part, ALNUM)
        text, window, start = _occurrences(words, index)
        hit = np.zeros(len(words.hash) + 1, dtype=np.int64)
        np.add.at(hit, start, 1)
        np.add.at(hit, start + index.length[window], -1)
        covered = np.cumsum(hit)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(covered)])
        item_ids: list[list[str]] = [[] for _ in range(len(part))]
        for t, w in set(zip(text.tolist(), window.tolist(), strict=True)):
            item_ids[t] += [index.ids[i] for i in index.owners[index.owner_first[w] : index.owner_first[w + 1]]]
        item_ids = [sorted({i for i in ids if i is not None}) for ids in item_ids]
        columns = {
            "doc_id": part.rows.column("doc_id"),
            "n_words": pa.array(words.counts()),
        }
        if row_column is None:
            columns["n_hit"] = pa.array(sums[words.first[1:]] - sums[words.first[:-1]])
        else:
            columns = {"doc_id": columns["doc_id"], "row_no": part.rows.column(row_column), "n_words": columns["n_words"]}
            columns["spans"] = pa.array(
                [np.flatnonzero(covered[a:b]).astype(np.int32) for a, b in zip(words.first[:-1], words.first[1:], strict=True)],
                pa.list_(pa.int32()),
            )
        columns["item_ids"] = pa.array(item_ids, pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict(columns)
