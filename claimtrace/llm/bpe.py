"""BPE encoding and decoding by speculation: greedy tokens, checked pair by pair."""

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from claimtrace.llm.text import cut

#: pieces known at once, and those of them that are kept when there are more
CACHE_WORDS, KEPT_WORDS = 100_000, 1 << 15
BATCH_BYTES = 1 << 20
MAX_FILE_BYTES = 64 << 20
#: longer pieces, in bytes, are merged exactly without a guess
GUESS_BYTES = 64
#: pieces merged exactly at once
ROWS = 4096
#: the piece pattern and the byte letters of the tokenizer file (fixed values), for classes of characters to be filled in
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: the same pattern for texts of characters up to U+02C1, with their letters, digits and blanks spelled out
LATIN = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PIECES = rf"[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{LATIN}{NUMBERS}\t-\r \x85\xa0]+"
BEYOND_LATIN = re.compile("[^\0-\u02c1]")
END = 256


@lru_cache(maxsize=8)
def character_class(pattern: str) -> str:
    """The characters that match ``pattern`` as the tokenizers library reads it, as ranges for ``re``.

    Which code points are letters depends on a library's version of Unicode; here it is asked
    about every one of them, so the answer is its own.
    """
    matching = Split(Regex(f"{pattern}+"), "removed", invert=True)
    # code points in order, without surrogates; a run of matches is a range
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    ranges = [(text[0], text[-1]) for part in (low, high) for text, _ in matching.pre_tokenize_str(part)]
    return "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in ranges)


def _byte_letters() -> list[str]:
    """A printable character for every byte; the others take the ones from 256 on."""
    table, spare = [""] * 256, 256
    for byte in range(256):
        if byte in PRINTABLE:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(spare)
            spare += 1
    return table


class _Pairs:
    """Sorted keys with values; a missing key gives ``missing``."""

    def __init__(self, entries: dict[int, int], missing: int):
        keys = np.fromiter(entries, dtype=np.int64, count=len(entries))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(entries.values(), dtype=np.int64, count=len(entries))[order]
        self.missing = missing

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(keys.shape, self.missing)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.values[place], self.missing)


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file with BPE merges and word ends."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.file, self.latin = file, re.compile(LATIN_PIECES)
        letters = _byte_letters()
        ids = model["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        self.id_text = {i: str(i) for i in self.tokens}
        self.size = size = max(self.tokens) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge_to = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.never = len(merges)
        pairs = {ids[a] * size + ids[b]: r for r, (a, b) in enumerate(merges)}
        self.rank = _Pairs(pairs, self.never)
        self.rank_of = pairs
        # how each token came about: its two parts and the rank of their merge; -1 for single letters
        self.left, self.right, self.born = (np.full(size, -1) for _ in range(3))
        for (a, b), (key, r) in zip(merges, pairs.items(), strict=True):
            if self.born[ids[a + b]] < 0:
                self.left[ids[a + b]], self.right[ids[a + b]], self.born[ids[a + b]] = *divmod(key, size), r
        self.letter = np.array([ids[letters[b]] for b in range(256)])
        self.last_letter = np.array([ids[letters[b] + suffix] for b in range(256)])
        # greedy matching walks a tree of the tokens that merge to themselves
        byte = {c: b for b, c in enumerate(letters)}
        spelled = {}
        for token, i in ids.items():
            body = token.removesuffix(suffix) if token != suffix else token
            spelled[i] = ([byte[c] for c in body], token != body)
        own = self._merge_all([(self.letter[s] if not end else np.append(self.letter[s[:-1]], self.last_letter[s[-1:]])) for s, end in spelled.values()])
        step: dict[int, int] = {}
        self.accepts = [-1]
        for (i, (body, end)), merged in zip(spelled.items(), own, strict=True):
            if list(merged) != [i]:
                continue
            node = 0
            for symbol in [*body, *[END] * end]:
                key = node << 9 | symbol
                if key not in step:
                    step[key] = len(self.accepts)
                    self.accepts.append(-1)
                node = step[key]
            self.accepts[node] = i
        self.accepts = np.array(self.accepts)
        self.step = _Pairs(step, -1)
        self.known_ids: dict[str, str] = {}
        self.known_tokens: dict[str, str] = {}

    @cached_property
    def pieces(self) -> re.Pattern:
        """The piece pattern for all characters; made for the first text that needs it."""
        classes = {"letters": r"\p{L}", "numbers": r"\p{N}", "blanks": r"\s"}
        return re.compile(PIECES.format(**{name: character_class(p) for name, p in classes.items()}))

    @cached_property
    def normal(self):
        """Composed and lower case as the library's version of Unicode has it."""
        return Tokenizer.from_str(self.file).normalizer.normalize_str

    # --- exact merging -------------------------------------------------------------------

    def _merge(self, symbols: list[int]) -> list[int]:
        """Applies the merge of lowest rank, the leftmost first, until none applies.

        A heap holds the merges that are possible; each is checked when it comes up, so a
        piece of n letters takes about n log n steps.
        """
        size, rank = self.size, self.rank_of
        token = list(map(int, symbols))
        n = len(token)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[a * size + b], i, a, b) for i, (a, b) in enumerate(zip(token, token[1:], strict=False)) if a * size + b in rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else -1
            if j < 0 or token[j] != b:
                continue
            token[i], token[j] = int(self.merge_to[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := rank.get(token[x] * size + token[y])) is not None:
                    heapq.heappush(heap, (found, x, token[x], token[y]))
        return [t for t in token if t >= 0]

    def _merge_all(self, pieces: list) -> list:
        """The same for many pieces: in every round each piece applies its next merge."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= GUESS_BYTES]
        for i in order[len(short) :]:
            out[i] = self._merge(pieces[i])
        for at in range(0, len(short), ROWS):
            rows = short[at : at + ROWS]
            width = int(sizes[rows].max())
            table = np.full((len(rows), width + 1), -1)
            table[np.arange(width + 1) < sizes[rows, None]] = np.concatenate([pieces[i] for i in rows])
            length = sizes[rows].copy()
            ranks = np.where(table[:, 1:] >= 0, self.rank[table[:, :-1] * self.size + table[:, 1:]], self.never)
            live = np.arange(len(rows))
            while len(live):
                where = ranks[live].argmin(axis=1)
                best = ranks[live, where]
                go = best < self.never
                live, where, best = live[go], where[go], best[go]
                if not len(live):
                    break
                columns = np.arange(width + 1)
                shifted = np.minimum(columns + (columns > where[:, None]), width)
                symbols = np.take_along_axis(table[live], shifted, axis=1)
                here = np.arange(len(live))
                symbols[here, where] = self.merge_to[best]
                table[live] = symbols
                length[live] -= 1
                moved = np.take_along_axis(ranks[live], np.minimum(shifted[:, :width], width - 1), axis=1)
                moved[:, width - 1] = self.never
                for place in (where - 1, where):
                    ok = place >= 0
                    a, b = symbols[here[ok], place[ok]], symbols[here[ok], np.minimum(place[ok] + 1, width)]
                    moved[here[ok], place[ok]] = np.where(b >= 0, self.rank[a * self.size + b], self.never)
                ranks[live] = moved
            for k, i in enumerate(rows):
                out[i] = table[k, : length[k]].tolist()
        return out

    # --- speculation and its check -----------------------------------------------------

    def _guess(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over many pieces at once: (piece, token) in order.

        ``data`` holds the bytes of piece i and one END at first[i]:first[i+1]. A token may
        not leave the END by itself; a piece that a token cannot be found for stops short.
        """
        at, stop = first[:-1].copy(), first[1:]
        live = np.flatnonzero(stop - at > 1)
        position, node = at.copy(), np.zeros(len(at), dtype=np.int64)
        token, token_end = np.full(len(at), -1), at.copy()
        owners, tokens = [], []
        while len(live):
            inside = position[live] < stop[live]
            child = np.full(len(live), -1)
            walking = live[inside]
            child[inside] = self.step[node[walking] << 9 | data[position[walking]]]
            on = child >= 0
            moving = live[on]
            node[moving] = child[on]
            position[moving] += 1
            accepted = self.accepts[child[on]]
            good = (accepted >= 0) & (position[moving] != stop[moving] - 1)
            token[moving[good]], token_end[moving[good]] = accepted[good], position[moving[good]]
            ended = live[~on]
            ended = ended[token[ended] >= 0]
            owners.append(ended)
            tokens.append(token[ended])
            position[ended], node[ended], token[ended] = token_end[ended], 0, -1
            # a piece is over at its end, or stuck where no token was found
            keep = on.copy()
            rest = live[~on]
            keep[~on] = (node[rest] == 0) & (token[rest] < 0) & (position[rest] < stop[rest]) & np.isin(rest, ended)
            live = live[keep]
        owner, found = np.concatenate([*owners, at[:0]]), np.concatenate([*tokens, at[:0]])
        order = np.argsort(owner, kind="stable")
        return owner[order], found[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token a followed by token b is what merging their joined letters gives.

        Merging is run backwards at the border between them: whichever neighbour was merged
        last is taken apart into the part that touches the border. If the pair that touches
        at some moment has a merge that comes before the next step of either, merging would
        have crossed the border. At equal rank the place further left goes first.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), dtype=bool)
        next_a, next_b = np.full(len(a), self.never + 1), np.full(len(a), self.never + 1)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.rank[x * self.size + y]
            crossed = (rank < next_a[live]) & (rank <= next_b[live]) & (rank < self.never)
            ok[live[crossed]] = False
            born_x, born_y = self.born[x], self.born[y]
            going = ~crossed & ((born_x >= 0) | (born_y >= 0))
            live, x, y, born_x, born_y = live[going], x[going], y[going], born_x[going], born_y[going]
            on_left = born_x > born_y
            # of equal rank the left one was merged first, so the right one is undone first
            la, lb = live[on_left], live[~on_left]
            next_a[la], next_b[lb] = born_x[on_left], born_y[~on_left]
            a[la], b[lb] = self.right[x[on_left]], self.left[y[~on_left]]
        return ok

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not known yet and remembers ids and tokens as text."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        data = np.full(first[-1], END, dtype=np.int64)
        ends = np.zeros(first[-1], dtype=bool)
        ends[first[1:] - 1] = True
        data[~ends] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        short = np.flatnonzero(sizes <= GUESS_BYTES)
        inside = np.repeat(sizes <= GUESS_BYTES, sizes)
        owner, token = self._guess(data[inside], np.concatenate([[0], np.cumsum(sizes[short])]))
        border = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, where = np.unique(token[border] * self.size + token[border + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[where]
        cut = np.searchsorted(owner, np.arange(len(short) + 1))
        failed = cut[1:] == cut[:-1]
        failed[owner[border[~good]]] = True
        letters = np.where(data < END, self.letter[np.minimum(data, 255)], -1)
        last = first[1:] - 2
        letters[last] = self.last_letter[data[last]]
        exact = np.concatenate([short[failed], np.flatnonzero(sizes > GUESS_BYTES)])
        merged = dict(zip(exact.tolist(), self._merge_all([letters[first[i] : first[i + 1] - 1] for i in exact]), strict=True))
        token_list, id_text, tokens = token.tolist(), self.id_text, self.tokens
        for k, i in enumerate(short.tolist()):
            if i not in merged:
                merged[i] = token_list[cut[k] : cut[k + 1]]
        for i, piece in enumerate(pieces):
            ids = merged[i]
            self.known_ids[piece] = " ".join([id_text[t] for t in ids])
            self.known_tokens[piece] = " ".join([tokens[t] for t in ids])

    def rest(self) -> None:
        """Forgets all but the pieces met first, mostly frequent ones."""
        if len(self.known_ids) > KEPT_WORDS:
            self.known_ids, self.known_tokens = (dict(islice(k.items(), KEPT_WORDS)) for k in (self.known_ids, self.known_tokens))

    # --- texts ----------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Pieces of a text; a special token written out in it is a piece of its own."""
        if any(s in text for s in self.specials):
            out, at = [], 0
            for m in self.special_pattern.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append("\0" + m.group())
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin.findall(text.lower())
        text = self.normal(text) if BEYOND_LATIN.search(text) else text.lower()
        return (self.pieces if BEYOND_LATIN.search(text) else self.latin).findall(text)

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Ids and tokens joined by single spaces, and the number of tokens, of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known_ids) > CACHE_WORDS:
            self.rest()
        for s, i in self.specials.items():
            self.known_ids["\0" + s], self.known_tokens["\0" + s] = self.id_text[i], s
        new = set().union(*split).difference(self.known_ids)
        if new:
            self.learn(list(new))
        ids, tokens = self.known_ids.__getitem__, self.known_tokens.__getitem__
        out = []
        for pieces in split:
            joined = " ".join(map(ids, pieces))
            out.append((joined, " ".join(map(tokens, pieces)), joined.count(" ") + 1 if pieces else 0))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special ones included; the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


def tokenizer_file(path: str) -> str:
    """The tokenizer file, read on the driver and handed to the tasks; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return data.decode()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in cut(batches, "text", BATCH_BYTES):
        yield part, [t or "" for t in part.column("text").to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every whole text: doc_id, ids; other columns are ignored.

    Each piece of a text is speculated on: greedy longest match proposes tokens, all adjacent
    pairs of a batch are checked at once, and only pieces with a pair that fails are merged
    exactly. Null and empty texts have no ids; repeated rows are encoded as often.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        # nothing of it stays in the Python worker, which other operators' tasks use next
        bpe = WordBpe(file.value)
        for part, texts in _batches(batches):
            ids = [list(map(int, found[0].split())) for found in bpe.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of token ids: doc_id, text. Null ids give an empty text; unknown ids are an error."""
    file = encoded.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        bpe = WordBpe(file.value)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Number of tokens and hashes of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``with_ids`` adds the ids themselves. The same encoder and decoder as above in one pass; a piece met before contributes the text of
    its ids and tokens at once.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        bpe = WordBpe(file.value)
        for part, texts in _batches(batches):
            found = bpe.encode_batch(texts)
            ids = [pa.array([np.array(f[0].split(), dtype=np.int32) for f in found], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f[0].encode()).hexdigest() for f in found], pa.string()),
                    pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
                    *ids,
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
