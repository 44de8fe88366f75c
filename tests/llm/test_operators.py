"""The text operators against plain versions, on small tables with nulls, ties and odd texts."""

import hashlib
import math
import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimtrace.llm import bpe, decontamination, fingerprints, langid, lines, lm, ngrams, pii, quality, toxicity
from claimtrace.llm.graph import components
from claimtrace.llm.queries import TOKENIZER

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"{a}{b}" for a in ("an", "be", "cor", "du", "et", "fi") for b in ("ra", "lo", "men", "tis", "qua")]


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def odd_texts() -> list:
    long = prose(1, 3000)
    return [None, "", " \n\t ", "one", "ONE two", prose(2, 40), prose(2, 40), prose(2, 40) + " more", long, long + " x", "ünï Çödé ß 漢字 \x00 é", "a\nb\n\nb"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[5]], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- n-gram Jaccard join --------------------------------------------------------------------


def shingle_set(text) -> set:
    words = regex.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts: dict) -> dict:
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in texts}


def edited(text: str, seed: int, n: int) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("salt_rows, block", [(10_000, 4096), (20, 4)])
def test_jaccard_components(spark, monkeypatch, salt_rows, block):
    monkeypatch.setattr(ngrams, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(ngrams, "BLOCK", block)
    base, shared = prose(3, 120), prose(4, 60)
    texts = dict(enumerate(odd_texts()))
    # a group of near copies of several grades, and texts that share a long passage only
    texts |= {100 + i: edited(base, i, i % 9) for i in range(60)}
    texts |= {300 + i: shared + " " + prose(500 + i, 15 + i) for i in range(40)}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, node string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_components(frame).collect()}
    assert found == brute_components(texts)
    kept = {r.doc_id for r in ngrams.keep_one(frame).collect()}
    assert kept == {i for i, (_, c) in found.items() if i == c}


def test_products_of_blocks(spark, monkeypatch):
    """Columns of one to many blocks, components of many rows among them, against all pairs."""
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    rng = random.Random(5)
    size, bits = {}, {}
    for node in range(300):
        size[node], bits[node] = rng.randrange(20, 60), [1 << rng.randrange(62) if rng.random() < 0.7 else 0 for _ in range(8)]
    label = {node: 0 if node < 60 else node if node < 200 else node - node % 3 for node in range(300)}
    rows = [(c, 0, node, size[node], rng.randrange(size[node] // 4 + 1)) for c in range(12) for node in rng.sample(range(300), (c + 1) * 20 if c < 10 else 3)]
    postings = spark.createDataFrame(rows, "column bigint, salt int, node bigint, n int, at int")
    labels = spark.createDataFrame([*label.items()], "node bigint, label bigint")
    nodes = spark.createDataFrame([(node, bits[node]) for node in size], "node bigint, folded array<bigint>")
    dealt = ngrams._dealt(ngrams._mixed(postings, labels))
    assert dealt.groupBy("column", "lo", "hi").count().agg({"count": "max"}).first()[0] < 60
    assert dealt.where("column = 9").select("lo", "hi").distinct().count() > 20
    wanted = {}
    for c, _, a, n, at in rows:
        for d, _, b, m, o in rows:
            least = -(-75 * (n + m) // 175)
            alone = [sum((x & ~y).bit_count() for x, y in zip(bits[p], bits[q])) for p, q in ((a, b), (b, a))]
            if c == d and a < b and label[a] != label[b] and min(at, o) + min(n - at, m - o) >= least and 100 * min(n, m) >= 75 * max(n, m):
                if n - alone[0] >= least and m - alone[1] >= least:
                    wanted.setdefault((a, b), []).append((at, o))
    wanted = {
        (a, b) for (a, b), met in wanted.items()
        if len(met) + min(size[a] - max(met)[0], size[b] - max(met)[1]) - 1 >= -(-75 * (size[a] + size[b]) // 175)
    }
    found = [(r.a, r.b) for r in ngrams._cross_pairs(postings, labels, nodes).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 100


def test_overlaps_are_added_up_in_the_task(spark, monkeypatch):
    """Documents that share many columns are a pair once for each home, not for each column."""
    rows = [(column, 0, node, 200, column) for column in range(40) for node in range(30)]
    postings = spark.createDataFrame(rows, "column bigint, salt int, node bigint, n int, at int")
    labels = spark.createDataFrame([(node, node) for node in range(30)], "node bigint, label bigint")
    nodes = spark.createDataFrame([(node, [0] * 8) for node in range(30)], "node bigint, folded array<bigint>")
    dealt = ngrams._dealt(ngrams._mixed(postings, labels)).join(nodes, "node")
    dealt = dealt.repartition("home", "part", "lo", "hi").sortWithinPartitions("home", "column", "lo", "hi", "n")
    met = dealt.select(*ngrams.PRODUCT).mapInArrow(ngrams._summed, "a bigint, b bigint, n int, o_n int, at int, o_at int, overlap bigint").collect()
    assert len(met) == 30 * 29 // 2 and {(r.overlap, r.at, r.o_at) for r in met} == {(40, 39, 39)}
    # a home of much work is several tasks'
    monkeypatch.setattr(ngrams, "HOME_WORK", 1)
    assert ngrams._mixed(postings, labels).select("home", "part").distinct().count() > 10


def test_jaccard_of_nulls_and_nothing(spark, docs):
    assert ngrams.jaccard_components(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert sorted(ngrams.jaccard_components(rows).collect(), key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None)], key=str)
    assert ngrams.keep_one(rows).count() == 2


def test_rows_of_one_id_are_judged_apart(spark):
    first = {i: prose(700 + i, 80) for i in range(10)}
    clean = {100 + i: [prose(800 + i, 80), prose(900 + i, 80)] for i in range(10)}
    rows = [*first.items()] + [(i, first[i - 100] + " more") for i in clean] + [(i, t) for i, texts in clean.items() for t in texts]
    rows += [(100, ""), (100, clean[100][0])]
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id bigint, text string, __node int, __KEPT int")
    kept = ngrams.keep_one(frame).collect()
    assert {(r["__node"], r["__KEPT"]) for r in kept} == {(7, 8)}
    wanted = [*first.items()] + [(i, t) for i, texts in clean.items() for t in texts] + [(100, "")]
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(wanted)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# --- decontamination ---------------------------------------------------------------------------


def brute_hits(texts: dict, items: dict) -> dict:
    find = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    for i, text in texts.items():
        words, hit, ids = find(text), set(), set()
        for item, passage in items.items():
            own = find(passage)
            size = min(10, len(own))
            windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(words) - size + 1) if own else ():
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    ids.add(str(item))
        out[i] = (len(words), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block", [500_000, 20])
def test_decontamination(spark, block):
    items = {1: prose(60, 30), 2: "Short, item", 3: None, 4: "", 10: prose(60, 30), 5: "a a a a a a a a a a a a"}
    few = WORDS[:3]
    texts = dict(enumerate(odd_texts()))
    texts |= {20: prose(9, 15) + " " + prose(60, 30)[:80] + " z", 21: "x short ITEM y", 22: "a " * 25, 23: prose(60, 30)}
    texts |= {30 + i: prose(70 + i, 200, few) for i in range(5)}
    items[6] = prose(71, 200, few)[40:120]
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = decontamination.decontaminate(frame, tests, block_words=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found} == brute_hits(texts, items)
    clean = {r.doc_id for r in decontamination.drop_contaminated(frame, tests, block_words=block).collect()}
    assert clean == {r.doc_id for r in found if not r.n_hit}


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontamination.decontaminate(docs, none).collect()} == {0}
    assert decontamination.decontaminate(empty(spark), none).count() == 0


# --- lines ---------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(i, f"menu\nown {i}\n menu ", "big", "x") for i in range(30)] + [(40 + i, "menu\nown", None, "x") for i in range(2)]
    rows += [(50, None, "big", "x"), (51, "", "big", "x"), (52, "menu", "big", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_lines string")
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.line_dedup(frame).collect()}
    assert out[3] == ("own 3", 3, 2)
    assert out[40] == ("menu\nown", 2, 0)  # two pages are too few
    assert (out[50], out[51], out[52]) == ((None, 0, 0), ("", 1, 0), ("", 1, 1))
    assert lines.line_dedup(frame.limit(0)).count() == 0


def test_line_dedup_of_lines_on_a_few_hundredths_of_the_pages(spark):
    """A line on 4 of 300 pages is boilerplate, one on 1 % of them is not; so it is on ten times the pages."""
    for n in (300, 3000):
        rows = [(i, f"own {i}" + "\nfooter" * (i % 75 == 0) + "\nchance" * (i % 100 == 0), "s") for i in range(n)]
        out = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
        assert out == {i: f"own {i}" + "\nchance" * (i % 100 == 0) for i in range(n)}


# --- BPE -------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs):
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x3D0), 0x130, 0x85, 0x3000, 0x4E2D, 0x1F600, 0x301]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["<|endoftext|>a <|startoftext|>", "a" * 3000, "!" * 500, "it's we'LL ΑΣ Σ", "aaaaaaaaaaaaa" * 3, *(t or "" for t in odd_texts())]
    library = Tokenizer.from_file(TOKENIZER)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in bpe.digests(frame, TOKENIZER, with_ids=True).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame, TOKENIZER), TOKENIZER).collect()}
    for i, own in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert found[i].ids == own.ids and found[i].n_tokens == len(own.ids)
        text = library.decode(own.ids, skip_special_tokens=False)
        assert back[i] == text
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, own.ids)).encode()).hexdigest()
    assert bpe.digests(empty(spark), TOKENIZER).count() == 0
    assert {r.n_tokens for r in bpe.digests(docs.where("text is null"), TOKENIZER).collect()} == {0}


def test_bpe_reads_every_character_as_the_library_does():
    with open(TOKENIZER, encoding="utf-8") as f:
        ours = bpe.WordBpe(f.read())
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1 " for c in characters[i : i + 128]) for i in range(0, len(characters), 128)]
    library = Tokenizer.from_file(TOKENIZER)
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, (ids, *_), own in zip(part, ours.encode_batch(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids == " ".join(map(str, own.ids)), hex(ord(text[1]))


# --- learned operators --------------------------------------------------------------------------------


def learned(spark):
    good, bad = WORDS[:20], ["$$$", "!!!", "###"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        junk = i % 7 == 0
        words = prose(1000 + i, 60, good).split()
        if toxic:
            words[20:24] = ["vile", "scum", "vile", "pest"]
        text = " ".join(words) + (" " + prose(i, 30, bad) if junk else "")
        rows.append((i, text if i != 9 else None, "xx" if i % 2 else "yy", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (9999, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = learned(spark)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.in_fold("doc_id", 1)).collect()
    assert all((r.predicted == 1) == (r.toxic == 1) and 0 <= r.score <= 1 for r in scored if r.doc_id != 9)
    hit = next(r for r in scored if r.toxic and r.doc_id != 9)
    text = docs.where(F.col("doc_id") == hit.doc_id).first().text.encode()
    assert b"vile" in text[hit.passages[0].start : hit.passages[0].end]
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_segments_are_those_of_all_cuts():
    import numpy as np

    def maximal(values):
        """Greatest segments, then the same left and right of them; shortest and first among equals."""
        best = None
        for a in range(len(values)):
            for b in range(a + 1, len(values) + 1):
                s = sum(values[a:b])
                if s > 0 and (best is None or s > best[2] or s == best[2] and b - a < best[1] - best[0]):
                    best = (a, b, s)
        if best is None:
            return []
        a, b, s = best
        return maximal(values[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in maximal(values[b:])]

    rng = random.Random(2)
    for _ in range(200):
        values = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 1000 for _ in range(rng.randrange(1, 14))]
        found = toxicity.segments(np.array(values), 0.0)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in maximal(values)]


def test_quality_on_held_out_documents(spark):
    docs, labels = learned(spark)
    model = quality.train(docs, labels.where("doc_id % 3 <> 1"))
    rated = quality.rate(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1 and doc_id <> 9").collect()
    assert all(r.selected == (r.quality == 1) for r in rated)
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert {r.selected for r in quality.rate(docs, None).collect()} == {None}


def test_quality_grades_are_ordered(spark):
    rows = [(i, " ".join(["good"] * (i % 3 * 10) + ["bad"] * (20 - i % 3 * 10)), i % 3 + 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = quality.train(docs, docs.select("doc_id", "grade"), grade="grade")
    by = {r.grade: r.e for r in quality.rate(docs, model).join(docs, "doc_id").groupBy("grade").agg(F.avg("expected_grade").alias("e")).collect()}
    assert by[1] < by[2] < by[3] and list(model.thresholds) == sorted(model.thresholds)


def test_language_of_held_out_documents(spark):
    texts = {"aa": WORDS[:15], "bb": [w[::-1] for w in WORDS[15:]]}
    rows = [(i, prose(i, 30, texts[lang]), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "12 !", "bb"), (502, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(docs, langid.train(docs.where("doc_id % 3 <> 1"))).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[:120])
    assert [(found[i].lang_pred, found[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_lm_base_scores_and_probabilities(spark):
    import math

    texts = {i: prose(i, 20 + i) for i in range(60)} | {60: None, 61: "", 62: "Never seen WORDS"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    counts, split = {}, lambda t: [*regex.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, t in texts.items():
        for w in split(t) if not held[i] else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in lm.score(docs).collect():
        tokens = split(texts[r.doc_id])
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0 and r.bits_per_byte < 8.5
    assert lm.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [lm.HELD, 50])
def test_lm_slots_are_those_of_the_training_text(spark, monkeypatch, held):
    """Every context and code node seen has a slot of its own, and no other has one."""
    import numpy as np
    import pyarrow as pa

    from claimtrace.llm.text import NOT_SPACE, Slice, Words

    monkeypatch.setattr(lm, "HELD", held)
    texts = {i: prose(i, 20 + i) for i in range(60)} | {60: None, 61: ""}
    docs = lm._fold(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).withColumn("row_no", F.col("doc_id"))
    model = lm.train(docs, lm.word_counts(docs.where(F.col("fold") != lm.HELD_OUT)))
    own = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 not in (lm.HELD_OUT, lm.GATES)]
    part = Slice(pa.RecordBatch.from_pydict({"text": pa.array(own, pa.string())}), "text")
    data, first = lm.symbols(part, Words(part, NOT_SPACE))
    wanted = {}
    for k, context in enumerate(lm._contexts(data, first)):
        for c, byte in zip(context.tolist(), data.tolist(), strict=True):
            at = slice(model.code.start[byte], model.code.start[byte] + model.code.size[byte])
            for node, bit in zip(model.code.node[at].tolist(), model.code.bit[at].tolist(), strict=True):
                wanted.setdefault((k, c ^ node), [0, 0])[bit] += 1
    found = {}
    for row in model.slots.collect():
        for slot, level in zip(np.frombuffer(row.slots, np.uint32).tolist(), row.levels, strict=True):
            assert (row.chunk >> model.chunk_bits, slot) not in found
            found[row.chunk >> model.chunk_bits, slot] = level
    assert found == {key: lm._level(*np.array(n)) for key, n in wanted.items()}


def lm_texts() -> dict:
    odd = ["", None, " ", "a", "a b", " A  bb c\td ", "é", "漢字 é x", "x" * 200, "a a a a a", "b" * 70 + " " + "b" * 65]
    return dict(enumerate(odd + [prose(i, 20 + i) for i in range(50)] + [prose(3, 23)] * 3))


@pytest.mark.parametrize("size", [None, 300])
def test_lm_scores_are_those_of_whole_texts(spark, monkeypatch, size):
    """Pieces give each text the sum that its symbols have one by one in their contexts."""
    import numpy as np
    import pyarrow as pa

    from claimtrace.llm.text import NOT_SPACE, Slice, Words

    if size:
        monkeypatch.setattr(lm, "SLICE", size)
        monkeypatch.setattr(lm, "PIECES_SLICE", size)
        monkeypatch.setattr(lm, "HEAD", 20)
    models, trained = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *args: models.append(trained(*args)) or models[-1])
    texts = lm_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in lm.score(docs).collect()}
    model = models[0]
    levels = {}
    for row in model.slots.collect():
        levels |= {(row.chunk >> model.chunk_bits, s): x for s, x in zip(np.frombuffer(row.slots, np.uint32).tolist(), row.levels, strict=True)}
    assert len(found) == len(texts)
    for i, text in texts.items():
        part = Slice(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())}), "text")
        data, first = lm.symbols(part, Words(part, NOT_SPACE))
        contexts, total = lm._contexts(data, first), 0.0
        for j, byte in enumerate(data.tolist()):
            for at in range(model.code.start[byte], model.code.start[byte] + model.code.size[byte]):
                cell = 0
                for k in range(lm.CONTEXTS):
                    cell = cell * lm.LEVELS + levels.get((k, int(contexts[k][j] ^ model.code.node[at])), 0)
                total += model.log_p[cell, model.code.bit[at]]
        assert found[i].score == pytest.approx(total), text
        assert found[i].bits_per_byte == pytest.approx(-total / math.log10(2) / len(data))


def test_lm_learns_from_texts_in_their_order():
    import numpy as np
    import pyarrow as pa

    from claimtrace.llm.text import NOT_SPACE, Slice, Words

    part = Slice(pa.RecordBatch.from_pydict({"text": pa.array(list(lm_texts().values()), pa.string())}), "text")
    pieces, first, size = lm._in_text(part)
    data, starts = lm.symbols(part, Words(part, NOT_SPACE))
    symbol = np.concatenate([np.arange(a, a + n) for a, n in zip(first, size, strict=True)])
    assert np.array_equal(pieces.symbols[symbol], data)
    for own, whole in zip(pieces.contexts, lm._contexts(data, starts), strict=True):
        assert np.array_equal(own[symbol], whole)


def test_lm_asks_no_more_for_copies_of_texts(spark):
    """Slots are asked for by distinct pieces; asked for by texts, their number grew with the copies."""
    asked = []
    for copies in (1, 6):
        rows = [(i + 1000 * c, prose(i, 40)) for c in range(copies) for i in range(30)]
        docs = lm._fold(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))
        model = lm.train(docs, lm.word_counts(docs.where(F.col("fold") != lm.HELD_OUT)))
        # each slot that is asked for has a level; bounded by a slice for each task, whichever task the pieces are in
        asked.append(model.pieces.agg(F.sum(F.length("levels"))).first()[0])
    assert asked[1] < 1.5 * asked[0]


def test_lm_probabilities_of_a_decision_add_up():
    import numpy as np

    seen = np.zeros((lm.LEVELS**lm.CONTEXTS, 2))
    seen[::7] = [3, 9]
    assert np.allclose((10 ** lm._mixed(seen)).sum(axis=1), 1)
    code = lm.huffman(np.arange(256))
    assert sum(2.0 ** -code.size) == 1


def test_lm_mixing_counts_however_much_was_seen_and_is_learned_online():
    import numpy as np

    seen = np.full((lm.LEVELS**lm.CONTEXTS, 2), 10.0**9)
    few, many = (lm._mixed(seen, np.full((1 << lm.CONTEXTS, lm.CONTEXTS), w)) for w in (0.1, 0.6))
    assert np.abs(few - many).max() > 0.1
    rng = np.random.default_rng(3)
    # the first context is right, the others are noise
    level = rng.integers(1, lm.LEVELS, (200_000, lm.CONTEXTS))
    cell = level @ lm.LEVELS ** np.arange(lm.CONTEXTS - 1, -1, -1)
    bit = (rng.random(len(cell)) < 1 / (1 + np.exp(-lm._odds_of_level(level[:, 0])))).astype(np.int64)
    weights = np.full((1 << lm.CONTEXTS, lm.CONTEXTS), lm.START)
    assert lm.learn(weights, cell, bit).sum() == len(cell)
    assert weights[-1][0] > 0.7 and np.abs(weights[-1][1:]).max() < 0.15
    assert (weights[:-1] == lm.START).all()


# --- fingerprints -----------------------------------------------------------------------------------


def test_fingerprints_of_edits(spark, docs):
    found = {}
    for r in fingerprints.with_edits(docs, parts=4).collect():
        found.setdefault(r.doc_id, []).append(r)
    texts = dict(enumerate(t or "" for t in odd_texts()))
    order = sorted([*texts, 5])
    for place, i in enumerate(order):
        n, following = len(texts[i]) // 4, texts[order[(place + 1) % len(order)]]
        change = texts[i][: len(texts[i]) - n] + following[:n]
        assert hashlib.sha256(change.encode()).hexdigest() in {r.edited_sha256 for r in found[i]}
        assert {r.n_chars for r in found[i]} == {len(texts[i])}
    assert len({r.fingerprint for i in (5, 6) for r in found[i]}) == 1
    assert found[6][0].near_next > 0.8 and found[8][0].near_edited > 0.6
    assert sum(map(len, found.values())) == len(order)
    assert fingerprints.with_edits(empty(spark)).count() == 0


def test_near_fingerprints(spark):
    texts = {i: prose(i, 200) for i in range(30)} | {100: prose(3, 200) + " added", 101: prose(4, 200), 102: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    links = {(r.a, r.b) for r in fingerprints.near_links(fingerprints.fingerprint(frame)).collect()}
    assert {tuple(sorted(x)) for x in links} == {(3, 100), (4, 101)}


def test_near_links_lead_to_all_that_pairs_lead_to(spark):
    rng = random.Random(12)
    prints = []
    for _ in range(40):
        # pairs at the limit, one just beyond it, and a chain whose ends are far apart
        base = rng.getrandbits(256)
        for n in (32, 33):
            own = rng.getrandbits(256)
            prints += [own, own ^ sum(1 << b for b in rng.sample(range(256), n))]
        bits = rng.sample(range(256), 120)
        prints += [base ^ sum(1 << b for b in bits[: 30 * k]) for k in range(5)]
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 32 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    frame = spark.createDataFrame([(i, f"{p:064x}") for i, p in enumerate(prints)], "doc_id bigint, fingerprint string")
    links = fingerprints.near_links(frame).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() == r.differ <= 32 for r in links)
    found = {r.node: r.label for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a bigint, b bigint")).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == label


# --- personal data -------------------------------------------------------------------------------------


def brute_base(text: str) -> list:
    out = []
    for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in regex.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in regex.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = regex.sub("[^0-9]", "", m.group())
        doubled = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append(("card", *m.span()))
    for m in regex.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(regex.findall("[0-9]", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_equals_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a.b", "@", "x-y", ".", "c@d.e", "..", "1.2.3.4", "256", "0255", "4111 1111 1111 1111", "4111-1111", " ", "é", "+1 (212) 555-0100", "+", "12", "-", "漢", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["1" * 30_000, "a" * 30_000, "@" * 3000, "+1" + " " * 20_000, "1." * 9000]
    for t in texts:
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE] == brute_base(t), t[:80]
    kinds = lambda text: [f[0] for f in pii.find(text) if f[0] not in pii.BASE]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"]
    assert kinds("order 123-45-6789, an example") == []
    frame = spark.createDataFrame([(1, "me@x.org é"), (2, None), (2, None)], "doc_id bigint, text string")
    rows = sorted(pii.pii_digests(frame).collect())
    assert [(r.doc_id, r.n_email, r.spans) for r in rows] == [(1, 1, "email:0:8"), (2, 0, ""), (2, 0, "")]
    assert rows[0].base_sha256 == hashlib.sha256(b"email:0:8").hexdigest()
    assert pii.pii_spans(frame).where("doc_id = 1").first().spans[0].value == "me@x.org"


# --- memory of Python workers ---------------------------------------------------------------


def test_jaccard_takes_texts_in_small_batches(spark, docs, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes, write = spark.conf.get(name), [], ngrams.written
    monkeypatch.setattr(ngrams, "written", lambda df, path: sizes.append(int(spark.conf.get(name))) or write(df, path))
    found = {r.doc_id: r.component_id for r in ngrams.jaccard_components(docs).collect()}
    assert found[6] == found[5] and max(sizes) <= 1000
    assert spark.conf.get(name) == before


def test_bpe_forgets_rare_pieces_only(monkeypatch):
    with open(TOKENIZER) as f:
        ours = bpe.WordBpe(f.read())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 60)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40, raising=False)
    first = ours.encode_batch(["the of and"])
    many = [prose(i, 30, [f"{w}{i}" for w in WORDS]) for i in range(6)]
    apart = [ours.encode_batch([t])[0] for t in many]
    assert "the" in ours.known_ids and "the" in ours.known_tokens and len(ours.known_ids) < 120
    assert ours.encode_batch(["the of and"]) == first and ours.encode_batch(many) == apart
