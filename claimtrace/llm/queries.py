"""One query per operator, over the whole of its table, with SQL where SQL can express it."""

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimtrace.llm import bpe, decontamination, fingerprints, idfiles, langid, lines, lm, ngrams, pii, quality, runs, toxicity, tries
from claimtrace.sources import scratch_path, table

TOKENIZER = tokenizer_path("word_bpe_49k.json")
BYTE_TOKENIZER = tokenizer_path("byte_bpe_50k.json")
END_ID = 2


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_components(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.in_fold("doc_id", 1)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.rate(docs, model).select("doc_id", held_out.alias("held_out"), "expected_grade", "tail_probability", "selected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.in_fold("doc_id", 1)
    profiles = langid.train(docs.where(~held_out))
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.in_fold("doc_id", 1).alias("held_out"), "score", "predicted", "passages")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def _looped(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of the id, goes on in circles from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("words").cast("bigint")
    with_words = docs.withColumn("h", h).withColumn(
        "words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    )
    g = F.floor(F.col("h") / 10)
    with_places = (
        with_words.withColumn("n", n)
        .withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    )
    rest = (F.col("n") - F.col("a")).cast("int")
    circle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    looped = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(circle, F.lit(1), rest)), " ")
    return with_places.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_looped(table(spark, sf_dir, "documents")))
    # greater length / period first, compared by products
    left, right = lambda r, s: r["length"] * s["period"], lambda r, s: s["length"] * r["period"]

    def before(r, s):
        earlier = (r["start"] < s["start"]) | ((r["start"] == s["start"]) & (r["period"] < s["period"]))
        return F.when(left(r, s) != right(r, s), F.when(left(r, s) > right(r, s), -1).otherwise(1)).otherwise(F.when(earlier, -1).otherwise(1))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    listed = F.transform("runs", lambda r: F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(F.col(f"best.{f}").alias(f) for f in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def _rebuilt(paths: DataFrame) -> DataFrame:
    """Conversations that begin with up to three turns of the last one whose id 20 divides."""
    heads = paths.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    own = paths.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    none = F.slice("path", 1, 0)
    path = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("path", F.col("h") + 1, F.size("path")))
    return own.join(heads, "base", "left").select("conv_id", path.alias("path"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_rebuilt(tries.turn_paths(table(spark, sf_dir, "conversations"))))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = idfiles.in_id_order(table(spark, sf_dir, "documents"))
    path = scratch_path(spark, "token-ids")
    idfiles.write_ids(idfiles.encode_ids(docs, BYTE_TOKENIZER, END_ID), path)
    return idfiles.read_binary(spark, path).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("data").alias("ids_crc32")
    )


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_decontamination, op3_line_dedup, op4_bpe, op5_quality, op6_language_id, op7_fingerprints, op8_toxicity, op9_pii, op10_lm_scoring, op11_periodic_runs, op12_prefix_trie, op13_token_files)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

_OP2 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, words)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_OP3 = f"""
WITH lines AS (
  SELECT doc_id, source, i, l FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL)),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (
  SELECT c.source, c.line FROM (
    SELECT source, line, count(*) AS pages FROM (SELECT DISTINCT doc_id, source, trim(l, ' ') AS line FROM lines)
    WHERE line <> '' GROUP BY source, line) c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE pages >= {lines.MIN_PAGES} AND pages > {lines.RATIO} * host_pages),
marked AS (
  SELECT l.doc_id, l.i, l.l, b.line IS NOT NULL AS dropped
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.l, ' ') = b.line)
SELECT d.doc_id, count(m.i) AS n_lines, count(*) FILTER (m.dropped) AS n_dropped,
       CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(m.l, chr(10) ORDER BY m.i) FILTER (NOT m.dropped), '') END AS text
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""

#: crc32 of a number's decimal digits, bit by bit
_CRC32 = """
xor(4294967295, list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), CAST(4294967295 AS BIGINT)))
"""

# stretches of 16, 32, ... words are numbered exactly by doubling; only repeated ones are kept
_OP11 = rf"""
WITH RECURSIVE plain AS (
  SELECT doc_id, {_CRC32.format("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM plain),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM periods)),
numbers AS (SELECT doc_id, n, i, word, min(i) OVER (PARTITION BY doc_id, word) AS c FROM words),
first_two AS (
  SELECT doc_id, n, i, min(i) OVER g AS c, count(*) OVER g AS m
  FROM (SELECT x.doc_id, x.n, x.i, x.c AS c1, y.c AS c2 FROM numbers x JOIN numbers y ON x.doc_id = y.doc_id AND y.i = x.i + 1)
  WINDOW g AS (PARTITION BY doc_id, c1, c2)),
levels AS (
  SELECT 2 AS k, doc_id, n, i, c FROM first_two WHERE m > 1
  UNION ALL
  SELECT 2 * k, doc_id, n, i, c FROM (
    SELECT k, doc_id, n, i, min(i) OVER g AS c, count(*) OVER g AS m
    FROM (SELECT x.k, x.doc_id, x.n, x.i, x.c AS c1, y.c AS c2
          FROM levels x JOIN levels y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i = x.i + x.k)
    WINDOW g AS (PARTITION BY doc_id, c1, c2))
  WHERE m > 1 AND 3 * k <= n),
lags AS (SELECT k, doc_id, i, i - lag(i) OVER (PARTITION BY k, doc_id, c ORDER BY i) AS q FROM levels WHERE k >= 16),
stretches AS (
  SELECT doc_id, k, q, i, i - row_number() OVER (PARTITION BY k, doc_id, q ORDER BY i) AS s
  FROM lags WHERE q <= k AND (q > k // 2 OR k = 16)),
found AS (
  SELECT doc_id, min(i) - q AS start, count(*) + k - 1 + q AS length, q AS period FROM stretches GROUP BY doc_id, k, q, s
  HAVING count(*) + k - 1 + q >= greatest(24, 3 * q)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM found GROUP BY doc_id),
best AS (
  SELECT * FROM found
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM plain LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP12 = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, {_CRC32.format("conv_id")} % 4 AS h FROM turns),
rebuilt AS (
  SELECT c.conv_id, t.role, t.text, 0 AS part, t.pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
steps AS (
  SELECT conv_id, row_number() OVER g AS depth, list(sha256(length(role) || ':' || role || text)) OVER g AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt WINDOW g AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS len FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len), '') AS ends
  FROM steps JOIN lengths USING (conv_id) GROUP BY path),
children AS (SELECT path[: depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
subtrees AS (
  SELECT path[: d] AS path, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM valued) GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(v.ends) AS ends_sha256
FROM valued v JOIN subtrees USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[: v.depth - 1]
"""

ORACLES = {"op1_ngram_jaccard": _OP1, "op2_decontamination": _OP2, "op3_line_dedup": _OP3, "op11_periodic_runs": _OP11, "op12_prefix_trie": _OP12}
