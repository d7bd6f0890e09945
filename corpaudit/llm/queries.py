"""Registered queries of the operators in this package: thin digests of the operators' own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpaudit.llm import (
    chat, divergence, licenses, merkle, mixing, partition_join, passages, phrases, secrets, suffix_dedup, tokencounts,
    toxicity, winnowing,
)
from corpaudit.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _joined(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query
def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    firsts, lasts = F.transform("phrase_places", lambda p: p["first"]), F.transform("phrase_places", lambda p: p["first"])
    base = F.transform("phrase_places", lambda p: p["label"])
    own = F.transform("template_places", lambda p: p["label"])
    return scanned.select(
        "doc_id", "n_words", F.size("phrase_places").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(lasts).alias("last_word"), _joined(base).alias("base_labels"), _joined(F.concat(base, own)).alias("labels"),
        "score", F.size("template_places").cast("long").alias("n_templates"),
    )


@query
def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.quality_rules(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


@query
def op3_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return toxicity.toxicity_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic",
    )


@query
def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_counts(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_candidates", "n_secrets", "kinds", F.round("max_score", 6).alias("max_score"),
    )


#: The conversation that the query adds to the table: control strings in both texts.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op5_chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = F.inline(F.array(*[F.struct(
        F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")
    ) for c, t, r, x in ADDED]))
    rows = rows.unionByName(spark.range(1).select(added))
    turns = chat.canonical_turns(chat.records_from_rows(rows, "conv_id"), "conv_id")
    done = chat.formatted_chats(turns)
    back, masked = chat.parsed_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    read_back = done.select("conv_id", "formatted", back.alias("turns"), masked.alias("masked"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.ordered_mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("first_moment", 9).alias("first_moment"),
        "copies", "first_place", "last_place", F.round("last_position", 3).alias("last_position"),
    )


@query
def op8_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_join.similarity_components(read(spark, sf_dir, "documents"))


@query
def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.edited_counts(read(spark, sf_dir, "documents")).drop("leaf_chars", "leaf_tokens")


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(
        read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
        changes={"text": F.translate("text", _UPPER, _LOWER)}, changed=tampered,
    )
    return made.folded()


@query
def op12_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


@query
def op13_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = passages.train(docs, read(spark, sf_dir, "labels"), learn=part != 1)
    return passages.quality_scores(docs, model).select(
        "doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_passages", "heaviest",
    )


_PLAIN = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op10_winnowing"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT rid, p, n, item FROM dw JOIN iw USING (n, g)),
words AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hit))
  GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

#: crc32 bit by bit: each character of the decimal number is mixed in, then eight steps follow.
_CRC = """
  xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END),
  4294967295)"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format(_FIELD.format("text"))} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(_FIELD.format(_PLAIN.format("text")))} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM d),
up AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY tree, lvl, pos // 16, n),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
higher AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM higher WHERE n > 1
  GROUP BY lvl, pos // 16, n),
nodes AS (
  SELECT tree, lvl, pos, h FROM up WHERE n > 1
  UNION ALL SELECT NULL, lvl + 1000, pos, h FROM higher WHERE n > 1),
runs AS (SELECT tree, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY tree, lvl, pos // 16),
heights AS (SELECT tree, max(lvl) AS height FROM up GROUP BY tree),
tops AS (SELECT max(lvl) AS height FROM higher),
steps AS (
  SELECT l.tree, l.pos, r.lvl, r.hs, (l.pos // CAST(power(16, r.lvl) AS BIGINT)) % 16 AS slot
  FROM leaves l JOIN runs r ON r.tree = l.tree AND r.run = l.pos // CAST(power(16, r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, r.lvl, r.hs, (s.pos // CAST(power(16, r.lvl - 1000) AS BIGINT)) % 16
  FROM leaves l JOIN subroots s ON s.tree = l.tree
  JOIN runs r ON r.tree IS NULL AND r.run = s.pos // CAST(power(16, r.lvl - 999) AS BIGINT)),
paths AS (
  SELECT tree, pos, list({{'hs': hs, 'slot': slot}} ORDER BY lvl) AS path,
    string_agg(array_to_string(hs[:slot] || hs[slot + 2:], ''), '' ORDER BY lvl) AS others
  FROM steps GROUP BY tree, pos),
folds AS (
  SELECT l.tree, l.pos, 1 AS depth, coalesce(changed, leaf) AS h, path FROM leaves l LEFT JOIN paths USING (tree, pos)
  UNION ALL
  SELECT tree, pos, depth + 1,
    sha256(array_to_string(path[depth].hs[:path[depth].slot] || [h] || path[depth].hs[path[depth].slot + 2:], '')), path
  FROM folds WHERE depth <= len(coalesce(path, [])))
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.others, '')) AS proof_sha256, f.h AS folded_root,
  f.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN higher r ON r.n = 1
LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
JOIN folds f ON f.tree = l.tree AND f.pos = l.pos AND f.depth = len(coalesce(p.path, [])) + 1
"""

ORACLES["op12_son_phrases"] = f"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_PLAIN.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM pieces, unnest(range(1, 6)) AS ks(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scores AS (
  SELECT c.lang, c.phrase, words, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT c.lang, c.f, array_to_string(w[p:p + len - 1], ' ') AS phrase
  FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w FROM counts WHERE k > 2) c, unnest(range(2, 5)) AS ls(len), unnest(range(1, 5)) AS ps(p)
  WHERE len < k AND p + len - 1 <= k),
kept AS (
  SELECT * FROM worst WHERE NOT EXISTS (
    SELECT 1 FROM parts WHERE parts.lang = worst.lang AND parts.phrase = worst.phrase AND 100 * parts.f >= 100 * worst.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
