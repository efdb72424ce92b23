"""The registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, conversations, decontamination, filter_audit, language, lines, mixing, neighbours, quality, repeats, sharding, simhash, tokens
from .base import ORACLES, QUERIES, query, table


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)


MIX_SQL = r"""
WITH quality AS (SELECT doc_id, max(quality) AS best FROM labels GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         -ln((CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496e0)
         / coalesce(CASE WHEN best > 0 THEN 2e0 WHEN best = 0 THEN 0.5e0 END, 1e0) AS key
  FROM documents d LEFT JOIN quality q ON q.doc_id = d.doc_id
),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, 1e0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS ratio, 3e0 * source_size AS most FROM sources
),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0e0)) / (sum(ratio) OVER () - coalesce(sum(ratio) OVER b, 0e0)) AS level
  FROM ranked WINDOW b AS (ORDER BY most / ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT source, source_size,
         least(most, max(CASE WHEN level <= most / ratio THEN level END) OVER () * ratio) AS target
  FROM levels
),
running AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto + upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark, sf_dir):
    """Sources of the documents mixed in ratio 1, 2, 3; documents weighted by their labels."""
    quality = mixing.label_quality(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    """All documents in 16 shards of near equal size; equal texts stay together."""
    return sharding.shard_slots(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    """Fingerprints and near-duplicate components of all documents."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_packed_tokens")
def op3_packed_tokens(spark, sf_dir):
    """Token ids of all documents written in fixed-width bits, and read back."""
    import public_tokenizers

    _, read = tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read


LEAK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, text, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
of_item AS (
  SELECT DISTINCT item_id, text, k, unnest([array_to_string(w[a:a + k - 1], ' ') FOR a IN range(1, len(w) - k + 2)]) AS s FROM items
),
of_doc AS (
  SELECT DISTINCT doc_id, k, unnest([array_to_string(w[a:a + k - 1], ' ') FOR a IN range(1, len(w) - k + 2)]) AS s
  FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k
),
sizes AS (SELECT item_id, text, count(*) AS n_shingles FROM of_item GROUP BY ALL),
shared AS (SELECT doc_id, item_id, text, count(*) AS n_shared FROM of_item JOIN of_doc USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id, text) WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""


@query("op2_quality")
def op2_quality(spark, sf_dir):
    """Grades 0 (toxic), 1 (neither) and 2 (good) learned from the labels; every document scored."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1)
    model = quality.fit(docs, labels.select("doc_id", grade.alias("grade")), 3)
    scored = quality.score(docs, model, 3)
    return scored.withColumn("keep", F.coalesce(F.col("p_ge_2") >= 0.5, F.lit(True)))


@query("op5_language")
def op5_language(spark, sf_dir):
    """The language of every document; a third by id hash is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"), ~language.held_out())
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_decontamination", LEAK_SQL)
def op9_decontamination(spark, sf_dir):
    """Benchmark items of which a document has at least 0.8 of the five-word shingles."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_neighbours")
def op10_neighbours(spark, sf_dir):
    """The 5 nearest by cosine of every fiftieth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS raw FROM documents
),
t AS (SELECT doc_id, place, nullif(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '') AS line FROM l),
firsts AS (SELECT line, min({'doc_id': doc_id, 'place': place}) AS first, length(line) AS n FROM t WHERE line IS NOT NULL GROUP BY line),
near AS (
  SELECT DISTINCT a.line FROM firsts a JOIN firsts b
  ON b.n BETWEEN a.n - 1 AND a.n + 1 AND least(a.n, b.n) >= 20 AND b.first < a.first AND a.line != b.line
  AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2) OR right(a.line, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) - least(a.n, b.n) // 2))
  AND levenshtein(a.line, b.line) <= 1
),
judged AS (
  SELECT t.*, first, near.line IS NOT NULL AS near FROM t LEFT JOIN firsts ON t.line = firsts.line LEFT JOIN near ON t.line = near.line
)
SELECT doc_id, count(line) AS n_lines,
       count(*) FILTER (WHERE line IS NOT NULL AND {'doc_id': doc_id, 'place': place} != first) AS n_repeated,
       count(*) FILTER (WHERE line IS NOT NULL AND {'doc_id': doc_id, 'place': place} = first AND near) AS n_near,
       coalesce(sum(strlen(line)) FILTER (WHERE {'doc_id': doc_id, 'place': place} = first AND NOT near), 0)::BIGINT AS kept_bytes
FROM judged GROUP BY doc_id
"""


@query("op6_lines", LINE_SQL)
def op6_lines(spark, sf_dir):
    """Lines per document, and how many repeat an earlier line exactly or nearly."""
    return lines.line_counts(table(spark, sf_dir, "documents"))


@query("op8_repeats")
def op8_repeats(spark, sf_dir):
    """Bytes of each document that lie in a 100-byte string which starts earlier in the corpus."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN said ON said.doc_id = w.doc_id
),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a JOIN l b ON b.bit != a.bit JOIN l c ON c.bit NOT IN (a.bit, b.bit) JOIN l d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN l e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS r(step)
),
walked AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM walked
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    """What each step of each order of five filters keeps, removes and loses, per source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_bpe")
def op12_bpe(spark, sf_dir):
    """All documents encoded with a byte-level vocabulary, and decoded again: digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query("op13_conversations")
def op13_conversations(spark, sf_dir):
    """The conversations with planted faults, and the cheapest repair of each."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)
