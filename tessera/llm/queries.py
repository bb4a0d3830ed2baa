"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(_read(spark, sf_dir, "pages"))


def op7_site_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .site_quality import judged

    found = judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.select("doc_id", F.col("host").alias("source"), F.col("path").alias("lang"), "evidence", "host_rate", "path_rate", "score", "kept")


def op8_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import linked

    return linked(_read(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op2_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_turns

    saying = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", saying), (-1, 1, "assistant", saying)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_turns(turns))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import scored

    return scored(_read(spark, sf_dir, "documents"))


def op4_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import POLICIES, apply_policy, ledger

    book = apply_policy(apply_policy(ledger(_read(spark, sf_dir, "documents")), POLICIES["web-1"]), POLICIES["base-1"], "base_kept")
    return book.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT base_kept AS base_failed", "kept", "fail_bits")


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import findings

    return findings(_read(spark, sf_dir, "documents"), F.col("source"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_checkpoint_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fill_in_middle import filled, restored

    text = restored(F.col("output"), F.col("form"))
    return filled(_read(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fingerprints import edited, shown

    found = edited(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "kept_in_edited", "kept_in_next")


def op13_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .filter_audit import audit

    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_prefix_join": op1_adaptive_prefix_join,
    "op2_typed_parts": op2_typed_parts,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_noisy_channel": op4_noisy_channel,
    "op5_rule_ledger": op5_rule_ledger,
    "op6_host_paths": op6_host_paths,
    "op7_site_posteriors": op7_site_posteriors,
    "op8_concat_and_cut": op8_concat_and_cut,
    "op9_secret_forest": op9_secret_forest,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_checkpoint_cuts": op11_checkpoint_cuts,
    "op12_scaled_sketch": op12_scaled_sketch,
    "op13_filter_cube": op13_filter_cube,
}

ORACLE_SQL: dict[str, str] = {
    "op1_adaptive_prefix_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT DISTINCT rid, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid, rid AS o FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON r.o = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN r USING (rid) JOIN d o ON o.rid = r.o LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id, n.n""",
    "op2_typed_parts": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, 18 + length(replace(replace(role, '%', '%25'), '|', '%7C'))
    + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens
FROM shown GROUP BY conv_id""",
    "op5_rule_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT DISTINCT rid, i + j AS at FROM h, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
r AS (SELECT rid, count(*) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_bangs > 8 * word_chars THEN 8 ELSE 0 END)
  + (CASE WHEN n_upper + n_lower > 100 AND 100 * n_upper > 60 * (n_upper + n_lower) THEN 16 ELSE 0 END)
  + (CASE WHEN n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END)
  + (CASE WHEN n_words > 0 AND word_chars > 40 * n_words THEN 64 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b""",
    "op11_checkpoint_cuts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
    "op13_filter_cube": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * (w.doc_id IS DISTINCT FROM least)::INT AS bits FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
p AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM c v, c w, c x, c y, c z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS f, coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0)::BIGINT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (bits & (before | f) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & f <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (bits & before <> 0 AND bits & f <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = f), 0) AS unique_fails,
  coalesce(sum(good) FILTER (bits & before = 0 AND bits & f <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & before = 0 AND bits & f <> 0), 0) AS toxic_lost
  FROM p CROSS JOIN s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM x""",
}
