"""Queries of the text operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, hard_negatives, line_dedup, minhash, packing, pii, quality, rules, sentencepiece_bpe, simhash, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.recorded(table(spark, sf_dir, "documents")), rules.POLICIES[-1])
    base = F.col("failed_bits").bitwiseAND(F.lit(rules.BASE.mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


def op6b_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.recorded(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))


def vocabulary(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_exact_dedup, op3_substring_dedup, op4_quality_classifier, op5_simhash, op6_quality_rules, op6b_rule_ablations, op7_line_dedup, op8_best_fit_packing, op9_toxicity, op10_sentencepiece, op11_minhash, op12_token_alignment, op13_hard_negatives)}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
            FROM documents),
        g AS (
            SELECT doc_id, digest, count(*) OVER (PARTITION BY digest) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY digest ORDER BY points DESC, doc_id) AS keep_id
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM g""",
}
_LEDGER = r"""
    w AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM pos WHERE i <= len(w) - 2),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
    rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
    ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM w),
    m AS (
        SELECT w.doc_id, len(w.w) AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(ln.l) - len(list_distinct(ln.l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ln.l) AS n_lines,
               length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g')) AS n_capitals
        FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
    led AS (
        SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
                + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                + (CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END)
                + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
                + (CASE WHEN 10 * word_chars < 15 * n_words THEN 16 ELSE 0 END)
                + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
                + (CASE WHEN 100 * n_capitals > 60 * word_chars THEN 64 ELSE 0 END) AS failed_bits
        FROM m)"""
ORACLE_SQL["op6_quality_rules"] = f"""
    WITH {_LEDGER}
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
           (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS INTEGER) AS failed_bits FROM led"""
ORACLE_SQL["op6b_rule_ablations"] = f"""
    WITH {_LEDGER},
    r(rule, bit) AS (VALUES {", ".join(f"('{n}', {b})" for n, b in rules.BIT.items())}),
    p(policy, mask) AS (VALUES {", ".join(f"('{p.version}', {p.mask})" for p in rules.POLICIES)})
    SELECT policy, rule, CAST(coalesce(sum(CASE WHEN failed_bits & bit <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_failed,
           CAST(coalesce(sum(CASE WHEN failed_bits & mask = bit THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_only_this,
           CAST(coalesce(sum(CASE WHEN failed_bits & mask <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_rejected
    FROM led, r, p WHERE mask & bit <> 0 GROUP BY policy, rule"""
_BLOCK = r"(?i)</?(?:html|head|title|body|nav|ul|ol|li|div|article|section|header|footer|main|aside|p|br|hr|h[1-6]|table|tr|td|th|blockquote|pre)(?:\s[^>]*)?/?>"
ORACLE_SQL["op7_line_dedup"] = rf"""
    WITH raw AS (
        SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
               regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', '', 'g'),
                   '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
    l AS (
        SELECT page_id, host, list_filter(list_transform(string_split(
            regexp_replace(regexp_replace(t, '{_BLOCK}', chr(10), 'g'), '<[^<>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM raw),
    tot AS (SELECT host, count(*) AS n FROM l GROUP BY host),
    held AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line),
    dropped AS (
        SELECT host, list(line) AS d FROM held JOIN tot USING (host)
        WHERE held.n >= 3 AND held.n > 0.3 * tot.n GROUP BY host),
    k AS (
        SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(d, []), x)) AS rest
        FROM l LEFT JOIN dropped USING (host))
    SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(rest) AS BIGINT) AS n_dropped,
           coalesce(array_to_string(rest, chr(10)), '') AS text FROM k"""
ORACLE_SQL["op11_minhash"] = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
    node AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
    item AS (SELECT node, n, unnest(s) AS x FROM node),
    pair AS (
        SELECT a.node AS a, b.node AS b FROM item a JOIN item b ON a.x = b.x AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
        GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
    reach(node, seen) AS (SELECT node, node FROM node UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen),
    root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
    SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
    FROM sets d LEFT JOIN node ON node.s = d.s LEFT JOIN root r USING (node)"""
ORACLE_SQL["op13_hard_negatives"] = r"""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    score AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    pos AS (SELECT * FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other_id) <= 5),
    neg AS (
        SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.s DESC, n.other_id) AS rank
        FROM pos p JOIN score n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
