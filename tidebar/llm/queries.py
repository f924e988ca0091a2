"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, merkle, packing, repeats, secrets, simhash, token_files, toxicity, url_filter,
)
from .common import LOWER, UPPER, ascii_lower, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and kept row of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce(ascii_lower(F.col("text")), F.lit("")), 256))
    return exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_WHOLE = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ORACLES["op5_exact_dedup"] = f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY whole) AS keep_id,
  count(*) OVER (PARTITION BY whole) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY whole) AS kept,
  sha256(whole) AS text_sha256 FROM (SELECT doc_id, {_WHOLE} AS whole FROM documents)"""


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document as read back from the token files."""
    manifest, folder = token_files.token_files(documents(spark, sf_dir), end_id=2)
    return token_files.read_token_files(spark, manifest, folder)


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece."""
    return packing.best_fit(documents(spark, sf_dir))


def _span_text(spans):
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, base kinds counted and digested, all spans listed."""
    found = secrets.secret_spans(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    base = [r.kind for r in secrets.BASE]
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_span_text(of(*base)), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"),
    )


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    known = language_id.dictionaries(docs.where(~F.col("held_out")))
    return language_id.identify(docs.drop("lang"), known).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fifth."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(~F.col("held_out")), labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items that each document shares with the benchmark."""
    found = decontaminate.shared_windows(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


ORACLES["op9_decontaminate"] = f"""WITH item_words AS (
  SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
doc_words AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
item_windows AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS span FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, w[i:i + n - 1] AS span FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, span)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@_query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once passages of 200 bytes that occur elsewhere are gone."""
    found = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once lines that resemble an earlier one are gone."""
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@_query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; what no rule fits is allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_AFTER = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
ORACLES["op11_url_filter"] = f"""WITH parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {_AFTER} AS rest FROM pages)),
rules(r_host, r_path, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (SELECT page_id, r_host || r_path AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS place
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)"""

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a proof says of the tampered ones."""
    docs = documents(spark, sf_dir).select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    own = merkle.leaf(*map(F.col, FIELDS))
    docs = docs.withColumn("held", merkle.leaf(*map(F.col, FIELDS[:-1]), changed))
    found = merkle.manifest(docs, own).withColumn("folded_root", merkle.fold(F.col("held"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _sql_leaf(text: str) -> str:
    one = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(map(one, (*FIELDS[:-1], text))) + ")"


# The cyclic redundancy check of the decimal id, bit by bit; the constant is its reversed polynomial.
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""
_SQL_UP = """SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3"""
ORACLES["op12_merkle_manifest"] = f"""WITH RECURSIVE leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM (
  SELECT doc_id, coalesce('=' || source, '') AS source, {_sql_leaf("text")} AS leaf,
    {_sql_leaf(f"CASE WHEN {_SQL_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS held FROM documents)),
low(tree, level, i, h, n) AS (SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM leaves UNION ALL {_SQL_UP.format(name="low")}),
tops AS (SELECT tree, level AS height, h FROM low WHERE n = 1),
high(tree, level, i, h, n) AS (SELECT '', 0, row_number() OVER (ORDER BY tree) - 1, h, count(*) OVER () FROM tops UNION ALL {_SQL_UP.format(name="high")}),
heights AS (SELECT t.tree, t.height, (SELECT count(*) FROM tops o WHERE o.tree < t.tree) AS i, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
  (SELECT max(level) FROM high) AS upper FROM tops t),
sides AS (SELECT p.tree, p.level, p.i, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i), '') AS r
  FROM (SELECT tree, level, i FROM low WHERE n > 1) p JOIN low s ON s.tree = p.tree AND s.level = p.level AND s.i // 3 = p.i // 3 GROUP BY ALL),
high_sides AS (SELECT p.level, p.i, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i), '') AS r
  FROM (SELECT level, i FROM high WHERE n > 1) p JOIN high s ON s.level = p.level AND s.i // 3 = p.i // 3 GROUP BY ALL),
walk(doc_id, source, leaf, step, i, height, upper, proof, folded) AS (
  SELECT doc_id, source, leaf, 0, l.i, height, upper, '', held FROM leaves l JOIN heights ON tree = source UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.step + 1, CASE WHEN w.step + 1 = w.height THEN t.i ELSE w.i // 3 END, w.height, w.upper,
    w.proof || coalesce(s.l || s.r, g.l || g.r), sha256(coalesce(s.l, g.l) || w.folded || coalesce(s.r, g.r))
  FROM walk w JOIN heights t ON t.tree = w.source
  LEFT JOIN sides s ON w.step < w.height AND s.tree = w.source AND s.level = w.step AND s.i = w.i
  LEFT JOIN high_sides g ON w.step >= w.height AND g.level = w.step - w.height AND g.i = (CASE WHEN w.step = w.height THEN t.i ELSE w.i END)
  WHERE w.step < w.height + w.upper)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk JOIN heights ON tree = source WHERE step = walk.height + walk.upper"""


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each of five positives of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, o.vec_id, o.r AS other, a.label = o.label AS alike, CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score
  FROM v a JOIN v o ON a.r <> o.r AND len(a.q) = len(o.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON s.r = p.r AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5"""
