"""Queries of the training-data operators (one per operator, whole tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import planes

    return planes.encode_and_read_back(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


@_query
def op3_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import binpack

    _, layout = binpack.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return layout.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op2_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


@_query
def op9_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import prefixcount

    return prefixcount.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), 1024)


@_query
def op7_regularised_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import qda

    return qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import mcd

    return mcd.quality_rules(table(spark, sf_dir, "documents"))


@_query
def op6_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from panelcast.llm import vptree

    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op6_vantage_point_trees"] = """
WITH parts AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20"""


@_query
def op8_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import suffixpieces

    return suffixpieces.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


@_query
def op5_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import linededup

    return linededup.line_classes(table(spark, sf_dir, "documents"))


ORACLE["op5_segment_edit_join"] = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM docs),
occ AS (
  SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no, unnest(parts) AS line FROM cut),
lines AS (
  SELECT * FROM occ
  WHERE length(replace(replace(replace(replace(replace(line, ' ', ''), chr(9), ''), chr(13), ''), chr(11), ''), chr(12), '')) > 0),
firsts AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS first FROM lines GROUP BY line),
long_lines AS (SELECT line, first, length(line) AS n FROM firsts WHERE length(line) >= 40),
links AS (
  SELECT a.line, b.first < a.first AS later
  FROM long_lines a JOIN long_lines b
    ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
   AND (substr(a.line, 1, 12) = substr(b.line, 1, 12) OR substr(a.line, a.n - 11) = substr(b.line, b.n - 11)
        OR levenshtein(substr(a.line, 1, 14), substr(b.line, 1, 14)) <= 4)
   AND levenshtein(a.line, b.line) <= 2),
near AS (SELECT line, count(*) AS links, bool_or(later) AS near FROM links GROUP BY line),
judged AS (
  SELECT l.doc_id, l.line_no, {'d': l.doc_id, 'l': l.line_no} > f.first AS is_exact, coalesce(n.near, false) AS is_near,
         coalesce(n.links, 0) AS links
  FROM lines l JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line)
SELECT d.doc_id, count(j.line_no) AS n_lines,
       count(*) FILTER (j.is_exact) AS n_exact, count(*) FILTER (NOT j.is_exact AND j.is_near) AS n_near,
       CAST(coalesce(sum(j.links), 0) AS BIGINT) AS n_links,
       coalesce(string_agg(CAST(j.line_no AS VARCHAR), ',' ORDER BY j.line_no) FILTER (j.is_exact OR j.is_near), '') AS removed
FROM docs d LEFT JOIN judged j ON d.doc_id = j.doc_id
GROUP BY d.doc_id"""


@_query
def op4_dice_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import licences

    return licences.scan(table(spark, sf_dir, "documents"))


def _licence_oracle() -> str:
    from panelcast.llm import licences

    return licences.oracle()


ORACLE["op4_dice_templates"] = _licence_oracle()


@_query
def op13_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4, scale=256)


@_query
def op11_butterfly_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from panelcast.llm import merkle

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verified(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                           {"n_chars": tampered})


def _field(expr: str) -> str:
    return f"coalesce(strlen(CAST({expr} AS VARCHAR)) || ':' || CAST({expr} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


#: No crc32 in DuckDB: eight steps a byte of the decimal id.
_CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
        "lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)")

ORACLE["op11_butterfly_merkle"] = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('CASE WHEN ' + _CRC + ' % 7 = 0 THEN n_chars + 1 ELSE n_chars END')} AS now
  FROM documents),
leaves AS (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER () AS id,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM rows_),
tree AS (
  SELECT g, 0::BIGINT AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY g, level, pos // 2, n),
subs AS (SELECT g, digest AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0::BIGINT AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT digest AS root, level AS height FROM top WHERE n = 1),
siblings AS (
  SELECT l.id, t.level, t.pos < (l.pos >> t.level) AS before, t.digest
  FROM leaves l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.id, s.height + t.level, t.pos < (s.pos >> t.level), t.digest
  FROM leaves l JOIN subs s ON s.g = l.g JOIN top t ON t.n > 1 AND t.pos = xor(s.pos >> t.level, 1)),
folded AS (
  SELECT l.id, 0::BIGINT AS level, l.now AS digest, s.height + r.height AS height
  FROM leaves l JOIN subs s ON s.g = l.g, root r
  UNION ALL
  SELECT f.id, f.level + 1, sha256(CASE WHEN s.before THEN s.digest || f.digest ELSE f.digest || coalesce(s.digest, '') END), f.height
  FROM folded f LEFT JOIN siblings s ON s.id = f.id AND s.level = f.level WHERE f.level < f.height),
proofs AS (SELECT id, string_agg(digest, '' ORDER BY level) AS proof FROM siblings GROUP BY id)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root,
       f.digest = r.root AS verified
FROM leaves l JOIN subs s ON s.g = l.g JOIN folded f ON f.id = l.id AND f.level = f.height LEFT JOIN proofs p ON p.id = l.id, root r"""


@_query
def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from panelcast.llm import decontaminate

    hits = decontaminate.document_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE["op12_suffix_decontamination"] = f"""
WITH doc AS (SELECT row_number() OVER () AS id, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT id, w, k, unnest(range(len(w) - k + 1)) AS i FROM doc, sizes WHERE len(w) >= k),
found AS (
  SELECT id, k, i, win FROM (SELECT id, k, i, array_to_string(w[i + 1:i + k], ' ') AS win FROM places)
  WHERE (k, win) IN (SELECT (k, win) FROM windows)),
hit AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + k)) AS word FROM found) GROUP BY id),
named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT f.id, n.item FROM found f JOIN windows n ON n.k = f.k AND n.win = f.win WHERE n.item IS NOT NULL) GROUP BY id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON h.id = d.id LEFT JOIN named n ON n.id = d.id"""
