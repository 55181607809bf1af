"""The ``opN_*`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, judged
    hits = judged(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@register("op4_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS place
  FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest_index import DigestIndex
    docs = _table(spark, sf_dir, "documents")
    index = DigestIndex.create(spark, docs.count())
    return index.add(docs).select("doc_id", "keep_id", "group_size", "kept",
                                  F.lower(F.hex("digest")).alias("text_sha256"))


@register("op10_virtual_slots")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_slots
    placed, _, _ = shard_by_slots(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def _bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op3_pack_column_generation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(_table(spark, sf_dir, "documents"), _bpe_path())


@register("op7_bitplane_ids")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitplanes import read_documents, write_ids
    from .common import shared_path
    path = shared_path(spark, "token_ids")
    write_ids(_table(spark, sf_dir, "documents"), path, _bpe_path())
    return read_documents(spark, path)


@register("op2_toxicity_nb_ngrams")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, fit, held_out
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op5_jaccard_multi_order")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


@register("op6_piece_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_counts import token_counts
    return token_counts(_table(spark, sf_dir, "documents"), _bpe_path())


@register("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import cut_repeats
    return cut_repeats(_table(spark, sf_dir, "documents"), keep_bytes=False)


@register("op9_line_spread", r"""
WITH texts AS (
  SELECT text, min(CAST('0x' || left(md5(coalesce('1' || source, '')), 15) AS BIGINT)) AS site
  FROM documents WHERE length(text) > 0 GROUP BY text),
lines AS (
  SELECT text, site, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM texts),
trimmed AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
shared AS (
  SELECT line FROM trimmed WHERE length(line) >= 10 GROUP BY line HAVING count(DISTINCT site) >= 8),
marked AS (
  SELECT t.*, s.line IS NOT NULL AS hit FROM trimmed t LEFT JOIN shared s ON s.line = t.line),
cuts AS (
  SELECT text, count(*) FILTER (hit) AS n, sum(length(raw)) FILTER (hit) AS chars,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT hit) AS rest
  FROM marked GROUP BY text)
SELECT d.doc_id, coalesce(c.n, 0) AS lines_cut, CAST(coalesce(c.chars, 0) AS BIGINT) AS chars_cut,
       sha256(coalesce(c.rest, '')) AS text_sha256
FROM documents d LEFT JOIN cuts c ON c.text = d.text""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_spread import cut_shared_lines
    cut = cut_shared_lines(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("__lines_cut").cast("long").alias("lines_cut"),
                      F.col("__chars_cut").cast("long").alias("chars_cut"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''),
              lambda ch: ord(ch)::BIGINT)),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
              lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""


def _encoded_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


@register("op12_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '1' || lang END AS g,
         xor({_CRC32.format("doc_id")}, 4294967295) % 3 = 0 AS hit,
         sha256({" || ".join(_encoded_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         sha256({" || ".join(_encoded_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_encoded_sql(
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed
  FROM documents),
ranked AS (
  SELECT doc_id, g, leaf, hit, changed, count(*) OVER (PARTITION BY g) AS n,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT g, 0 AS level, pos, leaf AS hash, n FROM ranked
  UNION ALL
  SELECT g, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8),
subs AS (
  SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, hash, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
  SELECT r.g, r.pos, x.level, string_agg(x.hash, '' ORDER BY x.pos) FILTER (x.pos < r.pos >> (3 * x.level)) AS l,
         string_agg(x.hash, '' ORDER BY x.pos) FILTER (x.pos > r.pos >> (3 * x.level)) AS r
  FROM ranked r JOIN nodes x ON x.g = r.g AND x.n > 1 AND x.pos // 8 = r.pos >> (3 * x.level + 3)
  GROUP BY r.g, r.pos, x.level
  UNION ALL
  SELECT r.g, r.pos, 100 + x.level, string_agg(x.hash, '' ORDER BY x.pos) FILTER (x.pos < s.pos >> (3 * x.level)),
         string_agg(x.hash, '' ORDER BY x.pos) FILTER (x.pos > s.pos >> (3 * x.level))
  FROM ranked r JOIN subs s ON s.g = r.g JOIN tops x ON x.n > 1 AND x.pos // 8 = s.pos >> (3 * x.level + 3)
  GROUP BY r.g, r.pos, x.level),
paths AS (
  SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY level) AS k FROM steps),
folds AS (
  SELECT g, pos, 0 AS k, CASE WHEN hit THEN changed ELSE leaf END AS hash FROM ranked
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(coalesce(p.l, '') || f.hash || coalesce(p.r, ''))
  FROM folds f JOIN paths p ON p.g = f.g AND p.pos = f.pos AND p.k = f.k + 1),
ends AS (
  SELECT g, pos, arg_max(hash, k) AS folded_root FROM folds GROUP BY g, pos),
proofs AS (
  SELECT r.g, r.pos, sha256(coalesce(string_agg(coalesce(l, '') || coalesce(p.r, ''), '' ORDER BY k), '')) AS proof_sha256
  FROM ranked r LEFT JOIN paths p ON p.g = r.g AND p.pos = r.pos GROUP BY r.g, r.pos)
SELECT r.doc_id, r.leaf, s.hash AS subroot, t.hash AS root, proof_sha256, folded_root, folded_root = t.hash AS verified
FROM ranked r JOIN subs s ON s.g = r.g CROSS JOIN (SELECT hash FROM tops WHERE n = 1) t
JOIN proofs p ON p.g = r.g AND p.pos = r.pos JOIN ends e ON e.g = r.g AND e.pos = r.pos""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fold, manifest, proof_digest, tampered_leaf
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tree = manifest(docs, carry={"changed": F.when(hit, tampered_leaf(docs))})
    return tree.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    nearest = """
a{k} AS (
  SELECT p.row, p.part, arg_min(b.entry, (d(p.v, b.v), b.entry)) AS entry, min(d(p.v, b.v)) AS dist
  FROM parts p JOIN b{k} b ON b.part = p.part GROUP BY p.row, p.part)"""
    nearest = nearest.replace("d(p.v, b.v)", "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")
    mean = """
s{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS v
  FROM (SELECT part, entry, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS m
        FROM (SELECT a.part, a.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS i
              FROM a{k} a JOIN parts p ON p.row = a.row AND p.part = a.part)
        GROUP BY part, entry, i)
  GROUP BY part, entry),
b{next} AS (
  SELECT b.part, b.entry, coalesce(s.v, b.v) AS v
  FROM b{k} b LEFT JOIN s{k} s ON s.part = b.part AND s.entry = b.entry)"""
    steps = [x for k in range(rounds) for x in (nearest.format(k=k), mean.format(k=k, next=k + 1))]
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (
  SELECT row, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS v
  FROM (SELECT row, q, unnest(range({parts})) AS part FROM kept)),
b0 AS (SELECT part, row AS entry, v FROM parts WHERE row < {entries}),{",".join(steps)},{nearest.format(k=rounds)},
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code,
         CAST(sum(a.dist) AS BIGINT) AS error
  FROM a{rounds} a JOIN kept k ON k.row = a.row GROUP BY k.row, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM coded"""


@register("op13_trie_vector_codes", _vector_codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress
    coded, books = compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error",
                        F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


@register("op11_bootstrapped_pii")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data
    return find_personal_data(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
