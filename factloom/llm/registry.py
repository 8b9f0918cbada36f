"""The queries of this subpackage, by name, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, exact_dedup, fingerprint, html_extract, merkle, near_dedup, packing, periodic_runs, quality, sentencepieces, sharding, toxicity, warc
from factloom.llm.common import table

ORACLES: dict[str, str] = {}


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""

def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.mark(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op6_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: SQL with a column ``text``: its CRC-32, by the byte table that the polynomial defines.
_CRC32 = """
  xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(text))), lambda i: (16 * (instr('0123456789ABCDEF', substr(hex(encode(text)), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(text)), 2 * i + 2, 1)) - 1)::UBIGINT)),
    lambda c, b: xor(c // 256, crc_bytes[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"""
_CRC_BYTES = """(SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS crc_bytes FROM range(256) t(i))"""

ORACLES["op6_jump_hash_sharding"] = f"""
WITH RECURSIVE hop(doc_id, k, j) AS (
  SELECT doc_id, doc_id::UHUGEINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k2, floor((j + 1) * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2 FROM hop WHERE j < 17)),
placed AS (
  SELECT doc_id, max(j) FILTER (WHERE j < 16)::INTEGER AS shard, max(j) FILTER (WHERE j < 17)::INTEGER AS grown_shard FROM hop GROUP BY doc_id),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_CRC32} AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_CRC_BYTES}),
stripes AS (SELECT greatest(1, ceil(count(*) / 32000.0))::BIGINT AS s FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT % s::UBIGINT, doc_id) - 1 AS slot, grown_shard
FROM sized JOIN placed USING (doc_id), stripes
"""

def op10_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(extra))


def _escaped_sql() -> str:
    out = "replace(text, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{chat.ESCAPES[control[0]]}{control[1:]}')"
    return out


ORACLES["op9_chat_formatting"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped_sql()}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 20 + length(role) END)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_of(table(spark, sf_dir, "documents").select("doc_id", "text"), periodic_runs.plant)


_CRC_OF_ID = f"SELECT r, {_CRC32} AS h FROM (SELECT r, doc_id::VARCHAR AS text FROM d), {_CRC_BYTES}"

# Words equal to those a period on, found by joining equal words, form stretches without gaps.
ORACLES["op11_periodic_runs"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS ({_CRC_OF_ID}),
g AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d JOIN k USING (r)),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
e AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
t AS (SELECT r, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM e),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS m FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, m, min(q) AS q FROM stretch GROUP BY r, s, m),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
         first(struct_pack(s := s, m := m, q := q) ORDER BY m::DOUBLE / q DESC, s, q) AS best
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS words FROM t ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period, 1000 * best.m // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    return merkle.manifest(docs, merkle.tampered_third(F.col("doc_id")))


#: Levels that the SQL unrolls: enough for 8 ** 7 documents of one language.
_LEVELS = 7


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of a tree: {name}k are its levels (g, i, d, l, r: siblings before and after; top: the only node), {name}top its roots."""
    out = []
    for k in range(_LEVELS + 1):
        below = leaves if k == 0 else f"(SELECT g, i // 8 AS i, sha256(run) AS d FROM {name}{k - 1} WHERE NOT top AND i % 8 = 0)"
        out.append(f"""{name}{k} AS (
  SELECT g, i, d, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r,
         string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run,
         count(*) OVER (PARTITION BY g) = 1 AS top
  FROM {below} WINDOW w AS (PARTITION BY g, i // 8 ORDER BY i))""")
    return ",\n".join(out) + f",\n{name}top AS (" + " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE top" for k in range(_LEVELS + 1)) + ")"


def _folded_sql(name: str, rows: str, level: int, columns: str) -> str:
    """One level's step for ``rows`` (g, at: node number, proof, f: digest so far)."""
    return f"""SELECT {columns}, x.g, x.at // 8 AS at, CASE WHEN t.top IS NULL OR t.top THEN x.proof ELSE concat(x.proof, t.l, t.r) END AS proof,
  CASE WHEN t.top IS NULL OR t.top THEN x.f ELSE sha256(concat(t.l, x.f, t.r)) END AS f
  FROM {rows} x LEFT JOIN {name}{level} t ON x.g = t.g AND x.at = t.i"""


def _merkle_sql() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode({c}::VARCHAR)), ':', {c}) END"
    digest = lambda text: "sha256(concat(" + ", ".join(value(text if c == "text" else c) for c in merkle.COLUMNS) + "))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, columns = [], "x.doc_id, x.d, x.top"
    for k in range(_LEVELS):
        steps.append(f"f{k + 1} AS ({_folded_sql('n', f'f{k}', k, columns)})")
    steps.append(f"h0 AS (SELECT f.doc_id, f.d, f.top, t.d AS subroot, 'all' AS g, t.i AS at, f.proof, f.f FROM f{_LEVELS} f JOIN tops t ON f.g = t.name)")
    for k in range(_LEVELS):
        steps.append(f"h{k + 1} AS ({_folded_sql('m', f'h{k}', k, columns + ', x.subroot')})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
k AS ({_CRC_OF_ID}),
leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE concat('=', lang) END AS g, {digest('text')} AS d,
         CASE WHEN h % 3 = 0 THEN {digest(lowered)} END AS changed
  FROM d JOIN k USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM leaves),
{_tree_sql('n', '(SELECT g, i, d FROM placed)')},
tops AS (SELECT 'all' AS g, g AS name, d, row_number() OVER (ORDER BY g) - 1 AS i FROM ntop),
{_tree_sql('m', '(SELECT g, i, d FROM tops)')},
f0 AS (SELECT doc_id, d, true AS top, g, i AS at, '' AS proof, coalesce(changed, d) AS f FROM placed),
{", ".join(steps)}
SELECT doc_id, h.d AS leaf, subroot, m.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m.d AS verified FROM h{_LEVELS} h, mtop m
"""


ORACLES["op12_merkle_manifest"] = _merkle_sql()


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLES["op13_warc_archive"] = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs, "op12_merkle_manifest": op12_merkle_manifest, "op13_warc_archive": op13_warc_archive, "op5_sentencepiece": op5_sentencepiece, "op4_html_extraction": op4_html_extraction, "op7_toxicity": op7_toxicity, "op8_quality": op8_quality, "op9_chat_formatting": op9_chat_formatting, "op10_piecewise_fingerprints": op10_piecewise_fingerprints, "op6_jump_hash_sharding": op6_jump_hash_sharding, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op1_best_fit_packing": op1_best_fit_packing, "op3_exact_dedup": op3_exact_dedup}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
