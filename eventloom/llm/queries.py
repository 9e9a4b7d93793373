"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import tokenizer_path

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.language_id import predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs, model, columns=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(BPE))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.token_counts import token_counts

    docs = _table(spark, sf_dir, "documents")
    return token_counts(docs, tokenizer_path(BPE), store=True, keep=["doc_id"]).withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.secret_scan import BASE_RULES, blob_name, digest, scan

    docs = _table(spark, sf_dir, "documents")
    # two deliveries: the blobs whose name begins with 0 to 7, and then the whole table, of which only the others are fetched and scanned
    _, ledger = scan(docs.where(blob_name(F.col("text")) < "8"))
    found, _ = scan(docs, ledger, columns=["doc_id"])
    base = [r.name for r in BASE_RULES]
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) n_{k}") for k in base],
        F.sha2(digest(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"), columns=["page_id", "url"])


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.token_files import write_and_read

    return write_and_read(_table(spark, sf_dir, "documents"), tokenizer_path(BPE))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.toxicity import score, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, labels.where(~held_out))
    return score(docs, model, columns=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.merkle import FIELDS, fold, leaf_hash, manifest, siblings

    def tampered(col):
        """The leaf of a row whose id has an even checksum, its text without line feeds; null for others."""
        text = F.replace(col("text"), F.lit("\n"), F.lit(""))
        return F.when(F.crc32(col("doc_id").cast("string")) % 2 == 0, leaf_hash([text if f == "text" else col(f) for f in FIELDS]))

    rows = manifest(_table(spark, sf_dir, "documents"), columns=["doc_id"], also={"tampered": tampered})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.vector_codes import codes

    return codes(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.exact_dedup import Delivery, DigestIndex

    docs = _table(spark, sf_dir, "documents")
    # two deliveries that share texts: the second finds the first one's digests in the index
    rows = Delivery(docs, lambda id: F.when(F.xxhash64(id) % 2 == 0, "first").otherwise("second"), columns=["doc_id"])
    index = DigestIndex(spark, id_type=rows.id_type)
    for part in ("first", "second"):
        index.add(rows.rows.where(F.col("delivery") == part), part)
    out = index.decide(rows)
    index.close()
    return out


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scans": op4_secret_scans,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_files": op6_token_files,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}



def _secrets_sql() -> str:
    from eventloom.llm.secret_scan import ASSIGN, BASE_RULES, RULES

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    tests = {"assign": f"length(regexp_extract(m, {quote('^' + ASSIGN)}, 2)) >= 12", "access": "length(m) >= 18"}
    parts = []
    for order, rule in enumerate(RULES):
        found = f"SELECT doc_id, string_split_regex(t, {quote(rule.pattern)}) AS g, regexp_extract_all(t, {quote(rule.pattern)}) AS ms FROM d"
        placed = f"SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s FROM ({found}) WHERE len(ms) > 0"
        parts.append(f"SELECT doc_id, {order} AS o, '{rule.name}' AS k, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM ({placed}) WHERE {tests.get(rule.name, 'true')}")
    base = len(BASE_RULES)
    text = "k || ':' || s || ':' || e, ',' ORDER BY s, o"
    counts = ", ".join(f"CAST(count(*) FILTER (k = '{r.name}') AS BIGINT) AS n_{r.name}" for r in BASE_RULES)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({text}) FILTER (o < {base}), '')) AS base_sha256, coalesce(string_agg({text}) FILTER (k IS NOT NULL), '') AS spans FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"
    )


#: Components of links l (a, b), both directions, as c (a, m): the smallest id that each reaches.
_REACH = "r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a)"

_NEAR_SQL = (
    "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents), "
    "s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')] ELSE list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i + 2], ' ')) END) AS h FROM w), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
    "p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL), "
    "l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), "
    + _REACH
    + " SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"
)

_VECTORS_SQL = (
    "WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9), "
    + _REACH
    + ", n AS (SELECT a, count(*) AS n FROM l GROUP BY a) SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"
)

_EXACT_SQL = (
    "WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents) "
    "SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256 FROM d WINDOW w AS (PARTITION BY h ORDER BY c DESC, doc_id)"
)


def _merkle_sql() -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # a bit of the checksum
    for _ in range(7):
        shift = f"list_transform([{shift}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    crc = f"list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_transform([xor(a, x)], lambda c: {shift})[1], 4294967295::BIGINT)"
    tree = lambda name, first: (
        f"{name} AS ({first} UNION ALL SELECT g, l + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY g, l, p // 3, n)"
    )
    return (
        f"WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS bad FROM documents), "
        "r AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM d), "
        + tree("t", "SELECT g, 0 AS l, p, n, leaf AS h FROM r")
        + ", sub AS MATERIALIZED (SELECT g, h FROM t WHERE n = 1), "
        + tree("u", "SELECT 0::BIGINT AS g, 0 AS l, g AS p, (SELECT count(*) FROM sub) AS n, h FROM sub")
        # all levels of all trees as one list: those of the group, then those over the groups
        + ", top AS (SELECT max(l) AS l FROM t), al AS MATERIALIZED (SELECT g, l, p, h FROM t UNION ALL SELECT -1, l + 1000, p, h FROM u), "
        "f AS (SELECT doc_id, g, 0 AS l, p, coalesce(bad, leaf) AS h, '' AS proof, false AS ended FROM r "
        "UNION ALL SELECT f.doc_id, CASE WHEN count(m.h) = 0 AND any_value(f.l) < 1000 THEN -1 ELSE f.g END, CASE WHEN count(m.h) = 0 THEN 1000 ELSE f.l + 1 END, CASE WHEN count(m.h) = 0 THEN f.g ELSE f.p // 3 END, "
        "CASE WHEN count(m.h) = 0 THEN f.h ELSE sha256(string_agg(CASE WHEN m.p = f.p THEN f.h ELSE m.h END, '' ORDER BY m.p)) END, f.proof || coalesce(string_agg(m.h, '' ORDER BY m.p) FILTER (m.p <> f.p), ''), count(m.h) = 0 AND f.l >= 1000 "
        "FROM f LEFT JOIN (SELECT *, max(p) OVER (PARTITION BY g, l) AS most FROM al) m ON m.g = f.g AND m.l = f.l AND m.p // 3 = f.p // 3 AND m.most > 0 WHERE NOT f.ended GROUP BY f.doc_id, f.g, f.l, f.p, f.h, f.proof) "
        "SELECT r.doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified FROM r JOIN sub USING (g) JOIN (SELECT h FROM u WHERE n = 1) root ON true JOIN f ON f.doc_id = r.doc_id AND f.ended"
    )


def _codes_sql() -> str:
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(4096 * x) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, vec_id, p, e[p * (len(e) // 8) + 1:(p + 1) * (len(e) // 8)] AS e FROM v, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, e FROM x QUALIFY c < 16)",
    ]
    for k in range(7):
        distance = "list_sum(list_transform(list_zip(x.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, x.p, arg_min(b.c, {distance} * 16 + b.c) AS c, CAST(min({distance}) AS BIGINT) AS d, any_value(x.e) AS e FROM x JOIN b{k} b ON b.p = x.p GROUP BY r, x.p)")
        if k < 6:
            sums = f"SELECT p, c, i, floor_div AS e FROM (SELECT p, c, i, CAST(CASE WHEN sum(y) < 0 AND sum(y) % count(*) <> 0 THEN sum(y) // count(*) - 1 ELSE sum(y) // count(*) END AS BIGINT) AS floor_div FROM (SELECT p, c, unnest(e) AS y, generate_subscripts(e, 1) AS i FROM a{k}) GROUP BY p, c, i)"
            parts.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(n.e, b.e) AS e FROM b{k} b LEFT JOIN (SELECT p, c, list(e ORDER BY i) AS e FROM ({sums}) GROUP BY p, c) n USING (p, c))")
    parts.append("f AS MATERIALIZED (SELECT r, string_agg(lower(lpad(to_hex(c), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)")
    return (
        "WITH "
        + ", ".join(parts)
        + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) FROM b6) AS codebooks_sha256 FROM v JOIN f USING (r)"
    )


#: The others learn, encode or parse, which SQL can't express; brute-force versions in the tests stand in.
ORACLES: dict[str, str] = {"op4_secret_scans": _secrets_sql(), "op7_minhash_near_dedup": _NEAR_SQL, "op8_embedding_near_dedup": _VECTORS_SQL, "op11_merkle_manifest": _merkle_sql(), "op12_vector_codes": _codes_sql(), "op13_exact_dedup": _EXACT_SQL}
