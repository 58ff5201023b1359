"""The registered queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, embeddings, mixing, ngram_join, pii, quality, secrets, substrings, tokens, toxicity, urls, whitening
from .common import table

# --- 1: embedding near-dedup --------------------------------------------------------------


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, component, and whether it stays."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON v.vec_id = m.a LEFT JOIN n ON v.vec_id = n.x"""

# --- 2: secret scans ----------------------------------------------------------------------


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base kinds, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"] < secrets.BASE_KINDS)
    kinds = [r.kind for r in secrets.RULES]
    number = lambda i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(kinds[: secrets.BASE_KINDS])],
        F.sha2(secrets.as_text(base, kinds), 256).alias("base_sha256"),
        secrets.as_text(spans, kinds).alias("spans"),
    )


def _sql_quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        rx = _sql_quoted(r.pattern)
        parts.append(f"""
SELECT id, {i} AS k, {_sql_quoted(r.kind)} AS kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
    s := coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0),
    n := length(hits[i]), ok := length(vals[i]) >= {r.least}))) AS m
FROM (SELECT id, regexp_extract_all(t, {rx}, 0) AS hits, regexp_extract_all(t, {rx}, {r.group}) AS vals, string_split_regex(t, {rx}) AS gaps FROM d)""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT id, k, kind, CAST(m.s AS BIGINT) AS s, CAST(m.s + m.n AS BIGINT) AS e FROM ({' UNION ALL '.join(parts)}) WHERE m.ok),
joined AS (SELECT id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {secrets.BASE_KINDS}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (id)"""


# --- 7: n-gram Jaccard join ------------------------------------------------------------------


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of similar documents."""
    return ngram_join.join_similar(table(spark, sf_dir, "documents"))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (total - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON s.doc_id = m.a"""


# --- 8: mixing sources to target weights ----------------------------------------------------

#: The target weights: domains (the source's number modulo 4), languages, sources.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 3}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17


def mixed(docs: DataFrame) -> DataFrame:
    domain = F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS int)") % 4).cast("string"))
    return mixing.mix(docs, [domain, F.col("lang"), F.col("source")], [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS], MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "copies")


def mix_sql(docs: str = "documents", columns: str = "doc_id, lang, source") -> str:
    """SQL for ``mixed`` over a table or view, returning the columns and ``copies``."""

    def weight(key: str, weights: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"

    def level(n: int, above: str, weights: dict[str, int]) -> str:
        keys, parents = [f"k{i}" for i in range(n + 1)], [f"k{i}" for i in range(n)]
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        return f"""
c{n} AS (SELECT {', '.join(keys)}, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS cap FROM leaves GROUP BY {', '.join(keys)}),
w{n} AS (SELECT c.*, p.budget, ({weight(f'c.k{n}', weights)})::HUGEINT AS weight FROM c{n} c JOIN {above} p {'USING (' + ', '.join(parents) + ')' if parents else 'ON true'}),
r{n} AS (SELECT *, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts FROM w{n}
    WINDOW o AS ({part} ORDER BY cap::DOUBLE / weight::DOUBLE, k{n})),
f{n} AS (SELECT *, cap * wts <= lft * weight AS is_full FROM r{n}),
g{n} AS (SELECT {', '.join(keys)}, CASE WHEN is_full THEN cap ELSE
    ((budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0))::HUGEINT * weight) // (sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}))::HUGEINT END AS budget FROM f{n}),"""

    orders = "CASE p.whole " + " ".join(f"WHEN {e} THEN md5('{MIX_SEED}:{e}:' || coalesce(d.doc_id::VARCHAR, ''))" for e in range(MIX_EPOCHS)) + " ELSE '' END"
    return f"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n,
    coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 4), '') AS k0, coalesce(lang, '') AS k1, coalesce(source, '') AS k2 FROM {docs}),
leaves AS (SELECT k0, k1, k2, sum(n)::HUGEINT AS tokens FROM d GROUP BY ALL),
root AS (SELECT (coalesce(sum(tokens), 0)::HUGEINT * {MIX_PERCENT}) // 100 AS budget FROM leaves),
{level(0, 'root', DOMAIN_WEIGHTS)}
{level(1, 'g0', LANG_WEIGHTS)}
{level(2, 'g1', SOURCE_WEIGHTS)}
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest FROM leaves l JOIN g2 USING (k0, k1, k2)),
runs AS (SELECT d.*, whole, rest, {orders} AS ord FROM d JOIN plan p USING (k0, k1, k2)),
taken AS (SELECT *, whole + CASE WHEN whole < {MIX_EPOCHS} AND sum(n) OVER (PARTITION BY k0, k1, k2 ORDER BY ord, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM runs)
SELECT {columns}, copies::BIGINT AS copies FROM taken WHERE copies > 0"""


# --- 3: token counts ------------------------------------------------------------------------


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_tokens", F.octet_length("text").alias("n_bytes"))


# --- 4: personal data -----------------------------------------------------------------------


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base kinds, all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    kinds = [g.kind for g in pii.GENERATORS]
    base = F.filter("pii", lambda s: s["sure"])
    number = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(kinds[: pii.BASE_KINDS])],
        F.sha2(secrets.as_text(base, kinds), 256).alias("base_sha256"),
        secrets.as_text(F.col("pii"), kinds).alias("spans"),
    )


# --- 5: toxicity ------------------------------------------------------------------------------


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that aren't held out."""
    found = toxicity.tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "toxic_spans")


# --- 6: quality classifier --------------------------------------------------------------------


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and the verdict."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), F.round("limit", 4).alias("limit"), "accepted")


# --- 9: benchmark decontamination -----------------------------------------------------------------


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of a benchmark item in a document: a row for each."""
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rows = marked.select("doc_id", F.explode("leaks").alias("m"))
    return rows.select("doc_id", F.col("m.item").cast("long").alias("item_id"), F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), F.col("m.edits").cast("long").alias("edits"))


# --- 10: substring dedup ------------------------------------------------------------------------


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those removed as repeats, and a digest of what stays."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM s),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE r > 1),
x AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(w, lambda word, j: gone IS NULL OR NOT list_contains(gone, j)), ' ')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id"""


# --- 11: URL filters ----------------------------------------------------------------------------

#: Words of the hosts whose pages the list holds; nobody has published one for the given tables.
LISTED_WORDS = ("casino", "pills", "adult", "ads")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; listed are the pages of hosts with certain words."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(urls.host_of(F.col("url")).rlike(f"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"))
    return urls.judge(pages, listed).select("page_id", "host", "path", "rule", "listed", "verdict")


def _urls_sql() -> str:
    rules = ", ".join(f"({_sql_quoted(r.host)}, {_sql_quoted(r.path)}, {_sql_quoted(r.verdict)})" for r in urls.RULES)
    tracking = ", ".join(map(_sql_quoted, urls.TRACKING))
    return f"""
WITH a AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT id, page_id, r, translate(regexp_extract(r, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, '{urls.TRACKING_PREFIX}') AND NOT string_split(p, '=')[1] IN ({tracking}))) AS q FROM a),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS form FROM h),
listed AS (SELECT DISTINCT form FROM c WHERE form <> '' AND regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)')),
rules AS (SELECT * FROM (VALUES {rules}) AS t(rh, rp, rv)),
fit AS (SELECT id, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(rv, length(rh || rp) * 1000 + length(rh)) AS rv
    FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, l.form IS NOT NULL AS listed, coalesce(rv, CASE WHEN l.form IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit USING (id) LEFT JOIN listed l ON c.form = l.form"""


# --- 12: cross-tokenizer alignment ----------------------------------------------------------------

VOCABULARIES = "/opt/tokenizers"


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers correspond in every document."""
    found = alignment.align(table(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# --- 13: embedding whitening ------------------------------------------------------------------------


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight whitened components."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 8)
    rows = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_source_mix": op8_source_mix,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": EMBEDDING_SQL, "op2_secret_scans": _secrets_sql(), "op7_ngram_join": NGRAM_SQL, "op8_source_mix": mix_sql(), "op10_substring_dedup": SUBSTRING_SQL, "op11_url_filters": _urls_sql()}
