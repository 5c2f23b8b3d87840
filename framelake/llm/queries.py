"""The dealt operators as named queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import collocations, jaccard, langid, line_dedup, lm, mixing, negatives, packing, qda, quality, secrets, topk, toxicity
from framelake.llm import text as T

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The installed tokenizer file; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(T.documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["rule"] < len(secrets.BASE_RULES))
    numbers = F.transform("found", lambda s: s["rule"])
    counts = [F.size(F.array_remove(numbers, i)) for i, _ in enumerate(secrets.BASE_RULES)]
    counts = [(F.size("found") - n).cast("long").alias(f"n_{r.kind}") for n, r in zip(counts, secrets.BASE_RULES)]
    digest = F.sha2(secrets.listing(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.listing(F.col("found")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(T.documents(spark, sf_dir).select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir)
    held_out = T.fold_of(modulus=4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).withColumn("held_out", held_out)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = T.documents(spark, sf_dir), T.fold_of(modulus=10)
    return lm.score(docs, fold != 0, fold == 9).withColumn("held_out", fold == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, T.table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(T.documents(spark, sf_dir), width=4, least=85)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(T.documents(spark, sf_dir), tokenizer_path())
    digest = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(T.stored(digest, "pieces"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir)
    held_out = T.fold_of(modulus=5) == 0
    model = toxicity.fit(docs.where(~held_out), T.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", held_out)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(T.documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(T.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(T.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = T.fold_of(modulus=5) == 0
    return qda.classify(T.documents(spark, sf_dir), T.table(spark, sf_dir, "labels"), ~held_out).withColumn("held_out", held_out)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(T.documents(spark, sf_dir).select("lang", "text"))


def _op1_sql() -> str:
    """One list of matches per rule, each with its place from the lengths of the gaps before it."""
    lists, texts = [], []
    for i, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        texts.append(
            f"list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS g{i}, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS m{i}, "
            f"list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS v{i}"
        )
        lists.append(
            f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: v{i}[k] >= {rule.least}), lambda k: "
            f"{{'s': list_sum(g{i}[1:k]) + coalesce(list_sum(m{i}[1:k-1]), 0), 'r': {i}, 'e': list_sum(g{i}[1:k]) + list_sum(m{i}[1:k])}})"
        )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    listing = f"array_to_string(list_transform({{}}, lambda x: {kinds}[x.r + 1] || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.e AS BIGINT)), ',')"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.r = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(secrets.BASE_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {", ".join(texts)} FROM d),
f AS (SELECT doc_id, list_sort({" || ".join(lists)}) AS f FROM p)
SELECT doc_id, {counts}, sha256({listing.format(f"list_filter(f, lambda x: x.r < {len(secrets.BASE_RULES)})")}) AS base_sha256,
       {listing.format("f")} AS spans FROM f
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) || coalesce(CAST(doc_id AS VARCHAR), '') AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][CAST(rank % 3 AS INTEGER) + 1]::DOUBLE AS weight FROM s
), r AS (
  SELECT *, 2 * source_size / weight AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2 * coalesce(sum(source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, rank, source_size,
         CASE WHEN ratio <= level THEN CAST(2 * source_size AS DOUBLE)
              ELSE weight * min_by(level, CASE WHEN ratio > level THEN (ratio, rank) END)
                            FILTER (WHERE ratio > level) OVER () END AS target
  FROM l
), u AS (
  SELECT source, key, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, key HAVING sum(size) > 0
), c AS (
  SELECT u.source, u.key, u.size, t.rank, t.source_size, t.target,
         CAST(sum(u.size) OVER (PARTITION BY u.source ORDER BY u.key) AS BIGINT) AS upto
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT c.*, p.pass, (p.pass * source_size + upto)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) p(pass)
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, key) AS running, (SELECT sum(size) FROM u) AS everything FROM f
), k AS (
  SELECT source, key, CAST(count(*) FILTER (WHERE 2 * running - size < 2 * 1.5::DOUBLE * everything) AS BIGINT) AS copies FROM g GROUP BY source, key
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(CASE WHEN d.size > 0 THEN coalesce(k.copies, 0) * d.size ELSE 0 END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id
FROM n JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id
"""

OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT min(n) AS n, vec_id, label, e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id, label, e
), s AS (
  SELECT q.n, q.vec_id AS anchor_id, v.vec_id, v.label = q.label AS same,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON v.label <> q.label OR v.vec_id <> q.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS slot FROM s WHERE same
), r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.n, p.slot ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.slot <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""

OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
), g AS (
  SELECT lang, k AS width, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, width, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE width = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE width > 1 AND a >= 100),
inner_of AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, width - k + 2)) AS i FROM c, (VALUES (2), (3), (4)) AS s(k) WHERE k < width) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inner_of i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a
), cut AS (
  SELECT kept.lang, kept.phrase, kept.a, n.n, k, l.a AS l, r.a AS r,
         1000 * CAST(kept.a AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(l.a AS HUGEINT) * CAST(r.a AS HUGEINT)) AS score
  FROM (SELECT *, unnest(range(1, width)) AS k FROM kept) kept JOIN n ON n.lang = kept.lang
  JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
), low AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cut
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE place = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": _op1_sql(),
    "op6_jaccard_join": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
