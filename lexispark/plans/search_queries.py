"""Queries of browsing, search, question answering and index audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import providers
from lexispark.functions import vectors as v
from lexispark.operators import browse, search
from lexispark.plans import entries as e

#: Limits that give each stage something to do on invented vectors.
NEAR, KEYWORD_NEAR, FAR = 0.2, 0.1, 0.05


def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, B1, B2, K7."""
    found = browse.matching(e.entries(spark, sf_dir), alphabet="T", category="en")
    return browse.page(found, number=2, size=20).select("id", "Alphabet", "base_alphabet", "category", "poem")


def browse_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, G5."""
    return browse.totals(browse.matching(e.entries(spark, sf_dir), alphabet="T", category="en"), size=20)


def browse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards of the user count."""
    found = browse.matching(e.entries(spark, sf_dir), search="ING TO%ES_A")
    more = browse.matching(e.entries(spark, sf_dir), search="erthe an")
    return found.unionByName(more).select("id", "category", "base_alphabet")


def browse_search_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 with only A-Z of the column folded."""
    return browse.matching(e.entries(spark, sf_dir), search="éré", compat="ascii").select("id", "category", "base_alphabet")


def letter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, G4, B16."""
    return browse.facets(e.entries(spark, sf_dir), "base_alphabet", "category")


def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4, K11."""
    return browse.literal(e.entries(spark, sf_dir), " All rights Reserved ", ("poem", "category", "source", "Alphabet")).select("id", "category", "source")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, K1."""
    top = search.nearest(e.vectors(spark, sf_dir), e.query_vector(spark, sf_dir), 150)
    return top.select("vec_id", "entry_ord", "facet", F.round("score", 6).alias("score"))


def maxsim_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, G1, G2, B5, W6, F14."""
    best = search.best_entries(e.vectors(spark, sf_dir), e.query_vector(spark, sf_dir), NEAR, 50)
    return best.select("entry_ord", F.round("score", 6).alias("score"), v.facet_name(F.col("facet")).alias("facet"))


def keyword_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, G6, U4."""
    return search.vocabulary(e.tagged(spark, sf_dir))


def keyword_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return search.inverted(e.tagged(spark, sf_dir))


def keyword_expand_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, J4, W10."""
    top = search.nearest(e.keyword_vectors(spark, sf_dir), e.query_vector(spark, sf_dir), 10).select("keyword", "score")
    return search.expand(top, e.tagged(spark, sf_dir), 20).select("keyword", "ordinal", F.round("score", 6).alias("score"))


def _candidates(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    return search.matches(e.vectors(spark, sf_dir), e.keyword_vectors(spark, sf_dir), e.tagged(spark, sf_dir), e.query_vector(spark, sf_dir), **limits)


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("entry_ord", F.round("score", 6).alias("score"), "match_type", *more)


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, G3, K3."""
    matches = _candidates(spark, sf_dir, threshold=NEAR, keyword_threshold=KEYWORD_NEAR).where("grp = 0")
    return _shown(search.ranked(search.fused(matches), 60))


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category filter above the ranked candidates."""
    matches = _candidates(spark, sf_dir, threshold=NEAR, keyword_threshold=KEYWORD_NEAR).where("grp = 0")
    top = search.ranked(search.fused(matches), 60)
    rows = top.join(e.tagged(spark, sf_dir).select(F.col("ordinal").alias("entry_ord"), "category"), "entry_ord")
    return _shown(search.in_category(rows, "(BRAND#11)"), "category")


def fallback_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3.1 step 5: nothing passes the strict limits, so the relaxed search answers."""
    matches = _candidates(spark, sf_dir, threshold=1.5, keyword_threshold=1.5, relaxed=FAR)
    return _shown(search.fused(search.first_group(matches)))


def fallback_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3.1 step 5: nothing semantic at all, so the first three keywords are forced."""
    matches = _candidates(spark, sf_dir, threshold=1.5, keyword_threshold=1.5, relaxed=1.5)
    return _shown(search.fused(search.first_group(matches)))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with category and k."""
    found = search.search(
        e.vectors(spark, sf_dir), e.keyword_vectors(spark, sf_dir), e.tagged(spark, sf_dir), e.query_vector(spark, sf_dir),
        text="steel", category="all", k=25, threshold=NEAR, keyword_threshold=KEYWORD_NEAR,
    )
    return _shown(found, "category")


def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, Q6."""
    rows = e.entries(spark, sf_dir)
    return search.resolve(rows.select(F.col("id").alias("asked"), F.col("poem").alias("key")), rows.select("ordinal", F.col("id").cast("string").alias("id"), "poem")).select("asked", "id")


def retrieve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, X3, K5."""
    top = search.best_entries(e.vectors(spark, sf_dir), e.query_vector(spark, sf_dir), None, 20)
    concern = e.read(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"]
    docs = e.documents(spark, sf_dir).select(F.col("doc_id").alias("entry_ord"), "text")
    candidates = docs.join(F.broadcast(top), "entry_ord")
    return search.rerank(candidates, providers.jaccard(F.lit(concern), F.col("text"))).select("entry_ord", F.round("score", 6).alias("score"), F.round("rerank", 6).alias("rerank"))


def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, G9, G10, G11, G20."""
    items = e.documents(spark, sf_dir).select(F.col("doc_id").alias("entry_ord"))
    found = search.audit(e.vectors(spark, sf_dir), items)
    return found.select("n_vectors", "dim", "n_zero", "n_duplicate", F.round("mean_norm", 6).alias("mean_norm"), "n_entries", "n_astray", "n_missing", F.round("per_entry", 6).alias("per_entry"))


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, F13."""
    rows = e.vectors(spark, sf_dir).withColumn("u", v.unit(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return rows.select("vec_id", F.transform("u", lambda x: F.round(x, 5) + 0.0).alias("unit"), F.round(v.norm(F.col("u")), 6).alias("norm"), F.round(v.cosine(F.col("u"), F.col("embedding")), 6).alias("cosine"))


def vocab_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 against a frozen vocabulary."""
    terms = e.keyword_vectors(spark, sf_dir)
    rows = e.read(spark, sf_dir, "embeddings")
    names = terms.select((F.col("vec_id") + 100).alias("vec_id"), F.upper("keyword").alias("known"))
    named = rows.join(names, "vec_id", "left").select(F.col("vec_id").alias("cand_id"), F.coalesce("known", F.concat(F.lit("term "), F.col("vec_id").cast("string"))).alias("name"), "embedding")
    return search.vocabulary_terms(named, terms.select("keyword", "embedding"), 0.3)


QUERIES = {
    f.__name__: f
    for f in (
        browse_page, browse_totals, browse_search, browse_search_ascii, letter_facets, literal_search, vector_topk, maxsim_entries, keyword_vocabulary, keyword_inverted,
        keyword_expand_capped, hybrid_fusion, hybrid_filtered, fallback_stage, fallback_keywords, hybrid_search, resolve_ids, retrieve_rerank, index_audit, normalize_vectors, vocab_resolve,
    )
}

_LETTER = """CASE WHEN trim(coalesce(letter, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = '' THEN 'A' ELSE
  translate(upper(letter), 'AĂÂÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶEÊÉÈẺẼẸẾỀỂỄỆIÍÌỈĨỊOÔƠÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢUƯÚÙỦŨỤỨỪỬỮỰYÝỲỶỸ',
                           'AAAAAAAAAAAAAAAAAAEEEEEEEEEEEEIIIIIIOOOOOOOOOOOOOOOOOOUUUUUUUUUUUUYYYYY') END"""
_ENTRIES = f"""entries AS (SELECT doc_id AS id, letter AS "Alphabet", {_LETTER} AS base_alphabet, lang AS category, text AS poem, source
  FROM (SELECT *, substr(text, 1, 1) AS letter FROM documents) d)"""
_VECTORS = """q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
vectors AS (SELECT vec_id, vec_id // 3 AS entry_ord, (vec_id % 3)::INT AS facet, list_dot_product(embedding::DOUBLE[], qv) AS score FROM embeddings, q)"""
_FACET = "['poem', 'meaning', 'keywords'][facet + 1]"
_BEST = """best AS (SELECT entry_ord, max(score) AS score, arg_max(facet, (score, -vec_id)) AS facet, arg_max(vec_id, (score, -vec_id)) AS vec_id
  FROM vectors WHERE score >= {t} GROUP BY entry_ord ORDER BY score DESC, vec_id LIMIT {n})"""
_KEYWORDS = """kr AS (SELECT DISTINCT p_partkey AS ordinal, unnest(string_split(lower(p_name), ' ')) AS keyword FROM part),
kv AS (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS vec_id FROM (SELECT DISTINCT keyword FROM kr WHERE keyword <> '') w),
ks AS (SELECT keyword, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM kv JOIN vectors USING (vec_id) ORDER BY rank LIMIT 10),
ke AS (SELECT * FROM (SELECT keyword, ordinal, score, rank, row_number() OVER (PARTITION BY keyword ORDER BY ordinal) AS place FROM kr JOIN ks USING (keyword)) x WHERE place <= 20)"""
_FUSED = """fused AS (SELECT entry_ord, max(score) AS score, arg_max(match_type, (score, -stage, -seq)) AS match_type, min((stage, seq)) AS first FROM m GROUP BY entry_ord)"""
_STAGES = f"""{_VECTORS}, {_BEST.format(t=NEAR, n=50)}, {_KEYWORDS},
m AS (
  SELECT entry_ord, score, {_FACET} AS match_type, 1 AS stage, row_number() OVER (ORDER BY score DESC, vec_id) AS seq FROM best
  UNION ALL SELECT ordinal, score, 'keyword: ' || keyword, 2, rank * 1000 + place FROM ke WHERE score >= {KEYWORD_NEAR}),
{_FUSED}"""

ORACLES = {
    "browse_page": f"""WITH {_ENTRIES}
SELECT id, "Alphabet", base_alphabet, category, poem FROM entries WHERE base_alphabet = 'T' AND category = 'en'
ORDER BY "Alphabet" NULLS FIRST, poem NULLS FIRST, id NULLS FIRST LIMIT 20 OFFSET 20""",
    "browse_totals": f"""WITH {_ENTRIES}
SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS total_pages FROM entries WHERE base_alphabet = 'T' AND category = 'en'""",
    "browse_search": f"""WITH {_ENTRIES}
SELECT id, category, base_alphabet FROM entries WHERE lower(poem) LIKE '%ing to%es_a%'
UNION ALL SELECT id, category, base_alphabet FROM entries WHERE lower(poem) LIKE '%erthe an%'""",
    "browse_search_ascii": f"""WITH {_ENTRIES}
SELECT id, category, base_alphabet FROM entries
WHERE translate(poem, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%éré%'""",
    "letter_facets": f"WITH {_ENTRIES} SELECT base_alphabet, category, count(*) AS n FROM entries GROUP BY ALL",
    "literal_search": f"""WITH {_ENTRIES}
SELECT id, category, source FROM entries
WHERE contains(lower(poem), 'all rights reserved') OR contains(lower(category), 'all rights reserved')
   OR contains(lower(source), 'all rights reserved') OR contains(lower("Alphabet"), 'all rights reserved') ORDER BY id LIMIT 10""",
    "vector_topk": f"WITH {_VECTORS} SELECT vec_id, entry_ord, facet, round(score, 6) AS score FROM vectors ORDER BY vectors.score DESC, vec_id LIMIT 150",
    "maxsim_entries": f"WITH {_VECTORS}, {_BEST.format(t=NEAR, n=50)} SELECT entry_ord, round(score, 6) AS score, {_FACET} AS facet FROM best",
    "keyword_vocabulary": "SELECT DISTINCT keyword FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS keyword FROM part) p WHERE keyword <> ''",
    "keyword_inverted": """SELECT keyword, list(ordinal ORDER BY ordinal) AS ordinals
FROM (SELECT DISTINCT p_partkey AS ordinal, unnest(string_split(lower(p_name), ' ')) AS keyword FROM part) p WHERE keyword <> '' GROUP BY keyword""",
    "keyword_expand_capped": f"WITH {_VECTORS}, {_KEYWORDS} SELECT keyword, ordinal, round(score, 6) AS score FROM ke",
    "hybrid_fusion": f"WITH {_STAGES} SELECT entry_ord, round(score, 6) AS score, match_type FROM fused ORDER BY fused.score DESC, first LIMIT 60",
    "hybrid_filtered": f"""WITH {_STAGES}, top AS (SELECT * FROM fused ORDER BY score DESC, first LIMIT 60)
SELECT entry_ord, round(score, 6) AS score, match_type, p_brand AS category FROM top JOIN part ON entry_ord = p_partkey WHERE lower(p_brand) = 'brand#11'""",
    "fallback_stage": f"""WITH {_VECTORS}, {_BEST.format(t=FAR, n=10)}
SELECT entry_ord, round(score, 6) AS score, {_FACET} || ' (gợi ý)' AS match_type FROM best""",
    "fallback_keywords": f"""WITH {_VECTORS}, {_KEYWORDS},
m AS (SELECT ordinal AS entry_ord, score, 'keyword: ' || keyword || ' (gợi ý)' AS match_type, 4 AS stage, rank * 1000 + place AS seq FROM ke WHERE rank <= 3 AND place <= 5),
{_FUSED} SELECT entry_ord, round(score, 6) AS score, match_type FROM fused""",
    "hybrid_search": f"""WITH {_STAGES}
SELECT entry_ord, round(score, 6) AS score, match_type, p_brand AS category FROM fused JOIN part ON entry_ord = p_partkey
ORDER BY fused.score DESC, first LIMIT 25""",
    "resolve_ids": """SELECT d.doc_id AS asked, coalesce(f.id, '') AS id
FROM documents d LEFT JOIN (SELECT text, min(doc_id)::VARCHAR AS id FROM documents GROUP BY text) f ON trim(d.text) = f.text""",
    "retrieve_rerank": f"""WITH {_VECTORS}, {_BEST.format(t=-9, n=20)},
c AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n]+'), lambda w: w <> '')) AS cw FROM benchmark WHERE item_id = 0),
d AS (SELECT entry_ord, score, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n]+'), lambda w: w <> '')) AS dw FROM best JOIN documents ON doc_id = entry_ord),
r AS (SELECT entry_ord, score, len(list_intersect(cw, dw)) / (len(cw) + len(dw) - len(list_intersect(cw, dw))) AS rerank FROM d, c)
SELECT entry_ord, round(score, 6) AS score, round(rerank, 6) AS rerank FROM r ORDER BY r.rerank DESC, r.score DESC, entry_ord LIMIT 3""",
    "index_audit": """WITH v AS (SELECT vec_id // 3 AS entry_ord, embedding FROM embeddings),
f AS (SELECT count(*) AS n_vectors, max(len(embedding)) AS dim, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS n_zero,
             count(*) - count(DISTINCT embedding) AS n_duplicate, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm,
             count(DISTINCT entry_ord) AS n_entries FROM v)
SELECT *, (SELECT count(*) FROM v WHERE entry_ord NOT IN (SELECT doc_id FROM documents)) AS n_astray,
       (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT entry_ord FROM v)) AS n_missing, round(n_vectors / n_entries, 6) AS per_entry FROM f""",
    "normalize_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: x::DOUBLE * 3) AS x FROM embeddings),
u AS (SELECT vec_id, e, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS u FROM v)
SELECT vec_id, list_transform(u, lambda y: round(y, 5) + 0.0::DOUBLE) AS unit, round(sqrt(list_dot_product(u, u)), 6) AS norm,
       round(list_dot_product(u, e) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(e, e))), 6) AS cosine FROM u""",
    "vocab_resolve": f"""WITH {_VECTORS}, {_KEYWORDS},
terms AS (SELECT keyword, vec_id, embedding::DOUBLE[] AS t FROM kv JOIN embeddings USING (vec_id)),
cand AS (SELECT c.vec_id AS cand_id, coalesce(upper(k.keyword), 'term ' || c.vec_id) AS name, c.embedding::DOUBLE[] AS e
         FROM embeddings c LEFT JOIN kv k ON c.vec_id = k.vec_id + 100),
exact AS (SELECT cand_id, name, e, keyword AS exact FROM cand LEFT JOIN kv ON lower(name) = keyword),
near AS (SELECT cand_id, arg_max(keyword, (s, keyword)) AS near, max(s) AS s FROM (
  SELECT cand_id, keyword, list_dot_product(e, t) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(t, t))) AS s FROM exact, terms WHERE exact IS NULL) x GROUP BY cand_id)
SELECT cand_id, coalesce(exact, CASE WHEN s >= 0.3 THEN near END, name) AS keyword,
       CASE WHEN exact IS NOT NULL THEN 'exact' WHEN s >= 0.3 THEN 'near' ELSE 'new' END AS kind FROM exact LEFT JOIN near USING (cand_id)""",
}
