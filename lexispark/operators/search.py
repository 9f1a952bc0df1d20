"""Hybrid search: exact vectors, keyword expansion, staged fallback (families A and B).

Vector rows are vec_id, entry_ord, facet, embedding. A query vector is a literal,
so scoring is a projection over the scan and top-k keeps k rows a task; nothing
is joined or broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as t
from lexispark.functions import vectors as v
from lexispark.operators import nearest as nearest_
from lexispark.sources.tables import stored, with_ordinal

THRESHOLD, KEYWORD_THRESHOLD, RELAXED = 0.6, 0.6, 0.25


def scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """All rows with their inner product."""
    return vectors.withColumn("score", v.dot(F.col("embedding"), query))


def nearest(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Exact top k; equal scores by vec_id (K1, K2, K6)."""
    if k < 1:
        raise ValueError("k starts at 1")
    return scored(vectors, query).orderBy(F.desc("score"), "vec_id").limit(k)


def best_entries(vectors: DataFrame, query: Sequence[float], threshold: float | None = THRESHOLD, limit: int = 50) -> DataFrame:
    """Entries by their best vector, with that vector's facet."""
    best = F.struct("score", (-F.col("vec_id")).alias("first"))
    found = scored(vectors, query)
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    grouped = found.groupBy("entry_ord").agg(F.max("score").alias("score"), F.max_by("facet", best).alias("facet"), F.max_by("vec_id", best).alias("vec_id"))
    return grouped.orderBy(F.desc("score"), "vec_id").limit(limit)


def keyword_rows(entries: DataFrame) -> DataFrame:
    """(keyword, ordinal) with each keyword of an entry once."""
    return entries.select("ordinal", F.explode(F.array_distinct(F.transform("keywords", t.normalized))).alias("keyword")).where("keyword <> ''")


def vocabulary(entries: DataFrame) -> DataFrame:
    """Distinct keywords, sorted."""
    return keyword_rows(entries).select("keyword").distinct().orderBy("keyword")


def inverted(entries: DataFrame) -> DataFrame:
    """Entries of each keyword, in order."""
    return keyword_rows(entries).groupBy("keyword").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def expand(keywords: DataFrame, entries: DataFrame, cap: int) -> DataFrame:
    """The first `cap` entries of each of the ranked keywords (rank, keyword, score).

    The ranked keywords are a top-k result of fixed size, hence the broadcast.
    """
    rows = keyword_rows(entries).join(F.broadcast(keywords), "keyword")
    first = Window.partitionBy("keyword").orderBy("ordinal")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= cap)


def fused(matches: DataFrame) -> DataFrame:
    """One row per entry from matches (entry_ord, score, match_type, stage, seq).

    The best score wins, the earliest match among equals gives the label, and the
    entry's first appearance in any stage breaks ties between entries.
    """
    best = F.struct("score", (-F.col("stage")).alias("s"), (-F.col("seq")).alias("q"))
    return matches.groupBy("entry_ord").agg(F.max("score").alias("score"), F.max_by("match_type", best).alias("match_type"), F.min(F.struct("stage", "seq")).alias("first"))


def ranked(candidates: DataFrame, limit: int) -> DataFrame:
    return candidates.orderBy(F.desc("score"), "first.stage", "first.seq").limit(limit)


def in_category(found: DataFrame, category: str | None) -> DataFrame:
    """Above the limit, so fewer than k rows may remain."""
    wanted = (category or "").replace("(", "").replace(")", "").strip().lower()
    return found if wanted in ("", "all") else found.where(t.clean_category(F.col("category")) == wanted)


def first_group(matches: DataFrame) -> DataFrame:
    """Only the matches of the first group that has any: the fallbacks in one plan (3.1)."""
    first = matches.agg(F.min("grp").alias("grp"))
    return matches.join(F.broadcast(first), "grp")


def matches(
    vectors: DataFrame, keyword_vectors: DataFrame, entries: DataFrame, query: Sequence[float], text: str = "",
    threshold: float = THRESHOLD, keyword_threshold: float = KEYWORD_THRESHOLD, relaxed: float = RELAXED, fields: tuple[str, ...] = ("poem",),
) -> DataFrame:
    """The matches of all stages: 1 and 2 are group 0, the relaxed semantic search 1, forced keywords 2, literal search 3."""
    by_rank = Window.orderBy(F.desc("score"), "vec_id")  # over a top-k result

    def staged(rows: DataFrame, label, *stages) -> DataFrame:
        """Each row as a match of every stage (condition, stage, group, suffix of the label) that takes it."""
        found = F.array(*[F.when(takes, F.struct(F.concat(label, F.lit(suffix)).alias("match_type"), F.lit(stage).alias("stage"), F.lit(grp).alias("grp"))) for takes, stage, grp, suffix in stages])
        return rows.select("entry_ord", "score", "seq", F.explode(F.array_compact(found)).alias("m")).select("entry_ord", "score", "m.match_type", "m.stage", "seq", "m.grp")

    # The strict and the relaxed search are two cuts of one ranking, and so are the two expansions of keywords.
    best = best_entries(vectors, query, min(threshold, relaxed), 50).withColumn("seq", F.row_number().over(by_rank).cast("long"))
    found = staged(best, v.facet_name(F.col("facet")), (F.col("score") >= threshold, 1, 0, ""), ((F.col("score") >= relaxed) & (F.col("seq") <= 10), 3, 1, t.SUGGESTION))

    keywords = nearest(keyword_vectors, query, 10).select("keyword", "score", F.row_number().over(by_rank).cast("long").alias("rank"))

    expanded = expand(keywords.where((F.col("score") >= keyword_threshold) | (F.col("rank") <= 3)), entries, 20)
    expanded = expanded.select(F.col("ordinal").alias("entry_ord"), "score", "keyword", "rank", "place", (F.col("rank") * 1_000 + F.col("place")).cast("long").alias("seq"))
    label = F.concat(F.lit("keyword: "), "keyword")
    forced = (F.col("rank") <= 3) & (F.col("place") <= 5)
    found = found.unionByName(staged(expanded, label, (F.col("score") >= keyword_threshold, 2, 0, ""), (forced, 4, 2, t.SUGGESTION)))
    if text:
        from lexispark.operators import browse

        plain = browse.literal(entries, text, fields)
        found = found.unionByName(
            plain.select(F.col("ordinal").alias("entry_ord"), F.lit(0.5).alias("score"), F.lit("text").alias("match_type"), F.lit(5).alias("stage"), F.col("ordinal").alias("seq"), F.lit(3).alias("grp"))
        )
    return found


def search(vectors: DataFrame, keyword_vectors: DataFrame, entries: DataFrame, query: Sequence[float], text: str = "", category: str | None = None, k: int = 50, **limits) -> DataFrame:
    """Ranked entries of the first stage group that finds any; entries: ordinal, keywords, category and the text fields.

    Candidates number some hundred at most (fixed caps), so they are broadcast to the entries.
    """
    if k < 1:
        raise ValueError("k starts at 1")
    candidates = fused(first_group(matches(vectors, keyword_vectors, entries, query, text, **limits)))
    rows = entries.join(F.broadcast(candidates), entries["ordinal"] == candidates["entry_ord"]).drop("ordinal")
    return ranked(in_category(rows, category), k)


def resolve(texts: DataFrame, entries: DataFrame, default: str = "") -> DataFrame:
    """The id of the first entry with each text, or a default (J5, Q6); texts: key; entries: ordinal, id, poem."""
    first = entries.groupBy("poem").agg(F.min_by("id", "ordinal").alias("id"))
    return texts.join(first, F.trim("key") == F.col("poem"), "left").select(*texts.columns, F.coalesce("id", F.lit(default)).alias("id"))


def rerank(candidates: DataFrame, score, keep: int = 3) -> DataFrame:
    """The best by a second score; equals in the order of the first (K5)."""
    return candidates.withColumn("rerank", score).orderBy(F.desc("rerank"), F.desc("score"), "entry_ord").limit(keep)


def complete(entries: DataFrame, *fields: str) -> DataFrame:
    """Entries whose fields are all filled."""
    for field in fields:
        entries = entries.where(t.strip(F.coalesce(F.col(field), F.lit(""))) != "")
    return entries


def index_rows(entries: DataFrame, facets: tuple[str, ...], embed) -> DataFrame:
    """Vectors of an index: one row per entry and facet with a word, numbered by entry and facet (family D, Q18, Q19)."""
    texts = F.array(*[F.struct(F.lit(i).alias("facet"), F.col(f).alias("text")) for i, f in enumerate(facets)])
    rows = entries.select(F.col("ordinal").alias("entry_ord"), F.explode(texts).alias("f")).where(F.col("f.text").rlike("[^ \t\n]"))
    embedded = rows.select("entry_ord", "f.facet", embed(F.col("f.text")).alias("e"))
    return embedded.select((F.col("entry_ord") * len(facets) + F.col("facet")).alias("vec_id"), "entry_ord", "facet", v.unit(F.col("e")).alias("embedding"))


def audit(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """One row: size, zero and duplicate vectors, mean norm, and rows without partner on either side.

    Hashes tell which vectors may be alike, and only those are compared whole. Null vectors count as
    duplicates. An index without vectors has null figures where there is nothing to average.
    """
    figures = vectors.agg(
        F.count("*").alias("n_vectors"),
        F.max(F.size("embedding")).cast("long").alias("dim"),
        F.count_if(F.forall("embedding", lambda x: x == 0)).alias("n_zero"),
        F.avg(v.norm(F.col("embedding"))).alias("mean_norm"),
        F.countDistinct("entry_ord").alias("n_entries"),
        F.count_if(F.col("embedding").isNull()).alias("_null"),
    )
    hashed = vectors.where("embedding is not null").select(F.xxhash64("embedding").alias("_hash"), "embedding")
    alike = hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash")
    copies = hashed.join(alike, "_hash", "left_semi").groupBy("_hash", "embedding").agg(F.count("*").alias("n"))
    duplicate = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))
    astray = vectors.join(items, "entry_ord", "left_anti").agg(F.count("*").alias("n_astray"))
    missing = items.join(vectors, "entry_ord", "left_anti").agg(F.count("*").alias("n_missing"))
    whole = figures.join(F.broadcast(duplicate)).join(F.broadcast(astray)).join(F.broadcast(missing))
    whole = whole.withColumn("n_duplicate", F.col("n_duplicate") + F.col("_null")).drop("_null")
    return whole.withColumn("per_entry", F.try_divide("n_vectors", "n_entries"))


def _exact(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """The candidates with `exact`, the first term of the same normalised name."""
    named = candidates.withColumn("_name", t.normalized(F.col("name")))
    known = terms.groupBy(t.normalized(F.col("keyword")).alias("_name")).agg(F.min("keyword").alias("exact"))
    return named.join(known, "_name", "left").select(*candidates.columns, "exact")


def _known(candidates: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """The candidates with exact, or near: (similarity, keyword) of the nearest term within the threshold."""
    exact = _exact(candidates, terms)
    asked = exact.where("exact is null").select(F.col("cand_id").cast("string").alias("id"), "embedding")
    pairs = nearest_.within(asked, terms.select(F.col("keyword").alias("id"), "embedding"), threshold)
    near = pairs.groupBy(F.col("left").alias("_cand")).agg(F.max(F.struct("similarity", F.col("right").alias("keyword"))).alias("near"))
    return exact.join(near, F.col("cand_id").cast("string") == F.col("_cand"), "left").drop("_cand")


def vocabulary_terms(candidates: DataFrame, terms: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Each candidate (cand_id, name, embedding) to a term (keyword, embedding): equal name first, else the nearest
    by cosine at or above the threshold, else itself as new (J10 against a frozen vocabulary).

    Near terms are found with pivots (`nearest.within`): exact, and only what their bounds can't rule out is compared.
    """
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("new")
    return _known(candidates, terms, threshold).select("cand_id", F.coalesce("exact", "near.keyword", t.strip(F.col("name"))).alias("keyword"), kind.alias("kind"))


def _refused(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The nodes (v) that a greedy walk in order refuses, of stored edges (u, v) with u before v.

    The walk accepts what it has accepted no neighbour of: the lexicographically first
    maximal independent set. In a round every node whose earlier neighbours are all
    decided decides, wherever it stands, so rounds are as many as the longest chain of
    nodes that wait for one another, which is short in any order but a contrived one.
    Edges of decided nodes are gone after a round; each round is stored.

    names (node, name, order): nodes of one name are neighbours, too. They are as many as
    they are, not as their pairs: only the first of a name that is undecided can be accepted,
    and it shuts all others of its name.
    """
    if names is None:
        pairs = edges
        nodes = stored(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("name"), F.lit(0).alias("order")), "waiting")
    else:
        pairs, nodes = edges, stored(names, "waiting")
    refused = nodes.select(F.col("node").alias("v")).limit(0)
    while not nodes.isEmpty():
        first = nodes.groupBy("name").agg(F.min_by("node", "order").alias("node"))
        accepted = stored(first.join(pairs.select(F.col("v").alias("node")).distinct(), "node", "left_anti"), "accepted")
        near = pairs.join(accepted.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))
        namesakes = nodes.join(accepted.select("name"), "name", "left_semi").select("node").join(accepted.select("node"), "node", "left_anti")
        now = stored(near.union(namesakes).distinct(), "refused")
        refused = stored(refused.unionByName(now.select(F.col("node").alias("v"))), "refused")
        gone = now.select("node").union(accepted.select("node"))
        nodes = stored(nodes.join(gone, "node", "left_anti"), "waiting")
        # An accepted node's neighbours are all refused, so pairs of refused nodes are the only ones to drop.
        pairs = stored(pairs.join(now.select(F.col("node").alias("u")), "u", "left_anti").join(now.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v"), "edges")
    return refused


#: Candidates of the first batch of a growing vocabulary, and how many times as many each later one has.
FIRST, TIMES = 2000, 4


def _taken(fresh: DataFrame, threshold: float) -> DataFrame:
    """Those of the nodes (node, _name, order, name, embedding) that are taken in, one after the other.

    They come in batches that grow. A batch is held against what is taken so far, and only
    those left are compared with one another, so candidates of one direction don't meet in
    pairs: once one of them is taken, each later one meets that one.
    """
    placed = stored(with_ordinal(stored(fresh.orderBy("order"), "ordered")), "placed")
    n, begin, size = fresh.count(), 0, FIRST
    taken = placed.drop("ordinal").limit(0)
    while begin < n:
        some = placed.where(F.col("ordinal").between(begin, begin + size - 1)).drop("ordinal")
        vector = [F.col("node").alias("id"), "embedding"]
        if begin:
            known = nearest_.within(some.select(*vector), taken.select(*vector), threshold).select(F.col("left").alias("node")).distinct()
            some = stored(some.join(taken.select("_name"), "_name", "left_anti").join(known, "node", "left_anti"), "batch")
        near = nearest_.within(some.select(*vector), some.select(*vector), threshold)
        order = some.select("node", "order")
        pairs = near.join(order.select(F.col("node").alias("left"), F.col("order").alias("_first")), "left").join(order.select(F.col("node").alias("right"), F.col("order").alias("_then")), "right")
        edges = stored(pairs.where("_first < _then").select(F.col("left").alias("u"), F.col("right").alias("v")), "edges")
        refused = _refused(edges, some.select("node", F.coalesce("_name", F.concat(F.lit("\x00"), "node")).alias("name"), "order"))
        taken = stored(taken.unionByName(some.join(refused.select(F.col("v").alias("node")), "node", "left_anti")), "taken")
        begin, size = begin + size, size * TIMES
    return taken


def grow_vocabulary(candidates: DataFrame, terms: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Candidates (cand_id, place, name, embedding) one after the other, in the order of place, onto a vocabulary that takes in those it doesn't know yet.

    As `vocabulary_terms`, but a candidate that is new is a term for all that come later. The
    result is that of the loop; which candidates are taken in is settled in batches, by rounds
    over the similar pairs of those that nothing taken before is near to. (cand_id, keyword, kind);
    kind is new for those taken in. The nearest term counts, of equally near ones the
    greater keyword; of equal places the smaller cand_id comes first. Candidates that
    repeat a name and a vector are compared once. Pairs are only with what is taken in, stored, never collected.
    """
    rows = candidates.select("cand_id", F.struct("place", "cand_id").alias("order"), t.strip(F.col("name")).alias("name"), "embedding")
    known = stored(_known(rows, terms, threshold), "known")
    same = ["_name", "embedding"]
    asked = known.where("exact is null").withColumn("_name", t.normalized(F.col("name")))
    nodes = asked.groupBy(*same).agg(F.min("order").alias("order"), F.min_by("name", "order").alias("name"), F.min("near").isNull().alias("open"))
    nodes = stored(nodes.withColumn("node", F.col("order.cand_id").cast("string")), "nodes")
    taken = _taken(nodes.where("open").drop("open"), threshold)
    vector = [F.col("node").alias("id"), "embedding"]
    close = nearest_.within(nodes.select(*vector), taken.select(*vector), threshold).select(F.col("left").alias("node"), F.col("right").alias("_by"), "similarity")
    alike = nodes.select("node", "_name").join(taken.select("_name", F.col("node").alias("_by")), "_name").select("node", "_by", F.lit(2.0).alias("similarity"))  # an equal name is nearer than any vector
    pairs = close.unionByName(alike).join(taken.select(F.col("node").alias("_by"), F.col("order").alias("first"), F.col("name").alias("keyword")), "_by")
    onto = pairs.join(nodes.select("node", *[F.col(c).alias(f"{c}_") for c in same]), "node").select(*[f"{c}_" for c in same], "first", "similarity", "keyword")
    members = asked.select("cand_id", "order", *same)
    equal = (F.col("_name") == F.col("_name_")) & F.col("embedding").eqNullSafe(F.col("embedding_")) & (F.col("first") <= F.col("order"))
    best = members.join(onto, equal).groupBy("cand_id").agg(F.max(F.struct("similarity", "keyword")).alias("new"), F.max(F.col("first") == F.col("order")).alias("own"))
    joined = known.join(best, "cand_id", "left")
    most = F.greatest("near", "new")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.coalesce("own", F.lit(False)), "new").when(most["similarity"] == 2.0, "exact").when(most.isNotNull(), "near").otherwise("new")
    joined = joined.withColumn("kind", kind).withColumn("most", most)
    keyword = F.when(F.col("kind") == "new", F.col("name")).otherwise(F.coalesce("exact", "most.keyword"))
    return joined.select("cand_id", keyword.alias("keyword"), "kind")


def fold_new_terms(terms: list[tuple[str, list[float]]], known: list[tuple[str, list[float]]], threshold: float = 0.85) -> dict[str, str]:
    """Resolves distinct new terms one after the other; each accepted one can match later ones (Q17, 7.5)."""
    import numpy as np

    names, matrix = [k for k, _ in known], [np.asarray(e, float) for _, e in known]
    lower = {n.lower(): n for n in names}
    out: dict[str, str] = {}
    for name, vector in terms:
        e = np.asarray(vector, float)
        if name.lower() in lower:
            out[name] = lower[name.lower()]
            continue
        if matrix:
            m = np.stack(matrix)
            similarity = m @ e / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(e), 1e-12)
            best = int(similarity.argmax())
            if similarity[best] >= threshold:
                out[name] = names[best]
                continue
        names.append(name)
        matrix.append(e)
        lower[name.lower()] = name
        out[name] = name
    return out
