"""Secret scans: fixed patterns, and sliding-window Shannon entropy. DataFrame functions only.

Five kinds of spans, in code points, end exclusive. The first three are patterns
(leftmost, non-overlapping per kind). The last two are windows of high entropy in
runs of a character class: WINDOW characters slide along each run of at least
WINDOW of them that has a letter and a digit, and overlapping windows at or above
the class's threshold make one span. Counts of the window's characters are
updated by the one that leaves and the one that enters; with n characters counted
c times each, entropy is log2 n - (sum of c log2 c) / n, so one running sum (an
exact integer, in units of 2^-20) decides. The allow-list suppresses a run that is
a UUID, and of other runs only the windows that overlap a listed word: such words
are blanked before the runs are looked for. Patterns' spans are never suppressed.

Texts are read once; what is stored are the lengths of gaps and hits. Positions
are running sums over the hits of a text. A cheap test of the whole text comes
before each extraction.

Null text counts as empty. Every row of the input gives one row, repeated rows
included. Only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WINDOW = 20
#: kind -> (class of its runs, threshold in bits).
ENTROPY = {"hex_entropy": ("0-9a-fA-F", 3.0), "text_entropy": ("A-Za-z0-9+/_=-", 3.85)}
#: No secrets: runs that are UUIDs, and stretches of the alphabet, of digits in order and of documentation samples.
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ALLOWED = ("placeholder", "abcdefgh", "01234567", "12345678", "deadbeef", "example", "sample")
KINDS = ("assign", "access", "hex", *ENTROPY)
BASE = 3

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Counts up to WINDOW take 5 bits each; 12 fit in a long.
FIELD, FIELDS = 5, 12
#: Windows of a run that are looked at together.
PIECE = 256
UNIT = 1 << 20
_NONE = "array<struct<b:int,e:int>>"
#: c log2 c for each count.
TERMS = tuple(round(c * log2(c) * UNIT) if c else 0 for c in range(WINDOW + 2))


def largest_sum(threshold: float) -> int:
    """The sum of c log2 c at which a window still has this entropy."""
    return floor((log2(WINDOW) - threshold) * WINDOW * UNIT)


def _piece(codes: Column, most: int, shift: Column) -> Column:
    """(b, e) of the merged windows of a short piece of a run whose sum is at most this, moved by shift."""
    terms = F.array(*map(F.lit, TERMS))
    words = -(-len(ALPHABET) // FIELDS)
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    field = lambda counts, word, at: F.call_function("shiftright", F.element_at(counts, word + 1), at).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")

    def step(state: Column, i: Column) -> Column:
        counts, enter, leave = state["counts"], F.element_at(codes, i), F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))
        word, at = F.floor(enter / FIELDS).cast("int"), (enter % FIELDS) * FIELD
        old_word, old_at = F.floor(leave / FIELDS).cast("int"), (leave % FIELDS) * FIELD
        n, m = field(counts, word, at), field(counts, old_word, old_at)
        added = F.element_at(terms, n + 2) - F.element_at(terms, n + 1)
        swapped = F.when(enter == leave, F.lit(0)).otherwise(added + F.element_at(terms, m) - F.element_at(terms, m + 1))
        total = state["total"] + F.when(i > WINDOW, swapped).otherwise(added)
        kept = F.transform(
            counts, lambda v, j: v + F.when(j == word, one(at)).otherwise(F.lit(0).cast("long")) - F.when((i > WINDOW) & (j == old_word), one(old_at)).otherwise(F.lit(0).cast("long"))
        )
        spans, last = state["spans"], F.try_element_at(state["spans"], F.lit(-1))
        begin = i - WINDOW
        span = lambda b: F.array(F.struct(b.alias("b"), i.alias("e")))
        joined = F.when((F.size(spans) > 0) & (last["e"] >= begin), F.concat(F.slice(spans, 1, F.size(spans) - 1), span(last["b"]))).otherwise(F.concat(spans, span(begin)))
        return F.struct(kept.alias("counts"), total.alias("total"), F.when((begin >= 0) & (total <= most), joined).otherwise(spans).alias("spans"))

    start = F.struct(F.array(*[F.lit(0).cast("long")] * words).alias("counts"), F.lit(0).cast("long").alias("total"), F.array().cast(_NONE).alias("spans"))
    moved = lambda s: F.transform(s["spans"], lambda x: F.struct((x["b"] + shift).alias("b"), (x["e"] + shift).alias("e")))
    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, moved)


def _windows(run: Column, most: int) -> Column:
    """(b, e) of the merged windows of a run whose sum is at most this.

    The run is cut into pieces of PIECE windows each, so what a step carries is bounded
    and the cost is in proportion to the run. Spans of neighbouring pieces that touch are
    one: it begins where a span has none before it and ends where one has none behind it.
    """
    codes = F.transform(F.split(run, ""), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("int"))
    first = F.sequence(F.lit(0), F.length(run) - WINDOW, F.lit(PIECE))

    def of(codes: Column) -> Column:
        part = lambda at: F.array(F.slice(codes, at + 1, F.lit(PIECE + WINDOW - 1)))
        return F.flatten(F.flatten(F.transform(first, lambda at: F.transform(part(at), lambda piece: _piece(piece, most, at)))))

    def merged(spans: Column) -> Column:
        begins = F.filter(spans, lambda s, i: (i == 0) | (F.element_at(spans, F.greatest(i, F.lit(1)))["e"] < s["b"]))
        ends = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.element_at(spans, F.least(i + 2, F.size(spans)))["b"] > s["e"]))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b["b"].alias("b"), e["e"].alias("e")))

    return F.flatten(F.transform(F.array(codes), lambda c: F.flatten(F.transform(F.array(of(c)), merged))))


def _parts(text: Column, test: str, pattern: str, spans, mask=lambda text: text) -> Column:
    """(gap, hit, spans within the hit) for each match of pattern, in order; group 2 is the match."""
    split = f"(?s)(.*?)(?:({pattern})|\\z)"
    gaps, hits = (F.regexp_extract_all(mask(text), F.lit(split), F.lit(i)) for i in (1, 2))
    parts = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), spans(h).alias("spans")))
    return F.when(text.rlike(test), parts).otherwise(F.array().cast("array<struct<gap:int,hit:int,spans:array<struct<b:int,e:int>>>>"))



def _whole(hit: Column, ok: Column) -> Column:
    return F.when(ok, F.array(F.struct(F.lit(0).alias("b"), F.length(hit).alias("e")))).otherwise(F.array().cast(_NONE))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _masked(text: Column) -> Column:
    """The text with listed words blanked; all else keeps its place."""
    for word in ALLOWED:
        text = F.regexp_replace(text, _any_case(word), " " * len(word))
    return text


def _high_entropy(run: Column, threshold: float) -> Column:
    open_ = run.rlike("[0-9]") & run.rlike("[A-Za-z]") & ~run.rlike(UUID)
    return F.when(open_, _windows(run, largest_sum(threshold))).otherwise(F.array().cast(_NONE))


def _hits(text: Column) -> Column:
    value = lambda h: F.length(F.regexp_extract(h, f"^(?:{ASSIGN})$", 1)) >= 6
    found = [
        _parts(text, ASSIGN, ASSIGN, lambda h: _whole(h, value(h))),
        _parts(text, "AKIA[A-Z0-9]{16}", "AKIA[A-Z0-9]+", lambda h: _whole(h, F.length(h) >= 20)),
        _parts(text, "[0-9a-f]{24}", "[0-9a-f]{24,}", lambda h: _whole(h, F.length(h) >= 24)),
    ]
    for runs, threshold in ENTROPY.values():
        found.append(_parts(text, f"[{runs}]{{{WINDOW}}}", f"[{runs}]{{{WINDOW},}}", lambda h, t=threshold: _high_entropy(h, t), _masked))
    return F.array(*found)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id and spans, an array of (start, kind number, end) in order."""
    text = F.coalesce("text", F.lit(""))
    scanned = stored(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", _hits(text).alias("hits")), "hits")
    kinds = scanned.select("row_id", F.posexplode("hits").alias("kind", "parts")).select("row_id", "kind", F.posexplode("parts").alias("place", "part"))
    upto = Window.partitionBy("row_id", "kind").orderBy("place")
    placed = kinds.select("row_id", "kind", "part.spans", (F.sum(F.col("part.gap") + F.col("part.hit")).over(upto) - F.col("part.hit")).alias("start"))
    spans = placed.select("row_id", "kind", "start", F.explode("spans").alias("s")).select(
        "row_id", F.struct((F.col("start") + F.col("s.b")).alias("start"), "kind", (F.col("start") + F.col("s.e")).alias("end")).alias("span")
    )
    found = spans.groupBy("row_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select("row_id", "doc_id").join(found, "row_id", "left").withColumn("spans", F.coalesce("spans", none))


def _shown(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(_shown(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        _shown(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    assign = ASSIGN.replace("'", "''")
    patterns = [(assign, "true"), ("AKIA[A-Z0-9]+", "length(hit) >= 20"), ("[0-9a-f]{24,}", "length(hit) >= 24")]
    patterns[0] = (assign, f"length(regexp_extract(hit, '^(?:{assign})$', 1)) >= 6")
    masked = "t"
    for word in ALLOWED:
        masked = f"regexp_replace({masked}, '{_any_case(word)}', '{' ' * len(word)}', 'g')"
    runs = [(f"[{cls}]{{{WINDOW},}}", largest_sum(t)) for cls, t in ENTROPY.values()]
    parts = [
        f"""SELECT n, {k} AS kind, unnest(regexp_extract_all({x}, '(?s)(.*?)(?:({p})|\\z)', 1)) AS gap, unnest(regexp_extract_all({x}, '(?s)(.*?)(?:({p})|\\z)', 2)) AS hit,
                 generate_subscripts(regexp_extract_all({x}, '(?s)(.*?)(?:({p})|\\z)', 1), 1) AS place FROM d"""
        for k, (x, p) in enumerate([("t", p) for p, _ in patterns] + [("m", r) for r, _ in runs])
    ]
    ok = " ".join(f"WHEN {k} THEN hit <> '' AND {cond}" for k, (_, cond) in enumerate(patterns))
    limits = " ".join(f"WHEN {k + BASE} THEN {most}" for k, (_, most) in enumerate(runs))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    shown = f"string_agg({names}[kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind, e)"
    return f"""
WITH e AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
d AS (SELECT *, {masked} AS m FROM e),
parts AS ({" UNION ALL ".join(parts)}),
hits AS (
  SELECT n, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY n, kind ORDER BY place) - length(hit) AS start FROM parts),
base AS (SELECT n, kind, start::BIGINT AS b, (start + length(hit))::BIGINT AS e FROM hits WHERE kind < {BASE} AND CASE kind {ok} END),
runs AS (
  SELECT n, kind, hit, start, unnest(range(0, length(hit) - {WINDOW - 1})) AS i FROM hits
  WHERE kind >= {BASE} AND hit <> '' AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '{UUID}')),
high AS (
  SELECT n, kind, start, i FROM runs
  WHERE list_sum(list_transform(map_values(list_histogram(string_split(substr(hit, i + 1, {WINDOW}), ''))),
                                lambda c: [{", ".join(map(str, TERMS))}][(c + 1)::BIGINT])) <= CASE kind {limits} END),
islands AS (
  SELECT *, sum(CASE WHEN i - before <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY n, kind, start ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY n, kind, start ORDER BY i) AS before FROM high) x),
spans AS (
  SELECT n, kind, b, e FROM base UNION ALL
  SELECT n, kind, (start + min(i))::BIGINT, (start + max(i) + {WINDOW})::BIGINT FROM islands GROUP BY n, kind, start, island),
found AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         {shown} FILTER (kind < {BASE}) AS base, {shown} AS spans FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (n)
"""


ORACLE = _sql()
