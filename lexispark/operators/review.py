"""Edit overlays over base rows (family G) and resumable enrichment (family E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as t


def applied(base: DataFrame, edits: DataFrame, deleted: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """Base rows without the deleted, edited fields first, then rows that only edits have."""
    changed = edits.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    live = base.join(deleted.select(key), key, "left_anti")
    old = live.join(changed, key, "left").select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])
    new = edits.join(base.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti").select(key, *fields)
    return old.unionByName(new)


def entry(base: DataFrame, edits: DataFrame, deleted: DataFrame, wanted, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """One entry with its flags; an empty result if there is none."""
    one = base.where(F.col(key) == wanted)
    changed = edits.where(F.col(key) == wanted).select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_edited"))
    gone = deleted.where(F.col(key) == wanted).select(key, F.lit(True).alias("_deleted")).distinct()
    row = one.join(changed, key, "full").join(gone, key, "left")
    return row.select(
        key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], F.coalesce("_edited", F.lit(False)).alias("is_reviewed"), F.coalesce("_deleted", F.lit(False)).alias("is_deleted")
    )


def progress(base: DataFrame, edits: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """The number of base rows or the largest numeric id of an edit, if that is more; and edits that aren't deleted."""
    total = _largest(base, edits, key)
    reviewed = edits.select(key).distinct().join(deleted.select(key), key, "left_anti").agg(F.count("*").alias("reviewed"))
    return total.join(F.broadcast(reviewed))


def next_live(base: DataFrame, deleted: DataFrame, at: int, key: str = "id") -> DataFrame:
    """The nearest later id that isn't deleted, else the nearest earlier, else 1."""
    live = base.select(key).join(deleted.select(key), key, "left_anti")
    return live.agg(
        F.coalesce(F.min(F.when(F.col(key) > at, F.col(key))), F.max(F.when(F.col(key) < at, F.col(key))), F.lit(1).cast("long")).alias("next_id")
    )


def _largest(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Ids that aren't numbers, such as those of exported pages, count as rows but have no place in the order."""
    rows = base.agg(F.count("*").alias("rows"))
    ids = edits.agg(F.max(F.col(key).cast("string").try_cast("long")).alias("i"))
    return rows.join(F.broadcast(ids)).select(F.greatest("rows", "i").alias("total"))


def new_id(base: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """One more than the number of base rows, or than the largest numeric id of an edit."""
    return _largest(base, edits, key).select((F.col("total") + 1).alias("new_id"))


def new_row(base: DataFrame, edits: DataFrame, fields: tuple[str, ...], defaults: dict[str, str] | None = None, key: str = "id") -> DataFrame:
    """The next row as it is offered: its id, and a default or a blank in each field."""
    values = [F.lit((defaults or {}).get(f, "")).alias(f) for f in fields]
    return new_id(base, edits, key).select(F.col("new_id").cast("string").alias(key), *values)


def appended(base: DataFrame, edits: DataFrame, deleted: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """Rows that only edits have, not deleted, in the order they are appended: by number, then ids that aren't numbers (K9)."""
    new = edits.join(base.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti").select(key, *fields)
    number = F.col(key).cast("string").try_cast("long")
    return new.orderBy(number.isNull(), number, F.col(key).cast("string"))


def saved(edits: DataFrame, changes: DataFrame, allowed: list[str], keywords: str, key: str = "id") -> DataFrame:
    """Edits with the changes over them; a change with a keyword outside the list raises when it is read."""
    bad = unknown(t.split_list(F.col(keywords)), F.array(*map(F.lit, allowed)).cast("array<string>"))
    message = F.concat(F.lit("unknown keywords: "), F.array_join(bad, ", "))
    checked = changes.withColumn(keywords, F.when(F.size(bad) > 0, F.raise_error(message).cast("string")).otherwise(F.col(keywords)))
    return upserted(edits, checked, key)


def unknown(items: Column, allowed: Column) -> Column:
    """Items outside an allowed list."""
    return F.array_except(items, allowed)


def suggestions(allowed: Column, chosen: Column, query: str) -> Column:
    """Allowed items with the text, not chosen yet."""
    return F.filter(F.array_except(allowed, chosen), lambda k: F.contains(F.lower(k), F.lit(query.lower())))


def with_item(items: Column, item: Column) -> Column:
    """Append if absent."""
    return F.array_union(items, F.array(item))


def without_item(items: Column, item: Column) -> Column:
    return F.array_remove(items, item)


def state_with_defaults(state: DataFrame, defaults: dict[str, list[str]]) -> DataFrame:
    """Missing and empty lists of a state document replaced by defaults (F32)."""
    for name, values in defaults.items():
        fallback = F.array(*map(F.lit, values))
        state = state.withColumn(name, F.when(F.coalesce(F.size(name), F.lit(0)) > 0, F.col(name)).otherwise(fallback))
    return state


def kept_correction(corrected: Column, previous: Column, new: Column, force: bool = False) -> Column:
    """A human's correction stays unless forced, empty, or the same as the previous original."""
    return F.when(F.lit(force) | (F.coalesce(corrected, F.lit("")) == "") | (corrected == previous), new).otherwise(corrected)


def upserted(states: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New states key by key over old ones."""
    fields = [c for c in states.columns if c != key]
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_new"))
    return states.join(new, key, "full").select(key, *[F.when(F.col("_new"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def pending(rows: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    """Rows with an output still blank: what a resumed run has left to do."""
    blank = F.lit(False)
    for name in outputs:
        blank = blank | (t.strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) == "")
    return rows.where(blank)
