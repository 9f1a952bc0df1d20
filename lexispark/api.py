"""What an application calls: one method for each thing that can be asked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import providers
from lexispark.operators import browse, review, search
from lexispark.sources import feedback, tables, versions


@dataclass
class Review:
    """Base rows, edits and deleted ids of a review, and what it offers (2.11). Tables in, tables out: the caller stores them."""

    base: DataFrame
    edits: DataFrame
    deleted: DataFrame
    fields: tuple[str, ...]
    allowed: list[str]
    keywords: str = "keywords"

    def progress(self) -> DataFrame:
        return review.progress(self.base, self.edits, self.deleted)

    def entry(self, wanted) -> DataFrame:
        return review.entry(self.base, self.edits, self.deleted, wanted, self.fields)

    def next(self, at: int) -> DataFrame:
        return review.next_live(self.base, self.deleted, at)

    def new(self, defaults: dict[str, str] | None = None) -> DataFrame:
        return review.new_row(self.base, self.edits, self.fields, defaults)

    def save(self, changes: DataFrame) -> DataFrame:
        """The edits with these changes; keywords outside the list raise."""
        return review.saved(self.edits, changes, self.allowed, self.keywords)

    def delete(self, wanted) -> DataFrame:
        gone = self.entries_spark.createDataFrame([(wanted,)], self.deleted.select("id").schema)
        return self.deleted.select("id").unionByName(gone).distinct()

    def restore(self, wanted) -> DataFrame:
        return self.deleted.select("id").where(F.col("id") != wanted)

    def export(self) -> DataFrame:
        """What is left of the base with its edits, and then the new rows in their order."""
        old = review.applied(self.base, self.edits.join(self.base.select("id"), "id", "left_semi"), self.deleted, self.fields)
        return old.unionByName(review.appended(self.base, self.edits, self.deleted, self.fields))

    def save_export(self, root: str) -> int:
        """The export as a new version of a table, which readers see in whole; the version's number."""
        return versions.publish(self.export(), root)

    def start(self, root: str) -> bool:
        """Writes the first export unless there is one; whether it has."""
        return versions.bootstrap(self.export(), root)

    @property
    def entries_spark(self) -> SparkSession:
        return self.base.sparkSession


@dataclass
class Corpus:
    """Entries (ordinal, id, Alphabet, base_alphabet, poem, category, explanation, keywords), their vectors and keyword vectors."""

    entries: DataFrame
    vectors: DataFrame
    keyword_vectors: DataFrame
    embed: Callable[[list[str]], np.ndarray]

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embed([text])[0]]

    def search(self, query: str, category: str | None = None, k: int = 50) -> DataFrame:
        """Ranked entries; the query is lower-cased before it is embedded (3.1)."""
        if not query.strip():
            raise ValueError("empty query")
        text = query.lower().strip()
        found = search.search(self.vectors, self.keyword_vectors, self.entries, self._vector(text), text, category, k, fields=("poem", "explanation", "category"))
        return found.select("id", "poem", F.col("explanation").alias("meaning"), "category", F.array_join("keywords", ", ").alias("keywords"), F.col("match_type").alias("matched_keyword"), "score")

    def browse(self, alphabet: str = "", category: str = "All", text: str = "", page: int = 1, per_page: int = 20) -> tuple[DataFrame, DataFrame]:
        """One page, and the totals (3.3)."""
        found = browse.matching(self.entries, alphabet, category, text)
        return browse.page(found, page, per_page), browse.totals(found, per_page)

    def answer(self, concern: str, choose: Callable[[list[dict]], tuple[int, str]] | None = None) -> dict | None:
        """Best vectors, rerank, one choice; without any candidate a row at random (3.2)."""
        if not concern.strip():
            raise ValueError("empty concern")
        top = search.best_entries(self.vectors, self._vector(concern), None, 20)
        rows = self.entries.join(F.broadcast(top), self.entries["ordinal"] == top["entry_ord"])
        best = search.rerank(rows, providers.jaccard(F.lit(concern), F.coalesce("explanation", F.lit(""))))
        return providers.answer(best, choose) or providers.answer(self.entries.orderBy(F.rand()).limit(1))

    def feedback(self, path: str, poem_id: int) -> DataFrame:
        return feedback.of_poem(feedback.read(self.entries.sparkSession, path), poem_id)

    def report(self, path: str, poem_id: int, status: str, username: str = "", text: str = "") -> None:
        spark = self.entries.sparkSession
        if status not in ("like", "dislike"):
            raise ValueError("status is like or dislike")
        feedback.append(spark.createDataFrame([(poem_id, username, status, text)], "poem_id int, username string, status string, interpretation string"), path)

    def learning(self, path: str) -> DataFrame:
        """Topics with their poems, blanks and texts, in the document's order (2.11)."""
        doc = tables.read_json(self.entries.sparkSession, path, tables.LEARNING)
        return doc.select(F.posexplode("doc").alias("topic_place", "t")).select("topic_place", "t.topic", "t.poems")

    def images(self, path: str, pattern: str = "*") -> DataFrame:
        """Each entry with the path of its image, null if there is none."""
        spark: SparkSession = self.entries.sparkSession
        files = tables.files(spark, path, pattern).select(F.regexp_replace("name", "\\.[^.]*$", "").alias("id"), F.col("path").alias("image"))
        return self.entries.join(files, "id", "left")
