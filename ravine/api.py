"""Requests and responses: a JSON request names a route and its parameters, the response is JSON.

``Engine`` holds a folder of tables. Responses hold a page or the best k rows, never a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.operators import analytics, search
from ravine.plans import analytics_queries
from ravine.sources.tables import chunks, document_index, table

MOST = 100


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.routes: dict[str, Callable[..., DataFrame]] = {
            "search/keyword": self.keyword,
            "search/vector": self.vector,
            "documents": self.documents,
            "jobs/stats": lambda: analytics.queue_stats(analytics_queries.jobs(spark, sf_dir)),
            "analytics/cost-by-type": lambda: analytics.cost_by_type(analytics_queries.queries(spark, sf_dir)),
        }

    def keyword(self, query: str, top_k: int = 10) -> DataFrame:
        d = table(self.spark, self.sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
        return search.web_search(d, "text", query, min(top_k, MOST)).select("id", "score")

    def vector(self, embedding: list[float], threshold: float = 0.3, top_k: int = 10, doc_id: str | None = None) -> DataFrame:
        return search.vector_search(chunks(self.spark, self.sf_dir), embedding, threshold, min(top_k, MOST), doc_id=doc_id).select("id", "similarity")

    def documents(self, page: int = 1, page_size: int = 20, search_for: str | None = None, language: str | None = None, document_type: str | None = None) -> DataFrame:
        found = search.list_documents(document_index(self.spark, self.sf_dir), page, page_size, search_for, language=language, document_type=document_type)
        return found.select("id", "title", "document_type", "language", "file_size_bytes", "total")

    def rows(self, request: str | dict) -> DataFrame:
        """The rows of the response to a request."""
        asked = json.loads(request) if isinstance(request, str) else dict(request)
        route = self.routes[asked.pop("route")]
        return route(**asked)

    def handle(self, request: str | dict) -> str:
        """The response to a request; errors are responses too."""
        try:
            rows = [json.loads(r) for r in self.rows(request).toJSON().take(MOST)]
        except (KeyError, TypeError, ValueError) as e:
            return json.dumps({"error": str(e)})
        return json.dumps({"rows": rows})
