"""Queries of model operators with the stub, and of stateful operators in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores
from tidewire.models import operators
from tidewire.plans.adapters import ARTICLES, articles, read
from tidewire.queries import Catalog
from tidewire.streaming import rounds

catalog = Catalog()
A = f"WITH {ARTICLES} "


@catalog.add("M01_scores", A + "SELECT id, (length(title) % 41 + least(length(title) % 31, 30) + least(length(title) % 29, 30))::BIGINT AS score FROM a")
def _(s, d):
    out = operators.score(articles(s, d).select("id", "title"))
    return out.select("id", scores.sub_scores(F.col("impact"), F.col("facts"), F.col("novelty"), F.lit(50)).alias("score"))


@catalog.add("M03_summaries", "SELECT doc_id, substr(CASE WHEN text = '' THEN '-' ELSE replace(text, chr(10), ' ') END, 1, 40) AS takeaway, 'technology' AS category FROM documents")
def _(s, d):
    return operators.summarise(read(s, d, "documents").select("doc_id", "text")).select("doc_id", "takeaway", "category")


@catalog.add("M07_verdicts", A + "SELECT id, 'new' AS verdict FROM a")
def _(s, d):
    return operators.verdicts(articles(s, d).select("id", "title")).select("id", "verdict")


@catalog.add("T08_reader_frontier", "WITH f AS (SELECT user_id, max(ts) AS frontier FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, (SELECT count(*) FROM events e WHERE e.ts > f.frontier) AS unread FROM f")
def _(s, d):
    e = read(s, d, "events")
    frontier = rounds.reader_frontiers(e.where("event_type = 'view'").select("user_id", F.col("ts").alias("frontier")))
    return rounds.unread(e.select(F.col("ts").alias("collected_at")), frontier)
