"""What happens to rows on their way in: projection, feed times, health messages, probes, dead letters and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import values
from tidewire.functions import text, times

#: Attempts from which on a row of the retry queue is shelved.
SHELVED = 3


def candidates(rows: DataFrame) -> DataFrame:
    """Rows with a title and a URL, the title without white space around it."""
    return rows.withColumns({"title": text.strip(F.col("title")), "source_url": F.coalesce("source_url", F.lit(""))}).where("title <> '' and source_url <> ''")


def feed_time(published: Column, official: Column, direct_hours: Column, now: Column) -> Column:
    """Kept by a feed's own time filter: within the window of its source; undated items only of official sources."""
    inside = (published <= now + F.expr("INTERVAL 24 HOURS")) & (times.hours_between(now, published) <= direct_hours)
    return F.when(published.isNull(), official).otherwise(inside)


def route(rows: DataFrame, published: str = "published_ts") -> DataFrame:
    """Each row with the day on which it was published, whenever it arrives; rows without a day are dead letters."""
    return rows.withColumn("date_key", F.coalesce(times.day_key(F.col(published)), F.lit(values.SENTINEL)))


def scrape_health(thrown: Column, error: Column, matched: Column, status: Column, rows: Column, fresh: Column) -> Column:
    """What a health row says about a scrape, the gravest thing first; null if all is well."""
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    found = [
        (thrown.isNotNull(), said("SCRAPER_THROW ", F.substring(thrown, 1, 180))),
        (error.isNotNull(), said("SCRAPER_ERROR ", F.substring(error, 1, 200))),
        (matched == 0, said("PARSED_ZERO http=", F.coalesce(status.cast("string"), F.lit("n/a")), values.HEALTH_NOTES["PARSED_ZERO"])),
        (~status.between(200, 299), said("HTTP ", status.cast("string"))),
        (matched.isNull() & (rows == 0), said("ZERO_NO_META", values.HEALTH_NOTES["ZERO_NO_META"])),
        ((fresh == 0) & (matched > 0), said("FILTERED_ALL matched=", matched.cast("string"), values.HEALTH_NOTES["FILTERED_ALL"])),
    ]
    return F.coalesce(*(F.when(when, what) for when, what in found))


def fatal_probe(status: Column, body: Column) -> Column:
    """The account of the model service is unusable: by its status or by what it answers."""
    return F.coalesce(status.isin(values.FATAL_STATUS), F.lit(False)) | F.coalesce(body.rlike(values.FATAL_ANSWER), F.lit(False))


def refusing(url: Column) -> Column:
    """The address holds the name of a host that often refuses."""
    return text.any_of([F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(h)) for h in values.REFUSING_HOSTS])


def retry(queue: DataFrame, usable: DataFrame) -> DataFrame:
    """One run of the retry queue: source_url, state and attempts afterwards.

    ``queue`` has source_url, reason and attempts; ``usable`` the URLs whose rows are clean after they were made
    anew. Shelved rows are left alone. Rows of poor quality are held for an editor, one attempt more. Clean rows are
    released. The others count one attempt more, those of refusing hosts two, and may be shelved by it.
    """
    done = F.coalesce("attempts", F.lit(0))
    out = queue.join(usable.select("source_url", F.lit(True).alias("clean")), "source_url", "left").withColumn("done", done)
    held = text.reason_class(F.col("reason")) == "quality"
    more = F.when(held, 1).when(refusing(F.col("source_url")), 2).otherwise(1)
    after = F.when((F.col("done") >= SHELVED) | (F.col("clean") & ~held), F.col("done")).otherwise(F.col("done") + more)
    state = F.when(F.col("done") >= SHELVED, "shelved").when(held, "held").when(F.col("clean"), "released").when(after >= SHELVED, "shelved").otherwise("queued")
    return out.select("source_url", state.alias("state"), after.cast("long").alias("attempts"))


def overflow(total: Column, limit: int) -> Column:
    """How many rows a reader doesn't see of a list that is cut at a limit."""
    return F.greatest(F.lit(0), total - limit)
