"""Not-modified revisit resolution for web archives.

Every revisit record is joined, as of its time, to the latest earlier full response of the same canonical URL.
Its validators are checked (an ETag, weakly compared, if it has one, else Last-Modified, else the payload
digest), and the response's headers are merged with those that a 304 may carry.

States: ``resolved``; ``mismatch`` (there is an earlier response, whose validators differ; nothing is merged);
``unresolved`` (no earlier response); ``unchecked`` (no validator on one of the sides; merged as resolved).

Defined results. "Earlier" is strictly earlier; of responses at one time the largest record_id counts (a null one last).
A null URL has no response. Null times are never earlier and have none earlier. A response without a record_id is
found like others, and what refers to it has a null ``refers_to``. Repeated rows are records of their own. Null headers
are none; records of other kinds are left out; of the others only the named columns are read. Empty tables give empty
results. Payloads never move: the result refers to a record.

What no response can answer (null URLs and times) leaves at once. Responses and questions are reduced to one row for
each URL and time before they meet, so that repeats of one moment are no group. A URL of more than ``hot_rows`` such
rows (if not given: over a thousandth of all, and at most 100,000) is cut into slices at quantiles of its times; each slice's last response is handed on to the next
through one row a slice. Answers go back to the revisits by URL and time, hot ones by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, held, join_unique
from .common import hot_rows as hot_rows_of

#: Header fields that a 304 response sends for its recipient to update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a campaign or referrer, not a resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme-less: lower-case host without default port, path without trailing slash or .html, sorted query without tracking, no fragment."""
    u = F.regexp_replace(F.btrim(url, F.lit(" \t\r\n")), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1)), r":(80|443)$", "")
    rest = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"(\.html?|/index\.html?)$", ""), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def hot_moment(answers: DataFrame) -> int:
    return hot_rows_of(answers.agg(F.sum("n")).first()[0] or 0)


def resolve(records: DataFrame, hot_rows: int | None = None, slices: int = 1000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each revisit: record_id, canonical, refers_to, state, headers.

    ``records``: record_id, url, ts (long), kind (``response`` or ``revisit``), etag, last_modified, digest,
    headers (map of lower-case names).
    """
    scratch = Scratch(records.sparkSession, "revisits")
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.expr("cast(map() as map<string,string>)"))))
    r = held(records, "record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers").where("kind IN ('response', 'revisit')")
    r = scratch.write(r.select("kind", "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "etag", "last_modified", "digest", entries.alias("headers")), "log")
    dated = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    moment = F.struct("canonical", "ts").alias("moment")
    top = F.max(F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")).alias("top")
    full = r.where(dated & (F.col("kind") == "response")).groupBy(moment).agg(top).select("moment", F.lit(False).alias("asked"), F.lit(0).cast("long").alias("n"), "top")
    asked = r.where(dated & (F.col("kind") == "revisit")).groupBy(moment).agg(F.count("*").alias("n"))
    line = scratch.write(full.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True).select("moment.canonical", "moment.ts", "asked", "n", "top"), "moments")
    limit = hot_rows or min(100_000, hot_rows_of(line.count()))
    hot = scratch.small(line.groupBy("canonical").agg(F.count("*").alias("rows")).where(F.col("rows") > limit), broadcast_bytes)
    shares = F.array(*[F.lit((k + 1) / slices) for k in range(slices - 1)])
    cuts = line.join(hot, "canonical").groupBy("canonical").agg(F.percentile_approx("ts", shares, 10 * slices).alias("cuts"))
    cuts = scratch.small(cuts, broadcast_bytes)
    line = line.join(cuts, "canonical", "left").withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("ts")))))
    inside = W.partitionBy("canonical", "slice").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    last = line.withColumn("last", F.max("top").over(inside)).where("asked")
    sums = line.where("cuts IS NOT NULL").groupBy("canonical", "slice").agg(F.max("top").alias("top"))  # at most ``slices`` rows of each hot URL
    carry = sums.select("canonical", "slice", F.max("top").over(W.partitionBy("canonical").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    carry = scratch.small(carry, broadcast_bytes)
    answers = last.join(carry, ["canonical", "slice"], "left").select(moment, "n", F.coalesce("last", "carried").alias("found"))
    answers = scratch.write(answers, "answers")
    revisits = r.where("kind = 'revisit'")
    known = revisits.where(dated).withColumn("moment", moment)
    out = join_unique(known, answers.drop("n"), "moment", answers.where(F.col("n") > hot_moment(answers)).select("moment")).drop("moment")
    out = out.unionByName(revisits.where(~dated).withColumn("found", F.lit(None).cast(answers.schema["found"].dataType)))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    check = (
        F.when(F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), tag(F.col("etag")) == tag(F.col("found.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull(), F.col("last_modified") == F.col("found.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("digest") == F.col("found.digest"))
    )
    out = out.withColumn("state", F.when(F.col("found").isNull(), "unresolved").when(check.isNull(), "unchecked").when(check, "resolved").otherwise("mismatch"))
    own = F.filter("headers", lambda h: h["key"].isin(*PERMITTED))
    old = F.filter("found.headers", lambda h: ~F.array_contains(F.transform(own, lambda o: o["key"]), h["key"]))
    merged = F.when(F.col("state").isin("resolved", "unchecked"), F.map_from_entries(F.array_sort(F.concat(old, own))))
    return out.select("record_id", "canonical", F.when(F.col("state") != "unresolved", F.col("found.record_id")).alias("refers_to"), "state", merged.alias("headers"))
