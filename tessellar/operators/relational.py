"""Versions, access control, dashboards and other relational building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return rows.orderBy(*order).offset(offset).limit(limit)


def permitted(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permission: str) -> DataFrame:
    """Users with a role that has the permission: semi-joins, no multiplied rows."""
    roles = role_permissions.where(F.col("permission") == permission).select("role")
    return users.join(user_roles.join(roles, "role", "left_semi"), "user_id", "left_semi")


def derived_scope(user_roles: DataFrame, user_sites: DataFrame) -> DataFrame:
    """Sorted role and site sets of each user."""
    roles = user_roles.groupBy("user_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    sites = user_sites.groupBy("user_id").agg(F.sort_array(F.collect_set("site_id")).alias("sites"))
    return roles.join(sites, "user_id", "full")


def completion_rate(done: Column, total: Column) -> Column:
    """Percent with halves to even; 0 of nothing."""
    return F.when(total > 0, F.bround(done / total * 100, 0)).otherwise(0.0)


def active_version(chunk_version: str, current: str, version: str, status: str) -> Column:
    """A chunk of no version in a document of none, or of the current version while that is active."""
    none = F.col(current).isNull() & F.col(chunk_version).isNull()
    return none | (F.coalesce(F.col(chunk_version) == F.col(current), F.lit(False)) & (F.col(version) == F.col(current)) & (F.col(status) == "active"))


def owner_draft(versions: DataFrame, user: int) -> DataFrame:
    """The newest version of each document that this user has under review."""
    mine = versions.where((F.col("status") == "review_required") & (F.col("uploaded_by") == user))
    newest = F.max("version").over(Window.partitionBy("document_id"))
    return mine.withColumn("newest", newest).where("version = newest").drop("newest")


def profile_versions(versions: DataFrame, user: int) -> DataFrame:
    """Versions that describe a document: the active one, else the user's newest draft; found before
    the join, so that the join stays on equal keys."""
    active = versions.where("status = 'active'").select("document_id", "version", "version_id", F.lit(0).alias("rank"))
    drafts = owner_draft(versions, user).select("document_id", "version", "version_id", F.lit(1).alias("rank"))
    return latest(active.unionByName(drafts), ["document_id"], F.asc("rank"), F.desc("version"))


def sample_text(rows: DataFrame, key: str, order: str | list[str], text: str, most: int, separator: str = "\n") -> DataFrame:
    """The first `most` texts of each key in order, joined."""
    w = Window.partitionBy(key).orderBy(order)
    kept = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most)
    parts = F.sort_array(F.collect_list(F.struct(F.col("__rn"), F.col(text).alias("t"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("sample"), F.count("*").alias("n"))


def intervals(starts: DataFrame, key: str, start: str, last: int = 10**9) -> DataFrame:
    """Each start with the end before the next one, never before itself."""
    ahead = F.lead(start).over(Window.partitionBy(key).orderBy(start)) - 1
    return starts.withColumn("end", F.greatest(F.col(start), F.coalesce(ahead, F.lit(last))))


def numbered(rows: DataFrame, key: list[str], *order: Column, start: int = 0) -> DataFrame:
    """Dense numbers within a key."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1 + start)


def global_ids(rows: DataFrame, order: str, buckets: int = 64) -> DataFrame:
    """Dense ids 1..n in the order of a number, date or time.

    Approximate quantiles cut the order into ranges, which are counted; each range numbers its own
    rows, so no single task sorts everything. The cuts are literals: every reader of a row sees the
    same range.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)])).first()[0] or []
    part = sum((F.when(F.col(order) >= F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    ranged = rows.withColumn("__part", part)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    before = ranged.groupBy("__part").count().withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__rn", own).join(F.broadcast(before), "__part").withColumn("id", F.col("__rn") + F.col("before")).drop("__part", "__rn", "count", "before")
