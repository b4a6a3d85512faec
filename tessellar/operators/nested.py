"""JSON of any shape: every value of a text with its place, by a recursive query over variants."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deeper nesting is an error, not a cut.
DEEPEST = 64
_NO_LIMIT = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(DEEPEST + 2)}


def json_walk(rows: DataFrame, key: str, column: str, stop: str | None = None, deepest: int = DEEPEST) -> DataFrame:
    """(key, depth, at, path, name, within, kind, value): every value of each JSON text, the text's own at depth 0.

    at holds places from the root on (fields of an object in order of their names), so it sorts values as a walk meets them;
    name is a field's name, within the name of the list or object around; kind is OBJECT, ARRAY, STRING and so on. Below items
    of lists named `stop` nothing is looked for. A null or broken text is one row without a kind.
    """
    if key in ("depth", "at", "path", "name", "within", "ended", "kind", "value"):
        raise ValueError(f"{key} is a name of the result: rename the key")
    spark = rows.sparkSession
    for name, limit in _NO_LIMIT.items():
        spark.conf.set(name, limit)
    view = f"json_{uuid.uuid4().hex}"
    rows.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text")).createOrReplaceTempView(view)
    ended = "false" if stop is None else f"coalesce(w.name = '{stop}', false) and w.kind = 'ARRAY'"
    kind = "regexp_extract(schema_of_variant({}), '^[A-Z]+', 0)"
    return spark.sql(f"""
      WITH RECURSIVE walk AS (
        SELECT key, 0 AS depth, cast(array() AS array<int>) AS at, '$' AS path, cast(null AS string) AS name, cast(null AS string) AS within, false AS ended,
          {kind.format("v")} AS kind, v AS value FROM (SELECT key, try_parse_json(text) AS v FROM {view})
        UNION ALL
        SELECT w.key, if(w.depth >= {deepest}, raise_error('JSON is nested deeper than {deepest}'), w.depth + 1), concat(w.at, array(e.pos)),
          w.path || coalesce('.' || e.key, '[' || e.pos || ']'), e.key, w.name, {ended}, {kind.format("e.value")}, e.value
        FROM walk w, LATERAL variant_explode(w.value) e WHERE NOT w.ended
      ) SELECT * FROM walk""").withColumnRenamed("key", key)


def collected(rows: DataFrame, key: str, column: str, name: str = "evidence_chunk_ids") -> DataFrame:
    """(key, ids): distinct items, as sorted text, of all lists of that name at any depth; null, empty, zero and false items don't count."""
    items = json_walk(rows, key, column, stop=name).where((F.col("within") == name) & F.col("ended"))
    text = F.when(F.col("kind") == "STRING", F.expr("variant_get(value, '$', 'string')")).otherwise(F.expr("to_json(value)"))
    ids = items.where("kind <> 'VOID'").select(key, text.alias("value")).where("value not in ('', '0', 'false', '[]', '{}', '0.0')")
    return ids.groupBy(key).agg(F.sort_array(F.collect_set("value")).alias("ids"))


def block_tables(rows: DataFrame, key: str, column: str, name: str = "block_content") -> DataFrame:
    """(key, pos, html): every text with a table under that name, in the order of the walk."""
    found = json_walk(rows, key, column).where((F.col("name") == name) & (F.col("kind") == "STRING"))
    found = found.select(key, "at", F.regexp_replace(F.expr("variant_get(value, '$', 'string')"), r'\\"', '"').alias("html")).where("html like '%<table%'")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "html"))), lambda x: x["html"])
    return found.groupBy(key).agg(ordered.alias("html")).select(key, F.posexplode("html").alias("pos", "html"))
