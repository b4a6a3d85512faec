"""Typed file scans and sinks: CSV, JSONL, term files, dual sinks, staged publishing, signed packages, audit rows."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.operators.merge import table_difference


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table whose header holds exactly the schema's columns, in any order; other headers fail."""
    header = spark.read.csv(path, header=True).columns
    header = [h.lstrip("﻿") for h in header]
    if sorted(header) != sorted(schema.names):
        raise ValueError(f"columns {header} instead of {schema.names}")
    by_name = {f.name: f for f in schema.fields}
    given = T.StructType([by_name[h] for h in header])
    return spark.read.schema(given).csv(path, header=True, multiLine=True, escape='"').select(*schema.names)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their numbers, however many splits a file is read in.

    Lines are counted by split; a split's first number is the sum over the splits before it, and a line's place within
    is the distance of its row's id from the split's first. No file is read by one task.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    rows = spark.read.text(path).select("value", *place)
    counted = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(counted, ["file", "split"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "value")


def _json_error(value: str) -> Column:
    """What is wrong with a line of JSON, or null."""
    kind = F.expr(f"schema_of_variant(try_parse_json({value}))")
    return F.when(kind.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "expected a JSON object")


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, error) of every line that is neither blank nor a JSON object."""
    return numbered_lines(spark, path).where(F.trim("value") != "").withColumn("error", _json_error("value")).where("error is not null").select("file", "line", "error")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON objects by line; blank lines are skipped, a line that isn't an object fails with its file and number."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("error", _json_error("value"))
    said = F.concat_ws(":", F.element_at(F.split("file", "/"), -1), "line", F.concat(F.lit(" "), F.col("error")))
    return lines.select(F.when(F.col("error").isNull(), F.from_json("value", schema)).otherwise(F.raise_error(said).cast(schema)).alias("r")).select("r.*")


def read_pair(spark: SparkSession, csv_path: str, jsonl_path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """The CSV table, and its difference from the JSONL table: one row, zero cells if both agree."""
    a, b = read_csv(spark, csv_path, schema), read_jsonl(spark, jsonl_path, schema)
    return a, table_difference(a, b, key, [n for n in schema.names if n != key])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load_table(spark: SparkSession, csv_path: str, jsonl_path: str, schema: T.StructType, key: str) -> DataFrame:
    """A table that is kept twice: the CSV file, or the JSONL file where there is none; no rows where there is neither.

    Where there are both they must agree in every cell, and every key must be filled; else it is an error.
    """
    if exists(spark, csv_path):
        rows = read_csv(spark, csv_path, schema)
        if exists(spark, jsonl_path):
            found = read_pair(spark, csv_path, jsonl_path, schema, key)[1].first().asDict()
            if found["only_a"] or found["only_b"] or found["cells_differ"]:
                raise ValueError(f"the files differ: {found}")
    elif exists(spark, jsonl_path):
        rows = read_jsonl(spark, jsonl_path, schema)
    else:
        return spark.createDataFrame([], schema)
    without = rows.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").count()
    if without:
        raise ValueError(f"{key} is empty in {without} rows")
    return rows


TERM_TYPES = ("combined", "title", "content")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Search terms: .csv with a term column in any case, or one term a line; unknown types count as combined."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        rows = rows.toDF(*(c.lower() for c in rows.columns))
        if "term" not in rows.columns:
            raise ValueError("a term column is needed")
        kind = F.lower("type") if "type" in rows.columns else F.lit("combined")
        rows = rows.select(F.trim("term").alias("term"), F.when(kind.isin(*TERM_TYPES), kind).otherwise("combined").alias("type"))
    else:
        rows = spark.read.text(path).select(F.trim("value").alias("term"), F.lit("combined").alias("type"))
    return rows.where("term <> ''")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, nulls as empty text: what CSV can hold."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*(F.coalesce(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields))


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as CSV and JSON lines under path."""
    flat(df).write.mode("overwrite").csv(f"{path}/csv", header=True, escape='"')
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/jsonl")


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, check: Callable[[str, DataFrame], None] | None = None) -> None:
    """Writes every table beside its place first and only then puts all of them there.

    check(name, rows as written) may refuse by an error before anything live is touched. A live table is set aside
    before the new one takes its place, and goes only when all are there; if anything fails in between, those set aside come
    back and those that had no former one go. A crash leaves them in `.former`, from where the next call, or `recover`,
    puts them back.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, path)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/.staged/{name}")
        if check:
            check(name, spark.read.schema(df.schema).parquet(f"{path}/.staged/{name}"))
    fs.mkdirs(fs_path(f"{path}/.former"))
    try:
        for name in tables:
            if not fs.exists(fs_path(f"{path}/{name}")):
                fs.mkdirs(fs_path(f"{path}/.former/.none-{name}"))
            elif not fs.rename(fs_path(f"{path}/{name}"), fs_path(f"{path}/.former/{name}")):
                raise OSError(f"could not set {name} aside")
        for name in tables:
            if not fs.rename(fs_path(f"{path}/.staged/{name}"), fs_path(f"{path}/{name}")):
                raise OSError(f"could not publish {name}")
    except BaseException:
        recover(spark, path)
        raise
    # one rename decides: from here on the new tables stand
    fs.rename(fs_path(f"{path}/.former"), fs_path(f"{path}/.done"))
    fs.delete(fs_path(f"{path}/.done"), True)
    fs.delete(fs_path(f"{path}/.staged"), True)


def recover(spark: SparkSession, path: str) -> list[str]:
    """Undoes an unfinished publish: the names of tables put back. Those that are new with it go."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(f"{path}/.done"), True)
    former = fs_path(f"{path}/.former")
    found = [x.getPath().getName() for x in fs.listStatus(former)] if fs.exists(former) else []
    names = [n for n in found if not n.startswith(".none-")]
    for name in found:
        fs.delete(fs_path(f"{path}/{name.removeprefix('.none-')}"), True)
    for name in names:
        fs.rename(fs_path(f"{path}/.former/{name}"), fs_path(f"{path}/{name}"))
    fs.delete(former, True)
    return names


def _whole_keys(key: list[str]) -> Callable[[str, DataFrame], None]:
    def check(name: str, rows: DataFrame) -> None:
        bad = rows.groupBy(*key).count().where(" or ".join([f"`{k}` is null" for k in key]) + " or count > 1").count()
        if bad:
            raise ValueError(f"{key} is null or repeated in {bad} cases")

    return check


def replace_all(spark: SparkSession, rows: DataFrame, path: str, key: list[str]) -> int:
    """Replaces a table's whole content by the rows, computed once and checked as written; the number of rows.

    Keys must be whole and different, else nothing is replaced.
    """
    parent, name = path.rstrip("/").rsplit("/", 1)
    publish(spark, {name: rows}, parent, _whole_keys(key))
    return spark.read.parquet(path).count()


#: Folders by hash of the document that a table of replace_documents has.
BUCKETS = 64


def replace_documents(spark: SparkSession, rows: DataFrame, path: str, key: list[str], document: str = "document_id", gone: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replaces what a table holds of the given documents by the rows; the number of rows now in the folders touched.

    The table lies in folders by a hash of the document. Rows are computed once, beside the table, and checked there (keys
    whole and different); then only the folders of documents in rows, or in gone (documents to delete), are written
    anew. All others keep their files.
    """
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(F.col(document).cast("string")), F.lit(buckets)).cast("int")
    try:
        rows.withColumn("bucket", bucket).write.parquet(f"{beside}/rows")
        new = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{beside}/rows")
        _whole_keys(key)(path, new)
        if new.where(F.col(document).isNull()).limit(1).count():
            raise ValueError(f"{document} is null")
        named = new.select(document, "bucket")
        if gone is not None:
            named = named.unionByName(gone.select(F.col(document).cast(rows.schema[document].dataType), bucket.alias("bucket")))
        named.dropDuplicates().write.parquet(f"{beside}/named")
        named = spark.read.parquet(f"{beside}/named")
        touched = [r.bucket for r in named.select("bucket").distinct().collect()]  # at most `buckets`
        if exists(spark, path):
            held = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)).join(named, [document, "bucket"], "left_anti")
            new = new.unionByName(held)
        # an empty folder of a touched bucket must lose its old files too
        new.write.partitionBy("bucket").parquet(f"{beside}/merged")
        merged = spark.read.schema(new.schema).parquet(f"{beside}/merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        filled = {r.bucket for r in merged.select("bucket").distinct().collect()}
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b in set(touched) - filled:
            fs.delete(fs_path(f"{path}/bucket={b}"), True)
        return merged.count()
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(beside)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def verify_stored(stored: DataFrame, rows: DataFrame, key: list[str]) -> int:
    """The number of stored rows if they are the given ones; an error with the number that differ otherwise."""
    columns = rows.columns
    gone, more = rows.exceptAll(stored.select(columns)), stored.select(columns).exceptAll(rows)
    differ = gone.count() + more.count()
    if differ:
        raise ValueError(f"{differ} rows differ from what was to be stored")
    return stored.count()


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest, from two aggregates."""
    h = F.xxhash64(*df.columns)
    n, a, b = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.expr("bit_xor(h)") if "h" in df.columns else F.bit_xor(h)).first()
    return n, hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def file_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every data file under path, by its place there; hashed in the executors."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("sha256")).collect()  # a row for each file
    plain = lambda x: x.replace("file:///", "/").replace("file:/", "/")
    return {plain(r.path)[len(plain(root)) :].lstrip("/"): r.sha256 for r in rows}


def write_package(spark: SparkSession, tables: dict[str, DataFrame], path: str, sign: Callable[[bytes], str], info: dict | None = None, check: Callable[[bytes, str], bool] | None = None) -> dict:
    """Tables with a canonical manifest of rows, digests and the SHA-256 of every file, signed, and read back."""
    manifest = {"info": info or {}, "tables": {}}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows, digest = table_digest(spark.read.parquet(f"{path}/{name}"))
        manifest["tables"][name] = {"rows": rows, "digest": digest, "files": file_digests(spark, f"{path}/{name}")}
    text = canonical_json(manifest)
    spark.createDataFrame([(text, sign(text.encode()))], "manifest string, signature string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    verify_package(spark, path, sign, check)
    return manifest


def verify_package(spark: SparkSession, path: str, sign: Callable[[bytes], str] | None = None, check: Callable[[bytes, str], bool] | None = None) -> dict[str, DataFrame]:
    """The package's tables, if signature, file set, checksums, rows and digests hold.

    check(text, signature) needs no secret (see functions.ed25519); with a shared secret, sign is enough.
    """
    text, signature = spark.read.schema("manifest string, signature string").json(f"{path}/manifest").first()
    sound = check(text.encode(), signature) if check else hmac.compare_digest(sign(text.encode()), signature)
    if not sound:
        raise ValueError("the signature doesn't match")
    out = {}
    for name, want in json.loads(text)["tables"].items():
        if file_digests(spark, f"{path}/{name}") != want["files"]:
            raise ValueError(f"{name}: files were changed, added or removed")
        out[name] = spark.read.parquet(f"{path}/{name}")
        if table_digest(out[name]) != (want["rows"], want["digest"]):
            raise ValueError(f"{name} was changed")
    return out


def export_package(spark: SparkSession, documents: DataFrame, chunks: DataFrame, path: str, sign: Callable[[bytes], str], kinds: tuple[str, ...], info: dict | None = None, check: Callable[[bytes, str], bool] | None = None) -> dict:
    """A package from the live tables: active public documents of the given kinds, and their ready chunks in order.

    Documents without a ready chunk stay out; the manifest's info names the counts. Vectors of two models or of two
    dimensions are refused.
    """
    public = (F.col("access_level") == "public") & (F.col("lifecycle_status") == "active") & F.col("source_type").isin(*kinds)
    ready = chunks.where("embedding_status = 'ready' and embedding is not null")
    own = documents.where(public).join(ready.select("document_id").dropDuplicates(), "document_id", "left_semi")
    parts = ready.join(own.select("document_id"), "document_id", "left_semi")
    models = [c for c in ("embedding_model",) if c in chunks.columns]
    found = parts.agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("sizes"), *(F.countDistinct(m).alias(m) for m in models)).first()
    if found.sizes > 1 or any(found[m] > 1 for m in models):
        raise ValueError(f"a package holds one model and one dimension: {found.asDict()}")
    counts = {"documents": own.count(), "chunks": found.n}
    parts = parts.repartition("document_id").sortWithinPartitions("document_id", "chunk_index")
    return write_package(spark, {"documents": own, "chunks": parts}, path, sign, {**(info or {}), **counts}, check)


def roll_back(packages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New states: the active version rolled back and the last superseded one active again, with its documents."""
    rank = F.row_number().over(Window.orderBy(F.desc("version")))  # a row for each version
    last = packages.where("status = 'superseded'").withColumn("rn", rank).where("rn = 1").select(F.col("version").alias("back"))
    if not last.limit(1).count():
        raise ValueError("no version to go back to")
    states = packages.join(F.broadcast(last), packages["version"] == last["back"], "left")
    states = states.select("version", F.when(F.col("back").isNotNull(), "active").when(F.col("status") == "active", "rolled_back").otherwise(F.col("status")).alias("status"))
    marked = documents.join(F.broadcast(states.select("version", F.col("status").alias("now"))), "version", "left")
    return states, marked.withColumn("deleted", F.when(F.col("now") == "active", False).when(F.col("now") == "rolled_back", True).otherwise(F.col("deleted"))).select(documents.columns)


def import_package(packages: DataFrame, documents: DataFrame, version: str, new_documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New states: the version active and the former active one superseded; its documents dropped softly."""
    states = packages.withColumn("status", F.when(F.col("status") == "active", "superseded").otherwise(F.col("status"))).where(F.col("version") != version)
    states = states.unionByName(packages.sparkSession.createDataFrame([(version, "active")], "version string, status string"))
    prefixed = new_documents.withColumn("external_id", F.concat_ws(":", F.lit(version), "external_id")).withColumn("version", F.lit(version)).withColumn("deleted", F.lit(False))
    kept = documents.where(F.col("version") != version).withColumn("deleted", F.lit(True))
    return states, kept.unionByName(prefixed.select(kept.columns))


def audit_rows(spark: SparkSession, rows: list[tuple[str, str, str, bool, str]], path: str) -> None:
    """Appends (event_type, actor, entity, success, payload) rows."""
    spark.createDataFrame(rows, "event_type string, actor string, entity string, success boolean, payload string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
