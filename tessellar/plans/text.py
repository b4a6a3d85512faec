"""Text, chunking, dates, intents and file-shaped queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.operators import answers as A
from tessellar.operators import chunking as C
from tessellar.plans.base import CHUNKS, chunks, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


TOKENS = "list_filter(list_transform(regexp_extract_all(lower(text), '[0-9a-z가-힣_-]+'), lambda x: regexp_replace(x, '^[_-]+|[_-]+$', '', 'g')), lambda x: length(x) >= 2)"


@query("tokenize", f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS pos FROM documents), f AS (SELECT doc_id, t, min(pos) AS pos FROM t GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY pos), '') AS tokens, count(t) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id")
def tokenize(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).alias("n"))


HTML = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script)\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6])\\s*>', chr(10), 'g')"
HTML = f"regexp_replace({HTML}, '<[^>]*>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_a}', '{_b}')"
HTML = f"array_to_string(list_filter(list_transform(string_split(regexp_replace({HTML}, '[ \\t\\r\\f]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query("html_to_text", f"SELECT page_id, {HTML} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("clean_text")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("normalize_text", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS lines, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_lines(F.col("text")).alias("lines"), T.squeeze(F.col("text")).alias("squeezed"))


@query("null_words", "SELECT n, CASE WHEN lower(trim(v)) IN ('', 'null', 'none', 'nan', 'n/a') THEN NULL ELSE trim(v) END AS v FROM (SELECT event_id AS n, CASE event_id % 5 WHEN 0 THEN ' NULL ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE ' ' || event_type END AS v FROM events)")
def null_words(spark, sf_dir):
    v = F.when(F.col("event_id") % 5 == 0, " NULL ").when(F.col("event_id") % 5 == 1, "n/a").when(F.col("event_id") % 5 == 2, "").otherwise(F.concat(F.lit(" "), "event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), T.null_words(v).alias("v"))


@query("typed_coerce", "SELECT event_id, CASE WHEN regexp_full_match(replace(s, ',', ''), '[+-]?[0-9]+') THEN try_cast(replace(s, ',', '') AS INT) END AS i, coalesce(round(try_cast(replace(s, ',', '') AS DOUBLE), 6), 0) AS d FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN 1 THEN event_type ELSE round(value, 2)::VARCHAR END AS s FROM events)")
def typed_coerce(spark, sf_dir):
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.round("value", 2).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", T.to_int(F.col("s")).alias("i"), F.round(T.to_double(F.col("s"), 0.0), 6).alias("d"))


@query("date_extract", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def date_extract(spark, sf_dir):
    shown = F.when(F.col("o_orderkey") % 7 == 0, F.lit("on 2024-02-30 it happened")).otherwise(F.concat(F.lit("date: "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(" (x)")))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("s")).select("o_orderkey", T.parse_date(F.col("s")).alias("day"))


@query("only_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE NULL END AS y FROM orders")
def only_year(spark, sf_dir):
    shown = F.concat(F.lit("in "), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit(" and "), (F.year("o_orderdate") - 1).cast("string"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("s")).select("o_orderkey", T.only_year(F.col("s")).alias("y"))


@query("focused_excerpt", "SELECT doc_id, substring(text, greatest(strpos(lower(text), 'tion') - 40, 1), 160) AS excerpt FROM documents")
def focused_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.focused_excerpt(F.col("text"), "tion").alias("excerpt"))


@query("display_excerpt", f"WITH {CHUNKS} SELECT chunk_id, title, left(content, 700) AS excerpt, row_number() OVER (PARTITION BY title ORDER BY chunk_id) AS rank FROM chunks")
def display_excerpt(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("title").orderBy("chunk_id"))
    return chunks(spark, sf_dir).select("chunk_id", "title", T.excerpt(F.col("content")).alias("excerpt"), rank.alias("rank"))


@query("section_exclusion", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE NOT (contains(title, 'src1') OR contains(title, '7'))")
def section_exclusion(spark, sf_dir):
    words = F.array(F.lit("src1"), F.lit("7"))
    return chunks(spark, sf_dir).where(~F.exists(words, lambda w: F.contains(F.col("title"), w))).select("chunk_id")


@query("edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 1")
def edit_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return pairs.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("d")).where("d <= 1")


@query("sentence_units")
def sentence_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "unit"))


#: Units of a text: marks go in where one ends, twice, as a unit of one letter is part of two matches.
_ENDS = "'(^|[^0-9])([.!?]\\s)(\\S)', '\\1\\2' || chr(1) || '\\3', 'g')"
UNITS = f"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '(\\n)([^\\n])', '\\1' || chr(1) || '\\2', 'g'), {_ENDS}, {_ENDS}, chr(1)), lambda x: x <> '')"
UNITS = f"u AS (SELECT doc_id, unnest({UNITS}) AS unit, CAST(generate_subscripts({UNITS}, 1) - 1 AS INT) AS pos FROM documents)"


@query("useful_sentences", f"WITH {UNITS}, t AS (SELECT doc_id, pos, trim(unit) AS unit FROM u) SELECT * FROM t WHERE length(unit) >= 10 AND NOT regexp_matches(unit, '^[\\d\\s.,-]+$') AND length(unit) - length(replace(unit, '|', '')) < 2 AND len(regexp_extract_all(unit, '\\S+:\\s')) < 3 AND regexp_matches(unit, '[A-Za-z가-힣]')")
def useful_sentences(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "unit"))
    return units.withColumn("unit", F.trim("unit")).where(T.useful_sentence(F.col("unit")))


@query("chunk_pack")
def chunk_pack(spark, sf_dir):
    return C.chunked(table(spark, sf_dir, "documents"), C.pack_sentences)


@query("chunk_at_marks")
def chunk_at_marks(spark, sf_dir):
    return C.chunked(table(spark, sf_dir, "documents"), lambda t: C.with_header("[자료유형] 문서", t))


@query("table_rows")
def table_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("<tr><td>"), "n_nationkey", F.lit("</td><td>"), "n_name", F.lit("</td></tr>")).alias("r"), "n_nationkey")
    pages = rows.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "r"))), lambda x: x["r"]), "").alias("rows"))
    html = pages.select("n_regionkey", F.concat(F.lit("<table><tr><th>id</th><th>name</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    return A.table_rows(html, "n_regionkey", "html")


ORACLES["table_rows"] = "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, '{\"id\":\"' || n_nationkey || '\",\"name\":\"' || n_name || '\"}' AS record FROM nation"


@query("section_paths")
def section_paths(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    rows = items.select((F.col("l_orderkey") % 50).alias("document"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") % 3 + 1).alias("level"), F.concat(F.lit("h"), "l_partkey").alias("title"))
    return C.with_section_paths(rows, "document", "ord")


_Q = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"
_DOC, _FOR, _ACT, _HOW, _PART, _ANY, _PLAIN = (f"regexp_matches(q, '{x}')" for x in (A.DOCUMENT, A.DOCUMENT_PURPOSE, A.ACTION, A.ACTION_PURPOSE, A.COMPONENT_PURPOSE, A.GENERIC, A.PLAIN_ACTION))
_RUNGS = ((f"{_DOC} AND {_FOR}", "document_qa", 0.96), (f"{_PART} AND NOT {_HOW}", "component_info", 0.94), (f"{_ACT} AND ({_HOW} OR NOT {_DOC} OR {_PLAIN})", "maintenance_guide", 0.92), (_PART, "component_info", 0.86), (_DOC, "document_qa", 0.72), (f"{_ANY} OR len(string_split(q, ' ')) <= 4", "clarification_required", 0.62), ("true", "clarification_required", 0.5))


@query("intent_ladder", f"WITH c AS (SELECT conv_id, turn, text AS question, {_Q} AS q FROM conversations) SELECT conv_id, turn, question, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in _RUNGS) + " END AS intent, CAST(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in _RUNGS) + " END AS DOUBLE) AS confidence FROM c")
def intent_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return A.intents(rows, "question", F.lit(False))


_TERMS = "(contains(lower(unit), 'tion')::INT + contains(lower(unit), 'heit')::INT + contains(lower(unit), 'que')::INT)"
_SIGNALS = "(contains(lower(unit), 'the')::INT + contains(lower(unit), 'der')::INT)"


@query("best_sentence", f"WITH {UNITS}, s AS (SELECT *, round({_TERMS} / 3.0::DOUBLE + CASE WHEN {_SIGNALS} > 0 THEN 0.3::DOUBLE ELSE 0 END - 0.02::DOUBLE * pos, 6) AS score FROM u) SELECT doc_id, pos, trim(unit) AS unit, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1")
def best_sentence(spark, sf_dir):
    return A.best_sentence(table(spark, sf_dir, "documents"), "doc_id", "text", ["tion", "heit", "que"], ["the", "der"])


@query("top_sentences", f"WITH {UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 2 * {_TERMS} + {_SIGNALS} - length(unit) / 400.0::DOUBLE DESC, pos) AS rn FROM u) SELECT doc_id, string_agg(trim(unit), ' ' ORDER BY pos) AS summary FROM r WHERE rn <= 3 GROUP BY doc_id")
def top_sentences(spark, sf_dir):
    return A.top_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", ["tion", "heit", "que"], ["the", "der"], 3)


@query("keyword_dedupe", "WITH k AS (SELECT doc_id, unnest(string_split(source || ',' || upper(source) || ',' || lang || ',x', ',')) AS w, unnest(range(4)) AS pos FROM documents), f AS (SELECT doc_id, lower(w) AS l, arg_min(w, pos) AS w, min(pos) AS pos FROM k GROUP BY ALL) SELECT doc_id, string_agg(w, ',' ORDER BY pos) AS words FROM f GROUP BY doc_id")
def keyword_dedupe(spark, sf_dir):
    words = F.concat_ws(",", "source", F.upper("source"), "lang", F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.distinct_ignoring_case(F.split(words, ",")), ",").alias("words"))


@query("evidence_union", "SELECT l_orderkey, list_sort(list(DISTINCT x)) AS evidence FROM (SELECT l_orderkey, l_partkey AS x FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey")
def evidence_union(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set("l_suppkey").alias("b"))
    return parts.select("l_orderkey", F.sort_array(F.array_union("a", "b")).alias("evidence"))


@query("image_paths", "SELECT event_id, '[' || array_to_string(list_transform(list_sort(list_distinct([event_type, 'a', event_type])), lambda x: '\"' || x || '\"'), ',') || ']' AS paths FROM events")
def image_paths(spark, sf_dir):
    given = F.to_json(F.array("event_type", F.lit("a"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.sort_array(A.path_list(given))).alias("paths"))


@query("page_envelope", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def page_envelope(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


@query("semantic_key_dedupe", "WITH k AS (SELECT p_partkey, p_brand, CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'brass') THEN 'brass' ELSE lower(p_type) END AS class FROM part) SELECT p_brand, class, min(p_partkey) AS first FROM k GROUP BY ALL")
def semantic_key_dedupe(spark, sf_dir):
    low = F.lower("p_type")
    rows = table(spark, sf_dir, "part").withColumn("class", A.class_key(low, {"steel": ("steel",), "brass": ("brass",)}))
    return rows.groupBy("p_brand", "class").agg(F.min("p_partkey").alias("first"))


@query("font_mapping_suspects", "SELECT doc_id, length(regexp_replace(text, '[^가-힣]', '', 'g')) AS hangul, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin FROM documents")
def font_mapping_suspects(spark, sf_dir):
    count = lambda ranges: F.length(F.regexp_replace("text", f"[^{ranges}]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", count("가-힣").alias("hangul"), count("A-Za-zÀ-ɏ").alias("latin"))


@query("retry_pages", "WITH t AS (SELECT l_suppkey AS term, count(*) AS total FROM lineitem GROUP BY 1) SELECT term, total, greatest(1, ceil(total / 50.0))::BIGINT AS pages FROM t")
def retry_pages(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("term")).agg(F.count("*").alias("total"))
    return t.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 50)))


LABELS = ["date", "place", "cause"]


@query("labelled_values", "SELECT o_orderkey, o_orderdate::DATE AS day, 'site ' || (o_custkey % 9) AS place, nullif(o_orderpriority, '5-LOW') AS cause FROM orders")
def labelled_values(spark, sf_dir):
    from tessellar.operators import accidents as D

    cause = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    text = F.concat(F.lit("report d a t e : "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit("\nplace: site  "), F.col("o_custkey") % 9, F.lit(" cause : "), cause)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    t = F.col("t")
    return rows.select("o_orderkey", D.accident_date(t, "date", LABELS).alias("day"), D.labelled_value(t, "place", LABELS).alias("place"), D.labelled_value(t, "cause", LABELS).alias("cause"))


@query("title_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def title_dates(spark, sf_dir):
    from tessellar.operators import accidents as D

    year = F.year("o_orderdate").cast("string")
    title = F.concat(F.date_format("o_orderdate", "M"), F.lit("/"), F.date_format("o_orderdate", "d"), F.lit(" fall"))
    text = F.concat(F.lit("in "), year, F.when(F.col("o_orderkey") % 3 == 0, ", before 1990").otherwise(", at work"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.title_date(title, text).alias("day"))


@query("final_text", "SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x NOT IN ('', '.')), chr(10)), '') AS text FROM documents")
def final_text(spark, sf_dir):
    from tessellar.operators import accidents as D

    return table(spark, sf_dir, "documents").select("doc_id", D.final_text(F.col("text")).alias("text"))


@query("best_locations", "WITH c AS (SELECT l_partkey, l_suppkey % 6 AS location, (l_quantity)::INT AS score FROM lineitem), k AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY score DESC) AS k FROM c WHERE score >= 20) SELECT l_partkey, CASE WHEN count(DISTINCT location) = 1 THEN min(location) END AS location, CASE WHEN count(DISTINCT location) = 1 THEN 'ok' ELSE 'conflict' END AS status FROM k WHERE k = 1 GROUP BY l_partkey")
def best_locations(spark, sf_dir):
    from tessellar.operators import accidents as D

    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 6).alias("location"), F.col("l_quantity").cast("int").alias("score"))
    return D.best_location(rows, "l_partkey")


@query("document_profiles", f"WITH {CHUNKS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY chunk_index) AS rn FROM chunks WHERE chunk_index < 12) WHERE rn = 1) SELECT document_id, count(*) AS n, left(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 18000) AS sample FROM h GROUP BY document_id")
def document_profiles(spark, sf_dir):
    from tessellar.operators import accidents as D

    return D.profile_sample(chunks(spark, sf_dir), ["tion"])


@query("profile_routing", f"WITH {CHUNKS} SELECT chunk_id, round(CASE WHEN title = 'src3' THEN 4.0 + 0.2 ELSE 0 END + CASE WHEN title IN ('src3', 'src30') OR contains('whatissrc3here', title) THEN 0 ELSE 0 END + CASE WHEN contains(lower(title), 'src3') THEN 1.2 ELSE 0 END, 6) AS score FROM chunks")
def profile_routing(spark, sf_dir):
    from tessellar.operators import accidents as D

    s = D.profile_score("what is src3 here", F.array().cast("array<string>"), F.array("title"), F.col("title"), F.col("source_type"), F.col("source_type"), ["src3"])
    return chunks(spark, sf_dir).select("chunk_id", F.round(s, 6).alias("score"))
