"""Nested JSON, cards and citations of answers, lines of pages and named places, made from events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellar.operators import answers as A
from tessellar.operators import gazetteer as G
from tessellar.operators import layout as L
from tessellar.operators import nested as N
from tessellar.operators import quality as Q
from tessellar.operators import risk as K
from tessellar.plans.base import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


E = "e AS (SELECT event_id, event_id // 8 AS answer_id, event_id % 8 AS pos, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 8").alias("answer_id"), (F.col("event_id") % 8).alias("pos"), "event_type", "user_id", k)


@query(
    "evidence_merge",
    f"""WITH RECURSIVE {E}, c AS (SELECT answer_id, pos, upper(event_type) || repeat(' ', CAST(k % 3 AS INT)) || (k % 4) AS text, CASE WHEN k % 7 = 0 THEN [] ELSE list_distinct(['k' || (k % 5), 'u' || (user_id % 3)]) END AS ev FROM e),
    s AS (
      SELECT answer_id, -1::BIGINT AS pos, []::BIGINT[] AS kept, []::VARCHAR[] AS ids, []::VARCHAR[] AS texts FROM (SELECT DISTINCT answer_id FROM c)
      UNION ALL
      SELECT answer_id, pos, CASE WHEN old THEN kept ELSE list_append(kept, pos) END, CASE WHEN old THEN ids ELSE list_concat(ids, ev) END, CASE WHEN old THEN texts ELSE list_append(texts, said) END
      FROM (SELECT s.answer_id, s.pos + 1 AS pos, kept, ids, texts, coalesce(ev, []) AS ev, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS said,
              ev IS NULL OR list_contains(texts, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) OR (len(ev) > 0 AND list_has_all(ids, ev)) OR len(kept) >= 4 AS old
            FROM s LEFT JOIN c ON c.answer_id = s.answer_id AND c.pos = s.pos + 1 WHERE s.pos < 7)
    ) SELECT c.answer_id, CAST(c.pos AS INT) AS pos, c.text, list_aggregate(list_sort(c.ev), 'string_agg', ',') AS evidence FROM s JOIN c ON c.answer_id = s.answer_id AND list_contains(s.kept, c.pos) WHERE s.pos = 7""",
)
def evidence_merge(spark, sf_dir):
    e = events(spark, sf_dir)
    ids = F.array(F.concat(F.lit("k"), (F.col("k") % 5).cast("string")), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    text = F.concat(F.upper("event_type"), F.repeat(F.lit(" "), (F.col("k") % 3).cast("int")), (F.col("k") % 4).cast("string"))
    cards = e.select("answer_id", "pos", text.alias("text"), F.when(F.col("k") % 7 == 0, F.slice(ids, 1, 0)).otherwise(ids).alias("evidence"))
    merged = A.merge_cards(cards, "answer_id", most=4)
    return merged.select("answer_id", "pos", "text", F.when(F.size("evidence") > 0, F.array_join(F.sort_array("evidence"), ",")).alias("evidence"))


@query(
    "citation_remap",
    f"""WITH {E}, sent AS (SELECT answer_id, pos + 1 AS n, user_id % 20 AS chunk_id FROM e),
    sources AS (SELECT answer_id, chunk_id, row_number() OVER (PARTITION BY answer_id ORDER BY chunk_id DESC) AS place FROM (SELECT DISTINCT answer_id, chunk_id FROM sent WHERE chunk_id % 3 <> 0)),
    number AS (SELECT s.answer_id, s.n, g.place FROM sent s JOIN sources g USING (answer_id, chunk_id))
    SELECT e.answer_id, string_agg(event_type || ' ' || CASE WHEN a.place IS NULL THEN '[' || (k % 11) || ']' ELSE '[' || a.place || ']' END || ' and ' || CASE WHEN b.place IS NULL THEN '[ 0' || (user_id % 9) || ' ]' ELSE '[' || b.place || ']' END || ' [x]', '; ' ORDER BY event_id) AS answer
    FROM e LEFT JOIN number a ON a.answer_id = e.answer_id AND a.n = k % 11 LEFT JOIN number b ON b.answer_id = e.answer_id AND b.n = user_id % 9 GROUP BY e.answer_id""",
)
def citation_remap(spark, sf_dir):
    e = events(spark, sf_dir)
    said = F.concat(F.col("event_type"), F.lit(" ["), (F.col("k") % 11).cast("string"), F.lit("] and [ 0"), (F.col("user_id") % 9).cast("string"), F.lit(" ] [x]"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("event_id", said.alias("t")))), lambda x: x["t"])
    answers = e.groupBy("answer_id").agg(F.array_join(texts, "; ").alias("answer"))
    sent = e.select("answer_id", (F.col("pos") + 1).alias("pos"), (F.col("user_id") % 20).alias("chunk_id"))
    ids = F.sort_array(F.collect_set(F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id"))), asc=False)
    sources = sent.groupBy("answer_id").agg(ids.alias("ids")).select("answer_id", F.posexplode("ids").alias("p", "chunk_id")).select("answer_id", (F.col("p") + 1).alias("pos"), "chunk_id")
    return A.remap_citations(answers, sent, sources, "answer_id")


@query(
    "evidence_walk",
    f"""WITH {E}, i AS (SELECT answer_id, 'c' || (k % 6) AS id FROM e UNION ALL SELECT answer_id, CAST(user_id AS VARCHAR) FROM e WHERE user_id <> 0 UNION ALL SELECT answer_id, event_type FROM e WHERE k % 4 <> 0)
    SELECT answer_id, list_sort(list(DISTINCT id)) AS ids FROM i GROUP BY answer_id""",
)
def evidence_walk(spark, sf_dir):
    """Lists at depths that vary with k, beside fields of other names and kinds, empty items and lists within lists."""
    e = events(spark, sf_dir)
    deep = (F.col("k") % 4).cast("int")
    inner = F.when(deep > 0, F.concat(F.repeat(F.lit('[{"x":[0,'), deep), F.lit('{"evidence_chunk_ids":["'), "event_type", F.lit('"]}'), F.repeat(F.lit("]}]"), deep))).otherwise(F.lit('{"evidence_chunk_ids":"none","other":["no"]}'))
    own = F.concat(F.lit('{"a":'), inner, F.lit(',"evidence_chunk_ids":["c'), (F.col("k") % 6).cast("string"), F.lit('",'), F.col("user_id").cast("string"), F.lit(',null,"",false],"z":null}'))
    texts = F.sort_array(F.collect_list(F.struct("event_id", own.alias("t"))))
    rows = e.groupBy("answer_id").agg(F.concat(F.lit('{"cards":['), F.array_join(F.transform(texts, lambda x: x["t"]), ","), F.lit("]}")).alias("doc"))
    return N.collected(rows, "answer_id", "doc")


LINES = f"""{E}, l AS (SELECT event_id // 64 AS page, CAST(event_id % 64 AS INT) AS line, CASE k % 4 WHEN 0 THEN '주' WHEN 1 THEN '회로' WHEN 2 THEN 'abc' ELSE 'x' END AS text,
    CASE WHEN user_id % 11 = 0 THEN NULL ELSE (k % 3) * 0.8 END AS x0, event_id % 64 * 10.0 + user_id % 3 * 2 AS y0, (event_id % 64 + 1) * 10.0 + event_id % 2 AS y1, k % 5 = 0 AS is_header FROM e)"""


@query(
    "vertical_fragments",
    f"""WITH {LINES}, m AS (SELECT *, coalesce(length(text) <= 2 AND x0 IS NOT NULL, false) AS short FROM l),
    g AS (SELECT *, coalesce(short AND lag(short) OVER w AND abs(x0 - lag(x0) OVER w) < 1.5 AND abs(y0 - lag(y1) OVER w) < 3.0, false) AS goes_on FROM m WINDOW w AS (PARTITION BY page ORDER BY line)),
    i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line) AS island FROM g)
    SELECT page, min(line) AS line, string_agg(text, '' ORDER BY line) AS text, bool_or(is_header) AND count(*) = 1 AS is_header, count(*) AS n FROM i GROUP BY page, island""",
)
def vertical_fragments(spark, sf_dir):
    e = events(spark, sf_dir)
    line, u, k = (F.col("event_id") % 64).cast("int"), F.col("user_id"), F.col("k")
    text = F.when(k % 4 == 0, "주").when(k % 4 == 1, "회로").when(k % 4 == 2, "abc").otherwise("x")
    lines = e.select(F.expr("event_id div 64").alias("page"), line.alias("line"), text.alias("text"), F.when(u % 11 != 0, (k % 3) * 0.8).alias("x0"), (line * 10.0 + u % 3 * 2).alias("y0"), ((line + 1) * 10.0 + F.col("event_id") % 2).alias("y1"), (k % 5 == 0).alias("is_header"))
    return L.merge_vertical(lines, [])


@query(
    "page_sections",
    f"""WITH {LINES}, s AS (SELECT *, page // 4 AS file, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY page // 4 ORDER BY page, line) AS section FROM l)
    SELECT file, section, coalesce(max(CASE WHEN is_header THEN text END), '머리말') AS header, min(page) AS start_page, max(CASE WHEN NOT is_header THEN page END) AS end_page, list(text ORDER BY page, line) FILTER (NOT is_header) AS blocks
    FROM s GROUP BY file, section HAVING count(*) FILTER (NOT is_header) > 0""",
)
def page_sections(spark, sf_dir):
    e = events(spark, sf_dir)
    k = F.col("k")
    text = F.when(k % 4 == 0, "주").when(k % 4 == 1, "회로").when(k % 4 == 2, "abc").otherwise("x")
    lines = e.select(F.expr("event_id div 256").alias("file"), F.expr("event_id div 64").alias("page"), (F.col("event_id") % 64).cast("int").alias("line"), text.alias("text"), (k % 5 == 0).alias("is_header"))
    return L.sections(lines, ["file"])


#: Two texts of an event: places by k and by user, as the rule says; NORTHSIDE is in every nation, PORT of a nation in one.
PLACES = f"""{E}, n AS (SELECT n_nationkey AS nk, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), r AS (SELECT r_regionkey AS rk, r_name FROM region),
    two AS (SELECT event_id, 0 AS run, k % 7 AS kind, (k + user_id) % 25 AS nk, user_id % 5 AS rk FROM e UNION ALL SELECT event_id, 1, (k + user_id) % 7, user_id % 25, k % 5 FROM e),
    said AS (SELECT two.*, n.n_name, n.r_name AS own, r.r_name FROM two JOIN n USING (nk) JOIN r USING (rk))"""


@query(
    "place_resolution",
    f"""WITH {PLACES} SELECT event_id, run,
      CASE kind WHEN 2 THEN 'ambiguous' WHEN 0 THEN CASE WHEN own = r_name THEN 'resolved' ELSE 'invalid' END ELSE 'resolved' END AS status,
      CASE WHEN kind = 2 OR kind = 0 AND own <> r_name THEN NULL WHEN kind = 4 THEN r_name ELSE own END AS province,
      CASE WHEN kind IN (2, 4) OR kind = 0 AND own <> r_name THEN NULL ELSE n_name END AS city,
      CASE kind WHEN 3 THEN 'NORTHSIDE' WHEN 6 THEN n_name || ' PORT' END AS district FROM said""",
)
def place_resolution(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    at = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("nk"), "n_name", F.col("r_name").alias("own"))
    none = F.lit(None).cast("string")
    levels = [at.select(F.col("own").alias("province"), none.alias("city"), none.alias("district")), at.select(F.col("own").alias("province"), F.col("n_name").alias("city"), none.alias("district"))]
    levels += [at.select(F.col("own").alias("province"), F.col("n_name").alias("city"), d.alias("district")) for d in (F.lit("NORTHSIDE"), F.concat("n_name", F.lit(" PORT")))]
    places = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3]).dropDuplicates()
    former = {f"OLD {r.n_name}": (r.own, r.n_name, None) for r in at.collect()}  # 25 nations
    names = G.gazetteer(places, former=former, misspelt={"NORTSIDE": "NORTHSIDE"}, provinces={})

    e, k, u = events(spark, sf_dir), F.col("k"), F.col("user_id")
    regions = region.select(F.col("r_regionkey").cast("long").alias("rk"), "r_name")

    def said(kind, n, r):
        own = e.select("event_id", kind.alias("kind"), n.alias("nk"), r.alias("rk")).join(F.broadcast(at), "nk").join(F.broadcast(regions), "rk")
        kind, city = F.col("kind"), F.col("n_name")
        text = F.when(kind == 0, F.concat_ws(" ", "r_name", city)).when(kind == 1, city).when(kind == 2, F.lit("NORTSIDE")).when(kind == 3, F.concat(city, F.lit(" NORTSIDE"))).when(kind == 4, F.col("r_name"))
        return own.select("event_id", text.when(kind == 5, F.concat(F.lit("OLD "), city)).otherwise(F.concat_ws(" ", "own", city, F.concat(city, F.lit(" PORT")))).alias("t"))

    one, two = said(k % 7, (k + u) % 25, u % 5), said((k + u) % 7, u % 25, k % 5).withColumnRenamed("t", "t2")
    texts = one.join(two, "event_id").select("event_id", F.concat(F.lit("A worker fell at "), "t", F.lit(", and was brought to "), "t2", F.lit(".")).alias("text"))
    return G.named_places(texts, "event_id", "text", names).select("event_id", "run", "status", "province", "city", "district")


@query(
    "state_regressions",
    f"""WITH {E} SELECT count(*) FILTER (WHERE event_id % 17 = 3) AS lost_rows, (SELECT count(*) FROM e WHERE event_id % 101 = 5) AS added_rows,
    count(*) FILTER (WHERE event_id % 17 <> 3 AND (k % 9 = 0 AND user_id IS NOT NULL)) AS protected_column_regressions,
    count(*) FILTER (WHERE event_id % 17 <> 3 AND k % 3 = 2) + (SELECT count(*) FROM e WHERE event_id % 101 = 5 AND k % 3 = 2) AS idempotence_errors, false AS passed FROM e""",
)
def state_regressions(spark, sf_dir):
    """A step that takes one trailing space of up to three: it drops rows, adds some, clears a protected column, and isn't done after one time."""
    e = events(spark, sf_dir).select("event_id", "k", "user_id", F.concat("event_type", F.repeat(F.lit(" "), (F.col("k") % 3).cast("int"))).alias("text"))
    step = lambda df: df.withColumn("text", F.regexp_replace("text", " $", ""))
    added = e.where("event_id % 101 = 5").withColumn("event_id", -1 - F.col("event_id"))
    after = step(e.where("event_id % 17 <> 3").unionByName(added)).withColumn("user_id", F.when((F.col("k") % 9 != 0) | (F.col("event_id") < 0), F.col("user_id")))
    return Q.regressions(e, after, "event_id", ["k", "user_id"], step(after))


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_all = (*enumerate(K.RULES), (-1, K.DEFAULT))
#: A request of an event: a task and a part, each from words of which some are no rule's; evidence by other events of the answer.
ASKED = ("컨베이어", "벨트 청소", "모터", "용접", "문서", "전압과 베어링", "산책")
RISK = f"""{E}, rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r.name}', {_list(r.keywords)}::VARCHAR[], {_list(r.checklist)}, {_list(r.safety)})" for i, r in _all)}) r(rule, name, keys, items, acts)),
    q AS (SELECT event_id, answer_id, {_list(ASKED)}[k % 7 + 1] || ' 및 ' || {_list(ASKED)}[user_id % 7 + 1] AS t FROM e),
    hit AS (SELECT event_id, answer_id, rules.* FROM q JOIN rules ON len(list_filter(keys, lambda x: contains(t, x))) > 0), h AS (SELECT * FROM hit UNION ALL SELECT event_id, answer_id, rules.* FROM q, rules WHERE rule = -1 AND event_id NOT IN (SELECT event_id FROM hit)),
    n AS (SELECT answer_id, k AS retrieval_rank, event_type AS title, user_id % 4 AS page_start, row_number() OVER (PARTITION BY answer_id ORDER BY k, event_type, user_id % 4) AS n FROM e WHERE k % 3 = 0),
    v AS (SELECT answer_id, list('근거 [' || retrieval_rank || '] ' || title || CASE WHEN page_start <> 0 THEN ' (' || page_start || '쪽)' ELSE '' END || '의 관련 절차를 원문과 대조합니다.' ORDER BY n) AS acts FROM n WHERE n <= 3 GROUP BY answer_id)"""


def _assessed(spark, sf_dir):
    e = events(spark, sf_dir)
    word = lambda n: F.element_at(F.array(*map(F.lit, ASKED)), (n % 7 + 1).cast("int"))
    found = K.hazards(e.select("event_id", F.concat(word(F.col("k")), F.lit(" 및 "), word(F.col("user_id"))).alias("text")), key="event_id")
    kept = e.where("k % 3 = 0").select("answer_id", F.col("k").alias("retrieval_rank"), F.col("event_type").alias("title"), (F.col("user_id") % 4).alias("page_start"))
    first = F.row_number().over(Window.partitionBy("answer_id").orderBy("retrieval_rank", "title", "page_start"))
    evidence = e.select("event_id", "answer_id").join(kept.withColumn("n", first).where("n <= 3"), "answer_id").drop("answer_id")
    return K.with_evidence(found, evidence, "event_id")


@query("safety_actions", f"WITH {RISK}, a AS (SELECT event_id, name, unnest(list_concat(h.acts, coalesce(v.acts, []))) AS act, generate_subscripts(list_concat(h.acts, coalesce(v.acts, [])), 1) AS pos FROM h LEFT JOIN v USING (answer_id)), f AS (SELECT event_id, name, act, min(pos) AS pos FROM a GROUP BY ALL) SELECT event_id, name, string_agg(act, '; ' ORDER BY pos) AS actions FROM f GROUP BY ALL")
def safety_actions(spark, sf_dir):
    return _assessed(spark, sf_dir)[0].select("event_id", "name", F.array_join("safety_actions", "; ").alias("actions"))


@query("evidence_checklist", f"WITH {RISK}, i AS (SELECT event_id, rule, unnest(items) AS item, unnest(range(len(items))) AS pos FROM h UNION ALL SELECT q.event_id, 99, unnest(coalesce(v.acts, ['{K.NO_EVIDENCE}'])), unnest(range(len(coalesce(v.acts, ['x'])))) FROM q LEFT JOIN v USING (answer_id)), f AS (SELECT event_id, item, min((rule, pos)) AS fst FROM i GROUP BY ALL) SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY fst, item) AS INT) AS sequence, item FROM f")
def evidence_checklist(spark, sf_dir):
    return _assessed(spark, sf_dir)[1]
