"""Registered queries of the document operators on the driver's tables, and the same in DuckDB's SQL.

The tables hold no captions, broken JSON or jobs, so each query first rewrites rows by fixed rules (by key), the same in
both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import json_repair as R
from vellumine.functions import text as X
from vellumine.functions.rouge import rouge_counts
from vellumine.operators import captions as C
from vellumine.operators import jobs as J
from vellumine.operators import mapping as M
from vellumine.operators import metrics as K
from vellumine.operators import sections as S
from vellumine.operators import validation as V
from vellumine.operators.documents import postprocess
from vellumine.operators.keyed_table import KeyedTable
from vellumine.plans.structure import GENERATORS, PROMPT, RETRY_TOKENS, SHORT_PROMPT, TEXT_MARK, structure
from vellumine.session import shared_folder
from vellumine.sources import files, markup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


#: Lines of documents in SQL: doc_id, pos (from 0), line.
LINES = """(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
STRIP = r"regexp_replace({}, '^[\s\x{{1C}}-\x{{1F}}]+|[\s\x{{1C}}-\x{{1F}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


@query(
    f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(8203) || text || chr(8201) || ' ' WHEN 1 THEN replace(text, ' ', chr(160) || ' ') ELSE text END AS x FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '[\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'),
      '[\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS y FROM t)
    SELECT doc_id, md5({strip_sql("y")}) AS digest, length({strip_sql("y")}) AS n_chars FROM u"""
)
def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    odd = F.when(kind == 0, F.concat(F.lit("\u200b"), "text", F.lit("\u2009 "))).when(kind == 1, F.replace("text", F.lit(" "), F.lit("\u00a0 "))).otherwise(F.col("text"))
    out = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", X.clean_unicode(odd).alias("c"))
    return out.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, pos::BIGINT AS pos, length(line) AS n_chars, md5(line) AS digest FROM {LINES}")
def section_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("n_chars"), F.md5("line").alias("digest"))


@query(
    f"""WITH t AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN '12%' WHEN pos % 4 = 2 THEN ' Methods ' ELSE {strip_sql("line")} END AS c FROM {LINES})
    SELECT doc_id, count(*) AS kept, sum(pos)::BIGINT AS kept_pos FROM t
    WHERE {strip_sql("c")} <> '' AND {strip_sql("c")} <> 'Methods' AND NOT (length({strip_sql("c")}) < 5 AND NOT regexp_matches(c, '\\p{{L}}')) GROUP BY doc_id"""
)
def empty_selfref_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("pos") % 4 == 3, "12%").when(F.col("pos") % 4 == 2, " Methods ").otherwise(X.strip(F.col("line")))
    rows = lines(spark, sf_dir).withColumn("c", c).filter(~S.is_empty_or_self_referential(F.lit("Methods"), F.col("c")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("kept_pos"))


_DEMUX = f"""(SELECT doc_id, pos, CASE WHEN pos % 5 = 1 THEN 'Figure ' || pos ELSE 'Part ' || pos END AS title,
   CASE WHEN pos % 5 = 2 THEN 'figure ' || pos || '. ' || line WHEN pos % 5 = 3 THEN 'Table ' || pos || '. ' || line ELSE line END AS content FROM {LINES})"""


@query(
    f"""WITH t AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)^figure\\s+\\d+') OR regexp_matches({strip_sql("content")}, '(?i)^figure\\s+\\d+\\.') THEN 'figure'
      WHEN regexp_matches(title, '(?i)^table\\s+\\d+') OR regexp_matches({strip_sql("content")}, '(?i)^table\\s+\\d+\\.') THEN 'table' ELSE 'section' END AS kind FROM {_DEMUX})
    SELECT doc_id, count(*) FILTER (kind = 'section') AS n_sections, count(*) FILTER (kind = 'figure') AS n_figures, count(*) FILTER (kind = 'table') AS n_tables,
      md5(coalesce(string_agg(CASE WHEN starts_with(content, CASE kind WHEN 'figure' THEN 'Figure' ELSE 'Table' END) THEN content ELSE title || '/' || content END, '|' ORDER BY kind, pos) FILTER (kind <> 'section'), '')) AS captions
    FROM t GROUP BY doc_id"""
)
def figure_table_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos")
    title = F.concat(F.when(p % 5 == 1, "Figure ").otherwise("Part "), p.cast("string"))
    content = F.when(p % 5 == 2, F.concat(F.lit("figure "), p.cast("string"), F.lit(". "), "line")).when(p % 5 == 3, F.concat(F.lit("Table "), p.cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    docs = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", title.alias("t"), content.alias("c")))).alias("s"))
    rest, figures, tables = S.demuxed(F.transform("s", lambda x: S.section(x["t"], x["c"])))
    told = lambda cs: F.transform(cs, lambda c: F.array_join(c["captions"], "/"))
    out = docs.select("doc_id", rest.alias("r"), figures.alias("f"), tables.alias("t"))
    n = lambda c: F.size(c).cast("long")
    return out.select("doc_id", n("r").alias("n_sections"), n("f").alias("n_figures"), n("t").alias("n_tables"), F.md5(F.array_join(F.concat(told(F.col("f")), told(F.col("t"))), "|")).alias("captions"))


_QUANTITIES = "(SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS q FROM lineitem GROUP BY l_orderkey)"


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("q"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["q"]), " ").alias("q"))


@query(
    f"""SELECT l_orderkey, (len(regexp_extract_all(q, '(?:^|\\s)-?\\d+\\.?\\d*\\s+-?\\d+\\.?\\d*\\s+-?\\d+\\.?\\d*')) >= 5
      OR regexp_matches(q, '\\d+\\s+\\d+\\s+\\d+\\s+\\d+\\s+\\d+')) AS is_chart FROM {_QUANTITIES}"""
)
def chart_axis_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).select("l_orderkey", X.has_chart_data(F.col("q")).alias("is_chart"))


_CHART = """(SELECT doc_id, text || chr(10) || '1 2.5 -3 4 5 6 7 8' || chr(10) || 'an axis of numbers from here on: 1 2 3 4 5 6 and more words' AS c FROM documents WHERE text IS NOT NULL)"""
_LETTERS = "len(regexp_extract_all({}, '[a-zA-Z]'))"


@query(
    f"""WITH t AS (SELECT doc_id, c, list_filter(list_transform(string_split(c, chr(10)), lambda l: {strip_sql("l")}),
        lambda l: {_LETTERS.format("l")} > len(regexp_extract_all(l, '[0-9.*-]')) AND length(l) > 30 AND NOT regexp_matches(l, '(?i)vs\\s+expression|Relative\\s+\\*|\\d+\\.\\d+\\s+\\d+\\.\\d+')) AS kept FROM {_CHART})
    SELECT doc_id, md5({strip_sql("regexp_replace(regexp_replace(array_to_string(kept, ' '), '(?:\\s+-?\\d+\\.?\\d*){5,}', '', 'g'), '\\s{2,}', ' ', 'g')")}) AS digest FROM t"""
)
def chart_axis_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.lit("\n1 2.5 -3 4 5 6 7 8\nan axis of numbers from here on: 1 2 3 4 5 6 and more words")
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("c", F.concat("text", more))
    return docs.select("doc_id", F.md5(X.clean_chart_data(F.col("c"))).alias("digest"))


_W = r"[\p{L}\p{N}_]"


@query(
    f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Results' WHEN 1 THEN 'Key Findings' ELSE 'Methods' END AS title,
        CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '| n |' WHEN 1 THEN 'Row 12 ' || text ELSE text END AS c FROM documents WHERE text IS NOT NULL),
    u AS (SELECT *, {strip_sql("string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1]")} AS f,
        regexp_matches(c, '(?i)Reason\\s+Participant\\s*\\(n=\\d+\\)|Column\\s+\\d+|Row\\s+\\d+|\\|\\s*{_W}+\\s*\\||{_W}\\s+{_W}+\\s+\\n{_W}+\\s+{_W}+\\s') AS hit FROM t)
    SELECT doc_id, hit AS is_table, md5(CASE WHEN hit AND (title LIKE '%Results%' OR title LIKE '%Findings%') AND length(f) > 20 AND NOT regexp_matches(f, '^(Reason|Participant|Example)') THEN f ELSE c END) AS digest FROM u"""
)
def table_data_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, "Results").when(k % 3 == 1, "Key Findings").otherwise("Methods")
    c = F.when(k % 4 == 0, F.concat("text", F.lit("\n| n |"))).when(k % 4 == 1, F.concat(F.lit("Row 12 "), "text")).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", title.alias("title"), c.alias("c"))
    return docs.select("doc_id", X.has_table_data(F.col("c")).alias("is_table"), F.md5(X.clean_table_data(F.col("c"), F.col("title"))).alias("digest"))


@query(f"SELECT doc_id, count(*) AS kept, sum(length({strip_sql('line')}))::BIGINT AS n_chars FROM {LINES} WHERE length({strip_sql('line')}) > 10 GROUP BY doc_id")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("c", X.strip(F.col("line"))).filter(F.length("c") > 10)
    return rows.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("c")).cast("long").alias("n_chars"))


@query(
    f"""WITH t AS (SELECT source, doc_id, left(lower({strip_sql("text")}), 200) AS k FROM documents WHERE text IS NOT NULL),
    u AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS n FROM t) SELECT source, doc_id FROM u WHERE n = 1 OR k = ''"""
)
def section_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", "doc_id", S.section_key(F.col("text")).alias("k"))
    return S.dedup_rows(rows, "source", "doc_id", "k").select("source", "doc_id")


@query(
    """WITH t AS (SELECT event_id, event_type AS e, (event_id % 11)::VARCHAR AS n FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Fig ' || n || '/' || e || '|Other' WHEN 1 THEN 'Fig ' || n WHEN 2 THEN 'one ' || n || '/ten/two' ELSE '' END AS captions FROM t"""
)
def caption_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.col("event_id") % 4
    n, e = (F.col("event_id") % 11).cast("string"), F.col("event_type")
    new = F.concat(F.lit('[{"captions":[" Fig '), n, F.lit(' ",5,"'), e, F.lit('",{"x":1},null," "]},{"captions":["FIG '), n, F.lit('","again"]},{"captions":[]},{"captions":["Other"]}]'))
    wrapped = F.concat(F.lit('{"captions":[{"captionParts":["Fig '), n, F.lit('"]},7,{"captionParts":["  "]}]}'))
    oldest = F.concat(F.lit('[{"caption3":7,"caption2":"two","caption10":" ten ","caption4":["x"],"caption1":"one '), n, F.lit('","id":"x"}]'))
    json = F.when(shape == 0, new).when(shape == 1, wrapped).when(shape == 2, oldest).otherwise('"none"')
    out = table(spark, sf_dir, "events").select("event_id", C.from_shapes(json).alias("c"))
    return out.select("event_id", F.array_join(F.transform("c", lambda x: F.array_join(x["captions"], "/")), "|").alias("captions"))


_ITEMS = "(SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS item FROM benchmark)"


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM benchmark), t AS (SELECT doc_id, item, CASE WHEN doc_id % 2 = 0 OR length(item) <= 130 THEN text || ' ' || item || ' tail of it.' ELSE text || ' ' || left(item, 110) || '#. tail of it.' END AS c
        FROM documents, n JOIN {_ITEMS} ON item_id = doc_id % n WHERE text IS NOT NULL),
    u AS (SELECT doc_id, c, item, CASE WHEN contains(c, item) THEN {strip_sql("replace(c, item, '')")} WHEN contains(c, left(item, 100)) THEN
        {strip_sql('''left(c, strpos(c, left(item, 100)) - 1) || CASE
          WHEN strpos(a, chr(10) || chr(10)) > 0 THEN substr(a, strpos(a, chr(10) || chr(10)) + 2) WHEN strpos(a, chr(10)) > 0 THEN substr(a, strpos(a, chr(10)) + 1)
          WHEN strpos(a, '. ') > 0 THEN substr(a, strpos(a, '. ') + 2) WHEN strpos(a, '.') > 0 THEN substr(a, strpos(a, '.') + 1) ELSE '' END''')} END AS d
        FROM (SELECT *, substr(c, strpos(c, left(item, 100)) + 100) AS a FROM t))
    SELECT doc_id, md5({strip_sql("regexp_replace(regexp_replace(d, '(?m)^\\s*[A-Z]\\s+[A-Z](?:\\s+[A-Z])*\\s*$', '', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')")}) AS digest, length(d) AS n_chars FROM u"""
)
def caption_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"(?U)\s+", " ").alias("item"))
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").join(F.broadcast(n))  # one row
    both = docs.withColumn("item_id", F.col("doc_id") % F.col("n")).join(items, "item_id")
    whole = (F.col("doc_id") % 2 == 0) | (F.length("item") <= 130)  # short items have no beginning to be known by
    content = F.when(whole, F.concat("text", F.lit(" "), "item", F.lit(" tail of it."))).otherwise(F.concat("text", F.lit(" "), F.left("item", F.lit(110)), F.lit("#. tail of it.")))
    out = both.select("doc_id", content.alias("c"), F.array("item").alias("parts"))
    return out.select("doc_id", F.md5(S.without_captions(F.col("c"), F.col("parts"))).alias("digest"), F.length(S.without_caption(F.col("c"), F.get("parts", F.lit(0)))).cast("long").alias("n_chars"))


@query("SELECT event_id, props AS body FROM events WHERE props IS NOT NULL")
def json_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    fenced = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit(" "), "props", F.lit(" ")))
    return table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_id", X.strip(R.unfenced(fenced)).alias("body"))


@query("SELECT event_id, '[' || props || ', {\"a\":[1,2]}]' AS body FROM events WHERE props IS NOT NULL")
def json_trailing_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("["), "props", F.lit(', {"a":[1,2 , ]}'.replace("2 , ]", "2,\n ]")), F.lit(",]"))
    return table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_id", R.drop_trailing_commas(broken).alias("body"))


@query("""SELECT event_id, '{"a":"' || (event_id % 97) || ' pc/\\" wide","b":"(' || (event_id % 13) || ' xy/\\")"}' AS body FROM events""")
def json_unit_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit('{"a":"'), (F.col("event_id") % 97).cast("string"), F.lit(' pc/" wide","b":"('), (F.col("event_id") % 13).cast("string"), F.lit(' xy/")"}'))
    return table(spark, sf_dir, "events").select("event_id", R.escape_unit_quotes(broken).alias("body"))


def _corrupted() -> Column:
    """Each class of damage; the sixth can't be repaired."""
    k, n = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    return (
        F.when(k == 0, F.concat(F.lit("Sure! ```json\n"), "props", F.lit("\n``` bye")))
        .when(k == 1, F.concat(F.lit('{"k":'), n, F.lit(',"l":[1,2,],}')))
        .when(k == 2, F.concat(F.lit('{"k":'), n, F.lit(',"l":["a","b"')))
        .when(k == 3, F.concat(F.lit('{"k":'), n, F.lit(',"s":"5 pc/" wide"}')))
        .when(k == 4, F.concat(F.lit('{"s":"line\nbreak \\u12","k":'), n, F.lit("} trailing {")))
        .otherwise(F.concat(F.lit('{"k":'), n, F.lit(',"s":[{"a":"cut')))
    )


def _odd_answers() -> Column:
    """Damage, and answers that parse but are odd: half of a surrogate pair, an object that looks like an error of the parser."""
    k, n = F.col("event_id") % 8, F.get_json_object("props", "$.k")
    return (
        F.when(k == 6, F.concat(F.lit('{"k":'), n, F.lit(',"s":"cut \\ud83d"}')))
        .when(k == 7, F.concat(F.lit('{"error":1,"raw":2,"k":'), n, F.lit("}")))
        .otherwise(_corrupted())
    )


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 8 >= 6 OR event_id % 6 <> 5) AS parsed, sum(CASE WHEN event_id % 8 >= 6 OR event_id % 6 <> 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END)::BIGINT AS sum_k
    FROM events WHERE props IS NOT NULL GROUP BY event_type"""
)
def json_robust_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_type", R.parse_json(_odd_answers()).alias("r"))
    k = F.get_json_object("r.value", "$.k").cast("long")
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.count("r.value").alias("parsed"), F.sum(k).alias("sum_k"))


@query("SELECT event_id, event_id % 6 IN (2, 4, 5) AS is_truncated FROM events WHERE props IS NOT NULL")
def truncation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_id", X.is_truncated(_corrupted()).alias("is_truncated"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN 1 WHEN event_id % 12 = 5 THEN 2 ELSE 3 END::INT AS rung, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL"""
)
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = lambda rung: F.concat(F.regexp_replace("props", r"}\s*$", ""), F.lit(f',"rung":{rung}}}'))
    second = F.when(F.col("event_id") % 12 == 5, later(2)).otherwise("no object")
    return _laddered(table(spark, sf_dir, "events").filter("props IS NOT NULL"), _corrupted(), second, later(3))


def _laddered(rows: DataFrame, *answers: Column) -> DataFrame:
    """event_id, rung, k of what a generator that gives these answers in turn leads to."""

    def generate(prompt: Column, tokens: int) -> Column:
        turn = F.when(prompt.startswith(SHORT_PROMPT), 2).otherwise(F.lit(int(tokens == RETRY_TOKENS)))
        return F.get(F.split(F.substring_index(prompt, TEXT_MARK, -1), "\x01"), turn)

    GENERATORS["in turn"] = generate
    try:
        done = structure(rows.select("event_id", F.concat_ws("\x01", *answers).alias("text")), "in turn", finish=False)
    finally:
        del GENERATORS["in turn"]
    at = lambda path: F.get_json_object("document", path)
    return done.select("event_id", F.coalesce(at("$.rung").cast("int"), F.lit(1)).alias("rung"), at("$.k").cast("long").alias("k"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 < 4 THEN 1 WHEN event_id % 12 IN (4, 5) THEN 2 ELSE 3 END::INT AS rung, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL"""
)
def structure_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also answers that parse, but say that they are errors."""
    later = lambda rung: F.concat(F.regexp_replace("props", r"}\s*$", ""), F.lit(f',"rung":{rung}}}'))
    k = F.col("event_id")
    first = F.when(k % 6 == 4, '{"error":"busy"}').otherwise(_corrupted())
    second = F.when((k % 12).isin(4, 5), later(2)).when(k % 6 == 4, '{"error":"busy again","k":0}').otherwise("no object")
    return _laddered(table(spark, sf_dir, "events").filter("props IS NOT NULL"), first, second, later(3))


def alnum_sql(x: str) -> str:
    """Words of ASCII letters and digits of a Latin text, glued where a comma stood."""
    return f"lower({strip_sql(f'''regexp_replace(regexp_replace(strip_accents(replace(replace({x}, 'ß', ''), ', ', '')), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')''')})"


@query(f"SELECT doc_id, md5({alnum_sql('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.md5(X.alphanumeric(X.normalize(F.col("text")))).alias("digest"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a benchmark item as its reference."""
    items = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", F.col("text").alias("reference"))
    n = items.agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").join(F.broadcast(n))  # one row
    return docs.withColumn("item_id", F.col("doc_id") % F.col("n")).join(items, "item_id").select("doc_id", "source", F.col("text").alias("generated"), "reference")


_PAIRS = "(SELECT doc_id, source, d.text AS generated, b.text AS reference FROM documents d, (SELECT count(*) AS n FROM benchmark) JOIN benchmark b ON b.item_id = d.doc_id % n WHERE d.text IS NOT NULL)"
_WORDS = f"""(SELECT doc_id, source, list_distinct(list_filter(string_split({alnum_sql("generated")}, ' '), lambda w: w <> '')) AS g,
    list_distinct(list_filter(string_split({alnum_sql("reference")}, ' '), lambda w: w <> '')) AS r FROM {_PAIRS})"""


@query(f"SELECT doc_id, len(list_intersect(g, r))::BIGINT AS n_common, len(r)::BIGINT AS n_reference, len(list_intersect(g, r)) / greatest(len(r), 1)::DOUBLE AS word_capture FROM {_WORDS}")
def word_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _pairs(spark, sf_dir).select("doc_id", X.normalize(F.col("generated")).alias("g"), X.normalize(F.col("reference")).alias("r")).select("doc_id", X.word_set(F.col("g")).alias("g"), X.word_set(F.col("r")).alias("r"))
    return words.select("doc_id", F.size(F.array_intersect("g", "r")).cast("long").alias("n_common"), F.size("r").cast("long").alias("n_reference"), K.word_capture(F.col("g"), F.col("r")).alias("word_capture"))


_NUMBERS = """(SELECT doc_id, source, list_filter(list_distinct(regexp_extract_all(g, '\\d+\\.?\\d*')), lambda n: contains(n, '.') OR n::DOUBLE < 1000 OR (n::DOUBLE < 100000 AND NOT n::DOUBLE BETWEEN 2010 AND 2030)) AS g,
    list_filter(list_distinct(regexp_extract_all(r, '\\d+\\.?\\d*')), lambda n: contains(n, '.') OR n::DOUBLE < 1000 OR (n::DOUBLE < 100000 AND NOT n::DOUBLE BETWEEN 2010 AND 2030)) AS r
  FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'n=' || doc_id % 89 || ' p=0.' || doc_id % 7 || ' in 2015 and 2005. ' || doc_id * 10 END AS r, 'about ' || doc_id % 83 || ', 0.' || doc_id % 5 || ' (' || doc_id * 10 || ')' AS g FROM documents))"""


@query(f"SELECT doc_id, len(list_intersect(g, r))::BIGINT AS n_common, len(r)::BIGINT AS n_reference, CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(g, r)) / len(r)::DOUBLE END::DOUBLE AS number_capture FROM {_NUMBERS}")
def number_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    r = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("n="), s(k % 89), F.lit(" p=0."), s(k % 7), F.lit(" in 2015 and 2005. "), s(k * 10)))
    g = F.concat(F.lit("about "), s(k % 83), F.lit(", 0."), s(k % 5), F.lit(" ("), s(k * 10), F.lit(")"))
    sets = table(spark, sf_dir, "documents").select("doc_id", X.number_set(g).alias("g"), X.number_set(r).alias("r"))
    return sets.select("doc_id", F.size(F.array_intersect("g", "r")).cast("long").alias("n_common"), F.size("r").cast("long").alias("n_reference"), K.number_capture(F.col("g"), F.col("r")).alias("number_capture"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select("doc_id", rouge_counts(X.normalize(F.col("reference")), X.normalize(F.col("generated"))).alias("c"))
    p, r = F.col("c.lcs") / F.greatest("c.n_generated", F.lit(1)), F.col("c.lcs") / F.greatest("c.n_reference", F.lit(1))
    return pairs.select("doc_id", "c.*", F.when(F.col("c.lcs") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("rouge_l"))


@query(
    """SELECT c_custkey, ((CASE WHEN c_custkey <> 0 THEN 1 ELSE 0 END) + (CASE WHEN c_name <> '' THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END)
    + (CASE WHEN c_nationkey <> 0 THEN 2 ELSE 1 END) + 1 + 2)::BIGINT AS n_fields FROM customer"""
)
def field_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    doc = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"name":"'), "c_name", F.lit('","note":'), F.when(k % 3 == 0, "[]").otherwise('"x"'), F.lit(',"nation":{"key":'), F.col("c_nationkey").cast("string"), F.lit(',"none":null},"list":[{"a":1,"b":""},[{"c":true}]],"zero":0}'))
    return table(spark, sf_dir, "customer").select("c_custkey", K.facets(doc)["fields"].alias("n_fields"))


_REPORT = f"""(SELECT w.doc_id, w.source, len(list_intersect(w.g, w.r)) / greatest(len(w.r), 1)::DOUBLE AS word_capture,
    CASE WHEN len(n.r) = 0 THEN 1.0 ELSE len(list_intersect(n.g, n.r)) / len(n.r)::DOUBLE END AS number_capture FROM {_WORDS} w JOIN {_NUMBERS} n USING (doc_id))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_capture(spark, sf_dir).select("doc_id", "word_capture").join(number_capture(spark, sf_dir).select("doc_id", "number_capture"), "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query(f"SELECT doc_id, word_capture, number_capture, (word_capture >= 0.25 AND number_capture >= 0.75) AS passes FROM {_REPORT}")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures that SQL has; the others count as passed, and the limit of words is set to where these tables differ."""
    word = F.when(F.col("word_capture") >= 0.25, 1.0).otherwise(0.0)
    return _report(spark, sf_dir).select("doc_id", "word_capture", "number_capture", K.passes(word, F.lit(1.0), F.col("number_capture"), F.lit(1.0)).alias("passes"))


@query(
    f"""SELECT source, count(*) AS documents, count(*) FILTER (number_capture >= 0.75) AS passed, sum(round(word_capture * 1000000)::BIGINT)::BIGINT AS word_millionths FROM {_REPORT} GROUP BY source"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = K.passes(F.lit(1.0), F.lit(1.0), F.col("number_capture"), F.lit(1.0))
    return _report(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(ok).alias("passed"), F.sum(F.round(F.col("word_capture") * 1000000).cast("long")).alias("word_millionths"))


@query(
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey % 5 = 0 THEN 'name:empty_string' END, CASE WHEN n_name IS NULL OR c_custkey % 7 = 0 THEN 'nation:missing_required' END,
      CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment:invalid_enum' END) AS warnings
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def validate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    name = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    nation = F.when(F.col("c_custkey") % 7 != 0, F.col("n_name"))
    checks = [
        (name == "", "name", "empty_string", "Field 'name' has empty string value"),
        (nation.isNull(), "nation", "missing_required", "Missing required field(s) at 'nation': name"),
        (~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "segment", "invalid_enum", "Invalid value at 'segment'"),
    ]
    told = F.transform(V.rule_warnings(checks), lambda w: F.concat(w["field"], F.lit(":"), w["issue"]))
    return both.select("c_custkey", F.array_join(told, ";").alias("warnings"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, 'en' AS language, CASE WHEN event_id % 2 = 0 THEN '1.0' ELSE '' END AS version,
    CASE WHEN event_id % 2 = 0 THEN 'language,domain' ELSE 'language,version,domain' END AS filled_fields FROM events WHERE props IS NOT NULL"""
)
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.regexp_replace("props", r"}\s*$", ""), F.lit(',"version":"1.0"}'))).otherwise(F.col("props"))
    defaults = {"language": "en", "version": "", "domain": ""}
    rows = table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_id", V.filled(doc, defaults).alias("m"), V.missing_fields(doc, list(defaults)).alias("f"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["language"].alias("language"), F.col("m")["version"].alias("version"), F.array_join("f", ",").alias("filled_fields"))


@query(
    """SELECT o_orderkey, CASE WHEN count(l_orderkey) > 1 THEN '["' || string_agg(l_shipmode, '","' ORDER BY l_linenumber, l_partkey, l_shipmode) || '"]' WHEN count(l_orderkey) = 1 THEN max(l_shipmode) END AS size, max(o_orderpriority) AS license
    FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("v"))
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["v"]).alias("sizes"))
    both = table(spark, sf_dir, "orders").join(sizes, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.select("o_orderkey", M.size_text(F.col("sizes")).alias("size"), F.col("o_orderpriority").alias("license"))


@query(
    f"""SELECT conv_id, coalesce(arg_min({strip_sql("text")}, turn) FILTER (role = 'user' AND text <> ''), '') AS title,
      coalesce(nullif(arg_min({strip_sql("text")}, turn) FILTER (role = 'system' AND text <> ''), ''), nullif(arg_min({strip_sql("text")}, turn) FILTER (text <> ''), ''), '') AS description
    FROM conversations GROUP BY conv_id"""
)
def title_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    titles = F.transform(F.filter("t", lambda x: x["role"] == "user"), lambda x: F.struct(x["text"].alias("title")))
    descriptions = F.transform("t", lambda x: F.struct(x["text"].alias("description"), F.when(x["role"] == "system", " Abstract ").otherwise("Other").alias("descriptionType")))
    none = F.array().cast(S.SECTIONS)
    return rows.select("conv_id", M.title_of(titles).alias("title"), M.description_of(descriptions, none).alias("description"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("posterId"), F.when(s == "O", J.PENDING).when(s == "P", J.PROCESSING).otherwise(J.COMPLETED).alias("status"),
        (s == "F").alias("completed"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("updated"), F.lit(None).cast("string").alias("error"),
    )


NOW = "2026-01-01 00:00:00"
_JOBS = "(SELECT o_orderkey AS id, o_custkey AS posterId, CASE o_orderstatus WHEN 'O' THEN 'pending-extraction' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderstatus = 'F' AS completed, o_orderdate AS created FROM orders)"


@query(f"SELECT id, posterId FROM {_JOBS} WHERE NOT completed AND status = 'pending-extraction' ORDER BY created, id LIMIT 1")
def claim_next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_job(_jobs(spark, sf_dir)).select("id", "posterId")


_LIMIT = "1995-06-17 00:05:00"


@query(f"SELECT id, CASE WHEN status = 'processing' AND created < TIMESTAMP '{_LIMIT}' - INTERVAL 5 MINUTE THEN 'failed' ELSE status END AS status, completed OR (status = 'processing' AND created < TIMESTAMP '{_LIMIT}' - INTERVAL 5 MINUTE) AS completed FROM {_JOBS}")
def expire_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expire_stuck(_jobs(spark, sf_dir), F.lit(_LIMIT).cast("timestamp")).select("id", "status", "completed")


@query(f"SELECT id, CASE WHEN status = 'processing' THEN CASE WHEN id % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE status END AS status, CASE WHEN status = 'processing' AND id % 2 = 1 THEN repeat('e', 10000) END AS error FROM {_JOBS}")
def mark_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, now = _jobs(spark, sf_dir), F.lit(NOW).cast("timestamp")
    mine = F.col("status") == J.PROCESSING
    failed = J.mark_failed(jobs, mine & (F.col("id") % 2 == 1), F.repeat(F.lit("e"), 10_500), now)
    return J.mark_completed(failed, mine & (F.col("id") % 2 == 0), now).select("id", "status", "error")


@query(
    """SELECT coalesce(c_custkey, k) AS posterId, CASE WHEN k IS NOT NULL THEN total ELSE c_nationkey END AS doi, CASE WHEN k IS NULL THEN c_mktsegment END AS domain, k IS NOT NULL AS was_updated
    FROM (SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer) FULL JOIN (SELECT o_custkey + 7 AS k, count(*) AS total FROM orders GROUP BY o_custkey) ON c_custkey = k"""
)
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = F.lit("2020-01-01").cast("timestamp"), F.lit(NOW).cast("timestamp")
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("posterId"), F.col("c_nationkey").cast("long").alias("doi"), F.col("c_mktsegment").alias("domain"), old.alias("created"), old.alias("updated"))
    source = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 7).alias("posterId")).agg(F.count("*").alias("doi"))
    return J.upsert(target, source, "posterId", now).select("posterId", "doi", "domain", (F.col("updated") == now).alias("was_updated"))


@query(
    """SELECT m.posterId, m.doi, coalesce(s_name, m.domain) AS domain, m.was_updated OR s_name IS NOT NULL AS was_updated FROM (
      SELECT coalesce(c_custkey, k) AS posterId, CASE WHEN k IS NOT NULL THEN total ELSE c_nationkey END AS doi, CASE WHEN k IS NULL THEN c_mktsegment END AS domain, k IS NOT NULL AS was_updated
      FROM (SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer) FULL JOIN (SELECT o_custkey + 7 AS k, count(*) AS total FROM orders GROUP BY o_custkey) ON c_custkey = k
    ) m LEFT JOIN supplier ON s_suppkey = m.posterId"""
)
def keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets: created, an upsert, then an update of one column."""
    old, now = F.lit("2020-01-01").cast("timestamp"), F.lit(NOW).cast("timestamp")
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("posterId"), F.col("c_nationkey").cast("long").alias("doi"), F.col("c_mktsegment").alias("domain"), old.alias("created"), old.alias("updated"))
    kept = KeyedTable(spark, shared_folder(spark, "keyed-table"), target.schema, "posterId", buckets=32).create(target)
    kept.upsert(table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 7).alias("posterId")).agg(F.count("*").alias("doi")), now)
    kept.update(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("posterId"), F.col("s_name").alias("domain")), ["domain"], now)
    return kept.rows().select("posterId", "doi", "domain", (F.col("updated") == now).alias("was_updated"))


@query(
    f"""SELECT doc_id, md5(coalesce(string_agg(array_to_string(w, ' '), chr(10) ORDER BY pos) FILTER (len(w) > 0), '')) AS digest
    FROM (SELECT doc_id, pos, regexp_extract_all(line, '[A-Za-z0-9]+') AS w FROM {LINES}) GROUP BY doc_id"""
)
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all("line", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit('<String HPOS="1" CONTENT="'), w, F.lit('"/><SP/>')))
    blocks = lines(spark, sf_dir).select("doc_id", F.struct("pos", F.concat(F.lit("<TextBlock ID='b'><TextLine>"), F.array_join(words, ""), F.lit("</TextLine></TextBlock>")).alias("b")).alias("b"))
    xml = blocks.groupBy("doc_id").agg(F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Page>'), F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["b"]), "\n"), F.lit("</Page></alto>")).alias("xml"))
    return xml.select("doc_id", F.md5(markup.alto_text(F.col("xml"))).alias("digest"))


@query(
    """SELECT page_id, len(t)::BIGINT AS n, md5(array_to_string(t, chr(10))) AS digest FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<(?:h1|p|li)[^>]*>((?:<[ab][^>]*>)?[^<]*)', 1),
      lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '') AS t FROM pages)"""
)
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", markup.html_lines(F.col("html")).alias("t"))
    return pages.select("page_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "\n")).alias("digest"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN length(text) > 500 THEN 'layout' ELSE 'plain' END WHEN 1 THEN CASE WHEN length(text) > 500 THEN 'ocr_cached' ELSE 'ocr' END
      WHEN 2 THEN 'ocr' WHEN 3 THEN 'plain' ELSE 'unknown' END AS source,
      CASE doc_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 1 THEN CASE WHEN length(text) > 500 THEN length(text) ELSE 3 END ELSE CASE WHEN length(text) > 500 THEN length(text) ELSE 5 END END::BIGINT AS n_chars
    FROM documents WHERE text IS NOT NULL"""
)
def extractor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    path = F.concat(F.lit("/a.b/"), F.col("doc_id").cast("string"), F.when(k == 0, ".PDF").when(k == 1, ".jpeg").when(k == 2, ".png").when(k == 3, ".pdf").otherwise(".txt"))
    layout, cached = F.when(k == 0, F.col("text")), F.when(k == 1, F.col("text"))
    text, source = files.route(path, layout, F.lit("plain"), F.lit("ocr"), cached)
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", source.alias("source"), F.length(text).cast("long").alias("n_chars"))


@query(
    """SELECT doc_id::VARCHAR AS poster_id, 'in/' || doc_id || '/a.' || CASE WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 3 = 1 THEN 'jpg' ELSE 'png' END AS poster, 'in/' || doc_id || '/x_sub-json.json' AS annotation
    FROM documents JOIN labels USING (doc_id)"""
)
def pair_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have an annotation; pdf, jpg, png are there for ids of remainder 0, of 1 and below, all."""
    folder = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("/"))
    kinds = F.filter(F.array(F.struct(F.lit("a.png").alias("n"), F.lit(2).alias("k")), F.struct(F.lit("a.jpg").alias("n"), F.lit(1).alias("k")), F.struct(F.lit("a.pdf").alias("n"), F.lit(0).alias("k"))), lambda x: x["k"] >= F.col("doc_id") % 3)
    posters = table(spark, sf_dir, "documents").select(F.explode(F.transform(kinds, lambda x: F.concat(folder, x["n"]))).alias("path"))
    notes = table(spark, sf_dir, "labels").select(F.explode(F.array(F.concat(folder, F.lit("x_sub-json.json")), F.concat(folder, F.lit("y.json")))).alias("path"))
    return files.annotation_pairs(posters.unionByName(notes))


@query()
def structure_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through prompt, generator and parser; the rule-based generator."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", R.parse_json(GENERATORS["rules"](F.concat(F.lit(PROMPT), "text"), 1)).alias("r"))
    return docs.select("doc_id", F.get_json_object("r.value", "$.titles[0].title").alias("title"), F.length("r.value").cast("long").alias("n_chars"))


def poster_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, sections, imageCaptions, tableCaptions: lines as sections, and a benchmark item as caption."""
    docs = _pairs(spark, sf_dir)
    parts = F.transform(F.split("generated", "\n"), lambda x, i: S.section(F.concat(F.lit("Part "), (i + 1).cast("string")), x))
    caption = F.array(F.struct(F.array("reference").alias("captions")))
    return docs.select("doc_id", "source", "reference", parts.alias("sections"), caption.alias("imageCaptions"), F.array().cast(S.CAPTIONS).alias("tableCaptions"))


@query()
def postprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = postprocess(poster_sections(spark, sf_dir))
    text = F.array_join(F.transform("sections", lambda s: s["sectionContent"]), "\n")
    return done.select("doc_id", F.size("sections").cast("long").alias("n_sections"), F.size("imageCaptions").cast("long").alias("n_captions"), F.md5(text).alias("digest"))


@query()
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents to sections, cleaned, deduplicated, without captions; scored against their references; a row for each source."""
    done = postprocess(poster_sections(spark, sf_dir))
    text = F.array_join(F.transform("sections", lambda s: s["sectionContent"]), "\n")
    sets = done.select("source", F.size("sections").alias("n"), X.word_set(X.normalize(text)).alias("g"), X.word_set(X.normalize(F.col("reference"))).alias("r"))
    scored = sets.select("source", "n", K.word_capture(F.col("g"), F.col("r")).alias("word_capture"))
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("sections"), F.avg("word_capture").alias("mean_word_capture"), F.count_if(F.col("word_capture") >= 0.25).alias("passed"))
