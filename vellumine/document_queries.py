"""Registered queries over whole documents: validation, mapping, scores, post-processing, jobs and extraction as a caller uses
them, each with its SQL. The documents are made of rows of the driver's tables by fixed rules, the same in both dialects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.functions.rouge import rouge_counts
from vellumine.operators import jobs as J
from vellumine.operators import mapping as M
from vellumine.operators import rule_checks as R
from vellumine.operators import metrics as K
from vellumine.operators import validation as V
from vellumine.operators.documents import postprocess_json
from vellumine.queries import _JOBS, NOW, _jobs, lines, query, table
from vellumine.sources import files, objects
from vellumine.session import shared_folder
from vellumine.streaming import jobs as stream
from vellumine.streaming import keyed_jobs as keyed


def _join(*parts: Column | str) -> Column:
    """Texts one after another; strings are constants."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    """WITH t AS (SELECT c_custkey AS k, (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT AS told, (c_custkey % 7 = 0)::INT AS silent, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 5 END AS absent FROM customer)
    SELECT k AS c_custkey, CASE WHEN k % 13 <> 0 THEN told + silent + absent = 0 END AS valid, CASE WHEN k % 13 <> 0 THEN told + silent + absent END::BIGINT AS errors_count,
      CASE WHEN k % 13 <> 0 THEN told + absent END::BIGINT AS warnings_count, CASE WHEN k % 13 = 0 THEN 0 ELSE 23 - (k % 2 = 0)::INT - (5 - absent) END::BIGINT AS n_filled,
      CASE WHEN k % 13 = 0 THEN '' ELSE concat_ws(';', CASE WHEN k % 3 = 0 THEN 'creators:empty_required_array' END, CASE WHEN k % 5 = 0 THEN 'titles.0.title:empty_string' END,
        CASE WHEN absent > 0 THEN 'root:missing_required;root:missing_required;root:missing_required;root:missing_required;root:missing_required' END) END AS issues,
      CASE WHEN k % 13 <> 0 AND k % 2 = 1 THEN 'en' END AS language FROM t"""
)
def validate_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rest = ',"subjects":[{"subject":"s"}],"descriptions":[{"description":"d","descriptionType":"Other"}],"publisher":{"name":"p"},"conference":{"conferenceName":"c","conferenceYear":2020},"formats":["PDF"]'
    doc = _join(
        '{"creators":', F.when(k % 3 == 0, "[]").otherwise(_join('[{"name":"', F.col("c_name"), '"}]')), ',"titles":[{"title":"', F.when(k % 5 == 0, "").otherwise(F.col("c_name")), '"}],"publicationYear":',
        F.when(k % 7 == 0, 1800).otherwise(2000 + k % 50), F.when(k % 2 == 0, ',"language":null').otherwise(""), F.when(k % 11 == 0, rest).otherwise(""), "}",
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", V.validate(F.when(k % 13 == 0, '{"error":"e"}').otherwise(doc)).alias("v"))
    told = F.transform("v.warnings", lambda w: F.concat_ws(":", w["field"], w["issue"]))
    count = lambda c: F.col(f"v.{c}").cast("long").alias(c)
    return rows.select("c_custkey", "v.valid", count("errors_count"), count("warnings_count"), F.size("v.filled_fields").cast("long").alias("n_filled"), F.array_join(told, ";").alias("issues"), F.get_json_object("v.document", "$.language").alias("language"))


@query(
    """SELECT o_orderkey, CASE WHEN count(l_orderkey) > 1 THEN '["' || string_agg(v, '", "' ORDER BY l_linenumber, l_partkey, v) || '"]' WHEN count(l_orderkey) = 1 THEN max(v) END AS size, 'PDF' AS format,
      '[{"identifier": "' || o_orderkey || '"}]' AS identifiers, 1990 + o_orderkey % 30 AS publicationYear, max(o_orderpriority) AS conferenceName, '{"subject": "s"}' AS subject, NULL::VARCHAR AS domain
    FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus AS v FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def metadata_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("v"))
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["v"]).alias("sizes"))
    both = table(spark, sf_dir, "orders").join(sizes, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k = F.col("o_orderkey")
    doc = _join('{"identifiers":[{"identifier":"', k, '"}],"sizes":', F.to_json(F.coalesce("sizes", F.array().cast("array<string>"))), ',"formats":["PDF"],"publicationYear":', 1990 + k % 30, ',"conference":{"name":"', F.col("o_orderpriority"), '"},"subjects":[{"subject":"s"}],"_x":1,"raw":"r"}')
    rows = both.select("o_orderkey", M.metadata_row(doc).alias("m"))
    return rows.select("o_orderkey", "m.size", "m.format", "m.identifiers", "m.publicationYear", "m.conferenceName", F.get("m.subjects", F.lit(0)).alias("subject"), "m.domain")


#: Of ten tokens the generated side has the first n, forwards or backwards; lengths of common subsequences follow.
_SCORES = """(SELECT doc_id, n, m, (n + 1) / 11.0::DOUBLE AS word_capture, n / 10.0::DOUBLE AS number_capture, m / 4.0::DOUBLE AS field_proportion,
    greatest(2 * (l1 / (n + 1.0::DOUBLE)) * (l1 / 11.0::DOUBLE) / (l1 / (n + 1.0::DOUBLE) + l1 / 11.0::DOUBLE), 2 * (l2 / n::DOUBLE) * (l2 / 10.0::DOUBLE) / (l2 / n::DOUBLE + l2 / 10.0::DOUBLE)) AS rouge_l
  FROM (SELECT doc_id, doc_id % 10 + 1 AS n, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 4 END AS m, CASE WHEN doc_id % 4 = 1 THEN 2 ELSE doc_id % 10 + 2 END AS l1, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE doc_id % 10 + 1 END AS l2 FROM documents))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    every = F.transform(F.sequence(F.lit(0), (k % 10).cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string")))
    said = F.array_join(F.when(k % 4 == 1, F.reverse(every)).otherwise(every), " ")
    doc = lambda text, more: _join('{"posterContent":{"sections":[{"sectionTitle":"T","sectionContent":"', text, '"}]}', more, "}")
    whole = F.lit(" ".join(f"a{i}" for i in range(10)))
    pairs = table(spark, sf_dir, "documents").select("doc_id", doc(said, F.when(k % 3 == 0, ',"n":7').otherwise("")).alias("generated"), doc(whole, "").alias("reference"))
    return K.score(pairs, "doc_id")


@query(
    f"""SELECT doc_id, word_capture, rouge_l, number_capture, field_proportion, 1::BIGINT AS gen_sections, 1::BIGINT AS ref_sections,
      word_capture >= 0.75 AND rouge_l >= 0.75 AND number_capture >= 0.75 AND field_proportion BETWEEN 0.5 AND 2 AS passes FROM {_SCORES}"""
)
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("gen_sections", "ref_sections")})


@query(
    f"""SELECT count(*) AS documents, count(*) AS scored, round(avg(word_capture), 6) AS mean_word_capture, round(avg(rouge_l), 6) AS mean_rouge_l, round(avg(number_capture), 6) AS mean_number_capture,
      round(avg(field_proportion), 6) AS mean_field_proportion, count(*) FILTER (word_capture >= 0.75 AND rouge_l >= 0.75 AND number_capture >= 0.75) AS passed, 0::BIGINT AS errors,
      round(100.0::DOUBLE * count(*) FILTER (word_capture >= 0.75 AND rouge_l >= 0.75 AND number_capture >= 0.75) / count(*), 6) AS pass_percent FROM {_SCORES}"""
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = K.summary(_scored(spark, sf_dir).withColumn("is_error", F.lit(False)))
    return one.select(*[F.round(c, 6).alias(c) if c.startswith("mean") or c == "pass_percent" else F.col(c) for c in one.columns])


@query(
    """SELECT doc_id, 'Intro/A long enough text number ' || doc_id || ' with  inside.' || CASE WHEN doc_id % 2 = 1 THEN '|Part/Second part of document ' || doc_id || ' stays.' ELSE '' END AS sections,
      'Old ' || doc_id || '|Figure 1/CAPTION TEXT' AS captions, 'd e' AS domain, doc_id % 2 = 0 AS has_schema FROM documents"""
)
def postprocess_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as lists and strings, captions of old shape, sections that repeat, are figures or too short."""
    k = F.col("doc_id")
    section = lambda title, content: f'{{"sectionTitle":"{title}","sectionContent":{content}}}'
    parts = [
        _join('{"sectionTitle":"In\u200btro","sectionContent":["A long enough text number ', k, '","with CAPTION TEXT inside."]}'),
        _join('{"sectionTitle":"Again","sectionContent":"a LONG enough text number ', k, ' with caption text inside."}'),
        F.lit(section("Figure 1", '"CAPTION TEXT"')), F.lit(section("Short", '"tiny"')), F.lit(section("Same", '"Same"')), F.lit(section("Number", "7")), F.lit('"junk"'),
    ]
    second = F.when(k % 2 == 1, _join(',{"sectionTitle":"Part","sectionContent":"Second part of document ', k, ' stays."}')).otherwise("")
    doc = _join("{", F.when(k % 2 == 0, '"$schema":"own",').otherwise(""), '"posterContent":{"sections":[', F.concat_ws(",", *parts), second, ']},"imageCaption":[{"caption1":"Old ', k, '","caption2":7}],"domain":"d  e"}')
    done = postprocess_json(table(spark, sf_dir, "documents").select("doc_id", doc.alias("document")))
    told = F.from_json("document", "struct<`$schema`:string,posterContent:struct<sections:array<struct<sectionTitle:string,sectionContent:string>>>,imageCaptions:array<struct<captions:array<string>>>,domain:string>")
    rows = done.select("doc_id", told.alias("d"))
    sections = F.transform("d.posterContent.sections", lambda s: F.concat_ws("/", s["sectionTitle"], s["sectionContent"]))
    return rows.select("doc_id", F.array_join(sections, "|").alias("sections"), F.array_join(F.transform("d.imageCaptions", lambda c: F.array_join(c["captions"], "/")), "|").alias("captions"), "d.domain", (F.col("d.`$schema`") == "own").alias("has_schema"))


@query(
    """SELECT doc_id, count(*) FILTER (line <> '') + 2 AS n, md5(coalesce(string_agg(line || chr(10), '' ORDER BY pos) FILTER (line <> ''), '') || 'caption ' || doc_id || chr(10) || 'old') AS digest
    FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id"""
)
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    sections = F.transform("l", lambda x: F.struct(F.lit("T").alias("sectionTitle"), x["line"].alias("sectionContent")))
    caption = F.array(F.struct(F.array(_join("caption ", F.col("doc_id")), F.lit("")).alias("captions")))
    old = F.array(F.struct(F.lit("old").alias("caption1")))
    doc = F.to_json(F.struct(F.struct(sections.alias("sections")).alias("posterContent"), caption.alias("imageCaptions"), old.alias("tableCaption")))
    rows = each.select("doc_id", K.facets(doc)["sections"].alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query(f"SELECT id, CASE WHEN n <= 5 AND NOT completed AND status = 'pending-extraction' THEN 'processing' ELSE status END AS status, n <= 5 AND NOT completed AND status = 'pending-extraction' AS was_claimed FROM (SELECT *, row_number() OVER (PARTITION BY NOT completed AND status = 'pending-extraction' ORDER BY created, id) AS n FROM {_JOBS})")
def claim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return J.claim(_jobs(spark, sf_dir), now, 5).select("id", "status", (F.col("updated") == now).alias("was_claimed"))


@query(
    """SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 4 WHEN 2 THEN 'completed' WHEN 0 THEN 'completed' ELSE 'failed' END AS status,
      CASE c_custkey % 4 WHEN 1 THEN 'Job stuck in processing for over 5 minutes; marked failed by cleanup' WHEN 3 THEN 'broken' END AS error, CASE WHEN c_custkey % 4 = 0 THEN 'IN/' || c_custkey END AS title FROM customer"""
)
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting, stuck, finished and hopeless jobs arrive as files, some of them twice; the stream works on what is there."""
    folder, k = shared_folder(spark, "jobs"), F.col("c_custkey")
    status = F.when(k % 4 == 1, J.PROCESSING).when(k % 4 == 2, J.COMPLETED).otherwise(J.PENDING)
    path = F.concat(F.when(k % 4 == 3, "bad/").otherwise("in/"), k.cast("string"))
    jobs = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), k.alias("posterId"), path.alias("filePath"), status.alias("status"), (status == J.COMPLETED).alias("completed"), F.lit("2024-01-01T11:00:00").alias("created"), F.lit("2024-01-01T11:00:00").alias("updated"))
    jobs.unionByName(jobs.filter(k % 10 == 0)).write.json(f"{folder}/in")

    def work(taken: DataFrame) -> DataFrame:
        return taken.select("id", F.when(F.col("filePath").startswith("bad"), "broken").alias("error"), F.upper("filePath").alias("title"))

    stream.run(spark, f"{folder}/in", f"{folder}/state", work, F.lit("2024-01-01 12:00:00").cast("timestamp")).awaitTermination()
    titles = spark.read.schema("id string, title string").parquet(f"{folder}/state/done/0")
    return spark.read.schema(stream.JOBS).parquet(f"{folder}/state/jobs/0").join(titles, "id", "left").select("id", "status", "error", "title")


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN length(text) > 500 THEN 'layout' ELSE 'plain' END WHEN 1 THEN CASE WHEN length(text) > 500 THEN 'ocr_cached' ELSE 'ocr' END
      WHEN 2 THEN 'ocr' WHEN 3 THEN 'plain' ELSE 'unknown' END AS source,
      CASE doc_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 1 THEN CASE WHEN length(text) > 500 THEN length(text) ELSE 3 END ELSE CASE WHEN length(text) > 500 THEN length(text) ELSE 5 END END::BIGINT AS n_chars
    FROM documents WHERE text IS NOT NULL"""
)
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (path, content) through registered tools and an earlier run's texts."""
    docs, k = table(spark, sf_dir, "documents").filter("text IS NOT NULL"), F.col("doc_id") % 5
    path = F.concat(F.lit("/a.b/"), F.col("doc_id").cast("string"), F.when(k == 0, ".PDF").when(k == 1, ".jpeg").when(k == 2, ".png").when(k == 3, ".pdf").otherwise(".txt"))
    before = dict(files.EXTRACTORS)
    files.EXTRACTORS.update(layout=lambda p, content: content.decode() if p.endswith(".PDF") else None, plain=lambda p, content: "plain", ocr=lambda p, content: "ocr")
    try:
        got = files.extract(docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")), docs.filter(k == 1).select(path.alias("path"), "text"))
    finally:
        files.EXTRACTORS.clear()
        files.EXTRACTORS.update(before)
    return got.select(F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "source", F.length("text").cast("long").alias("n_chars"))


_SHORT = "list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: left(w, 3))"


@query(
    f"""WITH RECURSIVE b AS (SELECT item_id, {_SHORT.format("strip_accents(text)")} AS w FROM benchmark WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM b),
    p AS (SELECT a.item_id, a.w AS g, b.w AS r FROM b AS a, n JOIN b ON b.item_id = (a.item_id + 1) % n),
    l AS (SELECT item_id, g, r, 0 AS i, list_transform(range(len(g) + 1), lambda x: 0) AS row FROM p
      UNION ALL SELECT item_id, g, r, i + 1, list_transform(range(1, len(g) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND g[k - 1] = r[i + 1] THEN greatest(row[k], row[k - 1] + 1) ELSE row[k] END))) FROM l WHERE i < len(r))
    SELECT item_id, row[len(g) + 1]::BIGINT AS lcs, len(r)::BIGINT AS n_reference, len(g)::BIGINT AS n_generated FROM l WHERE i = len(r)"""
)
def rouge_l_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the next ones, words cut to three letters, which have no stems."""
    short = F.array_join(F.transform(F.regexp_extract_all(F.lower(F.regexp_replace(X.normalize(F.col("text"), False), r"\p{M}+", "")), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.left(w, F.lit(3))), " ")
    items = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", short.alias("t"))
    n = items.agg(F.count("*").alias("n"))
    asked = items.join(F.broadcast(n)).select("item_id", F.col("t").alias("g"), ((F.col("item_id") + 1) % F.col("n")).alias("next"))  # n is one row
    pairs = asked.join(items.select(F.col("item_id").alias("next"), F.col("t").alias("r")), "next")
    return pairs.select("item_id", rouge_counts("r", "g").alias("c")).select("item_id", "c.*")


@query(
    """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 IN (0, 2) OR c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'completed' WHEN c_custkey % 4 = 1 AND c_custkey % 7 = 0 THEN 'processing' ELSE 'failed' END AS status,
      CASE WHEN c_custkey % 4 = 3 THEN 'broken' WHEN c_custkey % 4 = 1 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 'Job stuck in processing for over 5 minutes; marked failed by cleanup' END AS error,
      CASE WHEN c_custkey % 4 = 0 THEN 'IN/' || c_custkey END AS title FROM customer"""
)
def keyed_job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs an hour apart, the second from the first one's checkpoint: most jobs arrive in the first, the rest, repeats and
    the ends of some jobs that others work on in the second, when jobs that nobody ended expire."""
    folder, k = shared_folder(spark, "keyed-jobs"), F.col("c_custkey")
    status = F.when(k % 4 == 1, J.PROCESSING).when(k % 4 == 2, J.COMPLETED).otherwise(J.PENDING)
    path = F.concat(F.when(k % 4 == 3, "bad/").otherwise("in/"), k.cast("string"))
    updated = F.when(k % 7 == 0, "2024-01-01T11:57:00").otherwise("2024-01-01T11:00:00")
    jobs = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), k.alias("posterId"), path.alias("filePath"), status.alias("status"), (status == J.COMPLETED).alias("completed"), F.lit("2024-01-01T11:00:00").alias("created"), updated.alias("updated"))
    k = F.col("posterId")
    late, repeated = jobs.filter(k % 7 == 0), jobs.filter(k % 10 == 0)
    ends = jobs.filter((k % 4 == 1) & (k % 3 == 0)).withColumns({"status": F.lit(J.COMPLETED), "completed": F.lit(True), "updated": F.lit("2024-01-01T11:58:00")})

    def work(taken: DataFrame) -> DataFrame:
        return taken.select("id", F.when(F.col("filePath").startswith("bad"), "broken").alias("error"), F.upper("filePath").alias("title"))

    for wave, hour in ((jobs.filter(k % 7 != 0), 11), (late.unionByName(repeated).unionByName(ends), 12)):
        wave.write.mode("append").json(f"{folder}/in")
        events = spark.readStream.schema(stream.JOBS).json(f"{folder}/in")
        keyed.run(spark, events, f"{folder}/state", work, F.lit(f"2024-01-01 {hour}:00:00").cast("timestamp")).awaitTermination()
    titles = spark.read.schema("id string, title string").parquet(f"{folder}/state/results")
    return keyed.current(spark, f"{folder}/state").join(titles, "id", "left").select("id", "status", "error", "title")


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n_chars, lang, source, NULL::VARCHAR AS missing FROM documents UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'objects/none.json'")
def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored objects of JSON lines: tasks read the manifests and what they list; an object that isn't there is a row with its error."""
    folder = shared_folder(spark, "stored")
    folder = folder if ":" in folder else f"file://{folder}"
    table(spark, sf_dir, "documents").write.option("maxRecordsPerFile", 2000).json(f"{folder}/objects")
    spark.read.format("binaryFile").load(f"{folder}/objects/*.json").select(F.regexp_extract("path", "objects/[^/]+$", 0)).write.text(f"{folder}/lists")
    lists = [f"lists/{p.rsplit('/', 1)[1]}" for p in spark.read.text(f"{folder}/lists").inputFiles()]  # names of manifests, not of objects
    objects.register(spark)
    got = spark.read.format("objects").options(base=folder, manifests=json.dumps(lists), paths='["objects/none.json"]').load()
    row = F.from_json("line", "doc_id bigint, text string, lang string, source string")
    lines_ = got.filter("error IS NULL").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).filter("line <> ''").select(row.alias("d"))
    docs = lines_.select("d.doc_id", F.md5("d.text").alias("digest"), F.length("d.text").cast("long").alias("n_chars"), "d.lang", "d.source", F.lit(None).cast("string").alias("missing"))
    absent = got.filter("error IS NOT NULL").select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[:-1]], F.col("path").alias("missing"))
    return docs.unionByName(absent)


_KINDS = "('Abstract', 'Methods', 'SeriesInformation', 'TableOfContents', 'TechnicalInfo', 'Other')"


@query(
    f"""WITH t AS (SELECT doc_id, text, lang AS l, source AS s, n_chars AS n, CASE WHEN doc_id % 2 = 0 THEN 'Abstract' ELSE lang END AS kind, doc_id % 17 = 0 OR doc_id % 19 = 0 AS bad FROM documents),
    e AS (SELECT *, (text IS NULL)::INT + (kind IS NULL)::INT AS gone, (n < 1900)::INT + (n > 2100)::INT AS far FROM t),
    w AS (SELECT doc_id, bad, coalesce(2 * far, 0) + (s IS NULL)::INT AS silent, list_concat(
      CASE WHEN s = '' THEN ['creators.0.name:empty_string'] ELSE [] END, CASE WHEN l NOT IN ('Personal', 'Organizational') THEN ['creators.0.nameType:invalid_enum'] ELSE [] END,
      CASE WHEN s IS NULL THEN ['creators.0:missing_required'] ELSE [] END, CASE WHEN text = '' THEN ['titles.0.title:empty_string'] WHEN text IS NULL THEN ['titles.0:missing_required'] ELSE [] END,
      CASE WHEN text = '' THEN ['descriptions.0.description:empty_string'] ELSE [] END, CASE WHEN kind NOT IN {_KINDS} THEN ['descriptions.0.descriptionType:invalid_enum'] ELSE [] END,
      list_transform(range(gone), lambda x: 'descriptions.0:missing_required'), CASE WHEN l = '' THEN ['publisher.name:empty_string'] WHEN l IS NULL THEN ['publisher:missing_required'] ELSE [] END,
      CASE WHEN n IS NULL THEN ['conference:missing_required'] ELSE [] END, CASE WHEN s = '' THEN ['formats.0:empty_string'] ELSE [] END,
      CASE WHEN n IS NULL THEN ['root:missing_required', 'root:missing_required'] ELSE ['root:missing_required'] END) AS told FROM e)
    SELECT doc_id, NOT bad AS judged, CASE WHEN NOT bad THEN (silent + len(told))::BIGINT END AS errors_count, CASE WHEN NOT bad THEN len(told)::BIGINT END AS warnings_count,
      CASE WHEN bad THEN '' ELSE array_to_string(told, ';') END AS issues FROM w"""
)
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with whole texts as titles and descriptions; some are cut or no objects."""
    k, one = F.col("doc_id"), lambda **c: F.array(F.struct(*[v.alias(n) for n, v in c.items()]))
    kind = F.when(k % 2 == 0, "Abstract").otherwise(F.col("lang"))
    doc = F.to_json(
        F.struct(
            one(name=F.col("source"), nameType=F.col("lang")).alias("creators"), one(title=F.col("text")).alias("titles"), F.col("n_chars").alias("publicationYear"),
            one(description=F.col("text"), descriptionType=kind).alias("descriptions"), F.struct(F.col("lang").alias("name")).alias("publisher"),
            F.struct(F.lit("c").alias("conferenceName"), F.col("n_chars").alias("conferenceYear")).alias("conference"), F.array_compact(F.array("source")).alias("formats"),
        )
    )
    given = F.when(k % 17 == 0, F.left(doc, F.length(doc) - 1)).when(k % 19 == 0, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
    rows = table(spark, sf_dir, "documents").select("doc_id", R.checks(given).alias("c"))
    told = F.transform("c.warnings", lambda w: F.concat_ws(":", w["field"], w["issue"]))
    return rows.select("doc_id", F.col("c.errors_count").isNotNull().alias("judged"), *[F.col(f"c.{c}").cast("long").alias(c) for c in ("errors_count", "warnings_count")], F.array_join(told, ";").alias("issues"))
