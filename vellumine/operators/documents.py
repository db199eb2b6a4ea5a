"""Post-processing of whole documents, as typed columns and as JSON text."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.functions.json_repair import dumped, storable
from vellumine.functions.udf import add_column
from vellumine.operators import captions as C
from vellumine.operators import sections as S
from vellumine.schema import SCHEMA_URL

#: What the flow takes out of a document: everything whose shape varies becomes text of its own.
_PARTS = "struct<is_list:boolean,sections:array<struct<sectionTitle:string,sectionContent:string>>,image:string,table:string,image_old:string,table_old:string>"


def _told(content: object) -> str:
    return " ".join(map(str, content)) if isinstance(content, list) else content if isinstance(content, str) else ""


def document_parts(documents: list[str | None]) -> list[dict]:
    """Sections with content as text (lists joined by spaces, else empty), and captions of any shape as JSON text."""
    rows = []
    for d in documents:
        doc = json.loads(d) if d else {}
        content = doc.get("posterContent")
        listed = content.get("sections", []) if isinstance(content, dict) else None
        some = [{"sectionTitle": storable(_told(s.get("sectionTitle", ""))), "sectionContent": storable(_told(s.get("sectionContent", "")))} for s in listed if isinstance(s, dict)] if isinstance(listed, list) else []
        shapes = [dumped(doc[k]) if doc.get(k) else None for k in ("imageCaptions", "tableCaptions", "imageCaption", "tableCaption")]
        rows.append(dict(zip(("is_list", "sections", "image", "table", "image_old", "table_old"), (isinstance(listed, list), some, *shapes), strict=True)))
    return rows


def postprocess(df: DataFrame, sections: str = "sections", image: str = "imageCaptions", table: str = "tableCaptions") -> DataFrame:
    """Typed form: replaces the three columns. Each step is a column of its own, so that none is computed twice."""
    rest, figures, tables = S.demuxed(F.col("__clean"))
    staged = df.withColumn("__clean", S.cleaned(F.col(sections)))
    staged = staged.withColumns({"__rest": rest, "__figures": figures, "__tables": tables}).drop("__clean")
    none = F.array().cast(S.CAPTIONS)
    unicode_clean = lambda cs: F.transform(cs, lambda c: F.struct(F.transform(c["captions"], X.clean_unicode).alias("captions")))
    staged = staged.withColumns({"__kept": S.deduplicated(S.tidied(F.col("__rest")))} | {c: C.normalized(F.concat(F.coalesce(F.col(c), none), F.col(x))) for c, x in ((image, "__figures"), (table, "__tables"))})
    staged = staged.withColumns({c: unicode_clean(F.col(c)) for c in (image, table)})
    once = S.remove_caption_text(F.col("__kept"), F.col(image))
    staged = staged.withColumn("__once", once)
    return staged.withColumn(sections, S.remove_caption_text(F.col("__once"), F.col(table))).drop("__rest", "__figures", "__tables", "__kept", "__once")


def _assembled(documents: list[str | None], parts: list[dict], url: str) -> list[str]:
    """The document with its new parts, the schema stamp and cleaned names."""
    out = []
    for d, p in zip(documents, parts, strict=True):
        doc = json.loads(d) if d else {}
        doc.setdefault("$schema", url)
        for key in ("imageCaption", "tableCaption"):
            doc.pop(key, None)
        doc["imageCaptions"], doc["tableCaptions"] = json.loads(p["image"]), json.loads(p["table"])
        content = doc.get("posterContent")
        for holder, key in ((doc, "posterTitle"), (doc, "domain"), (content, "posterTitle")):
            if isinstance(holder, dict) and isinstance(holder.get(key), str):
                holder[key] = cleaned_text(holder[key])
        if p["is_list"] and isinstance(content, dict):
            content["sections"] = json.loads(p["sections"])
        for key, field in (("creators", "name"), ("titles", "title")):
            for item in doc[key] if isinstance(doc.get(key), list) else ():
                if isinstance(item, dict) and isinstance(item.get(field), str):
                    item[field] = cleaned_text(item[field])
        out.append(dumped(doc))
    return out


def cleaned_text(s: str) -> str:
    """What text.clean_unicode does, for names within a JSON document."""
    return re.sub(" {2,}", " ", re.sub(X.ODD_SPACES, " ", re.sub(X.INVISIBLE, "", s))).strip()


def postprocess_json(df: DataFrame, column: str = "document", schema_url: str = SCHEMA_URL) -> DataFrame:
    """JSON form, any shape of captions and contents: the column's documents in their final form. Error objects get their stamp and captions too."""
    parts = add_column(df, "__p", _PARTS, document_parts, column)
    joined = lambda new, old: F.concat(C.from_shapes(F.coalesce(F.col(f"__p.{new}"), F.lit("[]"))), C.from_shapes(F.coalesce(F.col(f"__p.{old}"), F.lit("[]"))))
    typed = parts.withColumns({"__s": F.col("__p.sections"), "__i0": joined("image", "image_old"), "__t0": joined("table", "table_old")}).withColumns({"__i": F.col("__i0"), "__t": F.col("__t0")})
    done = postprocess(typed, "__s", "__i", "__t")
    listed = F.col("__p.is_list")
    new = F.struct(listed.alias("is_list"), F.to_json("__s").alias("sections"), F.to_json(F.when(listed, F.col("__i")).otherwise(F.col("__i0"))).alias("image"), F.to_json(F.when(listed, F.col("__t")).otherwise(F.col("__t0"))).alias("table"))
    return add_column(done.select(*df.columns, new.alias("__new")), column, "string", lambda ds, ps: _assembled(ds, ps, schema_url), column, "__new").select(*df.columns)
