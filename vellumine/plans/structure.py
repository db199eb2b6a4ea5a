"""From raw text to a structured document: prompt, generator, parse, retries.

A generator is (prompt, most tokens) to text columns. `rules` is a deterministic one without a model: it reads the text
out of the prompt and writes JSON by the headings in it. A model can be registered in its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.json_repair import parse_json
from vellumine.functions.text import is_truncated
from vellumine.functions.udf import arrow
from vellumine.operators.documents import postprocess_json
from vellumine.session import shared_folder

FIRST_TOKENS, RETRY_TOKENS = 18_000, 24_000
#: Headings that begin a section. Fixed values.
HEADINGS = """abstract|introduction|background|methods|methodology|materials and methods|results|key findings|findings|discussion|conclusion|conclusions|
discussion/conclusions|references|acknowledgements|acknowledgments|contact|funding""".replace("\n", "").split("|")
TEXT_MARK = "TEXT:\n"
#: What a model is asked for; the text goes behind the mark.
PROMPT = f"""Turn the poster text below into one JSON object with the keys creators, titles, posterContent.sections, imageCaptions and tableCaptions.
Give every heading a section of its own ({", ".join(HEADINGS)}), with sectionTitle and sectionContent, and copy the text word for word.
Findings are results; references are numbered citations. Captions of figures and tables go into their lists.
Answer with JSON only.
{TEXT_MARK}"""
SHORT_PROMPT = f"""Poster text to JSON: creators, titles, posterContent.sections (sectionTitle, sectionContent, word for word), imageCaptions, tableCaptions.
{TEXT_MARK}"""

Generator = Callable[[Column, int], Column]
GENERATORS: dict[str, Generator] = {}


def structured(text: str) -> dict:
    """By rule: the first line is the title, heading lines begin sections, lines that begin like captions are captions."""
    title, sections = "", []
    captions: dict[str, list] = {"figure": [], "table": []}
    for line in (x.strip() for x in text.split("\n")):
        name = re.sub(r"\s*:$", "", line).casefold()
        if not line:
            continue
        if m := re.match(r"(figure|table)\s+\d+", line, re.I):
            captions[m[1].lower()].append({"captions": [line]})
        elif name in HEADINGS:
            sections.append((line.rstrip(": "), []))
        elif not title and not sections:
            title = line
        else:
            if not sections:
                sections.append(("", []))
            sections[-1][1].append(line)
    return {
        "creators": [],
        "titles": [{"title": title}],
        "posterContent": {"sections": [{"sectionTitle": t, "sectionContent": "\n".join(x)} for t, x in sections]},
        "imageCaptions": captions["figure"],
        "tableCaptions": captions["table"],
    }


@arrow("string")
def _by_rule(prompts: list[str | None]) -> list[str]:
    return [json.dumps(structured((p or "").partition(TEXT_MARK)[2]), ensure_ascii=False) for p in prompts]


GENERATORS["rules"] = lambda prompt, most_tokens: _by_rule(prompt)


def attempt(rows: DataFrame, prompt: str, tokens: int, generate: Generator, text: str) -> DataFrame:
    """rows with value, error, raw of one call."""
    asked = rows.withColumn("__r", parse_json(generate(F.concat(F.lit(prompt), F.col(text)), tokens)))
    return asked.withColumns({"value": F.col("__r.value"), "error": F.col("__r.error"), "raw": F.col("__r.raw")}).drop("__r")


def failed() -> Column:
    """What doesn't parse, and objects that say "error" themselves, or whose "raw" looks cut."""
    says = F.array_contains(F.json_object_keys("value"), "error")
    raw = F.coalesce("raw", F.get_json_object("value", "$.raw"), F.lit(""))
    return F.col("error").isNotNull() | F.coalesce(says, F.lit(False)) | is_truncated(raw)


def _rung(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "rung")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def structure(rows: DataFrame, generator: str = "rules", text: str = "text", finish: bool = True, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with document (JSON; error objects where nothing parsed), error (also that which an object names itself).

    Three rungs: the prompt, the prompt with more tokens, the short prompt. Only rows that failed go on to the next
    rung. Each rung's rows are written as a table before they are used, so that a model is asked once for a row and a rung, whatever
    is made of the answers. write: does that; by default into the folder that the cluster shares."""
    keep, generate = write or _rung, GENERATORS[generator]
    names = rows.columns
    done: DataFrame | None = None
    left = rows
    for prompt, tokens in ((PROMPT, FIRST_TOKENS), (PROMPT, RETRY_TOKENS), (SHORT_PROMPT, RETRY_TOKENS)):
        tried = keep(attempt(left.select(*names), prompt, tokens, generate, text))
        last = prompt is SHORT_PROMPT
        good = tried if last else tried.filter(~failed())
        done = good if done is None else done.unionByName(good)
        left = tried.filter(failed())
    told = F.to_json(F.struct("error", "raw"))
    out = done.withColumn("document", F.coalesce("value", told)).withColumn("error", F.coalesce("error", F.get_json_object("value", "$.error"))).drop("value", "raw")
    return postprocess_json(out) if finish else out


def batch_generator(load: Callable[[], Callable[[list[str], int], list[str]]]) -> Generator:
    """A generator of a model: load gives a function of (prompts, most tokens) to answers. A worker loads it once and asks it a batch at a time."""

    def generate(prompt: Column, most_tokens: int) -> Column:
        import pandas as pd  # only models take batches as pandas has them

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for prompts in batches:
                yield pd.Series(model([p or "" for p in prompts], most_tokens), dtype="object")

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string")(prompt)

    return generate
