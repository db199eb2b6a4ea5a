"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base. Four kinds (email, ip, card, phone) by pattern, left to right without overlap within a kind; what fails its check
(parts of an ip, Luhn, numbers of digits) is dropped. Places come from the text itself: each match is set between
marks, the text is split at the marks, and the lengths of the parts are summed over the matches of a document in a window, so
that many matches cost no more than their number. A mark that stands in the text is swapped for another private-use
character first, so no place moves. Quantifiers are possessive wherever giving back could not help, so that no text
takes more than linear time.

Seeds. Base spans, whole, are seed entities of their kinds. A fifth kind, secret, has seeds that are named as such (a value
assigned to one of `SECRET_NAMES`) or have a published key format; these are added spans themselves.

Method. Instances are seeds and runs of identifier-like words (with a digit or @) beside them. An instance's patterns are
lexical: the one, two or three words before it, glued or not, the word behind it, and one on each side. Seeds induce the
graph of patterns and instances. In each round a pattern's confidence in a kind is the mean score of its instances in
that kind (with one failure added), and an instance that isn't a seed scores 1 - the product of (1 - confidence) over
its patterns. Patterns of high confidence with enough different seeds then mark the instances in them that no
base pattern knows. Edges are aggregated before they are joined; only the accepted patterns meet occurrences again.

Defined results: a null or empty text has no spans. Repeated rows each keep their own spans: rows carry a number of
their own within the operator. Tables may be empty. Places are code points, ends exclusive. Contexts are whole words,
whatever their length; beyond 64 characters a word or value is known by its hash. One document's matches are one
window, so they meet in one task: a few dozen bytes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.bind import let
from vellumine.llm.common import written

KINDS = ("email", "ip", "card", "phone")
SECRET, LIKELY = 4, 5
NAMES = (*KINDS, "secret")
_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
#: What secrets are called where they are assigned.
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth_key", "private_key")
#: The kinds as Java patterns that find the same matches as the greedy ones, from the first character of a run on.
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: A value of eight characters or more behind a name, and keys that begin with four fixed letters. Only the groups but the first are the match.
SECRETS = rf"((?i:{'|'.join(SECRET_NAMES)})[\"']?[ ]?[:=][ ]?[\"']?)([A-Za-z0-9_+/-]{{8,}}+)|(?<![A-Za-z0-9])(AKIA[0-9A-Z]{{16}})(?![A-Za-z0-9])"
_MARK, _SWAP = "\ue000", "\ue001"
_EDGE = r"\s\"'<>()\[\],;:="
#: A whole word with a digit or @; no sign that ends a sentence ends it.
_WORD = rf"(?<![^{_EDGE}])(?=[^{_EDGE}0-9@]*+[0-9@])[^{_EDGE}]*[^{_EDGE}.!?]"
#: As matches are told: kind, number within the kind, characters before it since the last one, its own, its value, whether it counts, contexts.
_CUT = "array<struct<kind:int,i:int,gap:int,size:int,value:string,ok:boolean,left:string,right:string>>"
SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at matches: elements 1, 3, 5... (from 0) are matches."""
    marked = f"$1{_MARK}$2$3{_MARK}" if pattern == SECRETS else f"{_MARK}$0{_MARK}"
    return F.split(F.regexp_replace(F.translate(text, _MARK, _SWAP), pattern, marked), _MARK)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (d.cast("int") * (1 + i % 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: int, c: Column) -> Column:
    if kind in (0, SECRET, LIKELY):
        return F.lit(True)
    if kind == 1:
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(c, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    n = F.length(_digits(c))
    if kind == 3:
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(c))).otherwise(False)


def _known(c: Column) -> Column:
    """A text, or the hash of a long one."""
    return F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c)


def _left(before: Column) -> Column:
    """Up to three words at the end of a text, single spaces between and behind them as they stand: read from the end, so that it takes no longer than they are."""
    tail = F.reverse(F.regexp_extract(F.reverse(before), r"^\s*+(?:\S++(?:\s++|$)){0,3}", 0))
    return F.ltrim(F.lower(F.regexp_replace(tail, r"\s+", " ")))


def _right(after: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(after, r"^\s*+\S*+", 0), r"\s+", " "))


def _cuts(text: Column, pattern: str, kind: int) -> Column:
    def told_(parts: Column, i: Column) -> Column:
        before, match, after = (F.get(parts, 2 * i + k) for k in range(3))
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(before).alias("gap"), F.length(match).alias("size"), _known(F.lower(match)).alias("value"),
            F.coalesce(_valid(kind, match), F.lit(False)).alias("ok"), _left(before).alias("left"), _right(after).alias("right"),
        )

    def each(parts: Column) -> Column:
        n = F.floor(F.size(parts) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: told_(parts, i)))

    return let(_parts(text, pattern), each).cast(_CUT)


def _matches(text: Column) -> Column:
    """Matches of all kinds, those that don't count too. What a kind cannot do without is looked for first."""
    none = F.array().cast(_CUT)
    digits = text.rlike("[0-9]")
    may = [text.contains("@"), digits & text.contains("."), digits, digits & text.contains("+"), text.rlike("[:=]") | text.contains("AKIA"), digits | text.contains("@")]
    patterns = (*PATTERNS, SECRETS, _WORD)
    return F.concat(*[F.when(m, F.coalesce(_cuts(text, p, k), none)).otherwise(none) for k, (p, m) in enumerate(zip(patterns, may, strict=True))])


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def placed(rows: DataFrame) -> DataFrame:
    """row, kind, start, stop, value, left, right of the matches that count. rows: row, found (of _matches)."""
    each = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    return each.withColumn("stop", stop).filter("ok").select("row", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", "value", "left", "right")


def instances(found: DataFrame) -> DataFrame:
    """row, start, stop, value, left, right, seed: seeds with their kind, and runs of identifier-like words, one space apart, that no seed touches, with null."""
    by_start = Window.partitionBy("row").orderBy("start")
    seed = F.col("kind") < LIKELY
    before = F.max(F.when(seed, F.col("stop"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # From the end, as a frame that ends at the last row is worked out anew for each row.
    from_end = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = F.min(F.when(seed, F.col("start"))).over(from_end)
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("stop"), F.lit(False))
    free = found.withColumn("touched", touched).filter(seed | ~F.col("touched")).drop("touched")
    fresh = free.filter(~seed)
    new = F.coalesce(F.lag("stop").over(by_start) + 1 != F.col("start"), F.lit(True))
    runs = fresh.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = F.array_sort(F.collect_list(F.struct("start", "value")))
    joined = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.transform(words, lambda w: w["value"]), " ").alias("value"), F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"))
    columns = ("row", "start", "stop", "value", "left", "right")
    seeds = free.filter(seed).select(*columns, F.col("kind").alias("seed"))
    return seeds.unionByName(joined.select(*columns, F.lit(None).cast("int").alias("seed")))


def patterns_of(left: Column, right: Column) -> Column:
    """array<string> of an instance's patterns: L with one, two and three words, R with one, B with one on each side. What isn't there gives none."""
    last = lambda n: F.regexp_extract(left, r"(?:^|(?<= ))\S+(?: \S+){%d} ?$" % (n - 1), 0)
    tell = lambda kind, *words: F.when(F.forall(F.array(*words), lambda w: w != ""), F.concat_ws("|", F.lit(kind), *map(_known, words)))
    return F.array_compact(F.array(tell("L1", last(1)), tell("L2", last(2)), tell("L3", last(3)), tell("R1", right), tell("B", last(1), right)))


def score_patterns(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """pattern, kind, confidence, seeds. edges: pattern, value, seed (a kind, or null), distinct."""
    n = range(len(NAMES))
    names = [f"s{k}" for k in n]
    seeds = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    scores = seeds.select("value", *[F.coalesce((F.col("seed") == k).cast("double"), F.lit(0.0)).alias(f"s{k}") for k in n])
    links = edges.select("pattern", "value").distinct()
    for turn in range(rounds):
        graph = links.join(scores, "value")
        confidence = graph.groupBy("pattern").agg(*[(F.sum(x) / (F.count("*") + 1)).alias(x) for x in names], *[F.count_if(F.col(x) == 1.0).alias(f"n{x}") for x in names])
        if turn < rounds - 1:
            strong = [F.when(F.col(x) >= 0.5, F.least(F.col(x), F.lit(0.999))).otherwise(0.0).alias(x) for x in names]
            sure = confidence.select("pattern", *strong).filter(" OR ".join(f"{x} > 0" for x in names))
            spread = links.join(sure, "pattern").groupBy("value").agg(*[(1 - F.exp(F.sum(F.log1p(-F.col(x))))).alias(f"t{x}") for x in names])
            own = seeds.join(spread, "value", "left")
            # Between the rounds one row for each value is written, which cuts the lineage.
            scores = written(own.select("value", *[F.when(F.col("seed").isNotNull(), (F.col("seed") == k).cast("double")).otherwise(F.coalesce(F.col(f"ts{k}"), F.lit(0.0))).alias(f"s{k}") for k in n]), "pii-scores")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("confidence"), F.col(f"ns{k}").alias("seeds")) for k in n]))
    return confidence.select("pattern", each.alias("x")).select("pattern", "x.*")


def find_pii(docs: DataFrame, least_confidence: float = 0.8, least_seeds: int = 8, rounds: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, added, spans (both, in order): arrays of struct<start, kind, stop>, for each document. kind: place in NAMES."""
    body = F.coalesce(F.col("__vq_text"), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("__vq_text")).select("doc_id", _matches(body).alias("found"))
    rows = written(one.select(F.monotonically_increasing_id().alias("row"), "doc_id", "found"), "pii-rows")
    found = written(placed(rows.select("row", "found")), "pii-spans")
    known = written(instances(found), "pii-instances")
    linked = known.withColumn("pattern", F.explode(patterns_of(F.col("left"), F.col("right"))))
    edges = written(linked.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    trusted = score_patterns(edges, rounds).filter((F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds))
    # A pattern is trusted for one kind: two shares of at least 0.8 can't both be.
    trusted = written(trusted.select("pattern", "kind", "confidence"), "pii-patterns")
    hits = linked.filter("seed IS NULL").join(trusted, "pattern").groupBy("row", "start", "stop").agg(F.min_by("kind", F.struct(-F.col("confidence"), F.col("kind"))).alias("kind"))
    span = F.struct("start", "kind", "stop")
    mine = found.filter(F.col("kind") < LIKELY).select("row", span.alias("s"), (F.col("kind") >= SECRET).alias("more")).unionByName(hits.select("row", span.alias("s"), F.lit(True).alias("more")))
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("s"))))
    spans = mine.groupBy("row").agg(listed(~F.col("more")).alias("base"), listed(F.col("more")).alias("added"), listed(F.lit(True)).alias("spans"))
    empty = F.array().cast(SPANS)
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", *[F.coalesce(c, empty).alias(c) for c in ("base", "added", "spans")])
