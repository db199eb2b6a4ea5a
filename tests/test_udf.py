"""Arrow functions: what a worker holds at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from vellumine.functions import udf
from vellumine.functions.json_repair import attempt, parse_json
from vellumine.functions.text import nfkd
from vellumine.session import BATCH_BYTES
from vellumine.sources.markup import _alto


def test_long_texts_are_python_values_by_slices():
    told = []

    def size(texts):
        told.append((len(texts), sum(len(t or "") for t in texts)))
        return [(len(t or ""), [t]) for t in texts]

    texts = ["a" * 5000, None, "é" * 300] * 2000 + ["b" * (3 << 20), "c"]
    kind = pa.struct([("n", pa.int64()), ("t", pa.list_(pa.string()))])
    got = udf._sliced(size, kind, (pa.array(texts, pa.string()),)).to_pylist()
    assert [(x["n"], x["t"]) for x in got] == [(len(t or ""), [t]) for t in texts]
    assert all(n <= udf.ROWS and (size_ <= 2 * udf.BYTES or n == 1) for n, size_ in told)
    assert udf._sliced(size, kind, (pa.array([], pa.string()),)).to_pylist() == []


def test_a_worker_gets_batches_of_bounded_bytes(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    sizes = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("t")).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long")
    seen = [r.n for r in sizes.collect()]
    assert len(seen) > 3 and max(seen) < 2 * BATCH_BYTES


def test_functions_of_several_columns_keep_nulls(spark):
    df = spark.createDataFrame([("ﬁn", None), (None, "é")], "a string, b string").select(nfkd("a").alias("a"), nfkd("b").alias("b"), parse_json("a").alias("r"))
    assert [(x.a, x.b, x.r.value) for x in df.collect()] == [("fin", None, None), (None, "é", None)]


def test_repairs_that_change_nothing_are_not_parsed_again(monkeypatch):
    from vellumine.functions import json_repair

    texts = []
    load = json_repair.json.loads
    monkeypatch.setattr(json_repair.json, "loads", lambda s: texts.append(s) or load(s))
    assert attempt('{"k":1,"s":[{"a":"cut')[1] == "JSON parse failed"
    assert len(texts) == len(set(texts)) < len(json_repair.LADDER)


def test_alto_of_several_name_spaces_and_nested_blocks():
    xml = '<a xmlns="u" xmlns:p="v"><TextBlock><p:String CONTENT="1"/><String CONTENT="2"/><TextBlock><String CONTENT="3"/><String/></TextBlock></TextBlock><p:TextBlock><String CONTENT="4"/></p:TextBlock></a>'
    assert _alto(xml) == "1 2 3\n3\n4" and _alto("<TextBlock/>") == "" and _alto("<a>") is None and _alto(None) is None
