"""The pipeline's near-duplicate stage against all pairs of a plain version."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import near_copies, simhash, stages


def plain_set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_least(texts):
    """Of each text the first one of its group."""
    sets = [plain_set(t) for t in texts]
    least = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                low, high = sorted((least[i], least[j]))
                least = [low if v == high else v for v in least]
    return least


def changed(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"x{r.random()}"
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    word = lambda: f"w{r.randint(0, 3000)}"
    footer = [word() for _ in range(60)]
    out = []
    for k in range(60):
        base = [word() for _ in range(r.randint(4, 160))] + (footer if k % 3 == 0 else [])
        out.append(base)
        out += [changed(r, base, min(len(base), n)) for n in (1, 2, 3, 4, 5)]
        out.append(base[: len(base) * 8 // 10] + [word() for _ in range(3)])
    out += [footer, changed(r, footer, 1), [], ["one"], ["one"], ["One", "two"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]]
    return [" ".join(x) for x in out]


def test_every_similar_pair_is_found(spark, texts, monkeypatch):
    want = plain_least(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(near_copies, "SLICE", 7)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)  # frequent shingles are known
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 2000)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_the_stage_drops_copies_far_in_bits(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {x.doc_id for x in stages.drop_near_duplicates(spark, docs, "").collect()}
    least = plain_least(texts)
    assert kept == set(least)
    prints = simhash.fingerprints(pa.array(texts))
    assert any(bin(int(prints[i]) ^ int(prints[j])).count("1") > simhash.FAR for j, i in enumerate(least))


def test_a_text_is_shuffled_once_for_a_block(spark, monkeypatch):
    """A group of 80 near copies: 3,160 pairs, but only a few texts go to the tasks that verify."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 3000)}" for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(changed(r, base, 1))) for i in range(80)], "doc_id bigint, text string")
    made = {}
    write = near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name, **o: made.setdefault(name, write(df, name, **o)))
    found = near_copies.similar(docs.select("text"))
    assert made["copies-pairs"].count() == 80 * 79 // 2
    blocks = made["copies-ranges"].select("part", F.floor(F.col("index") / near_copies.BLOCK).alias("n")).distinct().count()
    assert blocks <= 2 + made["copies-ranges"].select("part").distinct().count() and found.count() == 80 * 79 // 2


def test_golay_codewords_lead_the_stage(spark, monkeypatch):
    """A chain of near copies within 4 bits is linked by its Golay codewords alone, verified; the join by shingles adds nothing to it."""
    r = random.Random(7)
    base = [f"w{r.randint(0, 3000)}" for _ in range(400)]
    texts = [" ".join([*base[: 5 * i], f"x{i}", *base[5 * i + 1 :]]) for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (40, " ".join(f"v{i}" for i in range(50)))], "doc_id bigint, text string")
    made = {}
    write = near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name, **o: made.setdefault(name, write(df, name, **o)))
    near_copies._grouped(docs, near_copies.SIMILARITY, near_copies.SHINGLE, "doc_id", "text", None)
    bits = [int(x) for x in simhash.fingerprints(pa.array(texts))]
    links = {(i, j) for i in range(40) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= simhash.FAR}
    assert made["copies-golay-links"].count() == len({i for link in links for i in link}) - 1 > 20
    inside = made["copies-golay-groups"].select("node").union(made["copies-golay-groups"].select("root")).distinct()
    left = made["copies-pairs"]
    assert left.join(inside.select(F.col("node").alias("a")), "a").join(inside.select(F.col("node").alias("b")), "b").count() == 0


def test_what_is_found_does_not_grow_with_the_square(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 3000)}" for _ in range(120)]
    texts = spark.createDataFrame([(" ".join(changed(r, base, 1)),) for _ in range(80)], "text string")
    found = near_copies.similar(texts, groups=spark.createDataFrame([], "node bigint, root bigint"))
    assert found.count() < 5 * 80
    assert simhash.components(found).count() == 79


def test_long_keys_lose_no_link(spark, texts, monkeypatch):
    """Keys of three sets are long, with one centre: most links are found between groups."""
    monkeypatch.setattr(near_copies, "LONG", 2)
    monkeypatch.setattr(near_copies, "CENTRES", 1)
    monkeypatch.setattr(near_copies, "SLICE", 7)
    r = random.Random(5)
    base = [f"b{r.randint(0, 3000)}" for _ in range(150)]
    texts = [*texts, *(" ".join(changed(r, base, r.randint(1, 4))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_least(texts)


def test_pairs_that_meet_do_not_grow_with_the_square(spark, monkeypatch):
    """Variants of one text, near copies and others: what leaves the tasks as pairs grows with them, not with their square."""
    made = {}
    write = near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name, **o: made.setdefault(name, write(df, name, **o)))

    def pairs(count):
        made.clear()
        r = random.Random(6)
        base = [f"w{r.randint(0, 3000)}" for _ in range(120)]
        texts = spark.createDataFrame([(" ".join(changed(r, base, 1 + i % 5)),) for i in range(count)], "text string")
        found = near_copies.similar(texts, groups=spark.createDataFrame([], "node bigint, root bigint")).count()
        return found, sum(made[name].count() for name in ("copies-pairs", "copies-pairs-apart") if name in made)

    (_, less), (found, more) = pairs(200), pairs(400)
    assert found >= 0.4 * 400 and more < 20 * 400 and more < 3 * less


def test_bits_of_every_place(spark):
    places = [0, 1, 32767, 32768, 65535, 65536, (1 << 17) - 1]
    rows = spark.createDataFrame([((p << 47) - (1 << 64 if p >> 16 else 0),) for p in places], "m bigint")
    got = near_copies.bit_table(rows, ["m"], 17)
    assert len(got) == 1 << 14 and [i for i in range(1 << 17) if got[i >> 3] >> (i & 7) & 1] == places
