"""Packed sequences: every id once, no padding, and a shard's index and choices against plain ones."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from vellumine.llm import packing
from vellumine.llm.encoder import Encoder
from vellumine.llm.queries import TOKENIZER

KIND = "doc_id bigint, text string, ids string, start string, `sequence_id` string, `a.b` string"


def corpus(n, seed=1):
    r = random.Random(seed)
    topics = [[f"w{t}x{i}" for i in range(40)] for t in range(12)]
    rows = [(i, " ".join(r.choices(r.choice(topics), k=r.choice((0, 3, 20, 60, 200))))) for i in range(n)]
    return rows + [(None, None), (None, ""), (3, "a copy of its own"), (3, "a copy of its own"), (900, "very long text " * 5000), (901, " \n\t é 😀 ...")]


@pytest.mark.parametrize("length, shard", [(1024, 2048), (64, 20), (16, 3)])
def test_every_id_is_in_one_piece_and_nothing_is_padded(spark, length, shard):
    rows = corpus(150)
    docs = spark.createDataFrame([(*x, "i", "s", "q", "z") for x in rows], KIND).repartition(5)
    packed = packing.pack(docs, TOKENIZER, length=length, shard=shard)
    got = packed.collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for x in got:
        ids = np.frombuffer(x.ids, dtype="<u4").tolist()
        by_doc.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, ids))
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, ids))
    for pieces in by_sequence.values():
        at = 0
        for offset, ids in sorted(pieces):
            assert offset == at and ids
            at += len(ids)
        assert at <= length and at & (at - 1) == 0
    for key, pieces in by_doc.items():
        copies = [x for x in want.elements() if (x[0], len(x[1])) == key]
        assert copies and Counter(p for s, ids in pieces for p in enumerate(ids, s)) == Counter(p for _, ids in copies for p in enumerate(ids))
    assert sum(len(ids) for p in by_doc.values() for _, ids in p) == sum(len(x[1]) for x in want.elements())
    whole = {x.sequence_id: x.ids for x in packing.sequences(packed).collect()} if length == 64 else {}
    assert all(whole[s] == np.array([i for _, ids in sorted(p) for i in ids], dtype="<u4").tobytes() for s, p in by_sequence.items() if whole)


def test_short_rests_share_sequences_with_like_ones(spark):
    """Of pieces in one sequence far more are of one topic than by chance (a twelfth)."""
    rows = [(i, t) for i, t in corpus(600, 2) if t and "x" in t and 10 < t.count(" ") < 100]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), TOKENIZER).collect()
    topic = {i: t.split("x")[0] for i, t in rows}
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append(topic[x.doc_id])
    pairs = [a == b for p in by.values() for i, a in enumerate(p) for b in p[:i]]
    assert len(pairs) > 100 and sum(pairs) > 0.6 * len(pairs)


def plain_scores(docs, unit, terms):
    """BM25 by the book. docs: words of each."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))

    def weight(w, d):
        tf = d.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0

    query = sorted((w for w in set(docs[unit]) if df[w] > 1), key=lambda w: -weight(w, docs[unit]))
    edge = weight(query[terms - 1], docs[unit]) if len(query) > terms else None
    return [sum(weight(w, d) for w in query[:terms]) for d in docs], edge is not None and len(query) > terms and abs(weight(query[terms], docs[unit]) - edge) < 1e-9


def test_index_is_bm25():
    r = random.Random(5)
    own = Encoder(TOKENIZER, 0)
    kind, name = packing.id_kinds(own)
    docs = [[r.choice(["tree", "House", "river", "stone", "cloud", "field", "winter", "Summer", "paper"]) for _ in range(r.randint(1, 30))] for _ in range(40)]
    ids = [np.array(own.tokenizer.encode(" " + ", ".join(d) + ".", add_special_tokens=False).ids, dtype=np.uint32) for d in docs]
    index = packing.Index(ids, kind, name)
    lower = [[w.lower() for w in d] for d in docs]
    for unit in range(40):
        want, tied = plain_scores(lower, unit, 100)
        assert not tied and np.allclose(index.scores(unit, 100), want)


def test_a_seed_takes_its_best_neighbours_first():
    own = Encoder(TOKENIZER, 0)
    kind, name = packing.id_kinds(own)
    texts = [" tree house river", " stone cloud", " tree house paper", " winter field stone", " river tree paper house"]
    ids = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts]
    assert [len(x) for x in ids] == [3, 2, 3, 3, 4]
    score = packing.Index(ids, kind, name).scores(0, 16)
    assert score[4] > score[2] > 0 == score[1] == score[3]
    # 3 + 4 fill 8 but for one, which is cut from the next best.
    assert packing.fill(ids, packing.Index(ids, kind, name), 8, 16) == [[(0, 0, 3), (4, 0, 4), (2, 0, 1)], [(1, 0, 2), (3, 0, 3), (2, 1, 3)]]


def test_powers_of_two():
    assert packing.by_powers_of_two([(0, 2, 5), (1, 0, 8)]) == [[(0, 2, 5), (1, 0, 5)], [(1, 5, 7)], [(1, 7, 8)]]
    assert packing.by_powers_of_two([]) == []


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], KIND), TOKENIZER).count() == 0
