import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from almanack.llm import packing, simhash, suffixes, toxicity
from almanack.llm.common import settle, table
from almanack.llm.queries import QUERIES

from .test_suffixes import brute


def test_registered():
    for n in range(1, 14):
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_run_equals_its_stages(spark, sf):
    """Each stage's decisions take effect on all that its predecessor kept."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = settle(stages[0](spark, docs, sf))
    assert clean.columns == columns
    scores = toxicity.score_documents(docs, table(spark, sf, "labels"))
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(r.doc_id for r in scores.where("predicted = 0").collect())

    single = settle(stages[1](spark, clean, sf))
    assert single.columns == columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    ids, root = sorted(texts), {}
    for i in ids:
        near = [j for j in ids if j <= i and bin(prints[i] ^ prints[j]).count("1") <= simhash.RADIUS]
        roots = {root.get(j, j) for j in near}
        for j in ids:
            if root.get(j, j) in roots and j <= i:
                root[j] = min(roots)
    keep = [i for i in ids if root[i] == i]
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == keep

    cut = settle(stages[2](spark, single, sf))
    assert cut.columns == columns
    want = brute([texts[i].encode() for i in keep], suffixes.THRESHOLD)
    got = {r.doc_id: r.text for r in cut.collect()}
    assert [got[i] for i in keep] == [w[0].decode("utf-8", "ignore") for w in want]

    rows = corpus_pipeline.run(spark, sf)
    packed = rows.collect()
    n = {i: 1 + len(x.ids) for i, x in zip(keep, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([got[i] for i in keep], add_special_tokens=False))}
    held = {}
    for r in packed:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        assert len(r.ids) == 4 * r.length
    assert held == n
    per = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= packing.CAPACITY for r in per)
    assert len(per) <= np.ceil(sum(n.values()) / packing.CAPACITY) * 1.05 + 2
