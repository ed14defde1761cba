"""The pipeline on the smallest tables: rows of every stage by brute force."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
from test_texts import slow_classes, slow_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from arealis.llm import mixing, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_rows_of_brute_force(spark):
    root = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).parent
    before = set(root.glob("*/*/4-packing"))
    out = corpus_pipeline.run(spark, SF).collect()
    (last,) = set(root.glob("*/*/4-packing")) - before
    stages = [spark.read.parquet(str(last.parent / f"{i}-{name}")).collect() for i, (name, _) in enumerate(corpus_pipeline.STAGES)]
    assert Counter(map(tuple, out)) == Counter(map(tuple, stages[4]))

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    chain, ranking = toxicity.train(docs, labels), quality.train(docs, labels)
    rows = [r for r in rows if chain.predict(chain.rows([r.text]))[0][-1] < toxicity.CUT]
    assert Counter(stages[0]) == Counter(rows)
    rows = [r for r in rows if ranking.score(np.array([quality.measures(r.text)]))[0] >= quality.CUT]
    assert Counter(stages[1]) == Counter(rows)
    kept = set(slow_classes([r.doc_id for r in rows], [slow_fingerprint(r.text) for r in rows]))
    rows = [r for r in rows if r.doc_id in kept]
    assert Counter(stages[2]) == Counter(rows)

    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    taken = {i: (size, n) for i, size, _, _, n in db.execute(mixing.ORACLE).fetchall()}
    want = Counter()
    for r in rows:
        size, n = taken[r.doc_id]
        want[r] += n // size + (0 < 2 * (n % size) >= size) if size else 0
    assert Counter(stages[3]) == +want

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = Counter()
    for r, times in want.items():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [packing.END]
        ends = range(len(ids) % packing.SEQUENCE or packing.SEQUENCE, len(ids) + 1, packing.SEQUENCE)
        for i, end in enumerate(ends):
            start = max(0, end - packing.SEQUENCE) if i else 0
            pieces[(r.doc_id, i, start, np.array(ids[start:end], "<u4").tobytes())] += times
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in out) == +pieces
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= packing.SEQUENCE
