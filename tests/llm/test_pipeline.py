"""The pipeline, stage by stage, against what brute force says about each stage's own input."""

import collections
import re

import corpus_pipeline
from siltstone.llm import quality
from siltstone.llm.common import kept, table


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    after = {}
    for name, f in corpus_pipeline.STAGES:
        out = kept(f(spark, docs, small), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, rows = {r.doc_id: r for r in docs.collect()}, out.collect()
        after[name] = rows
        if name == "quality classifier":
            bad = {r.doc_id for r in quality.judged(docs, table(spark, small, "labels")).collect() if not r.predicted}
            assert {r.doc_id for r in rows} == set(before) - bad
        elif name == "exact dedup":
            groups = collections.defaultdict(list)
            for r in before.values():
                groups[squeezed(r.text)].append((-len(r.text or ""), r.doc_id))
            assert {r.doc_id for r in rows} == {min(g)[1] for g in groups.values()}
        elif name == "SimHash near-dedup":
            stay, sets = {r.doc_id for r in rows}, {i: shingles(r.text) for i, r in before.items()}
            near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert not [p for p in near if set(p) <= stay]
            for i in set(before) - stay:
                assert any(len(sets[i] & sets[j]) >= 0.4 * len(sets[i] | sets[j]) for j in sets if j != i)
        elif name == "mixing sources to target weights":
            assert max(collections.Counter(r.doc_id for r in rows).values()) <= 2
        else:
            assert len(rows) == docs.count() and all(r.round_trip for r in rows)
        docs = out
    whole = sorted((r.doc_id, r.n_ids) for r in corpus_pipeline.run(spark, small).collect())
    assert whole == sorted((r.doc_id, r.n_ids) for r in after[corpus_pipeline.STAGES[-1][0]])


def test_pipeline_of_odd_rows(spark, odd, marks, tmp_path):
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        d = str(tmp_path / name)
        rows.write.parquet(f"{d}/documents.parquet")
        marks.write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert (len(out) > 0) == (name == "odd") and all(r.round_trip for r in out)
