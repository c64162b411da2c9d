"""The stages of the pipeline, each against its operator's brute force on its own input."""

import corpus_pipeline as pipeline
from test_corpus_operators import shingle_set

from furlong.llm import decontaminate, registry
from furlong.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = registry.table(spark, SF, "documents")
    columns = docs.columns
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(materialize(spark, stage(spark, tables[-1], SF), name))
        if name != "packing":
            assert tables[-1].columns == columns
    texts = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in tables[:-1]]
    assert set(texts[4]) <= set(texts[3]) <= set(texts[2]) <= set(texts[1]) <= set(texts[0])
    sets = {i: shingle_set(t) for i, t in texts[2].items()}
    assert not any(9 * len(a & b) >= 4 * (len(a) + len(b)) for i, a in sets.items() for j, b in sets.items() if i < j and a)
    seen = {}
    for i in sorted(texts[3]):
        b = texts[3][i].encode()
        assert not any(seen.get(b[p : p + 50], i) < i for p in range(len(b) - 49)) or texts[3][i] != texts[2][i]
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
    leaks = {r.doc_id for r in decontaminate.search(tables[3], registry.table(spark, SF, "benchmark")).collect()}
    assert set(texts[4]) == set(texts[3]) - leaks
    assert {r.doc_id for r in tables[5].select("doc_id").collect()} == set(texts[4])
