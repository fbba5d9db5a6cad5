from collections import Counter, defaultdict

import corpus_pipeline as P
from hitloom.llm import bpe, langid, mixing
from hitloom.llm.common import held_out
from tests.llm.test_mixing import water_fill
from tests.llm.test_neardup import brute


def test_stages_by_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, tables[-1], sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or tables[-1].columns == docs.columns
    told, exact, near, mixed, coded = ([r for r in t.collect()] for t in tables[1:])

    langs = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs.where(~held_out()))).collect()}
    assert {r.doc_id for r in told} == {i for i, r in langs.items() if r.lang_pred != "und" and not r.ambiguous}
    assert len(told) > 0.95 * docs.count()

    last = {}
    for r in sorted(told):
        last[r.text] = r.doc_id
    assert sorted(r.doc_id for r in exact) == sorted(last.values())

    groups = brute([(r.doc_id, r.text) for r in exact], 5, 80)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, _, kept) in groups.items() if kept)

    size = {r.doc_id: len(r.text.split()) for r in near}
    by_source = defaultdict(int)
    for r in near:
        by_source[r.source] += size[r.doc_id]
    names = sorted(by_source)
    goal = dict(zip(names, water_fill([by_source[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    copies = Counter(r.doc_id for r in mixed)
    source = {r.doc_id: r.source for r in near}
    for s in names:
        taken = sum(n * size[i] for i, n in copies.items() if source[i] == s)
        assert abs(taken - goal[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1e-6
    assert max(copies.values()) <= 3

    t = bpe.tokenizer(bpe.word_bpe_path())
    text = {r.doc_id: r.text for r in near}
    assert Counter((r.doc_id, r.n_tokens) for r in coded) == Counter((r.doc_id, len(t.encode(text[r.doc_id])) // 4) for r in mixed)


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir)
    assert rows.columns[:2] == ["doc_id", "n_tokens"] and rows.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
