"""The pipeline's stages on a small corpus, each against its brute force on the rows that its predecessor kept."""

import numpy as np

import corpus_pipeline
from queuelens.llm import mixing, ngram_join, packing, pii, quality
from tests.llm.test_llm_operators import brute_components, make_texts


def test_stages(spark, tmp_path):
    junk = ["$$$ THND!! ### EREHA!! &&& " * (3 + i % 5) + str(i) for i in range(40)]
    good = [t for t in make_texts(11, 80) if t and len(t.split()) > 2] + [f"write to ann{i}@example.org about the thnd ereha onre tion {i} of the road" for i in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + junk)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] < len(good))) for r in rows if r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < 4:
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            kept.append({r.doc_id: r for r in docs.collect()})
    scores = quality.score_documents(spark.createDataFrame(rows, schema), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert set(kept[0]) == {r.doc_id for r in scores.collect() if r.predicted == 1}
    assert len(set(kept[0]) & set(range(len(good)))) > 0.9 * len(good) and not any(d >= len(good) for d in kept[0])
    components = brute_components([(r.doc_id, r.text) for r in kept[0].values()], ngram_join.NEAR)
    assert set(kept[1]) == {d for d, (_, c) in components.items() if c == d}
    for d, r in kept[2].items():
        before = kept[1][d].text
        assert r.text == pii.masked(before, pii._ordered(pii.base_spans(before) + pii.added_spans(before))) and r.n_chars == len(r.text)
    assert any("[EMAIL]" in r.text for r in kept[2].values())
    assert {d: r.text for d, r in kept[3].items()} == {d: r.text for d, r in kept[2].items()}
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    used = np.bincount([r.sequence_id for r in packed], weights=[r.length for r in packed])
    assert used.max() <= 4096 and len(used) == -(-int(used.sum()) // 4096)

    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_sequences_follow_the_mix(spark):
    """Tokens of each source in every prefix of the sequences are near those in as long a prefix of the mixed stream."""
    rng = np.random.default_rng(4)
    rows = [(i, "road " * int(rng.integers(2, 15) * 100), "en", "a" if i % 10 else "b", 1) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    packed = packing.stage(spark, docs, "").collect()
    slots = {r.doc_id: (r.slot, r.in_block) for r in mixing.pfair_mix(docs, carry=("doc_id",)).select("row.doc_id", "slot", "in_block").collect()}
    used = np.bincount([r.sequence_id for r in packed], weights=[r.length for r in packed])
    assert used.max() <= 4096 and used.min() > 0
    last = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset >= last.get(r.sequence_id, 0)
        last[r.sequence_id] = r.offset + r.length
    share = lambda order: np.cumsum([r.length * (r.doc_id % 10 == 0) for r in order]) / np.sum([r.length for r in packed])
    tokens = lambda order: np.cumsum([r.length for r in order])
    by_sequence, by_slot = sorted(packed, key=lambda r: (r.sequence_id, r.offset)), sorted(packed, key=lambda r: (*slots[r.doc_id], r.piece))
    at = np.linspace(0, tokens(packed)[-1], 50)
    assert np.abs(np.interp(at, tokens(by_sequence), share(by_sequence)) - np.interp(at, tokens(by_slot), share(by_slot))).max() < 0.01
    # Without the stream's order b's documents would be spread over all sequences; in the stream they end early.
    assert share(by_sequence)[len(packed) // 2] > 0.6 * share(by_sequence)[-1]
