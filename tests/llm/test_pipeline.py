"""Every stage of the pipeline on a small table, against plain Python."""

import corpus_pipeline
from faultline.llm import pii
from faultline.llm._shared import stored
from tests.llm.conftest import prose
from tests.llm.test_near_dedup import by_hand, classes
from tests.llm.test_packing import JSON, tiles
from tests.llm.test_toxicity import LABELS, corpus


def tables(spark, tmp_path, rng):
    rows, labels = corpus(rng, 600)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows]
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(0, 60, 2)]  # copies
    rows += [(2000 + i, prose(rng, 30) + f" jo{i}@host.org, +1 (212) 555-{1000 + i}, 10.0.0.{i}, 4539578763621486", "en", None, 0) for i in range(30)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (None, prose(rng, 20), "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), labels


def test_stages(spark, tmp_path, rng):
    sf_dir, labels = tables(spark, tmp_path, rng)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        at[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    start, kept = at["toxicity"]
    ids = {r.doc_id for r in kept}
    assert sum((i in ids) == (t == 1) for i, _, t in labels) < 0.03 * len(labels)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in start} and None in ids and 3000 in ids

    before, after = at["simhash_near_dedup"]
    named = [r for r in before if r.doc_id is not None]
    named.sort(key=lambda r: r.doc_id)
    roots = classes([by_hand(r.text) for r in named], 3)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == [named[i].doc_id for i in sorted(set(roots))]

    before, after = at["pii"]
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        base = [x for x in pii.spans(texts[r.doc_id] or "") if x[3]]
        assert (r.text == texts[r.doc_id]) or r.n_chars == len(r.text)
        assert not [x for x in pii.spans(r.text or "") if x[3]]
        if r.doc_id and 2000 <= r.doc_id < 2030:
            assert len(base) >= 4 and all(f"[{k.upper()}]" in r.text for k in pii.KINDS)

    before, after = at["source_mixing"]
    sizes = {r.doc_id: len((r.text or "").split()) for r in before}
    words = {}
    for r in after:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * sizes[i] for i, n in words.items())
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())

    before, after = at["packing"]
    from tokenizers import Tokenizer
    encode, total = Tokenizer.from_file(JSON), 0
    crcs = set()
    for r in before:
        ids = [*encode.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        crcs.add((r.doc_id, len(ids)))
    assert sum(r.length for r in after) == total and {(r.doc_id, r.doc_tokens) for r in after} == crcs
    sequences = {}
    for r in after:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(tiles(x) < 2048 for x in sequences.values()) <= 11


def test_run_is_the_stages(spark, tmp_path, rng):
    sf_dir, _ = tables(spark, tmp_path, rng)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
