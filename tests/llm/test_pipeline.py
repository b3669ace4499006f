from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import posindex, registry
from tests.llm import cases
from tests.llm.test_learned import LETTER
from tests.llm.test_sets import brute_classes


def test_stages(spark, tmp_path):
    item = "alpha " + " ".join(f"item{k}" for k in range(20))
    foul = [(3000 + k, f"{cases.WORDS[k % 20]} u{k} idiot moron {'pad' * k} scum trash you") for k in range(40)]
    clean = [(4000 + k, f"{cases.WORDS[k % 20]} v{k} plain w{k} text x{k} here") for k in range(40)]
    docs = cases.documents(spark, extra=[*foul, *clean, (5000, item), (5001, f"{LETTER} end")])
    labels = spark.createDataFrame([(i, 1, 1) for i, _ in foul] + [(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf_dir = str(tmp_path)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows.write.parquet(str(tmp_path / f"s{k}"))
        rows = spark.read.parquet(str(tmp_path / f"s{k}"))
        before = cases.pairs(rows)
        rows = stage(spark, rows, sf_dir)
        if k < 4:
            assert rows.columns == docs.columns
            seen.append((before, cases.pairs(rows)))
    toxic, near, bench, private = seen
    assert not {i for i, _ in foul} & {i for i, _ in toxic[1]} and {i for i, _ in clean} <= {i for i, _ in toxic[1]}
    classes = brute_classes(near[0], 5, 80)
    blank = [str(i) for i, n, _ in classes if not n]
    assert sorted(str(i) for i, _ in near[1]) == sorted([*{str(c) for _, n, c in classes if n}, *blank])
    assert not Counter(near[1]) - Counter(near[0])
    assert {i for i, _ in bench[0]} - {i for i, _ in bench[1]} == {5000}
    masked = dict(private[1])[5001]
    assert "[email]" in masked and "@" not in masked
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = Counter((r.doc_id, tuple(r.ids)) for r in rows.collect())
    assert encoded == Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in private[1])
    whole = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert whole == encoded


def test_without_counts_of_characters(spark):
    docs = cases.documents(spark).drop("n_chars")
    assert corpus_pipeline.mask_personal_data(spark, docs, "").columns == docs.columns


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names) and posindex.SQL
