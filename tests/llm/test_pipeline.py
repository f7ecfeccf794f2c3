"""The pipeline's stages one after the other, each against a plain version on what the stage before kept."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from fleetlens.llm import private_data, quality_rules
from tokenizers import Tokenizer

from llm.test_duplicates import plain_components, plain_repeats
from llm.test_quality import plain_counts, plain_spans
from llm.texts import HARD, prose


def documents():
    rows = list(enumerate(HARD))
    rows += [(100 + i, prose(i, 60 + 5 * i)) for i in range(40)]
    rows += [(200 + i, prose(5, 85) + f" extra{i}") for i in range(6)]
    rows += [(300 + i, f"{prose(70 + i, 90)} {prose(999, 60)} {prose(170 + i, 80)}") for i in range(4)]
    rows += [(400 + i, f"{prose(270 + i, 90)} joe{i}@x.example.com and +1 (222) 555-010{i}") for i in range(4)]
    rows += [(500, " ".join(w.upper() + "!!" for w in prose(9, 200).split())), (None, prose(1234, 120)), (501, None)]
    return rows


@pytest.fixture
def stored_documents(spark, tmp_path, make):
    frame = make(documents()).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, stored_documents):
    docs = spark.read.parquet(f"{stored_documents}/documents.parquet")
    columns = docs.columns
    results = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, stored_documents)
        if name != "packing":
            assert after.columns == columns
            after.write.parquet(f"{stored_documents}/{name}")
            after = spark.read.parquet(f"{stored_documents}/{name}")
            assert all(r.n_chars == len(r.text) for r in after.where("text is not null").collect())
        results[name] = (before, after)
        before = after

    before, after = results["quality rules"]
    rated = quality_rules.rated(before, quality_rules.language_references(before)).where("kept").collect()
    kept = {r.doc_id for r in rated}
    assert texts(after) == sorted(((i, t) for i, t in documents() if i in kept), key=repr)
    assert not any(plain_counts(t)[5] for i, t in documents() if i in kept) and 500 not in kept and 139 in kept and None in kept

    before, after = results["near-duplicates"]
    kept = {i for i, _, _, k in plain_components(texts(before)) if k}
    assert texts(after) == [(i, t) for i, t in texts(before) if i in kept] and len(texts(after)) < len(texts(before))

    before, after = results["repeated passages"]
    plain = sorted(((i, kept) for i, _, _, _, kept in plain_repeats(texts(before))), key=repr)
    assert texts(after) == plain and plain != texts(before)

    before, after = results["personal data"]
    assert texts(after) == sorted(((i, private_data.redacted(t, plain_spans(t))) for i, t in texts(before)), key=repr)

    before, after = results["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(after.collect(), key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert pieces == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts(before)}


def test_run_is_all_stages(spark, stored_documents):
    found = corpus_pipeline.run(spark, stored_documents)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns)
    assert found.select("doc_id").distinct().count() > 30
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None


def test_one_row_of_each_group_goes_on(spark, make):
    same, other, null = prose(31, 90), prose(32, 90), prose(33, 90)
    rows = [(7, same), (7, same), (7, same), (None, same), (None, same.replace(" ", "  ")), (3, same + " more"), (3, other)]
    rows += [(9, other), (None, null), (None, null), (5, prose(34, 90)), (5, prose(35, 90)), (6, None), (6, None)]
    docs = make(rows)
    found = corpus_pipeline.near_duplicate(spark, docs, "")
    assert found.columns == docs.columns
    wanted = [(3, same + " more"), (3, other), (None, null), (5, prose(34, 90)), (5, prose(35, 90)), (6, None), (6, None)]
    assert texts(found) == sorted(wanted, key=repr)
    whole = found.where("text is not null")
    assert texts(corpus_pipeline.repeated_passages(spark, whole, "")) == texts(whole)
    assert corpus_pipeline.near_duplicate(spark, make([]), "").collect() == []
