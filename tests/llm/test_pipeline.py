"""The pipeline against its stages done by brute force in plain Python."""

import importlib.util

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from eventlake.llm import bpe
from eventlake.llm.queries import QUERIES

from .test_core import brute_components, brute_fingerprint, brute_hits
from .test_models import brute_statistics, quality_corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs, labels = quality_corpus(240, 9)
    licence = "This common licence line is more than forty code points long."
    rows = [(i, t + ("\n" + licence if i % 7 == 1 else ""), "en", "src0", len(t)) for i, t, *_ in docs]
    item = " ".join(rows[5][1].split()[:14])
    rows += [(1000, rows[1][1], None, None, None), (1001, rows[4][1], "en", "src1", 3), (1002, "pre " + item + " post and more words to be long enough " + rows[8][1], "en", "src1", 3)]
    # An id of two texts, of which one is another document's, and a row that repeats.
    rows += [(1006, rows[1][1], None, None, None), (1006, rows[2][1] + " and words that no other document has in its end", "en", "src2", 9), (1007, rows[8][1] + " with quite another end than all of the others have", "en", "src2", 9)]
    rows += [rows[-1]]
    rows += [(1003, None, None, None, None), (1004, "", None, None, None), (1005, "few words", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, labels, [(1, item)], licence


def test_pipeline_is_its_stages_by_brute_force(spark, sf_dir):
    at, rows, labels, items, licence = sf_dir
    truth = {i: q for i, q, _ in labels}
    left = []
    for i, t, *_ in rows:
        n, _, _, _, repeats = brute_statistics(t)
        if n >= 10 and 100 * repeats <= 20 * n and truth.get(i, 1):
            left.append((i, t))
    holders = [i for i, t in left if licence in t.split("\n")]
    assert len(holders) >= 5
    left = [(i, t if i == max(holders) else "\n".join(x for x in t.split("\n") if x != licence)) for i, t in left]
    first = {}
    for (i, t), c in sorted(zip(left, brute_components([brute_fingerprint(t) for _, t in left]))):
        first.setdefault(c, (i, t))
    left = sorted((i, t) for i, t in first.values() if not brute_hits(t, items)[1])
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    found = corpus_pipeline.run(spark, at).collect()
    assert {(r.doc_id, r.text) for r in found} ^ set(left) == set() and len(found) == len(left)
    ids = {r.doc_id for r in found}
    assert 1000 not in ids and 1002 not in ids and 5 not in ids and {1006, 1007} <= ids
    for r in found:
        assert r.round_trip and r.n_chars == len(r.text)
        assert r.token_ids == b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(r.text))


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir[0]).count() == 0, name


def test_every_query_is_registered_once():
    assert importlib.util.find_spec("corpus_pipeline")
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
