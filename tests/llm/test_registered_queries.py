"""The registered queries that SQL cannot express, on the smallest tables, against brute force."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from test_joins import brute_links, classes

from tarnwell.llm import pseudo_likelihood as L
from tarnwell.llm import substring_dedup as P
from tarnwell.llm import token_output as T
from tarnwell.llm.common import text_words
from tarnwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def test_jaccard_join(spark, docs):
    links = brute_links(docs)
    found = {r.doc_id: r for r in QUERIES["op3_jaccard_join"](spark, SF).collect()}
    assert {i: r.n_links for i, r in found.items()} == {i: len(v) for i, v in links.items()} and {i: r.class_id for i, r in found.items()} == classes(links)


def test_token_output(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op10_token_output"](spark, SF).collect()}
    tokenizer, start = T.encoder(T.vocabulary()).tokenizer, 0
    assert len(found) == len(docs)
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[doc].start, found[doc].n_tokens, found[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), doc
        start += len(ids)


def test_substring_dedup(spark, docs):
    """Every pair of texts compared whole, without seeds."""
    known = {}
    for doc, text in docs:
        if text is not None:
            known.setdefault(text, []).append(doc)
    texts = sorted(known)
    words, bounds = text_words(pa.array(texts))
    words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    passages = {}
    for i, j in combinations(range(len(texts)), 2):
        if min(len(words[i]), len(words[j])) >= 50:
            a, b = P.shared(words[i], words[j], 4)
            if len(a) and (p := P.passages(words[i], words[j], a, b, k=4, least=50, identity=0.8, reach=28)):
                passages[i, j] = p
    wanted = {known[texts[n]][k] for pair in passages for n in pair for k in range(len(known[texts[n]]))} | {d for t, own in known.items() if len(own) > 1 and len(t.split()) >= 50 for d in own}
    rows, links = P.repeated_passages(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    found = {r.doc_id: r for r in rows.collect()}
    assert set(found) == {r.doc_id for r in QUERIES["op7_substring_dedup"](spark, SF).collect()}
    assert set(found) <= wanted and len(set(found)) >= 0.97 * len(wanted) > 5
    pairs = {frozenset((min(known[texts[i]]), min(known[texts[j]]))) for i, j in passages}
    met = {frozenset((r.left_id, r.right_id)) for r in links.collect()}
    assert met <= pairs and len(met) >= 0.9 * len(pairs)


def test_pseudo_likelihood(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op2_pseudo_likelihood"](spark, SF).collect()}
    assert len(found) == len(docs)
    for doc, text in docs:
        n = len(L.token_hashes(pa.array([text]))[0])
        assert found[doc].n_tokens == n and (found[doc].log_likelihood < 0) == (n > 0) and np.isfinite(found[doc].log_likelihood)
    means = [found[d].mean_log_likelihood for d, _ in docs if found[d].n_tokens > 20]
    assert np.std(means) > 0.1


def test_quality_classifier(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, SF).collect()}
    assert len(found) == len(docs) and all(0 <= v <= 1 for r in found.values() for v in (r.p_text, r.p_meta, r.score))
    known = [d for d, _ in docs if labels.get(d) in (0, 1)]
    assert np.mean([found[d].kept == (labels[d] == 1) for d in known]) > 0.9


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)]).tolist()[:-1] and len(found) > 50
