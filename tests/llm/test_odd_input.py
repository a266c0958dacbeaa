"""Every operator on nulls, empty and long texts, repeated rows, missing ids, clashing columns and empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from basketlens.llm import bpe, exact_dedup, language, licenses, line_dedup, ngram_join, packing, pages, quality, secrets, substring_dedup

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify(docs):
    return language.predict(docs, language.fit(docs.select("doc_id", "text", "lang")))


ONE_ROW_EACH = {
    "pages": lambda d: pages.extract_text(d, "doc_id", "text"),
    "substrings": substring_dedup.without_repeats,
    "language": identify,
    "quality": quality.quality_decisions,
    "near": ngram_join.near_duplicates,
    "bpe": lambda d: bpe.round_trip_digests(bpe.encode_texts(d, RANKS, PATTERN), RANKS, PATTERN),
    "lines": line_dedup.without_repeated_lines,
    "exact": exact_dedup.exact_duplicates,
    "secrets": secrets.secret_digests,
}
OTHERS = {
    "packing": lambda d: packing.pack_documents(d, TOKENIZER),
    "licenses": licenses.scan_licenses,
    "keep_good": quality.keep_good,
    "cut_lines": line_dedup.remove_repeated_lines,
    "cut_words": substring_dedup.remove_repeats,
    "one_of_each": ngram_join.one_of_each,
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_document(name, odd, odd_rows):
    got = [r[0] for r in ONE_ROW_EACH[name](odd).collect()]
    assert sorted(got, key=str) == sorted((r[0] for r in odd_rows), key=str)


@pytest.mark.parametrize("name", ONE_ROW_EACH | OTHERS)
def test_other_columns_change_nothing(name, odd, clashing):
    operator = (ONE_ROW_EACH | OTHERS)[name]
    got = operator(clashing)
    names = [c for c in operator(odd).columns]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, operator(odd).collect()))


@pytest.mark.parametrize("name", ONE_ROW_EACH | OTHERS)
def test_empty_table(name, make):
    assert (ONE_ROW_EACH | OTHERS)[name](make([])).collect() == []


def test_stages_take_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd.columns
    docs.collect()


def test_defined_results(odd):
    near = {r.doc_id: r for r in ngram_join.near_duplicates(odd).collect()}
    assert near[1].n_shingles == 0 and near[1].component_id == 1
    assert near[5].component_id == 4  # equal but for case
    assert near[None].component_id is None
    exact = {r.doc_id: r for r in exact_dedup.exact_duplicates(odd).collect()}
    assert exact[1].keep_id == 2 and exact[1].group_size == 2  # null and empty
    assert exact[4].keep_id == 5 and not exact[4].kept
    words = {r.doc_id: r for r in substring_dedup.without_repeats(odd).collect()}
    assert words[5].n_removed == 0 and words[3].n_removed == 0 and words[1].n_words == 0
    languages = {r.doc_id: r for r in identify(odd).collect()}
    assert languages[1].lang_pred == languages[6].lang_pred == "und" and languages[1].score == 0
    good = {r.doc_id: r for r in quality.quality_decisions(odd).collect()}
    assert good[1].base_failed and good[4].n_words == 30_000
