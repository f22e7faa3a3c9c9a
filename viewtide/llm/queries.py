"""The registered corpus queries, with SQL where SQL can say the same."""

from __future__ import annotations

from viewtide.llm import ball_search, collocations, common, decontaminate, html_main, language_id, minhash, packing, pii, quality, reference_sql, secret_scan, substring_dedup, toxicity, warc

VOCABULARY = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(VOCABULARY))


def op1_warc_archive(spark, sf_dir):
    return warc.archive(common.load(spark, sf_dir, "pages"))


def op2_html_main_text(spark, sf_dir):
    return html_main.extract(common.load(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return secret_scan.secrets(common.load(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(common.load(spark, sf_dir, "documents"))


def op5_personal_data(spark, sf_dir):
    return pii.personal_data(common.load(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(common.load(spark, sf_dir, "documents"), tokenizer_path())


def op7_string_tiling(spark, sf_dir):
    return decontaminate.leaks(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark, sf_dir):
    return quality.quality(common.load(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(common.load(spark, sf_dir, "documents"), size=4)


def op10_prefix_doubling_dedup(spark, sf_dir):
    return substring_dedup.deduplicated(common.load(spark, sf_dir, "documents"), keep_text=False)


def op11_phrase_collocations(spark, sf_dir):
    return collocations.collocations(common.load(spark, sf_dir, "documents"))


def op12_ball_tree_search(spark, sf_dir):
    return ball_search.search(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


def op13_toxicity_grammar(spark, sf_dir):
    return toxicity.toxicity(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc_archive, op2_html_main_text, op3_secret_scan, op4_language_id, op5_personal_data, op6_best_fit_packing, op7_string_tiling,
                                   op8_quality_rules, op9_minhash_near_dedup, op10_prefix_doubling_dedup, op11_phrase_collocations, op12_ball_tree_search, op13_toxicity_grammar)}
SQL: dict[str, str] = {"op11_phrase_collocations": reference_sql.COLLOCATIONS,
                       "op12_ball_tree_search": reference_sql.RANKED_SEARCH}
