"""The subpackage's queries, one an operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import host_reputation, license_scan, odd_sketch, prefix_trie, quality_rules, warc
from heronry.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.host_reputation import judge_urls, outcomes_from_labels

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, outcomes_from_labels(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.odd_sketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heronry.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.rule_ensemble import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.token_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronry.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_host_reputation, op3_near_duplicates, op4_license_scan, op5_suffix_dedup, op6_quality_rules, op7_byte_bpe, op8_rule_ensemble, op9_decontamination, op10_token_store, op11_warc, op12_whitening, op13_prefix_trie)}
_SQL: dict[str, Callable[[], str]] = {"op2_host_reputation": lambda: host_reputation.SQL, "op3_near_duplicates": lambda: odd_sketch.sql(4, 80), "op4_license_scan": license_scan.sql, "op6_quality_rules": lambda: quality_rules.SQL, "op11_warc": lambda: warc.SQL, "op13_prefix_trie": lambda: prefix_trie.SQL}


class _Written(Mapping):
    """SQL that is written when it is asked for, as one query's holds a model that is fitted first."""

    def __getitem__(self, name: str) -> str:
        return _SQL[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(_SQL)

    def __len__(self) -> int:
        return len(_SQL)


ORACLE_SQL: Mapping[str, str] = _Written()
