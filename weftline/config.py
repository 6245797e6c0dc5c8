"""Limits and paths of the dump pipeline, settable like any Spark setting."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

# Names of the settings that a user may already have in scripts.
CONF_KEYS = {
    "redirects_file": "wiki.redirects.file",
    "filter_words": "wiki.filter.words",
    "max_sentence_length": "wiki.sentence.maxlength",
    "max_page_length": "wiki.page.maxlength",
    "max_links": "wiki.links.maxperpage",
    "max_implicit_links": "wiki.implicitlinks.maxperpage",
}


@dataclass(frozen=True)
class PipelineConfig:
    """max_links and max_implicit_links bound the links of one sentence: a sentence with as many or more keeps none."""

    redirects_file: str | None = None
    filter_words: str = ""
    max_sentence_length: int = 1_000
    max_page_length: int = 1_000_000
    max_links: int = 1_000
    max_implicit_links: int = 10_000
    per_word: int = 5
    per_sense: int = 3
    max_senses: int = 10
    min_senses: int = 2
    per_lemma: int = 100
    seed: int = 42

    @classmethod
    def of(cls, spark: SparkSession, **given) -> PipelineConfig:
        """What is given here, else what the session's settings say, else the defaults."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        for name, key in CONF_KEYS.items():
            told = spark.conf.get(key, None)
            if told is not None and name not in given:
                given[name] = int(told) if kinds[name] is int else told
        return cls(**given)

    @property
    def whitelist(self) -> list[str]:
        return [w.strip() for w in self.filter_words.split(",") if w.strip()]
