"""The pipelines: statistical and linguistic extraction, and what follows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import stopwords as sw
from termloom.functions.tokens import tokenize
from termloom.operators import candidates as ops
from termloom.operators import evaluation, linguistic, tsr
from termloom.runtime import checkpointed
from termloom.sources import writers


@dataclass(frozen=True)
class Results:
    """A candidate table and the steps that refine it; each step gives new results and nothing is computed before it is read."""

    candidates: DataFrame
    tokens_table: DataFrame | None = None
    ngrams_table: DataFrame | None = None

    def _with(self, df: DataFrame) -> Results:
        return replace(self, candidates=df)

    def terms(self, limit: int | None = 20) -> DataFrame:
        return ops.top(self.candidates, limit)

    def tokens(self, limit: int | None = 20) -> DataFrame:
        out = self.tokens_table.orderBy(F.desc("frequency"), "token")
        return out if limit is None else out.limit(limit)

    def ngrams(self, limit: int | None = 20) -> DataFrame:
        out = self.ngrams_table.orderBy(F.desc("frequency"), "ngram")
        return out if limit is None else out.limit(limit)

    tagged_ngrams = ngrams

    def case_normalization(self) -> Results:
        return self._with(ops.case_normalize(self.candidates))

    def nest_normalization(self, percent: float = 10) -> Results:
        return self._with(ops.nest_normalize(self.candidates, percent))

    def regex_exclusion(self, regexes: DataFrame | list[str]) -> Results:
        return self._with(ops.regex_exclusion(self.candidates, regexes))

    def tsr_filter(self, seeds: DataFrame, kind: str = "strict", *, column: str = "term", max_rounds: int | None = None) -> Results:
        return self._with(tsr.tsr_filter(self.candidates, seeds, kind, column=column, max_rounds=max_rounds))

    def lemmatization(self, lemmas: DataFrame) -> Results:
        return self._with(ops.lemmatize(self.candidates, lemmas))

    def exclude_known(self, known: DataFrame, column: str = "term") -> Results:
        return self._with(ops.exclude_known(self.candidates, known, column))

    def evaluate(self, reference: DataFrame, k: int, **options) -> DataFrame:
        return evaluation.evaluate_topk(self.candidates, reference, k, **options)

    def save_candidates(self, path: str, *, only_candidates: bool = False) -> None:
        writers.save_candidates(self.candidates, path, only_candidates=only_candidates)


@dataclass
class Extractor:
    """Extracts candidates from a corpus (segments with the column ``text``).

    ``language`` picks the built-in stopwords; ``outer`` and ``inner`` replace them.
    """

    corpus: DataFrame
    text: str = "segment"
    language: str = "en"
    outer: Iterable[str] | None = None
    inner: Iterable[str] | None = None
    tokenizer: Callable[[Column], Column] = tokenize
    _outer: frozenset[str] = field(init=False)
    _inner: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self._outer = frozenset(self.outer) if self.outer is not None else sw.outer(self.language)
        self._inner = frozenset(self.inner) if self.inner is not None else sw.inner(self.language)

    def add_stopwords(self, words: Iterable[str]) -> Extractor:
        self._outer |= frozenset(words)
        return self

    def add_inner_stopwords(self, words: Iterable[str]) -> Extractor:
        self._inner |= frozenset(words)
        return self

    def _tokenised(self) -> DataFrame:
        return self.corpus.where(F.col(self.text).isNotNull()).select(self.tokenizer(F.col(self.text)).alias("tokens"))

    def statistical(self, *, nmin: int = 2, nmax: int = 3, minfreq: int = 2, case_normalization: bool = False) -> Results:
        segments = self._tokenised()
        ngrams = ops.ngram_counts(segments, nmin=nmin, nmax=nmax, minfreq=minfreq)
        found = ops.stopword_filter(ops.as_candidates(ngrams), self._outer, self._inner)
        if case_normalization:
            found = ops.case_normalize(found)
        return Results(found, ops.token_frequency(segments), ngrams)

    def linguistic(
        self,
        *,
        patterns: list[str] | None = None,
        evaluation_terms: DataFrame | None = None,
        tagged: DataFrame | None = None,
        nmin: int = 2,
        nmax: int = 3,
        minfreq: int = 2,
        representativity: float = 100,
        max_patterns: int | None = None,
    ) -> Results:
        """Candidates by patterns, which are learned from ``evaluation_terms`` if none are given.

        ``tagged`` is a tagged corpus; without it the corpus is tagged by word endings.
        Raises ValueError if there are no patterns and none can be learned. All learned
        patterns are matched, or the ``max_patterns`` most frequent if that is given.
        """
        if tagged is None:
            tagged = self._tokenised().select(linguistic.tag_tokens(F.col("tokens")).alias("tagged"))
        ngrams = linguistic.tagged_ngrams(tagged, nmin=nmin, nmax=nmax, minfreq=minfreq)
        if patterns is None:
            if evaluation_terms is None:
                raise ValueError("give patterns, or evaluation terms to learn them from")
            learned = linguistic.representative(linguistic.learn_patterns(ngrams, evaluation_terms), representativity)
            if max_patterns is not None:
                learned = learned.orderBy(F.desc("frequency"), "pattern").limit(max_patterns)
            learned = checkpointed(learned)
            if learned.isEmpty():
                raise ValueError("no pattern could be learned: no evaluation term is an n-gram of the corpus")
        kept = linguistic.stopword_filter_tagged(ngrams, self._outer)
        if patterns is None:
            return Results(linguistic.match_learned(kept, learned), None, ngrams)
        return Results(linguistic.match_patterns(kept, patterns), None, ngrams)
