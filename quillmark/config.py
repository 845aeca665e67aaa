"""Every constant of the forensics engine. They decide the results."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    min_paragraph_chars: int = 80
    chunk_chars: int = 1000
    min_words: int = 10
    min_paragraphs: int = 5
    min_valid: int = 3
    min_valid_to_cluster: int = 2
    min_cluster_size: int = 2
    min_samples: int = 2
    allow_single_cluster: bool = False
    noise_limit: float = 0.90
    least_variance: float = 1e-10
    semantic_weight: float = 0.2
    override_confidence: float = 0.3
    year_gap: int = 10
    years: tuple[int, int] = (1900, 2030)
    verify_first: int = 5
    verify_min_chars: int = 15
    verify_score: float = 35.0
    similarity: float = 0.50
    boost: float = 0.06
    max_anomalies: int = 3
    legacy_backward_bibliography: bool = False
    legacy_passive_twice: bool = True
    sources_per_service: int = 3
    skip_clustering: bool = False
    skip_reasoning: bool = False
    skip_sources: bool = False


DEFAULT = Config()


def from_session(spark) -> Config:
    """DEFAULT with the session's settings quillmark.<field>, for flags and numbers; stages are switched here and never by the environment."""
    plain = {f.name: f.default for f in fields(Config) if isinstance(f.default, (bool, int, float))}
    told = {name: spark.conf.get(f"quillmark.{name}", None) for name in plain}
    return replace(DEFAULT, **{name: value.lower() == "true" if isinstance(plain[name], bool) else type(plain[name])(value) for name, value in told.items() if value is not None})

FEATURES = ("avg_sentence_length", "avg_word_length", "pronoun_ratio", "preposition_ratio", "conjunction_ratio", "passive_voice_pct", "yules_k", "burstiness_score")
SEMANTIC = ("semantic_1", "semantic_2", "semantic_3")

# Words that can't begin a citation.
NOT_AUTHORS = tuple("additionally also although consequently furthermore however moreover nevertheless subsequently therefore according after based before between compared during following including regarding since through until while within appendix chapter equation figure issue page part section table volume".split())

# Closed word classes of English, one class a word.
PRONOUNS = tuple("i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves who whom whose what which this that these those someone anyone everyone nobody something anything everything nothing".split())
PREPOSITIONS = tuple("of in to for with on at from by about into through during before after above below between under over against among within without toward towards upon across behind beyond near since until per via than".split())
CONJUNCTIONS = tuple("and or but nor yet so although because if unless while whereas though whether when where as once".split())
DETERMINERS = ("the", "a", "an", "each", "every", "either", "neither", "some", "any", "no", "all", "both", "another")
AUXILIARIES = tuple("am is are was were be been being do does did have has had can could may might must shall should will would".split())
FUNCTION_WORDS = tuple(sorted({*PRONOUNS, *PREPOSITIONS, *CONJUNCTIONS, "the", "a", "an", "is", "are", "was", "were", "be", "been", "not"}))

# Penalties of the integrity score.
SCORE_START = 10.0
PENALTY = {
    "noise": 8.0,
    "author": 1.5,
    "generated": 6.0,
    "anomaly": (0.5, 3.0),
    "boundary": (0.3, 1.5),
    "high": 1.5,
    "medium": 0.8,
    "late": 0.3,
    "source": (3.0, 2.0, 1.5),
    "explanation": (0.3, 1.5),
}
