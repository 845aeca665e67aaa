"""What is learnt of a corpus's language, as one object: the tagger's model and the tables of abbreviations, sentence starters and lemmas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import lemmas, sentences, tagging


@dataclass(frozen=True)
class Language:
    """model: of tagging; abbreviations, starters: of sentences; lemma: of lemmas.lemma_table()."""

    model: tagging.Model
    abbreviations: DataFrame
    starters: DataFrame
    lemma: DataFrame

    def annotate(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs(doc_id, paragraph_index, text) with tags and sentence_ends, as features.measured() reads them."""
        return tagging.tag(sentences.boundaries(paragraphs, self.abbreviations, self.starters), self.model)

    def save(self, path: str) -> None:
        """All of it below path, in the cluster's shared store."""
        spark = self.lemma.sparkSession
        numbers = [("transition", i, float(v)) for i, v in enumerate(self.model.transition.ravel())] + [("emission", i, float(v)) for i, v in enumerate(self.model.emission.ravel())]
        spark.createDataFrame(numbers, "part string, at int, value double").coalesce(1).write.parquet(f"{path}/model")
        for name in ("abbreviations", "starters", "lemma"):
            getattr(self, name).write.parquet(f"{path}/{name}")


def learn(paragraphs: DataFrame, rounds: int = 0) -> Language:
    """The language of paragraphs(text): statistics of words, and so many rounds of the tagger's training. The tables are lazy; save() and load() them before using them more than once."""
    short, start = sentences.learnt(paragraphs)
    known = lemmas.vocabulary(paragraphs.select(F.explode(T.alpha_words("text")).alias("word")))
    model = tagging.learn(paragraphs, rounds)[0] if rounds else tagging.PRIOR
    return Language(model, short, start, lemmas.lemma_table(known, lemmas.rules(known)))


def load(spark: SparkSession, path: str) -> Language:
    rows = spark.read.parquet(f"{path}/model").orderBy("part", "at").collect()  # a table of fixed size
    part = lambda name, like: np.array([r["value"] for r in rows if r["part"] == name]).reshape(like.shape)
    model = tagging.Model(part("transition", tagging.PRIOR.transition), part("emission", tagging.PRIOR.emission))
    return Language(model, *(spark.read.parquet(f"{path}/{name}") for name in ("abbreviations", "starters", "lemma")))
