"""Language identification: known words first, then shorter and shorter n-grams.

A word is a run of letters in lower case. A word met in training is scored by its log
frequency in each language. Any other word is scored by its character 4-grams that were
met, with marks for the word's ends; if none was met by its 3-grams, and so on down to
single letters. A document's score is the sum over its words.

Training takes at most about ``sample_rows`` labelled rows, chosen by a hash of their
text, and keeps the ``most_words`` most frequent words; both bounds are parameters and
bound the model that tasks receive. Prediction covers every row and whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text
if nothing was learned; letters never met leave the languages' shares in training to
decide; ties go to the language first in the alphabet; repeated rows get equal results;
an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import batches, column
from .tables import materialize

SAMPLE_ROWS = 8_000
MOST_WORDS = 100_000
LONGEST_GRAM = 4
UNKNOWN = "und"
#: Unseen words whose scores a task keeps.
KEEP_WORDS = 100_000
#: Text bytes scored at once; a word takes a row of scores.
SLICE = 2 << 20


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: pa.Array
    word_scores: np.ndarray
    #: n-gram -> row of ``gram_scores``
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unseen word by the longest n-grams of it that were met."""
        marked = f"^{word}$"
        for n in range(LONGEST_GRAM, 0, -1):
            found = [self.grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in self.grams]
            if found:
                return self.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.languages))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a third of the documents, by the CRC-32 of their id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _log_share(counts: dict[tuple[str, str], int], keys: list[str], languages: list[str]) -> np.ndarray:
    """Log frequency per language, with half a count added everywhere."""
    index = {k: i for i, k in enumerate(keys)}
    table = np.full((len(keys), len(languages)), 0.5)
    for (language, key), n in counts.items():
        table[index[key], languages.index(language)] += n
    return np.log(table / table.sum(axis=0)) if len(keys) else table


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, most_words: int = MOST_WORDS) -> Model:
    """Learns from ``text`` and ``lang`` of the rows where both are given."""
    rows = labelled.filter("text is not null and lang is not null")
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    rows = rows.filter(place < F.lit(int(share * (1 << 30)))) if share < 1 else rows
    rows = rows.select("lang", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")).alias("words"))
    words = materialize(rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count())
    prior = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    languages = sorted(prior)
    top = words.groupBy("word").agg(F.sum("count").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(most_words)
    known = {(r["lang"], r["word"]): r["count"] for r in words.join(top, "word").select("lang", "word", "count").collect()}
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    pieces = F.flatten(
        F.array(
            *[
                F.expr(
                    f"transform(sequence(1, greatest(length(w) - {n - 1}, 1)), i -> substring(w, i, {n}))"
                )
                for n in range(1, LONGEST_GRAM + 1)
            ]
        )
    )
    grams = words.select("lang", marked.alias("w"), "count").select("lang", F.explode(pieces).alias("gram"), "count")
    grams = grams.groupBy("lang", "gram").agg(F.sum("count").alias("n"))
    common = grams.groupBy("gram").agg(F.sum("n").alias("t")).filter("t > 1").orderBy(F.desc("t"), "gram").limit(2 * most_words)
    met = {(r["lang"], r["gram"]): r["n"] for r in grams.join(common, "gram").select("lang", "gram", "n").collect()}
    word_list = sorted({w for _, w in known})
    gram_list = sorted({g for _, g in met})
    # Each length of n-gram has frequencies of its own.
    scores = np.zeros((len(gram_list), len(languages)))
    for n in range(1, LONGEST_GRAM + 1):
        own = [i for i, g in enumerate(gram_list) if len(g) == n]
        keys = [gram_list[i] for i in own]
        wanted = set(keys)
        if own:
            scores[own] = _log_share({k: v for k, v in met.items() if k[1] in wanted}, keys, languages)
    share_of = np.array([prior[x] for x in languages], float)
    return Model(
        languages,
        np.log(share_of / share_of.sum()) if len(languages) else share_of,
        pa.array(word_list, pa.large_string()),
        _log_share(known, word_list, languages),
        {g: i for i, g in enumerate(gram_list)},
        scores,
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``doc_id, text`` and more) with ``lang_pred`` and ``score`` added.

    Columns of ``docs`` with one of these names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    names = docs.columns

    def score(frames):
        own = shared.value
        unseen: dict[str, np.ndarray] = {}
        count = len(own.languages)

        def backoff(word: str) -> np.ndarray:
            found = unseen.get(word)
            if found is None:
                if len(unseen) > KEEP_WORDS:
                    unseen.clear()
                found = unseen[word] = own.backoff(word)
            return found

        for rows, _, _ in batches(frames, "text", SLICE):
            text = pc.utf8_lower(column(rows, "text").cast(pa.large_string()).fill_null(""))
            pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(text, r"\P{L}+", " "))
            bounds = np.asarray(pieces.offsets)
            table = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
            bounds = bounds - bounds[0]
            distinct, at = table.dictionary, np.asarray(table.indices)
            scores = np.zeros((len(distinct), max(count, 1)))
            real = np.asarray(pc.binary_length(distinct)) > 0 if len(distinct) else np.zeros(0, bool)
            if count and len(distinct):
                where = pc.index_in(distinct, value_set=own.words).fill_null(-1).to_numpy(zero_copy_only=False)
                known = where >= 0
                scores[known] = own.word_scores[where[known]]
                for i in np.flatnonzero(~known & real).tolist():
                    scores[i] = backoff(distinct[i].as_py())
            weight = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[at], axis=0)])
            n = np.concatenate([[0], np.cumsum(real[at])])
            total = weight[bounds[1:]] - weight[bounds[:-1]]
            n = n[bounds[1:]] - n[bounds[:-1]]
            if count:
                total = total + own.prior
                best = total.argmax(axis=1)
                # Words are not independent, so the margin grows with the root of their number.
                margin = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                chance = 1 / np.exp(margin).sum(axis=1)
            sure = (n > 0) & (count > 0)
            languages = [own.languages[b] if ok else UNKNOWN for b, ok in zip(best, sure)] if count else [UNKNOWN] * len(n)
            chance = np.where(sure, chance, 0.0) if count else np.zeros(len(n))
            arrays = [rows.column(i) for i in range(rows.num_columns)]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(languages, pa.string()), pa.array(chance)], names + ["lang_pred", "score"]
            )
        pa.default_memory_pool().release_unused()

    from pyspark.sql import types as T

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(score, T.StructType(docs.schema.fields + added))


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text, held_out, lang_pred, score``; learns from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = train(rows.filter(~held_out() & F.col("doc_id").isNotNull()), **options)
    return predict(rows.select("doc_id", "text", held_out().alias("held_out")), model)
