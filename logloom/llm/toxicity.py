"""Toxicity: a weighted lexicon, matched by Aho-Corasick on texts with their disguises undone."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .quality import held_out, logistic

# Labelled documents that the lexicon is learned from, at most: those whose ids
# have the smallest hashes.
MAX_LABELLED = 20_000
# Entries of a lexicon, at most; those of the largest weight stay.
MAX_ENTRIES = 5_000
# An entry needs so many different contexts in toxic texts, and so many nats of log odds.
CONTEXTS, LEAST_ODDS, MOST_ODDS = 3, 3.0, 8.0
# Lengths of word stems, the words that must share one, and the share of a
# shorter stem's support at which the longer one takes its place.
STEMS, STEM_WORDS, SAME_SUPPORT = (4, 5, 6, 7), 5, 0.95
# Accents that a text may have in all, or per hundred characters, to count as disguise.
FEW_ACCENTS = 2

# Letters of other scripts, and digits, that pass for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ϲ": "c",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, **dict.fromkeys(_HIDDEN, "")})
_ASCII_TABLE = str.maketrans(DIGITS)
_MARKS = re.compile("[\u0300-\u036f]")
# A sign stands for a letter only in front of one: "!!" after a word is no disguise.
_SIGN = re.compile(r"[@$!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def folded_words(text: str) -> list[str]:
    """Words in lower case without homoglyphs, digits and signs for letters.

    Accents are part of a language that uses them, and a disguise in one that does
    not: they go where few letters of the text have one.
    """
    if text.isascii():
        text = text.lower().translate(_ASCII_TABLE)
    else:
        text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
        apart = unicodedata.normalize("NFD", text)
        accents = len(_MARKS.findall(apart))
        if 0 < accents <= max(FEW_ACCENTS, FEW_ACCENTS * len(text) / 100):
            text = _MARKS.sub("", apart)
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return _WORD.findall(text)


@dataclass(frozen=True)
class Lexicon:
    """Weights of patterns over folded words joined and surrounded by one space.

    ` word ` matches a whole word and ` stem` the start of one. Phrases in
    `exceptions` cancel the matches inside them.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    #: Of the logistic score: for the measured hits and a constant.
    model: tuple[float, ...] = (0.0, 0.0, -30.0)

    def matcher(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            automaton.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            pattern = f" {' '.join(folded_words(phrase))} "
            automaton.add_word(pattern, (len(pattern), None))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    @staticmethod
    def measured(automaton: ahocorasick.Automaton, text: str) -> tuple[float, float]:
        """Two measures of the hits: their weight, and their weight for the length of the text."""
        words = folded_words(text)
        if not words or not len(automaton):
            return 0.0, 0.0
        hits: dict[int, float] = {}
        allowed: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                allowed.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        total = sum(
            w for at, w in hits.items() if not any(a <= at < b for a, b in allowed)
        )
        return math.log1p(total), math.log1p(100 * total / len(words))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the texts that have them: toxic ones once per context, clean ones in sum."""
    for batch in batches:
        words, contexts, toxic_texts = [], [], []
        clean: Counter[str] = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = folded_words(text or "")
            if not toxic:
                clean.update(set(found))
                continue
            framed = ["", *found, ""]
            new = set(found)
            for before, word, after in zip(framed, found, framed[2:]):
                words.append(word)
                contexts.append(xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1)
                toxic_texts.append(int(word in new))
                new.discard(word)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*words, *clean], pa.string()),
                pa.array([*contexts, *[None] * len(clean)], pa.int64()),
                pa.array([*toxic_texts, *[0] * len(clean)], pa.int64()),
                pa.array([*[0] * len(words), *clean.values()], pa.int64()),
            ],
            ["word", "context", "toxic", "clean"],
        )


def learned_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    exceptions: Sequence[str] = (),
    max_labelled: int = MAX_LABELLED,
) -> Lexicon:
    """Words and word stems that tell toxic texts from others, with their log odds.

    Support is the number of texts, and at most that of different contexts in toxic
    ones: the two neighbours of a word. So a text that was copied counts once. Labels of held-out documents are
    not read; at most `max_labelled` labelled documents are.
    """
    known = (
        labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
        .filter(F.col("label").isNotNull() & F.col("label_id").isNotNull() & ~held_out("label_id"))
        .groupBy("label_id")
        .agg((F.max("label") == 1).alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_labelled)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(known), F.col("id") == F.col("label_id")
    )
    by_label = {
        bool(row["toxic"]): row["n"]
        for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    n_toxic, n_clean = by_label.get(True, 0), by_label.get(False, 0)
    words = saved(
        sample.select("text", "toxic")
        .mapInArrow(_seen, "word string, context bigint, toxic bigint, clean bigint")
        .groupBy("word")
        .agg(
            F.least(F.count_distinct("context"), F.sum("toxic")).alias("toxic"),
            F.sum("clean").alias("clean"),
        ),
        "toxic-words",
    )
    # A word counts if chance would give one like it less than once in ten lexicons.
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    surprise = math.log(10 * max(words.filter("toxic > 0").count(), 1))

    def surprising(toxic: str, clean: str):
        """Log likelihood ratio of a word's own share of toxic texts to that of all texts."""
        t, c = F.col(toxic).cast("double"), F.col(clean).cast("double")
        gain = F.when(t > 0, t * F.log(t / ((t + c) * share))).otherwise(0.0) + F.when(
            c > 0, c * F.log(c / ((t + c) * (1 - share)))
        ).otherwise(0.0)
        return gain >= surprise

    def odds(toxic: str, clean: str):
        return F.log((F.col(toxic) + 0.5) / (n_toxic + 1)) - F.log(
            (F.col(clean) + 0.5) / (n_clean + 1)
        )

    whole = words.filter(
        (F.col("toxic") >= CONTEXTS)
        & (odds("toxic", "clean") >= LEAST_ODDS)
        & surprising("toxic", "clean")
    ).select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "toxic", "clean", F.lit(1).alias("n"))
    lengths = F.array(*[F.lit(n) for n in STEMS])
    stems = (
        words.select("word", "toxic", "clean", F.explode(lengths).alias("length"))
        .filter(F.char_length("word") > F.col("length"))
        .groupBy(F.concat(F.lit(" "), F.substring("word", F.lit(1), F.col("length"))).alias("entry"))
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("n"))
        .filter(
            (F.col("toxic") >= CONTEXTS)
            & (F.col("n") >= STEM_WORDS)
            & (odds("toxic", "clean") >= LEAST_ODDS)
            & surprising("toxic", "clean")
        )
    )
    entries = (
        whole.unionByName(stems)
        .select("entry", "toxic", "clean", odds("toxic", "clean").alias("odds"))
        .orderBy(F.desc("odds"), "entry")
        .limit(MAX_ENTRIES)
        .collect()
    )
    support = {row["entry"]: row["toxic"] for row in entries}
    weights = {}
    for row in entries:
        entry = row["entry"]
        if not entry.endswith(" "):
            longer = [e for e in support if len(e) > len(entry) and e.startswith(entry) and e[-1] != " "]
            if any(support[e] >= SAME_SUPPORT * support[entry] for e in longer):
                continue
        weights[entry] = min(row["odds"], MOST_ODDS)
    lexicon = Lexicon(weights, tuple(exceptions))
    if not weights or not n_clean:
        return lexicon

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            found = [lexicon.measured(automaton, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for a, _ in found], pa.float64()),
                    pa.array([b for _, b in found], pa.float64()),
                    batch.column(1),
                ],
                ["a", "b", "toxic"],
            )

    seen = (
        sample.select("text", "toxic")
        .mapInArrow(measure, "a double, b double, toxic boolean")
        .groupBy(F.round("a", 1).alias("a"), F.round("b", 1).alias("b"), "toxic")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    x = np.array([[row["a"], row["b"], 1.0] for row in seen])
    y = np.array([float(row["toxic"]) for row in seen])
    n = np.array([float(row["n"]) for row in seen])
    model = np.zeros(3)
    ridge = np.diag([0.5, 0.5, 0.0])
    for _ in range(30):
        p = logistic(x @ model)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3)
        model = model - np.linalg.solve(hessian, x.T @ (n * (p - y)) + ridge @ model)
    return Lexicon(weights, tuple(exceptions), tuple(float(v) for v in model))


def toxicity_scores(
    docs: DataFrame,
    lexicon: Lexicon,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """Toxicity of every whole text: the id, `held_out`, `score`, `predicted`. No shuffle.

    Look-alike letters of other scripts, digits and signs that stand for letters,
    and odd accents are folded first. The score is a logistic function of the weight of all
    hits, as it is and for the length of the text; hits inside exception phrases do
    not count. Null and empty texts, and those without a hit, get the lowest score.
    Repeated rows get the same score. Other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    model = lexicon.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            found = [lexicon.measured(automaton, t or "") for t in batch.column(1).to_pylist()]
            x = np.array(found, np.float64).reshape(len(found), 2)
            scores = logistic(x @ np.array(model[:2]) + model[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["id", "score"]
            )

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, score double"
    )
    return scored.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
