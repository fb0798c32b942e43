"""URL filtering: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .decontam import LOWER, UPPER

# Longest context in characters, and the URLs of a class that a context needs.
ORDER, SUPPORT = 5, 2
# Entries of the models that are sent to the tasks at most; more are joined.
SENT = 400_000
# Parts that a gram, which may occur in every URL, is spread over in that join.
SALTS = 16
# Grams that a task counts before it passes the counts on.
COUNTED = 200_000
# Every fifth URL by hash calibrates the threshold; the others are counted.
FOLDS = 5
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """`verdict` for the URLs of `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _folded(url: Column) -> Column:
    """What the models see of a URL: all of it, with host in lower case and numbers as 0."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    start = F.when(at > 0, F.substring(url, F.lit(1), at + 2)).otherwise("")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.char_length(host) + 1, F.lit(2**31 - 1))
    lower = F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(host)
    return F.regexp_replace(F.concat(start, lower, after), "[0-9]+", "0")


def _fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text = verdict = F.lit(None).cast("string")
    # The last `when` put around the others decides, so the longest comes last.
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of up to ORDER + 1 characters, per class."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g for g, _ in counts], pa.string()),
                pa.array([a for _, a in counts], pa.bool_()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["gram", "allowed", "n"],
        )

    counts: Counter = Counter()
    for batch in batches:
        for name, allowed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = START + name + END
            counts.update(
                (text[i - k : i + 1], allowed)
                for i in range(1, len(text))
                for k in range(min(i, ORDER) + 1)
            )
            if len(counts) > COUNTED:
                yield sent(counts)
                counts = Counter()
    yield sent(counts)


class CharModel:
    """Variable-order Markov model: the longest known context, mixed with all shorter ones."""

    def __init__(self, grams: dict[str, int]):
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in grams.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.grams = grams
        self.known: dict[str, float] = {}

    def log_share(self, gram: str) -> float:
        """Log probability of the last character of `gram` after the others (Witten-Bell)."""
        found = self.known.get(gram)
        if found is None:
            share = 1 / 256
            for k in range(len(gram)):
                part = gram[len(gram) - 1 - k :]
                total = self.total.get(part[:-1])
                if not total:
                    break
                kinds = self.kinds[part[:-1]]
                share = (self.grams.get(part, 0) + kinds * share) / (total + kinds)
            if len(self.known) > COUNTED:
                self.known.clear()
            found = self.known[gram] = math.log(share)
        return found


def _scored(entries: list[tuple[str, bool, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow, block = (
            CharModel({g: n for g, allowed, n in entries if allowed == side})
            for side in (True, False)
        )
        for batch in batches:
            scores = []
            for name in batch.column(0).to_pylist():
                text = START + name + END
                grams = [text[max(0, i - ORDER) : i + 1] for i in range(1, len(text))]
                # An exact sum does not depend on the order, which `_joined` does not keep.
                total = math.fsum(allow.log_share(g) - block.log_share(g) for g in grams)
                scores.append(total / len(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(scores, pa.float64())], ["row", "score"]
            )

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of every name that `_scored` sums over, and how often each occurs."""
    for batch in batches:
        names, grams, times = [], [], []
        for name in batch.column(0).to_pylist():
            text = START + name + END
            seen = Counter(text[max(0, i - ORDER) : i + 1] for i in range(1, len(text)))
            names += [name] * len(seen)
            grams += seen
            times += seen.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(times, pa.int64())],
            ["name", "gram", "times"],
        )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for parts in batch.column(1).to_pylist():
            terms = [math.log(p["a"]) - math.log(p["b"]) for p in parts for _ in range(p["times"])]
            scores.append(math.fsum(terms) / len(terms))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64())], ["name", "score"]
        )


def _joined(names: DataFrame, model: DataFrame) -> DataFrame:
    """`name`, `score` of the distinct `names`, as `_scored` gives them, by joins with `model`.

    The shares of a gram come from those of the gram without its first character,
    so they are made by length: a join key has no more rows than there are characters.
    """
    allowed = F.col("allowed")
    n = F.coalesce(F.sum(F.when(allowed, F.col("n"))), F.lit(0))
    m = F.coalesce(F.sum(F.when(~allowed, F.col("n"))), F.lit(0))
    grams = saved(model.groupBy("gram").agg(n.alias("na"), m.alias("nb")), "url-model")
    context = F.expr("substring(gram, 1, char_length(gram) - 1)")
    contexts = saved(
        model.groupBy(context.alias("context")).agg(
            n.alias("ta"), m.alias("tb"),
            F.count_if(allowed).alias("ka"), F.count_if(~allowed).alias("kb"),
        ),
        "url-contexts",
    )
    found = saved(
        names.mapInArrow(_windows, "name string, gram string, times bigint"), "url-windows"
    )
    parts = found.select("gram").distinct()
    parts = saved(
        parts.select(
            F.explode(F.expr("transform(sequence(1, char_length(gram)), k -> right(gram, k))")).alias("gram")
        ).distinct(),
        "url-parts",
    )
    first = F.lit(1 / 256)
    shares = None
    for size in range(1, ORDER + 2):
        of_size = parts.filter(F.char_length("gram") == size).withColumn("context", context)
        known = of_size.join(grams, "gram", "left").join(contexts, "context", "left")
        if shares is None:
            known = known.withColumn("a", first).withColumn("b", first)
        else:
            shorter = shares.filter(F.char_length("gram") == size - 1).select(
                F.col("gram").alias("end"), "a", "b"
            )
            known = known.join(shorter, F.expr("substring(gram, 2)") == F.col("end"))

        def share(side: str) -> Column:
            count, total, kinds = (F.coalesce(f"{c}{side}", F.lit(0)).cast("double") for c in "ntk")
            before = F.col(side)
            return F.when(total > 0, (count + kinds * before) / (total + kinds)).otherwise(before)

        made = saved(known.select("gram", share("a").alias("a"), share("b").alias("b")), "url-shares")
        shares = made if shares is None else shares.unionByName(made)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    terms = found.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).join(
        shares.withColumn("salt", salts), ["gram", "salt"]
    )
    return saved(
        terms.groupBy("name")
        .agg(F.collect_list(F.struct("a", "b", "times")).alias("parts"))
        .mapInArrow(_summed, "name string, score double"),
        "url-scores",
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A verdict on every URL: the id, `host`, `path`, `rule`, `verdict`, `score`.

    The longest rule that fits decides. The URLs that rules allow or block are the
    accepted and rejected ones that two character models are counted from, over
    the whole table; they see the whole URL, and numbers are one character to them. A URL without a rule is
    allowed if its log-likelihood under the first model less that under the second,
    for its length, reaches a threshold: the one that best separates the ruled
    URLs that were left out of the counts. `score` is that difference, for all URLs.

    Null URLs and those without `://` have an empty host and path, and are judged
    like any other, the former as an empty text. Where rules accept none or reject none, all other URLs are
    allowed, with a null score. Repeated rows get the same verdict each; other
    columns are not looked at. Counts combine before the shuffle. The models hold
    all grams of SUPPORT or more; up to SENT are sent to the tasks, and more are
    joined with the grams of the distinct URLs, with the same result.
    """
    host, path = url_parts(F.col("url"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host.alias("host"), path.alias("path"), _folded(F.col("url")).alias("name")
    )
    rule, verdict = _fitting(rules, F.col("host"), F.col("path"))
    ruled = named.select(
        "id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "name"
    )
    fold = F.pmod(F.xxhash64("name"), F.lit(FOLDS))
    taught = ruled.filter("rule IS NOT NULL").select("name", (F.col("ruled") == "allow").alias("allowed"))
    counts = saved(
        taught.filter(fold != 0)
        .mapInArrow(_counts, "gram string, allowed boolean, n bigint")
        .groupBy("gram", "allowed")
        .agg(F.sum("n").alias("n")),
        "url-grams",
    )
    model = counts.filter((F.char_length("gram") == 1) | (F.col("n") >= SUPPORT))
    n_entries, n_sides = model.agg(F.count(F.lit(1)), F.count_distinct("allowed")).first()
    both = n_sides == 2
    entries: list[tuple[str, bool, int]] = []
    scores = None
    if both and n_entries > SENT:
        scores = _joined(ruled.select("name").distinct(), model)
    elif both:
        entries = [(row["gram"], row["allowed"], row["n"]) for row in model.collect()]

    def with_scores(rows: DataFrame, row_type: str) -> DataFrame:
        """`row`, `score` of a table of `name` and `row`."""
        if scores is None:
            return rows.mapInArrow(_scored(entries), f"row {row_type}, score double")
        return rows.join(scores, "name").select("row", "score")

    threshold = None
    if both:
        # How often each score occurs on either side, in hundredths.
        rows = taught.filter(fold == 0).select("name", F.struct("allowed").alias("row"))
        seen = (
            with_scores(rows, "struct<allowed:boolean>")
            .groupBy("row.allowed", F.round(F.greatest(F.least("score", F.lit(20.0)), F.lit(-20.0)), 2).alias("at"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        threshold = _threshold([(r["allowed"], r["at"], r["n"]) for r in seen])
    row = F.struct("id", "host", "path", "rule", "ruled")
    keyed = ruled.select("name", row.alias("row"))
    id_type = pages.schema[id_col].dataType.simpleString()
    if both:
        judged = with_scores(
            keyed, f"struct<id:{id_type},host:string,path:string,rule:string,ruled:string>"
        )
        by_score = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    else:
        judged = keyed.select("row", F.lit(None).cast("double").alias("score"))
        by_score = F.lit("allow")
    return judged.select(
        F.col("row.id").alias(id_col),
        "row.host",
        "row.path",
        "row.rule",
        F.coalesce("row.ruled", by_score).alias("verdict"),
        "score",
    )


def _threshold(seen: list[tuple[bool, float, int]]) -> float:
    """The score that best separates the two sides, each counting one half; else 0."""
    good = sum(n for allowed, _, n in seen if allowed)
    bad = sum(n for allowed, _, n in seen if not allowed)
    if not good or not bad:
        return 0.0
    sides: dict[float, list[int]] = {}
    for allowed, score, n in seen:
        sides.setdefault(score, [0, 0])[not allowed] += n
    best, at, right, wrong = -1.0, 0.0, 0, 0
    for cut in sorted(sides, reverse=True):
        right, wrong = right + sides[cut][0], wrong + sides[cut][1]
        if right / good - wrong / bad > best:
            best, at = right / good - wrong / bad, cut
    return at
