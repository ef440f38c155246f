"""Language identification, word first, backing off to character n-grams.

Training counts words and, within words (padded with a blank on both sides), character n-grams of
N_MAX down to 1 characters, per language. A known word scores its log frequency in each language. An
unseen word is cut into n-grams: the longest n of which any is known gives the mean log frequency of
the known ones; a word with no known character scores nothing. A text's score is a softmax over the
languages of the summed evidence.

The classifier is fitted on about SAMPLE_PER_LANG documents per language, taken by hash of doc_id,
and keeps the words and n-grams down to the least count at which they are at most WORDS_PER_LANG words
and GRAMS_PER_LANG n-grams per length and language, so the model has a bounded size; prediction reads
every whole text.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the language
first in alphabetical order; with no training rows every text is `und`; repeated rows are each
scored; other columns are ignored."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches

SAMPLE_PER_LANG, WORDS_PER_LANG, GRAMS_PER_LANG, N_MAX, MIN_COUNT = 4000, 20_000, 5000, 4, 2
WORD = re.compile(r"[^\W\d_]+")
#: At most this many words of one text are held at a time.
AT_ONCE = 1 << 20


def letters(found: list[str]) -> list[str]:
    """Runs of letters (Unicode category L) within matches of WORD, which also takes numbers such as a half or a Roman
    numeral; training cuts words in the same way."""
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Model:
    """langs: sorted names. words and grams: text to a row of `table`, log frequencies per language."""

    def __init__(self, langs: list[str], words: dict[str, list[float]], grams: dict[str, list[float]], n_max: int = N_MAX):
        self.langs, self.n_max = langs, n_max
        self.words, self.grams = words, grams

    def evidence(self, word: str) -> list[float] | None:
        """Log frequencies of a word; None if nothing of it is known."""
        if (known := self.words.get(word)) is not None:
            return known
        padded = f" {word} "
        for n in range(min(self.n_max, len(padded)), 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return None


class Scorer:
    """Applies a model to texts; words seen before are looked up by number."""

    CACHE = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        """Row 0 of the table is for words of which nothing is known."""
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))
        self.used = 1

    def number(self, word: str) -> int:
        row = self.model.evidence(word)
        if row is None:
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = row
        self.used += 1
        return self.used - 1

    def sums(self, words: list[str]) -> tuple[np.ndarray, int]:
        if len(self.ids) > self.CACHE:
            self.clear()
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = self.number(w)
        at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        return self.table[at].sum(0), int(np.count_nonzero(at))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text, at most about AT_ONCE at a time."""
        if len(text) <= AT_ONCE:
            yield letters(WORD.findall(text.lower()))
            return
        found = WORD.finditer(text.lower())
        while part := [m.group() for m in islice(found, AT_ONCE)]:
            yield letters(part)

    def predict(self, text: str | None) -> tuple[str, float]:
        total, known, any_word = np.zeros(len(self.model.langs)), 0, False
        if text and self.model.langs:
            for part in self.parts(text):
                if part:
                    any_word = True
                    s, n = self.sums(part)
                    total, known = total + s, known + n
        if not any_word:
            return "und", 0.0
        if not known:
            return self.model.langs[0], 1.0 / len(self.model.langs)
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(p[best] / p.sum())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_PER_LANG, words: int = WORDS_PER_LANG, grams: int = GRAMS_PER_LANG, n_max: int = N_MAX, min_count: int = MIN_COUNT) -> Model:
    """Fit on labelled rows (null languages are left out). What reaches the driver is bounded by the parameters."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, {})
    # hashes below a language's share of the hash range: about `sample` documents, however many there are
    share = F.broadcast(labelled.sparkSession.createDataFrame([(x, min(1.0, sample / n)) for x, n in sizes.items()], "lang string, share double"))
    part = rows.join(share, "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < F.col("share") * (1 << 24))
    counted = part.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("g")).where("g <> ''").groupBy("lang", "g").agg(F.count("*").alias("c"))
    counted = counted.persist()
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("c").alias("n")).collect()}

    def top(df: DataFrame, by: list[str], most: int) -> list:
        """The most frequent of each group, by a least count drawn from how many have each count."""
        often = df.where(F.col("c") >= min_count)
        counts = defaultdict(list)
        for r in often.groupBy(*by, "c").agg(F.count("*").alias("n")).collect():  # the sample is bounded, and so are its counts
            counts[tuple(r[x] for x in by)].append((r.c, r.n))
        least = []
        for group, found in counts.items():
            held, cut = 0, max(c for c, _ in found) + 1
            for c, n in sorted(found, reverse=True):
                held += n
                if held > most:
                    break
                cut = c
            least.append((*group, cut))
        if not least:
            return []
        bound = F.broadcast(df.select(*by).limit(0).sparkSession.createDataFrame(least, df.select(*by).schema.add("least", "long")))
        return often.join(bound, by).where(F.col("c") >= F.col("least")).select(*by, "g", "c").collect()

    langs = sorted(sizes)
    place = {x: i for i, x in enumerate(langs)}

    def as_logs(found: list, total: dict) -> dict[str, list[float]]:
        floor = {x: float(np.log(0.5 / max(1, total.get(x, 0)))) for x in langs}
        out: dict[str, list[float]] = {}
        for r in found:
            out.setdefault(r.g, [floor[x] for x in langs])[place[r.lang]] = float(np.log(r.c / total[r.lang]))
        return out

    known = as_logs(top(counted, ["lang"], words), totals)
    pad = F.concat(F.lit(" "), "g", F.lit(" "))

    def cut(n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(pad) - n + 1), lambda i: F.substring(pad, i, F.lit(n)))
        return F.when(F.length(pad) >= n, pieces).otherwise(F.array().cast("array<string>"))

    cuts = F.flatten(F.array(*map(cut, range(1, n_max + 1))))
    pieces = counted.select("lang", "c", F.explode(cuts).alias("g")).groupBy("lang", "g").agg(F.sum("c").alias("c")).withColumn("n", F.length("g")).persist()
    per = {(r.lang, r.n): r.c for r in pieces.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    found = top(pieces, ["lang", "n"], grams)
    tables: dict[str, list[float]] = {}
    for n in range(1, n_max + 1):
        tables |= as_logs([r for r in found if r.n == n], {x: per.get((x, n), 0) for x in langs})
    counted.unpersist()
    pieces.unpersist()
    return Model(langs, known, tables, n_max)


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with lang_pred and score appended (columns of those names are replaced)."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.words, model.grams, model.n_max))
    base = documents.drop("lang_pred", "score")
    schema = StructType([*base.schema.fields]).add("lang_pred", "string").add("score", "double")
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for b in batches:
            out = [scorer.predict(t.as_py()) for t in b.column(place)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)




def keep_identified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """documents, same columns, without those of no language (`und`) or scored below `least`; a null lang is filled in."""
    marked = predict(documents.withColumnsRenamed({c: f"__{c}" for c in documents.columns if c in ("lang_pred", "score")}), model)
    kept = marked.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    if "lang" in documents.columns:
        kept = kept.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"}).select(*documents.columns)
