"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A word is cross-parsed against it: the
longest match from where the last phrase ended is the next phrase (a letter that matches nothing is a
phrase). The fewer phrases a text needs, the better the language explains it; phrases are normalised to
bits a letter, phrases * log2(training letters) / letters, which is the cross-parsing entropy estimate. Each
language's letters are its own; fewer than ``LEAST`` count as that many, since a phrase found in next to no
text would cost next to nothing. So no language's text changes what another makes of a document. The language of the least wins; ties, which short texts have, go to the language of more training rows.

Words are runs of letters (Unicode's letter categories alone: no number signs) in lower case with a mark at
either end, so a match knows where words start and stop. A word's phrase counts depend on nothing else, and
each task keeps them for the words it has met, up to ``WORDS`` of them. All letters of a text count, at any
length.

The model is fitted on a bounded sample, whose bounds are parameters: for each language the ``SAMPLE``
training rows of smallest hash of the id, and of each row up to ``ROOM`` letters, from a place in its whole
text that the hash gives; ``LETTERS`` letters of a language at most. Where a language's rows leave it short of
``LETTERS``, rows that have letters are taken in the same order until it isn't, or there are no more. All
languages are sampled at once: their ids from the two small columns, then those rows' texts.

Edge cases: null text, or one without letters: ``und`` with score 0; a null language or id teaches nothing; a
table without labelled rows predicts ``und`` everywhere; one language alone wins with score 1; of several
texts of one id and language the least one teaches; repeated rows each get their prediction; an empty table
gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import functools
import math
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, col, resident, table, texts

SAMPLE = 96
LETTERS = 60_000
ROOM = 2_500
LEAST = 1_000
WORDS = 200_000
#: The pipeline's stage rejects a text that needs more phrases than this for each letter and mark: it is
#: like none of the languages, nearly every letter being a phrase of its own.
STRANGE = 0.8

_MARK = " "


@functools.cache
def _words():
    """Runs of letters: of what the expression \\w takes, all but digits, the underscore and signs that are
    numbers and no letters, of which a class is made here."""
    signs = [i for i in range(sys.maxunicode + 1) if (c := chr(i)).isalnum() and not c.isalpha()]
    ends = [i for i, n in zip(signs, [*signs[1:], -1]) if n != i + 1]
    starts = [i for i, n in zip(signs, [-2, *signs[:-1]]) if n != i - 1]
    return re.compile("[^\\W_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]+").findall


def words_of(text: str) -> list[str]:
    return _words()(text.lower())


class SuffixAutomaton:
    """All substrings of a text. State 0 is the start; next[state] has the letters that go on from it, so
    memory follows the text, however many letters its script has."""

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            nxt.append({})
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    nxt.append(nxt[q].copy())
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def phrases(self, word: str) -> int:
        """How many phrases the word is cut into, each the longest match from where the last ended; a letter
        never seen is a phrase of its own."""
        nxt = self.next
        start = state = nxt[0]
        n = 0
        for c in word:
            to = state.get(c) if state is not start else None
            if to is None:
                n += 1
                to = start.get(c, 0)
            state = nxt[to]
        return n


class CrossParser:
    """Languages' automata, each of its own text, and the phrase counts of words met. Of languages that
    explain a text equally well the one given first wins."""

    def __init__(self, samples: dict[str, str], letters: int = LETTERS, words: int = WORDS):
        kept = {lang: x for lang, x in samples.items() if x.strip()}
        self.langs = list(kept)
        self.bits = [math.log2(max(LEAST, min(letters, len(x)))) for x in kept.values()]
        self.automata = [SuffixAutomaton(x[:letters]) for x in kept.values()]
        self.most, self.known, self.counts = words, {}, []

    def _learn(self, new: list[str]) -> None:
        import numpy as np

        rows = []
        for w in new:
            marked = _MARK + w + _MARK
            self.known[w] = len(self.known)
            rows.append([a.phrases(marked) for a in self.automata])
        grown = np.array(rows, np.int32).reshape(len(rows), len(self.automata))
        self.counts = grown if not len(self.counts) else np.concatenate((self.counts, grown))

    def predict(self, items: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, phrases for each letter and mark) of each text. The score is the margin:
        1 - best bits / second best bits."""
        import numpy as np

        found = [words_of(x) for x in items]
        if not self.langs:
            return [("und", 0.0, 0.0)] * len(items)
        if len(self.known) > self.most:
            self.known, self.counts = {}, []
        new = {w for ws in found for w in ws if w not in self.known}
        if new:
            self._learn(sorted(new))
        out, at = [], self.known.__getitem__
        for ws in found:
            if not ws:
                out.append(("und", 0.0, 1.0))
                continue
            total = self.counts[np.fromiter(map(at, ws), np.int64, len(ws))].sum(0, dtype=np.int64)
            letters = sum(map(len, ws))
            bits = total * np.array(self.bits) / letters
            order = np.argsort(bits, kind="stable")
            best = float(bits[order[0]])
            out.append((self.langs[order[0]], 1.0 - best / float(bits[order[1]]) if len(order) > 1 else 1.0, float(total[order[0]]) / (letters + 2 * len(ws))))
        return out


def parser(samples: dict[str, str]) -> CrossParser:
    return resident(("langid", hash(tuple(samples.items()))), lambda: CrossParser(samples))


def held_out(id_column: str) -> "F.Column":
    """True for rows that teach nothing: crc32 of the id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(col(id_column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, letters: int = LETTERS, room: int = ROOM) -> dict[str, str]:
    """Normalised training text by language, most rows first, at most letters of each and room of a row: the
    bounded sample on the driver."""
    named = docs.select(col(id_column).cast("string").alias("i"), col(lang_column).cast("string").alias("lang"), col(text_column).cast("string").alias("text"), held_out(id_column).alias("out"))
    rows = named.where("lang IS NOT NULL AND i IS NOT NULL AND NOT out").select("lang", "i", F.xxhash64("i").alias("h"), "text")
    names = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not names:
        return {}
    whole = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", _MARK))
    spare = F.greatest(F.lit(0), F.length("t") - room)
    # a window of the whole text, cut back to whole words at its start
    at = F.when(spare > 0, F.pmod(F.col("h"), spare + 1)).otherwise(0)
    window = F.trim(F.when(at > 0, F.regexp_replace(F.substr("t", at + 1, F.lit(room)), r"^[^ ]* ", "")).otherwise(F.substr("t", at + 1, F.lit(room))))
    windows = lambda df: df.withColumn("t", whole).withColumn("t", window).where("t <> ''").select("lang", "i", "h", "t")
    first = W.partitionBy("lang").orderBy("h", "i")
    # a bounded top of each language, cut down in each task before the shuffle; of two small columns
    picked = rows.select("lang", "i", "h").withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).select("lang", "i").distinct()
    got: dict[str, list[tuple]] = {}

    def take(found: DataFrame) -> None:
        once = found.groupBy("lang", "h", "i").agg(F.min("t").alias("t"))
        for r in once.collect():
            got.setdefault(r["lang"], []).append((r["h"], r["i"], r["t"]))

    take(windows(rows.join(F.broadcast(picked), ["lang", "i"], "left_semi")))
    size = lambda lang: sum(len(t) + 1 for _, _, t in got.get(lang, [])) + 1
    short = [lang for lang, count in names.items() if size(lang) < letters and count > sample]
    if short:  # rows without letters, or of few: all rows in order, as far as their letters are asked for
        for lang in short:
            got.pop(lang, None)
        upto = F.sum(F.length("t") + 1).over(first.rowsBetween(W.unboundedPreceding, -1))
        more = windows(rows.where(F.col("lang").isin(short))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= letters)
        take(more.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < letters))
    return {lang: (_MARK + _MARK.join(t for _, _, t in sorted(got[lang])) + _MARK)[:letters] for lang in names if lang in got}


def predict(docs: DataFrame, samples: dict[str, str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    def run(batches):
        import pyarrow as pa

        model = parser(samples)
        for batch in batches:
            said = model.predict(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in said], pa.string()), pa.array([y for _, y, _ in said], pa.float64())], ["id", "lang_pred", "score"])

    return arrow_map(docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text")), run, "id long, lang_pred string, score double", model=True)


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The documents whose language can be told, columns as they came: those that are ``und`` or like
    none of the languages (STRANGE) go; without labelled rows none can be told, and none goes. The decision
    rides along with the row, so nothing is joined."""
    samples = training_sample(docs, id_column, text_column, lang_column)
    at, names = docs.columns.index(text_column), docs.columns

    def run(batches):
        import pyarrow as pa

        model = parser(samples)
        for batch in batches:
            said = model.predict(texts(batch.column(at)))
            kept = batch.filter(pa.array([x != "und" and z <= STRANGE for x, _, z in said], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names)

    return arrow_map(docs, run, docs.schema, model=True) if samples else docs


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    said = predict(docs, training_sample(docs))
    return said.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
