"""Language of a text: known words first, then character n-grams of falling length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, mix, prefix_hash, rolling_hash, sliced, span_hash

#: The sample that the model learns from: rows of each language at most, about, and rows in all, about.
TRAIN_ROWS, TRAIN_TOTAL = 500, 50_000
#: Parts that a language's rows are dealt to, as one language may hold most of them.
_SALTS = 256
#: A word or n-gram seen less often in a language is dropped there.
LEAST = 2
LONGEST = 5
#: Words looked up together, and numbers added together or held for the texts of a batch, so that memory is bounded.
_TOGETHER, _NUMBERS = 1 << 12, 1 << 21
#: Log frequencies are whole multiples of 1 / _UNIT, so that sums do not depend on their order.
_UNIT = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters in lower case. What the pattern takes besides letters, such as ² and ½, parts them too."""
    found = _LETTERS.findall(text.lower())
    return found if "".join(found).isalpha() else "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def held_out(doc_id: str = "doc_id"):
    """Is crc32 of the id's text, modulo 4, 2? False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the prefixes of ``words`` between spaces, and where each word starts and ends."""
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1)
    return prefix_hash(mix(chars), None), ends - size, ends


def _windows(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of all n-grams of words, with a space on either side."""
    count = np.maximum(ends - starts + 3 - n, 0)
    own = np.repeat(np.arange(len(starts)), count)
    return own, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[own] - 1


def sample(rows: DataFrame, max_rows: int = TRAIN_ROWS, total: int = TRAIN_TOTAL) -> DataFrame:
    """Of ``rows`` (doc_id, text, lang) a sample by a hash of the id: about ``max_rows`` of each language, ``total`` in all.

    However many languages there are, each keeps its share. Null texts, labels and ids are left out; rows that share
    an id and a label stay or go together.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    wanted = sizes.agg(F.sum(F.least(F.lit(max_rows), "_n"))).first()[0] or 0
    share = F.least(F.lit(1.0), F.lit(max_rows * min(1.0, total / max(1, wanted))) / F.col("_n"))
    # ids and labels meet their language's size, dealt apart within it; whole texts stay where they are, as the ids taken are few
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    ids = rows.select("doc_id", "lang", (F.monotonically_increasing_id() % _SALTS).cast("int").alias("_salt")).join(sizes, ["lang", "_salt"])
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "lang").distinct()
    return rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")


def fit(rows: DataFrame, max_rows: int = TRAIN_ROWS, least: int = LEAST, total: int = TRAIN_TOTAL) -> dict:
    """A model from a ``sample`` of labelled ``rows``: what each word and n-gram adds to the log frequencies of its languages.

    Counts are made by Spark, each task summing its own texts first. All words and n-grams that a language's sample has
    ``least`` times stay, of every language; the size of the model is bounded by the sample alone. A word is known by a hash of
    64 bits, and only its languages are held: for the others its log frequency is that of an unseen one (``base``).
    """
    rows = sample(rows, max_rows, total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in sliced(batches, "text"):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(letters(text))
        for lang, counts in seen.items():
            words, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            for at in range(0, len(words), _TOGETHER):
                prefix, starts, ends = _places(words[at : at + _TOGETHER])
                for k in range(LONGEST + 1):
                    own, place = _windows(starts, ends, k) if k else (np.arange(len(starts)), starts)
                    keys, which = np.unique(rolling_hash(prefix, k)[place] if k else span_hash(prefix, starts, ends), return_inverse=True)
                    n = np.bincount(which, times[at : at + _TOGETHER][own], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "size": pa.array(np.full(len(keys), k, np.int8)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    counts = rows.mapInArrow(count, "lang string, size byte, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counts.toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    rank = {x: i for i, x in enumerate(langs)}
    place = np.array([rank[x] for x in names.dictionary.to_pylist()], np.int32)
    lang = place[names.indices.to_numpy()] if len(got) else np.zeros(0, np.int32)
    size, key, n = (got.column(c).to_numpy() for c in ("size", "key", "n"))
    # add-half smoothing, by length for n-grams, so that n-grams of one length share their mass; 0 stands for words
    base = np.zeros((LONGEST + 1, len(langs)))
    tables = []
    for k in range(LONGEST + 1):
        own = size == k
        order = np.lexsort((lang[own], key[own].view(np.uint64)))
        keys, starts = np.unique(key[own].view(np.uint64)[order], return_index=True)
        base[k] = np.rint(_UNIT * np.log(0.5 / (np.bincount(lang[own], n[own], len(langs)) + 0.5 * max(1, len(keys)))))
        tables.append((keys, np.append(starts, own.sum()), lang[own][order], np.log1p(2.0 * n[own][order])))
    return {"langs": langs, "base": base, "tables": tables}


def _spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of ``size`` from ``starts``, one run after the other."""
    return np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)


class Scorer:
    """Texts by a model."""

    def __init__(self, model: dict):
        self.langs, self.base, self.tables = model["langs"], model["base"], model["tables"]

    def _solved(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word its table, how many gains it has, and languages and gains over the table's base, one word after the other.

        A known word has its own; any other the mean over the longest n-grams that the model knows, and table -1 if it knows none.
        """
        prefix, starts, ends = _places(words)
        left, table, found = np.arange(len(words)), np.full(len(words), -1), []
        for k in (0, *range(LONGEST, 0, -1)):
            keys, begin, lang, value = self.tables[k]
            if not len(left) or not len(keys):
                continue
            own, place = _windows(starts[left], ends[left], k) if k else (np.arange(len(left)), starts)
            wanted = (rolling_hash(prefix, k)[place] if len(place) else np.zeros(0, np.uint64)) if k else span_hash(prefix, starts, ends)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            at, own = at[hit], own[hit]
            parts = np.bincount(own, minlength=len(left))
            size = begin[at + 1] - begin[at]
            where, own = _spread(begin[at], size), np.repeat(own, size)
            found.append((left[own], lang[where], np.rint(_UNIT * value[where] / parts[own])))
            table[left[parts > 0]] = k
            left = left[parts == 0]
        own, lang, gain = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(own, kind="stable")
        return table, np.bincount(own, minlength=len(words)), lang[order], gain[order]

    def _sums(self, counts: list[Counter]) -> np.ndarray:
        """Sums of log frequencies of each text by language."""
        wide, index = len(self.langs), {}
        word = np.array([index.setdefault(w, len(index)) for c in counts for w in c], np.int64)
        text = np.repeat(np.arange(len(counts)), list(map(len, counts)))
        times = np.array([n for c in counts for n in c.values()], float)
        order, words = np.argsort(word, kind="stable"), list(index)
        word, text, times = word[order], text[order], times[order]
        total, tables = np.zeros(len(counts) * wide), np.zeros(len(counts) * (LONGEST + 2))
        for first in range(0, len(words), _TOGETHER):
            table, size, lang, gain = self._solved(words[first : first + _TOGETHER])
            begin = np.cumsum(size) - size
            s, e = np.searchsorted(word, [first, first + _TOGETHER])
            tables += np.bincount(text[s:e] * (LONGEST + 2) + table[word[s:e] - first] + 1, times[s:e], len(tables))
            part = np.cumsum(size[word[s:e] - first]) // _NUMBERS
            cuts = [s, *(np.flatnonzero(np.diff(part)) + 1 + s).tolist(), e]
            for a, b in zip(cuts, cuts[1:], strict=False):
                w = word[a:b] - first
                where, n = _spread(begin[w], size[w]), size[w]
                total += np.bincount(np.repeat(text[a:b] * wide, n) + lang[where], gain[where] * np.repeat(times[a:b], n), len(total))
        # whole numbers, so exact in any order below 2^53
        return total.reshape(len(counts), wide) + tables.reshape(len(counts), -1)[:, 1:] @ self.base

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ``und`` and 0.0 for one that is null or without letters, and for a model without languages.

        The score is the predicted language's share after a softmax over the languages' mean log frequency
        for each word, sharpened by up to 20 words. Ties go to the first language in order.
        """
        out = [("und", 0.0)] * len(texts)
        step = max(1, _NUMBERS // max(1, len(self.langs))) if self.langs else len(texts) + 1
        for first in range(0, len(texts) if self.langs else 0, step):
            own = [(i, c) for i, t in enumerate(texts[first : first + step], first) if t and (c := Counter(letters(t)))]
            if not own:
                continue
            n = np.array([c.total() for _, c in own], float)[:, None]
            mean = self._sums([c for _, c in own]) / n / _UNIT
            e = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(n, 20))
            best = mean.argmax(1)
            share = e[np.arange(len(own)), best] / e.sum(1)
            for (i, _), k, x in zip(own, best.tolist(), share.tolist(), strict=True):
                out[i] = self.langs[k], min(1.0, max(0.0, x)) if math.isfinite(x) else 0.0
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """``predict_all`` of one text."""
        return self.predict_all([text])[0]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Add lang_pred and score to ``docs`` from ``text`` alone; columns of these names are replaced.

    Each row is judged alone, a few MB of text at a time. The model, bounded by the sample it was fitted on, goes to the tasks as a broadcast.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in sliced(batches, "text"):
            got = scorer.predict_all(b.column("text").to_pylist())
            arrays = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, extended(docs, lang_pred="string", score="double"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of those that are not held out; a null id is not held out and teaches nothing."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
