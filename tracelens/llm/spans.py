"""10 Substring dedup: sliding spans of sentences.

A text is cut into sentences (after ``.!?`` and a blank, and at line ends; sentences of more than
``MAX_WORDS`` words are cut further, where the words say so). At each sentence starts one span and ends one: the fewest sentences that
are at least ``MIN_SENTENCES`` and have at least ``MIN_WORDS`` words. Spans are compared by a 128-bit digest of their
normalised words. Of the equal spans of the whole corpus the first, by (doc_id, text digest, place), stays;
sentences covered by any other one are removed. Digests are counted with map-side aggregation and joined back
only if they occur twice, by a shuffle at every size, which adaptive execution splits where a digest is hot. A text of fewer sentences or words than a span loses nothing, also if it is repeated whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, cut, digest, discard, table

MIN_SENTENCES, MIN_WORDS, MAX_WORDS = 2, 16, 24
#: Words of the hash that decides on a cut.
AROUND = 2
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
#: Thai to Tibetan, Burmese, Khmer, kana and Chinese characters: text without blanks between words.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD, _LONE = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+"), re.compile(f"[{_UNSPACED}]")


def _tokens(text: str, start: int, stop: int) -> list[tuple[int, str]]:
    """(start, word) of a sentence; in scripts that have no blanks each character is a word."""
    return [(m.start(), m.group()) for m in _WORD.finditer(text, start, stop)]


def _cuts(words: list[str], max_words: int) -> list[int]:
    """Where the pieces of a long sentence start. A piece ends where the hash of the ``AROUND`` words before the cut is the
    least among its neighbours on both sides, so equal passages are cut alike wherever they lie. Pieces that are
    still too long, such as runs of equal words, are cut by number from there."""
    words, reach = [w.lower() for w in words], max(max_words // 8, 1)
    marks = [crc32(" ".join(words[max(k - AROUND, 0) : k]).encode()) for k in range(len(words))]
    n, out = len(words), [0]
    for k in range(AROUND, n):
        left, right = marks[max(k - reach, AROUND) : k], marks[k + 1 : k + 1 + reach]
        if marks[k] < min(left, default=1 << 32) and marks[k] <= min(right, default=1 << 32):
            out.append(k)
    for a, b in zip(list(out), [*out[1:], n]):
        out += range(a + max_words, b, max_words)
    return sorted(out)


def sentences(text: str, max_words: int = MAX_WORDS) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence with words; the ranges follow each other and cover the text but
    for blank lines and blanks at its start."""
    out, at, lone = [], 0, not text.isascii() and _LONE.search(text)
    for stop in [*[m.end() for m in _END.finditer(text)], len(text)]:
        words = text[at:stop].split()
        if words and (len(words) > max_words or lone and _LONE.search(text, at, stop)):
            tokens = _tokens(text, at, stop)
            words = [w for _, w in tokens]
            cuts = _cuts(words, max_words) if len(words) > max_words else [0]
            marks = [at, *(tokens[k][0] for k in cuts[1:]), stop]
            out += [(marks[i], marks[i + 1], words[a:b]) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(words)]))]
        elif words:
            out.append((at, stop, words))
        at = stop
    return out


def spans(parts: list[tuple[int, int, list[str]]], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(first sentence, sentences, normalised text) of every span, in order: for each sentence the shortest run that starts there and
    the shortest that ends there. A repeated run is covered by the spans within it, up to both its ends."""
    texts = [" ".join(w).lower() for _, _, w in parts]
    sizes = [len(w) for _, _, w in parts]
    found, end, words, n = set(), 0, 0, len(parts)
    for first in range(n):
        while end < n and (end - first < min_sentences or words < min_words):
            words += sizes[end]
            end += 1
        if end - first < min_sentences or words < min_words:
            break
        found.add((first, end))
        words -= sizes[first]
    first, words = 0, 0
    for end in range(1, n + 1):
        words += sizes[end - 1]
        while end - first > min_sentences and words - sizes[first] >= min_words:
            words -= sizes[first]
            first += 1
        if end - first >= min_sentences and words >= min_words:
            found.add((first, end))
    for first, end in sorted(found):
        yield first, end - first, "\n".join(texts[first:end])


def _span_rows(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    hashed = xxhash.xxh3_128_digest
    names = ["doc_id", "digest", "h1", "h2", "first", "n"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            at, first, many, keys = [], [], [], []
            for i, t in enumerate(part.column(2)):
                for a, n, s in spans(sentences(t.as_py())):
                    at.append(i)
                    first.append(a)
                    many.append(n)
                    keys.append(hashed(s))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(rows), part.column(1).take(rows), pa.array(both[:, 0]), pa.array(both[:, 1]),
                pa.array(first, pa.int32()), pa.array(many, pa.int32())], names=names)


def _cut_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for t, cover in zip(batch.column(1), batch.column(2)):
            text, cover = t.as_py(), cover.as_py()
            given, text = text, text or ""
            parts = sentences(text)
            gone = {k for c in cover or () for k in range(c["first"], c["first"] + c["n"])}
            if gone:
                keep = [text[: parts[0][0]]] + [text[a:b] for k, (a, b, _) in enumerate(parts) if k not in gone]
                given = "".join(keep)
            rows.append((len(parts), len(gone), sum(len(parts[k][2]) for k in gone), given))
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_sentences", "n_removed", "n_removed_words", "text"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, cover (array of first, n) for the documents that hold a span that isn't the first of its kind. Spans are made
    once; digests are counted with map-side sums, and only the spans whose digest occurs twice are looked at further."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", digest().alias("digest"), blank("text").alias("text"))
    rows = cut(keyed.mapInArrow(_span_rows, f"doc_id {kind}, digest long, h1 long, h2 long, first int, n int"), "spans")
    many = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2"), "many")
    again = cut(rows.join(many, ["h1", "h2"]), "again")
    discard(rows, many)
    place = F.struct("doc_id", "digest", "first")
    lead = cut(again.groupBy("h1", "h2").agg(F.min(place).alias("lead")), "lead")
    later = again.join(lead, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("lead")))
    cover = cut(later.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "n")).alias("cover")), "cover")
    discard(again, lead)
    return cover


def dedup_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_sentences, n_removed (sentences), n_removed_words, text (what stays).

    Null text has no sentences and stays null. Rows that share doc_id and text count as one document and are
    treated alike; null doc_id sorts first. A text that loses all its sentences becomes empty.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = repeated_spans(docs)
    keyed = docs.select("doc_id", digest().alias("digest"), "text")
    on = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest"))
    joined = keyed.alias("d").join(found.alias("f"), on, "left").select("d.doc_id", "d.text", "f.cover")
    return joined.mapInArrow(_cut_rows, f"doc_id {kind}, n_sentences long, n_removed long, n_removed_words long, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
