"""5 Quality rules: a linear-chain conditional random field over lines.

Each line with a word gets a few yes/no features; the chain has two states, content and boilerplate. Its
weights are fitted here, by gradient ascent on the exact log-likelihood (forward-backward), to at most
``MAX_TRAINING_DOCS`` labelled documents, chosen by digest of doc_id. A line takes its document's label; and as the labels say
nothing of where states change inside a document, each good document is also trained on with a bad one set into its middle, and the other way
round, every line with the label of where it is from. Viterbi decoding marks the lines of every document; a document stays if
content lines hold at least ``MIN_CONTENT_SHARE`` of its word characters and the base rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, table

#: The bound of the training sample, in documents.
MAX_TRAINING_DOCS = 2000
#: A doc_id may stand in several rows; training reads up to this many rows for each of ``MAX_TRAINING_DOCS``, whole, in an order of digests.
ROWS_PER_DOC = 4
#: Lines, padded, of the training documents that are worked on at once; it bounds memory, not what is learned from.
BLOCK_LINES = 100_000
MIN_CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
ROUNDS, STEP, RIDGE = 80, 0.25, 1e-3

BLANKS, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
UPPER, DIGITS, ENDS = bytes(range(65, 91)), b"0123456789", (b".", b"!", b"?", b":", b'"', b")")
FEATURES = (
    "bias", "one_word", "short", "long", "symbols_some", "symbols_many", "shouting", "few_different", "very_few_different",
    "seen_before", "digits", "no_end_mark", "exclaims", "long_words", "first", "last", "web", "same_neighbours",
)


def line_features(lines: list[bytes]) -> tuple[list[list[int]], list[int]]:
    """The numbers of the features that hold, and the word characters (bytes), for each line with a word."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, packed = len(words), line.translate(None, BLANKS)
        size, on = len(packed), [0]
        kinds = len(set(words))
        symbols = size - len(packed.translate(None, SYMBOLS))
        if n == 1:
            on.append(1)
        if n < 5:
            on.append(2)
        if n > 40:
            on.append(3)
        if symbols > 0.03 * size:
            on.append(4)
        if symbols > 0.12 * size:
            on.append(5)
        if size - len(packed.translate(None, UPPER)) > 0.5 * size:
            on.append(6)
        if n >= 6 and kinds < 0.6 * n:
            on.append(7)
        if n >= 6 and kinds < 0.35 * n:
            on.append(8)
        if line in seen:
            on.append(9)
        if size - len(packed.translate(None, DIGITS)) > 0.2 * size:
            on.append(10)
        if not line.rstrip().endswith(ENDS):
            on.append(11)
        if line.count(b"!") > 0.2 * n + 1:
            on.append(12)
        if size > 14 * n:
            on.append(13)
        if not rows:
            on.append(14)
        if b"http" in line or b"www." in line or b"@" in line:
            on.append(16)
        if n >= 4 and sum(map(bytes.__eq__, words, words[1:])) > 0.2 * n:
            on.append(17)
        seen.add(line)
        rows.append(on)
        sizes.append(size)
    if rows:
        rows[-1].append(15)
    return rows, sizes


def spliced(docs: list[tuple[list[list[int]], list[int]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Documents (feature rows, states) of which the states change: one set into the middle of another of the other state."""
    good, bad = ([d for d in docs if d[1][0] == s] for s in (0, 1))
    out = []
    for pair in zip(good, bad):
        for (outer, y), (inner, z) in (pair, pair[::-1]):
            h = len(outer) // 2
            out.append((outer[:h] + inner + outer[h:], y[:h] + z + y[h:]))
    return out


class Chain:
    """State 0 is content, 1 is boilerplate. ``emit``: features x 2, ``move``: 2 x 2."""

    def __init__(self, emit=None, move=None):
        self.emit = np.zeros((len(FEATURES), 2)) if emit is None else np.asarray(emit, float)
        self.move = np.zeros((2, 2)) if move is None else np.asarray(move, float)

    def fit(self, docs: list[tuple[list[list[int]], int]]) -> Chain:
        """docs: (feature rows, label) with label 1 for good documents. Both labels count the same in total."""
        plain = [(rows, [0 if good else 1] * len(rows)) for rows, good in docs if rows]
        per = [sum(y[0] == s for _, y in plain) for s in (0, 1)]
        if not all(per):
            return self
        given = [(rows, y, len(plain) / 2 / per[y[0]]) for rows, y in plain] + [(*d, 1.0) for d in spliced(plain)]
        given.sort(key=lambda d: len(d[0]))
        blocks, lo, n = [], 0, len(given)
        for hi in range(1, n + 1):
            if hi == n or (hi + 1 - lo) * len(given[hi][0]) > BLOCK_LINES:
                blocks.append(self.block(given[lo:hi]))
                lo = hi
        squares = [1e-8, 1e-8]
        for _ in range(ROUNDS):
            up, side = -RIDGE * self.emit, -RIDGE * self.move
            for flat, on, weight, gold, moves_gold in blocks:
                node, pair = self.marginals(flat, on.shape, on)
                up += (flat.T @ ((gold - node) * weight[..., None]).reshape(-1, 2)) / n
                side += (moves_gold - np.einsum("nkij,n->ij", pair, weight[:, 0])) / n
            for i, (w, g) in enumerate(((self.emit, up), (self.move, side))):
                squares[i] = squares[i] + g * g
                w += STEP * g / np.sqrt(squares[i])
        return self

    @staticmethod
    def block(docs):
        """Features, which lines there are, weights and what the labels say, for documents of similar length."""
        n, t = len(docs), max(len(rows) for rows, *_ in docs)
        x, on, gold = np.zeros((n, t, len(FEATURES))), np.zeros((n, t)), np.zeros((n, t, 2))
        for i, (rows, y, _) in enumerate(docs):
            on[i, : len(rows)] = 1
            gold[i, np.arange(len(rows)), y] = 1
            for k, r in enumerate(rows):
                x[i, k, r] = 1
        weight = np.array([w for *_, w in docs])[:, None] / on.sum(1, keepdims=True)
        moves_gold = np.einsum("nti,ntj,n->ij", gold[:, :-1], gold[:, 1:], weight[:, 0])
        return x.reshape(-1, len(FEATURES)), on, weight, gold, moves_gold

    def marginals(self, flat, shape, on):
        n, t = shape
        e = (flat @ self.emit).reshape(n, t, 2)
        f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        f[:, 0] = e[:, 0]
        for k in range(1, t):
            step = np.logaddexp(f[:, k - 1, 0, None] + self.move[0], f[:, k - 1, 1, None] + self.move[1]) + e[:, k]
            f[:, k] = np.where(on[:, k, None] > 0, step, f[:, k - 1])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        for k in range(t - 2, -1, -1):
            after = b[:, k + 1] + e[:, k + 1]
            step = np.logaddexp(self.move[:, 0] + after[:, 0, None], self.move[:, 1] + after[:, 1, None])
            b[:, k] = np.where(on[:, k + 1, None] > 0, step, b[:, k + 1])
        node = np.exp(f + b - z[:, None, None]) * on[..., None]
        pair = np.exp(f[:, :-1, :, None] + self.move + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        return node, pair

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely states; ties go to content."""
        emit, ((a, b), (c, d)) = self.emit.tolist(), self.move.tolist()
        back, p, q = [], 0.0, 0.0
        for k, row in enumerate(rows):
            e0 = e1 = 0.0
            for i in row:
                e0 += emit[i][0]
                e1 += emit[i][1]
            if k:
                stay, back_to = p + a >= q + c, p + b >= q + d
                back.append((0 if stay else 1, 0 if back_to else 1))
                p, q = (p + a if stay else q + c) + e0, (p + b if back_to else q + d) + e1
            else:
                p, q = e0, e1
        state = 0 if p >= q else 1
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]

    def content_share(self, text: bytes) -> float:
        """Share of word characters (bytes) on content lines; 0 without words."""
        rows, sizes = line_features(text.split(b"\n"))
        total = sum(sizes)
        return sum(s for s, state in zip(sizes, self.decode(rows)) if state == 0) / total if total else 0.0


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
        kinds = len(number)
        _, pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)
        keys = pairs[:-1] * kinds + ids[2:]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeated = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


OUT = "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _judge(chain: Chain, min_share: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                raw = text.encode()
                counts = base_counts(text, raw)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_SHARE * counts[0]
                share = chain.content_share(raw)
                rows.append((*counts, failed, not failed and share >= min_share, share))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [line_features(t.as_py().encode().split(b"\n"))[0] for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["quality", "key", "digest", "rows"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Chain:
    """Fits the chain to a bounded sample of labelled rows. Without rows of both labels nothing is learned
    and every line counts as content."""
    sample = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(max_docs)
    # at most max_docs rows of two numbers, so the texts stay where they are
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", F.md5(F.col("doc_id").cast("string")).alias("key"), F.md5(blank("text")).alias("digest"), blank("text").alias("text"))
    rows = joined.mapInArrow(_features, "quality int, key string, digest string, rows array<array<int>>").orderBy("key", "digest", "quality").limit(ROWS_PER_DOC * max_docs).collect()
    rows = sorted((r["rows"], r["quality"]) for r in rows)
    return Chain().fit(rows)


def judge(docs: DataFrame, chain: Chain, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs`` with the base counts, ``base_failed``, ``kept`` and ``content_share``.

    Null text has no words, fails and isn't kept. Repeated rows and repeated or null doc_ids stay.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", blank("text").alias("text")).mapInArrow(_judge(chain, min_share), OUT.format(id=kind))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def _retain(chain: Chain, min_share: float, at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = []
            for t in batch.column(at):
                text = t.as_py() or ""
                raw = text.encode()
                n, *_, repeated = base_counts(text, raw)
                good = n >= MIN_WORDS and 100 * repeated <= MAX_REPEAT_SHARE * n
                ok.append(good and chain.content_share(raw) >= min_share)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def retain(docs: DataFrame, chain: Chain, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    return docs.mapInArrow(_retain(chain, min_share, docs.columns.index("text")), docs.schema)
