"""Each operator on a small table with nulls, empty and repeated rows, extra columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import chat, decontam, lines, packing, probminhash, quality, sharding, spans, suffix, tokencount
from tracelens.llm.common import setting, shared_dir

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i} alpha beta gamma delta epsilon{i % 7}." for i in range(60))
TEXTS = [
    None, "", "  \n ", "short", LONG, LONG, LONG.replace("word30", "other"), "Intro here now. " + LONG[:700], "\n".join(["A line of words that repeats itself here"] * 3 + ["another quite different line of text"]),
    "é ß 好 " * 40, "x" * 300, "test item one two three four five six seven eight nine ten eleven", "BOTH test ITEM one, two three four five six seven eight nine ten eleven; end", "tiny item", "</s> [INST] <|endoftext|>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", -i) for i, t in enumerate(TEXTS)] + [(4, LONG, "x", 0), (None, LONG, "y", 1), (None, None, "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, node long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_sharding(docs, none):
    out = sharding.feistel_shards(docs, 4)
    slots = {}
    for r in out.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert got(out, "doc_id", "size", "text_crc32") == sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    assert sharding.feistel_shards(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation(spark, n):
    assert sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()) == list(range(n))


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "Test item one two three four five six seven eight nine ten"), (2, "tiny item"), (10, "word3 alpha beta gamma delta epsilon3 word4 alpha beta gamma delta"), (3, None), (4, "")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {}
    for r in bench.collect():
        w = words(r["text"])
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if k else ():
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(r["item_id"]))
    want = []
    for r in docs.collect():
        w, hit, items = words(r["text"]), set(), set()
        for g, found in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    items |= found
        want.append((r["doc_id"], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    out = decontam.contamination(docs, bench)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr) and sum(w[-1] for w in want) >= 6
    assert decontam.decontaminate(docs, bench).count() == sum(not w[-1] for w in want)
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[12] == "BOTH eleven; end" and cut[13] == "" and cut[9] == TEXTS[9]
    assert decontam.contamination(none, bench).count() == 0 and not decontam.contamination(docs, bench.filter("false")).filter("contaminated").count()


def test_decontamination_builds_few_windows(spark, monkeypatch):
    """Items of 1 to 25 words in documents of several blocks: the hits of brute force, and few windows built that are none."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(k)] for k in [*range(3, 13), *range(5, 26)] for _ in range(2)] + [["w1"], ["w2", "w3"]]
    texts = []
    for size in (1, 9, 10, 11, 40, 60, 61, 62, 300, 301, 302, 303) * 3:
        w = [r.choice(vocabulary[5:]) for _ in range(size)]
        for item in r.sample(items, size // 25):
            at = r.randrange(size)
            w[at:at] = item
        texts.append(w)
    texts += items
    monkeypatch.setattr(decontam, "BLOCK", 32)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want, built = {}, 0
    for i, w in enumerate(texts):
        for k in {min(10, len(t)) for t in items}:
            built += max(len(w) - k + 1, 0)
        for j, t in enumerate(items):
            k = min(10, len(t))
            grams = {tuple(t[a : a + k]) for a in range(len(t) - k + 1)}
            at = {p for a in range(len(w) - k + 1) if tuple(w[a : a + k]) in grams for p in range(a, a + k)}
            if at:
                want.setdefault(i, (set(), set()))
                want[i][0].update(at)
                want[i][1].add(str(j))
    found = {x["doc_id"]: ({p for s in x["spans"] for p in range(s["start"], s["end"])}, set(x["items"])) for x in decontam.hits(docs, bench).collect()}
    assert found == want and len(want) > 60
    grams, lengths = decontam.test_windows(bench), sorted({min(10, len(t)) for t in items})
    assert decontam.looked_up(docs, decontam.test_runs(grams, lengths), lengths).count() < built / 5


def test_quality(spark, docs, none):
    def base(t):
        w, tri = re.findall(r"[^\x20\x09-\x0D]+", t or ""), {}
        for i in range(len(w) - 2):
            tri.setdefault(tuple(w[i : i + 3]), []).append(i)
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len({j for v in tri.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})

    out = quality.judge(docs, quality.Chain())
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(((r["doc_id"], *base(r["text"])) for r in docs.collect()), key=repr)
    assert quality.retain(docs, quality.Chain()).columns == docs.columns and quality.judge(none, quality.Chain()).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    r = np.random.default_rng(3)
    chain = quality.Chain(r.normal(size=(len(quality.FEATURES), 2)), r.normal(size=(2, 2)))
    rows = [sorted(set(r.integers(0, len(quality.FEATURES), 4).tolist())) for _ in range(7)]
    score = lambda p: sum(chain.emit[i][s] for row, s in zip(rows, p) for i in row) + sum(chain.move[a][b] for a, b in zip(p, p[1:]))
    assert tuple(chain.decode(rows)) == max(product((0, 1), repeat=7), key=score)


def test_quality_on_held_out(spark):
    """Verdicts on documents that weren't trained on, and lines inside documents that are part good, part bad."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.train(docs, labels.filter("doc_id % 2 = 0"), 200)
    out = quality.judge(docs, chain).join(labels.filter("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").filter("not base_failed").collect()
    assert len(out) > 100 and sum(r["kept"] == (r["quality"] == 1) for r in out) >= 0.97 * len(out)
    split = lambda q: [[x for x in r["text"].encode().split(b"\n") if x.split()] for r in out if r["quality"] == q]
    right = total = mixed = 0
    for good, bad in zip(split(1), split(0)):
        h = len(good) // 2
        states = chain.decode(quality.line_features(good[:h] + bad + good[h:])[0])
        want = [0] * h + [1] * len(bad) + [0] * (len(good) - h)
        right += sum(map(int.__eq__, states, want))
        total += len(want)
        mixed += len(set(states)) == 2
    assert mixed > 10 and right >= 0.9 * total


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </s> b <\\/s> [INST"), (2, 5, None, None), (2, 3, "assistant", "x"), (3, 0, "tool [ROLE]", "[/ROLE] [/TURN]"), (None, None, "user", "q"), (1, 1, "assistant", "a </s> b <\\/s> [INST")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df)
    out = {r["conv_id"]: r for r in chats.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for r in out.values():
        assert [(t["role"], t["text"]) for t in r["back"]] == [(t["role"], t["text"]) for t in r["turns"]]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert [t["text"] for t in out[2]["turns"]] == ["x", ""] and len(out[1]["turns"]) == 3
    assert not out[1]["valid"] and out[1]["first_bad_turn"] == 2 and not out[2]["valid"]
    assert chat.digests(chat.format_chats(df.filter("false"))).count() == 0


def test_token_counts(spark, docs, none, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.tokenizer_path())
    count = tokencount.counter(tokencount.tokenizer_path())
    for t in ["a ", " a", "  ", "a▁b", "a\n\n b", "<s> x", *[t or "" for t in TEXTS]]:
        assert count(t) == len(model.encode(t))
    store = tokencount.CountStore(spark, str(tmp_path / "counts"))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or "")), len(model.encode(r["text"] or "")) > 100) for r in docs.collect()), key=repr)
    for _ in range(2):
        assert got(tokencount.count_tokens(docs, store, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert store.read().count() == spark.read.parquet(store.path).count() == len({r["text"] or "" for r in docs.collect()})
    assert tokencount.count_tokens(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, capacity=64).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(TEXTS):
        ids, at = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes(), 0
        copies = 2 if i == 4 else 1
        for r in sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))[::copies]:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(ids)
    assert packing.pack(none).count() == 0


def test_packing_uses_few_sequences():
    r = np.random.default_rng(1)
    counts = Counter(r.integers(1, 1025, 20_000).tolist())
    shapes = packing.pack_histogram(counts)
    back = Counter()
    for lengths, n in shapes:
        assert sum(lengths) <= 1024
        for x in lengths:
            back[x] += n
    assert back == counts and sum(n for _, n in shapes) * 1024 <= 1.01 * sum(k * v for k, v in counts.items())


def test_suffix_dedup(spark, docs, none):
    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    want, seen = [], {}
    given = [(r["doc_id"], (r["text"] or "").encode()) for r in rows.collect()]
    for i, t in given:
        for a in range(len(t) - 49):
            s = t[a : a + 50]
            seen[s] = min(seen.get(s, i), i)
    for i, t in given:
        gone = {b for a in range(len(t) - 49) if seen[t[a : a + 50]] < i for b in range(a, a + 50)}
        spans_ = sum(b - 1 not in gone for b in gone)
        want.append((i, len(t), len(gone), spans_, hashlib.sha256(bytes(c for b, c in enumerate(t) if b not in gone)).hexdigest()))
    assert got(suffix.removal_report(rows), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix.removal_report(docs).filter("doc_id is null and n_removed > 0").count() == 0 and suffix.removal_report(none).count() == 0
    clash = spark.createDataFrame([(1, LONG), (1, LONG + " more"), (2, LONG), (None, LONG[:200])], "doc_id long, text string")
    out = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix.removal_report(clash).collect()}
    # rows of one doc_id leave each other alone; a null doc_id is the smallest
    assert out == {(None, 200): 0, (1, len(LONG)): 200, (1, len(LONG) + 5): 200, (2, len(LONG)): len(LONG)}


def test_family_levels():
    r = np.random.default_rng(5)
    data = bytes(r.integers(97, 99, 4000).astype(np.uint8))
    keys, sizes = np.arange(40), np.full(40, 100)
    want = set()
    seen = {}
    for i in range(40):
        for a in range(100 - 11):
            seen.setdefault(data[100 * i + a : 100 * i + a + 12], i)
    for i in range(40):
        want |= {100 * i + b for a in range(100 - 11) if seen[data[100 * i + a : 100 * i + a + 12]] < i for b in range(a, a + 12)}
    for batch in (1, 300, 10_000):
        found = suffix.covered(keys, sizes, data, length=12, batch=batch)
        assert {100 * i + b for i, a, e in found for b in range(a, e)} == want


def test_spans(docs, none):
    out = spans.dedup_spans(docs)
    seen, want = {}, []
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"]})
    lost = {}
    for has, i, t in rows:
        parts = spans.sentences(t)
        for a, n, s in spans.spans(parts):
            if seen.setdefault(s, (has, i, a)) != (has, i, a):
                lost.setdefault((has, i, t), set()).update(range(a, a + n))
    for r in docs.collect():
        t = r["text"]
        want.append((r["doc_id"], len(spans.sentences(t or "")), len(lost.get((r["doc_id"] is not None, r["doc_id"] or 0, t), ()))))
    assert got(out, "doc_id", "n_sentences", "n_removed") == sorted(want, key=repr) and sum(w[2] for w in want) > 50
    assert spans.dedup_spans(none).count() == 0


def test_near_duplicates(docs, none):
    got_ = {(r["doc_id"], r["class_id"], r["kept"]) for r in probminhash.near_duplicates(docs).collect()}
    by = {i: c for i, c, _ in got_ if i is not None}
    assert by[4] == by[5] == by[6] == 4 and by[0] == by[1] == 0 and by[2] == 2 and by[3] == 3 and (None, 4, False) in got_ and (None, 0, False) in got_
    assert len(probminhash.near_duplicates(docs).collect()) == docs.count() and probminhash.near_duplicates(none).count() == 0


def test_registers_estimate_probability_jaccard():
    import random

    r = random.Random(2)
    a = " ".join(r.choice("abc") for _ in range(80))
    b = a[:90] + " d" + a[90:]
    owner, hashes, weights = probminhash.shingles([a.encode(), b.encode()])
    exact = probminhash.probability_jaccard(*[(hashes[owner == i], weights[owner == i]) for i in (0, 1)])
    words = lambda t: t.split()
    count = [Counter(tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)) for t in (a, b)]
    slow = sum(1 / sum(max(count[0][j] / count[0][i], count[1][j] / count[1][i]) for j in set(count[0]) | set(count[1])) for i in set(count[0]) & set(count[1]))
    regs = probminhash.registers(2, owner, hashes, weights, 5000)
    assert abs(exact - slow) < 1e-9 and abs((regs[0] == regs[1]).mean() - exact) < 0.04


def test_line_dedup(spark, none):
    rows = [(1, "the quick brown foxes jumped over lazy sleeping dogs\nunrelated sentence about quantum computers"), (2, "The  quick brown foxes jumped over lazy sleeping dogs\nok"), (3, None), (4, ""), (5, "unrelated sentence about quantum computers"), (5, "unrelated sentence about quantum computers")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, norm string")
    out = {(r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect()}
    assert out == {(1, rows[0][1], 0), (2, "ok", 1), (3, None, 0), (4, "", 0), (5, "", 1)}
    assert lines.dedup_lines(df).columns[:2] == ["doc_id", "norm"] and lines.dedup_lines(none.select("doc_id", "text")).count() == 0


def test_pipeline_columns(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert out.count() > 100 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_candidates_find_fuzzy_lines(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    vocabulary, texts = [word() for _ in range(800)], []
    for n in (6, 8, 10, 15, 20, 25, 40, 60) * 4:
        a = [r.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for k in r.sample(range(n), max(1, n // 10)):
            b[k] = r.choice(vocabulary)
        texts += [" ".join(a), " ".join(b)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 0.8 <= len(texts[i]) / len(texts[j]) <= 1.25 and distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j]))]
    assert len(near) >= 25
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, norm string")
    buckets = {x["doc_id"]: {b for k in x["kinds"] for b in k["bands"]} for x in lines.signed(rows, ["doc_id"]).collect()}
    assert sum(bool(buckets[i] & buckets[j]) for i, j in near) >= 0.93 * len(near)
    out = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(rows.withColumnRenamed("norm", "text")).collect()}
    assert sum(out[max(p)] for p in near) >= 0.93 * len(near)


def test_lines_without_blanks_and_letter_edits(spark):
    """Lines of 60 to 400 characters without blanks, one character changed: at least 0.9 of the pairs are found, in Chinese and in Latin letters."""
    import random

    r, texts = random.Random(8), []
    for low, high in ((0x4E00, 0x9000), (97, 123)):
        for n in (60, 100, 130, 200, 400) * 5:
            a = [chr(r.randrange(low, high)) for _ in range(n)]
            b = list(a)
            b[r.randrange(n)] = "a" if low == 97 else chr(0x4E00)
            texts += ["".join(a), "".join(b)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {x["doc_id"] for x in lines.dedup_lines(rows).filter("n_removed > 0").collect()}
    assert gone <= set(range(1, len(texts), 2)) and len(gone) >= 0.9 * len(texts) / 2


def test_short_words_count_in_lines(spark):
    both = ["it is as he or we do so by us to me on an if at my up no go in of be", "it is as he or we do so by us to me on an if at my up no go in of elephant"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(both)], "doc_id long, norm string")
    assert [x["n_removed"] for x in lines.dedup_lines(rows.withColumnRenamed("norm", "text")).orderBy("doc_id").collect()] == [0, 1]


def test_equal_short_lines_go(spark):
    rows = spark.createDataFrame([(1, "Ja.\n\nnein"), (2, "ja.\n\nneun\nja. "), (3, "x")], "doc_id long, text string")
    out = {(r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(rows).collect()}
    assert out == {(1, "Ja.\n\nnein", 0), (2, "\nneun", 2), (3, "x", 0)}


def test_long_sentences_are_cut_alike_at_any_offset():
    import random

    r = random.Random(4)
    lost = 0
    for lead in range(48):
        passage = [f"w{r.randrange(400)}" for _ in range(60)]
        a, b = (" ".join([f"{x}{k}" for k in range(n)] + passage + [f"{x}z{k}" for k in range(9)]) for x, n in (("a", 40), ("b", lead)))
        seen = {s for _, _, s in spans.spans(spans.sentences(a))}
        parts = spans.sentences(b)
        assert "".join(b[x:y] for x, y, _ in parts) == b and max(len(w) for _, _, w in parts) <= spans.MAX_WORDS
        lost += not any(s in seen for _, _, s in spans.spans(parts))
    assert lost == 0
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(120))
    assert {s for _, _, s in spans.spans(spans.sentences("甲乙丙丁" + text))} & {s for _, _, s in spans.spans(spans.sentences(text))}


def test_spans_reach_both_ends_of_repeated_runs():
    import random

    r = random.Random(6)
    for _ in range(40):
        pool = [" ".join(f"s{i}x{k}" for k in range(r.randint(3, 11))) + "." for i in range(60)]
        common = r.sample(pool[:30], r.randint(3, 6))
        a, b = ([*r.sample(pool[lo : lo + 15], 3), *common, *([] if r.random() < 0.3 else r.sample(pool[lo : lo + 15], 3))] for lo in (30, 45))
        cut = [spans.sentences(" ".join(x)) for x in (a, b)]
        runs = [{(i, j): " ".join(x[i:j]) for i in range(len(x)) for j in range(i + 2, len(x) + 1) if sum(len(w) for _, _, w in p[i:j]) >= spans.MIN_WORDS} for x, p in zip((a, b), cut)]
        want = {k for (i, j), t in runs[1].items() if t in runs[0].values() for k in range(i, j)}
        first = {s for _, _, s in spans.spans(cut[0])}
        assert {k for i, n, s in spans.spans(cut[1]) if s in first for k in range(i, i + n)} == want


def test_pipeline_near_dedup_keeps_other_texts(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, a, "x"), (None, c, "x"), (None, d, "x"), (3, d + " e", "x"), (2, b, "y"), (None, None, "x")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(1, a), (2, b), (0, c), (3, d + " e"), (0, "")])
    assert out.columns == ["doc_id", "text", "source"]


def test_links_at_exactly_the_similarity():
    import pyarrow as pa

    pairs = []
    for k in range(1, 40):
        words = [f"w{i}" for i in range(5 * k + 4)]
        pairs.append((b"u", b"v", " ".join(words), " ".join(words[: 4 * k + 4])))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs)], names=["u", "v", "a", "b"])
    assert sum(out.num_rows for out in probminhash._verify(0.8)(iter([batch]))) == len(pairs)


def test_training_uses_all_lines(monkeypatch):
    plain, marked = [0], [0, 4, 5]
    docs = [([plain] * 80, 1), ([plain] * 60 + [marked] * 40, 0)] * 4
    chain = quality.Chain().fit(docs)
    assert chain.emit[5][1] > chain.emit[5][0] + 0.1
    monkeypatch.setattr(quality, "BLOCK_LINES", 100)
    assert np.allclose(quality.Chain().fit(docs).emit, chain.emit)


def test_edit_similarity_is_exact(spark):
    """The bounds that are asked first never decide otherwise than the distance."""
    import random

    r, rows = random.Random(1), []
    for _ in range(300):
        a = ["".join(r.choice("abcé好") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 60))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k, way = r.randrange(len(b)) if b else 0, r.random()
            if way < 0.3 and b:
                b[k] = r.choice(a) + "x"
            elif way < 0.6 and b:
                del b[k]
            elif way < 0.8:
                b.insert(k, "new")
            else:
                b = b[k:] + b[:k]
        if a != b:
            rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    out = df.select("a", "b", lines.similar(a, b, 0.8).alias("ok"), lines.trimmed(a, b).alias("t"), lines.apart(a, b, F.lit(1000), 4, 16).alias("bound")).collect()
    bounds = 0
    for x in out:
        d = distance(x["a"], x["b"])
        assert distance(x["t"]["a"], x["t"]["b"]) == d and x["ok"] == (d <= int(max(len(x["a"]), len(x["b"])) * (1 - 0.8) + 1e-9))
        assert x["bound"] is None or x["bound"] >= d
        bounds += x["bound"] is not None
    assert bounds > 50 and 50 < sum(x["ok"] for x in out) < len(out)


def test_normalised_lines(spark):
    rows = spark.createDataFrame([(" A  b\tC \x0b d\r",), ("plain Line",), ("\t",), ("Ä  ö",)], "t string")
    assert [r[0] for r in rows.select(lines.normalised(F.col("t"))).collect()] == ["a b c d", "plain line", "", "ä ö"]


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "an equal line of some length\nother", 5, "x", "y", "z"), (2, "an equal line of some length", None, "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, gone string, _id string, _digest string")
    out = {r["doc_id"]: (r["text"], r["n_removed"], r["gone"], r["_id"]) for r in lines.dedup_lines(df).collect()}
    assert out == {1: (rows[0][1], 0, "x", "y"), 2: ("", 1, "x", "y")}


CLASHES = ["_row", "_doc", "_id", "_digest", "_spans", "_node", "_first", "_hit", "gone", "digest", "norm"]


def test_stages_with_clashing_columns_and_bad_rows(spark):
    """Each filtering stage gives back the columns it got, for nulls, repeated ids and rows, without n_chars and for no rows."""
    import corpus_pipeline

    prose = " ".join(f"plain{i} words follow here and there{i}." for i in range(30))
    rows = [(1, prose, 7), (1, "Other text. " + prose.replace("plain", "clear").replace("follow", "are read"), 7), (2, prose, 7), (2, prose, 7), (None, prose + "\nlast", None), (3, None, 7), (4, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").select("*", *[F.lit(c).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
        assert stage(spark, df.filter("false"), DATA).count() == 0, name
    with_chars = spark.createDataFrame([(1, "one line of words\nother", 23), (2, "one line of words\nrest", 22)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, with_chars, DATA).collect()}
    assert out == {1: ("one line of words\nother", 23), 2: ("rest", 4)}


def bit_distance(a, b):
    """Edit distance by Myers' bit vectors, a column of the table at a time."""
    ones, top, at = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    up, down, score = ones, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(flat | up) & ones, up & flat
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & ones, minus << 1 & ones
        up, down = minus | ~(eq | down | plus) & ones, plus & (eq | down)
    return score


def test_bit_distance():
    import random

    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in "ab")
        assert bit_distance(a, b) == distance(a, b)


def test_line_groups_against_all_pairs(spark):
    """Every pair of different lines of sf0.001: at least 0.9 of the links are found, and every group hangs together by links."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    norm = lambda x: re.sub(r"\s+", " ", x).strip().lower()
    texts = sorted({norm(x) for r in df.collect() for x in (r["text"] or "").split("\n")} - {""}, key=lambda t: (len(t), t))
    texts = [t for t in texts if len(t) >= lines.MIN_CHARS]
    letters = np.array([np.bincount([ord(c) % 64 for c in t], minlength=64) for t in texts])
    size = np.array([len(t) for t in texts])
    links = []
    for i, t in enumerate(texts):
        most = np.floor(0.2 * size[i + 1 :] + 1e-9)
        # an edit changes the letter counts by two at most, so this loses no link
        for k in np.flatnonzero((np.abs(letters[i + 1 :] - letters[i]).sum(1) <= 2 * most) & (size[i + 1 :] - size[i] <= most)):
            if bit_distance(t, texts[i + 1 + k]) <= most[k]:
                links.append((t, texts[i + 1 + k]))
    assert len(links) >= 20
    # one line to a document, in this order: of a group of links the first stays
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["text_"] for r in lines.dedup_lines(rows.withColumn("text_", F.col("text"))).filter("n_removed > 0").collect()}
    assert sum(b in gone for _, b in links) >= 0.9 * len(links)
    assert gone <= {t for pair in links for t in pair}


def test_no_link_is_lost_to_scattered_edits(spark, monkeypatch):
    """Lines of 20 to 900 characters with 10 to 19 % of the letters changed, lost or added: every link that all pairs give, at several blocks a class."""
    import random

    r, texts = random.Random(11), []
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwé") for _ in range(r.randint(2, 9)))
    vocabulary = [word() for _ in range(300)]
    for size in (24, 40, 90, 130, 250, 450, 900) * 4:
        for share in (0.1, 0.15, 0.19):
            a = ""
            while len(a) < size:
                a += " " + r.choice(vocabulary)
            a = a.strip()
            b = list(a)
            for k in r.sample([k for k, c in enumerate(a) if c != " "], int(share * len(a))):
                b[k] = r.choice(("", b[k] + r.choice("xyz"), r.choice("xyz"), r.choice("xyz")))
            texts += [a, " ".join("".join(b).split())]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) <= 0.2 * max(len(texts[i]), len(texts[j]))
            and bit_distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)]
    first = list(range(len(texts)))
    for _ in range(3):
        for i, j in near:
            first[i] = first[j] = min(first[i], first[j])
    assert len(near) >= 80
    monkeypatch.setattr(lines, "BLOCK", 8)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in lines.dedup_lines(rows).filter("n_removed > 0").collect()} == {i for i, f in enumerate(first) if f != i}


def test_all_pairs_of_lines_take_disk_by_the_lines(spark, monkeypatch):
    """What deciding all pairs shuffles, writes and keeps doesn't grow with the pairs of blocks, and every pass finds its links, once."""
    import random

    r, kept = random.Random(12), []
    texts = ["".join(r.choice("abcdefghiklmnoprstuvw ") for _ in range(r.randint(80, 300))) for _ in range(120)]
    texts += [t[:-3] + "xyz" for t in texts[::2]]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, root long, norm string").repartition(3)
    files = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    monkeypatch.setattr(lines, "BLOCK", 8)
    monkeypatch.setattr(lines, "CHUNK", 100_000, raising=False)
    monkeypatch.setattr(lines, "discard", lambda *cuts: kept.append(files()))
    shuffle, disk = shuffled(), files()
    found = sorted((min(x), max(x)) for x in lines.rest(rows).collect())
    assert found == [(2 * i, 120 + i) for i in range(60)]
    size = sum(map(len, texts))
    assert shuffled() - shuffle < 4 * size and kept[0] - disk < 8 * size


def test_pairs_of_lines_meet_by_numbers(spark, monkeypatch):
    """Pairs are met in a compiled loop over lengths and letters, which looks at no text; and what the starts of lines rule out is no link,
    also where characters are lost or added at one end."""
    import random

    r, plans, real = random.Random(13), [], lines.cut
    texts = ["".join(r.choice("abcdefghiklmnoprstuvwé ") for _ in range(n)) for n in (20, 21, 35, 60, 100, 170, 260) * 3]
    edits = lambda n: [r.choice(((0, 1), (1, 0), (1, 1))) for _ in range(n)]
    for t in list(texts):
        most = int(0.2 * len(t) + 1e-9)
        texts += [t[most:], t[:-most], t[: len(t) // 2] + t[len(t) // 2 + most :]]
        for lo, hi in ((0, len(t) // 3), (len(t) // 3, len(t)), (0, len(t))):
            b = list(t)
            for k, (lost, more) in zip(r.sample(range(lo, hi), min(most, hi - lo)), edits(most)):
                b[k] = b[k] * (1 - lost) + "x" * more
            texts.append("".join(b))
    texts = sorted(set(texts))
    near = [(i, j) for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) <= 0.2 * max(len(texts[i]), len(texts[j]))
            and bit_distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)]
    assert len(near) >= 100

    def cut(df, name="cut", by=(), onto=None):
        if name == "rest":
            with setting(spark, "spark.sql.adaptive.enabled", "false"):
                plans.append(spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "formatted"))
        return real(df, name, by, onto)

    monkeypatch.setattr(lines, "cut", cut)
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, root long, norm string").repartition(3)
    assert sorted((min(x), max(x)) for x in lines.rest(rows).collect()) == sorted(near)
    met = [x for p in plans for x in p.split("\n\n") if "BroadcastNestedLoopJoin" in x.split("\n")[0]]
    assert met and all("codegen id" in x.split("\n")[0] and "norm" not in x.split("Join condition")[1] for x in met)


def test_lost_pieces_are_no_more_than_edits(spark):
    """What the pieces of a line rule out is no link, wherever its edits are and however lengths differ; and they rule out nearly all
    pairs of unlike lines of the same syllables, of which lengths and letters leave many."""
    import random

    r = random.Random(14)
    syllables = ["".join(r.choice("etaoinsrhé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    line = lambda n: "".join(r.choice(syllables) + " " * (r.random() < 0.4) for _ in range(n))[:n].strip()
    pairs, unlike = [], []
    for size in (20, 23, 40, 75, 150, 310, 620):
        for _ in range(3):
            a, n = line(size), size // 5 - 1
            pairs += [(a, a[n:]), (a, a[:-n]), (a, a[: size // 2] + line(n) + a[size // 2 :]), (a, a[: size // 3] + a[size // 3 + n :]), (a, line(n) + a[:-n]), (a, a[n:] + line(n))]
            for lo, hi in ((0, size // 3), (size // 2, size), (0, size)):
                b = list(a)
                for k in r.sample(range(lo, min(hi, len(b))), min(n, min(hi, len(b)) - lo)):
                    b[k] = r.choice(("", "x", b[k] + "\U0001f600"))
                pairs.append((a, "".join(b)))
    pairs += [(b, a) for a, b in pairs]
    unlike = [(line(n), line(n + r.randint(-n // 12, n // 12))) for n in (60, 120, 250, 400, 500) * 12]
    rows = spark.createDataFrame(pairs + unlike, "a string, b string").repartition(4)
    x, y, step = F.length("a"), F.length("b"), F.ceil(F.length("a") / lines.STEPS).cast("int")
    most = F.floor(F.greatest(x, y) * 0.2 + 1e-9).cast("int")
    rows = rows.select("a", "b", most.alias("most"), step.alias("step"), lines.pieces(F.col("b")).alias("pieces"), F.floor((most + y - x) / 2).cast("int").alias("ahead"))
    rows = rows.withColumn("windows", lines.windows(F.col("a"), F.col("step"), 0.8))
    out = {(x["a"], x["b"]): x for x in rows.withColumn("lost", lines.lost(*map(F.col, ("pieces", "windows", "step", "ahead")))).collect()}
    assert all("".join(x["pieces"]) == x["b"] for x in out.values())
    near = [(a, b) for a, b in pairs if bit_distance(a, b) <= out[a, b]["most"]]
    assert len(near) >= 250 and all(out[k]["lost"] <= bit_distance(*k) for k in near)
    assert sum(out[k]["lost"] > out[k]["most"] for k in unlike) >= 0.9 * len(unlike)


def test_near_duplicates_against_all_pairs(spark):
    """Classes of sf0.01, and of copies of its texts with a word replaced now and then, against the probability Jaccard of every pair
    of documents, written out as its definition."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r["text"].split() for r in df.orderBy("doc_id").collect() if r["text"] and len(r["text"].split()) > 120][:100]
    swap = lambda i, x, m: " ".join(f"swap{i}x{k}" if k % m == m // 2 else w for k, w in enumerate(x))
    copies = [(100000 + i, swap(i, x, (40, 44, 46, 50, 60, 90)[i % 6])) for i, x in enumerate(texts)]
    df = df.union(spark.createDataFrame(copies, df.schema)).repartition(8)
    weights = {}
    for r in df.collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode()))
        weights[r["doc_id"]] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)) if words)

    def similarity(a, b):
        a, b = ({k: n / sum(c.values()) for k, n in c.items()} for c in (a, b))
        keys = a.keys() | b.keys()
        return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in a.keys() & b.keys())

    distinct = {}
    for d, c in sorted(weights.items()):
        distinct.setdefault(frozenset(c.items()), d)
    ids = [d for k, d in distinct.items() if k]
    links = []
    for i, u in enumerate(ids):
        for v in ids[:i]:
            a, b = weights[u], weights[v]
            both = a.keys() & b.keys()
            # a term of the sum is at most the shingle's own part of its text
            if both and all(sum(c[s] for s in both) >= 0.8 * sum(c.values()) - 1e-6 for c in (a, b)) and similarity(a, b) >= 0.8 - 1e-9:
                links.append((u, v))
    assert len(links) >= 60
    label = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(df).collect()}
    assert sum(label[u] == label[v] for u, v in links) >= 0.99 * len(links)
    root = {d: distinct[frozenset(c.items())] for d, c in weights.items()}
    for u, v in links:
        keep, go = sorted((root[u], root[v]))
        root = {d: keep if r == go else r for d, r in root.items()}
    groups = {}
    for d, c in label.items():
        groups.setdefault(c, set()).add(root[d])
    assert all(len(g) == 1 for g in groups.values())
