"""Hard negatives, centroid clustering and HTML extraction against brute force and hand-made pages."""

import hashlib
import math
import time

import duckdb
import numpy as np
import pytest

from tracelens.llm import centroids, extraction, negatives, vectors

DATA = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def bad_vectors(dim):
    nan, inf = float("nan"), float("inf")
    return [(5, None, 1), (6, [0.5] * (dim - 1) + [nan], 1), (8, [0.5] * (dim - 1) + [inf], 1), (9, [None] + [0.5] * (dim - 1), 1), (10, [0.5] * (dim + 1), 1), (11, [], 1), (12, [0.5] * dim, None), (None, [0.5] * dim, 2)]


@pytest.fixture(scope="module")
def embedded(spark):
    """Close groups, equal vectors with other ids, equal rows, ties, bad rows and clashing columns."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    made = [(i, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=8) * 0.3, 2)], int(rng.integers(0, 4))) for i in range(100, 700)]
    made += [(1000, made[0][1], 0), (1100, made[0][1], 1), (1200, made[7][1], 1), (1200, made[7][1], 1), (1300, [0.0] * 8, 2)]
    made += bad_vectors(8)
    return spark.createDataFrame([(*r, "x", 1, -1) for r in made], "vec_id long, embedding array<float>, label int, v string, row int, cluster int").repartition(5)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_negatives_against_brute_force(embedded, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "PASS", 2)
    data = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in embedded.collect() if r["vec_id"] is not None and r["label"] is not None and usable(r["embedding"])]
    want = []
    for i, (a, va, la) in enumerate(data):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), b, k) for k, (b, v, _) in enumerate(data) if k != i and len(v) == len(va))
        for s, b, k in [x for x in scored if data[x[2]][2] == la][:5]:
            fit = [x for x in scored if data[x[2]][2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            want += [(a, b, n, x[1], -s, -x[0]) for n, x in enumerate(fit, 1)]
    got = rows(negatives.mined(embedded), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got == sorted(want, key=repr) and len(want) > 100


def test_planes_drop_pairs_and_lose_none():
    rng = np.random.default_rng(5)
    a, p = rng.integers(-200, 200, (7, 16)), rng.integers(-200, 200, (300, 16))
    left = []

    def top(low, high, alive):
        assert (low <= (a @ p.T)).all() or not alive.all()
        left.append(int(alive.sum()))
        return high >= negatives.kth(low, alive, 5)

    at, found, scores = negatives.sliced(a, p, np.ones((7, 300), bool), top)
    exact = a @ p.T
    assert (scores == exact[at, found]).all() and left[-1] < left[0] / 4
    for i in range(7):
        assert set(np.argsort(-exact[i])[:5]) <= set(found[at == i])


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([([1e9],)], "embedding array<double>").select(vectors.integers("embedding")).collect()


def test_vectors_without_rows(embedded):
    assert negatives.mined(embedded.filter("false")).count() == 0
    assert centroids.clustered(embedded.filter("false"), dim=8).count() == 0


def lloyd(data, k, rounds):
    points = np.array([v for _, v in data], object)
    order = sorted(range(len(data)), key=lambda i: (hashlib.sha256(f"2:{'' if data[i][0] is None else data[i][0]}".encode()).hexdigest(), data[i][1]))
    c = [list(data[i][1]) for i in order[:k]]

    def nearest():
        return [min((sum((x - y) ** 2 for x, y in zip(p, q)), n) for n, q in enumerate(c)) for p in points]

    for _ in range(rounds):
        own = nearest()
        for n in range(len(c)):
            some = [p for p, (_, m) in zip(points, own) if m == n]
            if some:
                c[n] = [sum(col) // len(some) for col in zip(*some)]
    own = nearest()
    per = {n: sum(d for d, m in own if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in c]
    return sorted(((data[i][0], m, int(d), int(per[m]), int(sum(per.values())), sha[m]) for i, (d, m) in enumerate(own)), key=repr)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_clusters_against_brute_force(embedded, monkeypatch, k):
    monkeypatch.setattr(centroids, "TREE", 50)
    some = embedded.filter("vec_id is null or vec_id < 160 or vec_id >= 1000")
    data = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in some.collect() if usable(r["embedding"]) and len(r["embedding"]) == 8]
    got = rows(centroids.clustered(some, k, 3, 8), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert got == lloyd(data, k, 3)


def test_trees_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(1)
    c = rng.integers(-500, 500, (12, 4))
    points = np.concatenate([rng.integers(-20, 20, (400, 4)) + x for x in c])
    order, splits, boxes, sums = centroids.grown(points)
    assert sorted(order) == list(range(len(points))) and (sums[0] == points.sum(0)).all()
    tree = {"points": points[order].astype("<i4").tobytes(), "splits": splits.tobytes(), "boxes": boxes.tobytes()}
    own, whole, leaves = np.full(len(points), -1), [], []
    centroids.filtered(tree, c, lambda n, k: (whole.append(splits[n][1] - splits[n][0]), own.__setitem__(slice(*splits[n][:2]), k)), lambda lo, hi, k: (leaves.append(hi - lo), own.__setitem__(slice(lo, hi), k)))
    assert (own == ((points[order][:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(whole) > 0.9 * len(points) and max(whole) > centroids.LEAF


@pytest.fixture(scope="module")
def model(spark):
    return extraction.trained(spark)


def text_of(spark, model, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id int, html string")
    return [r["text"] for r in extraction.extracted(df, model).orderBy("page_id").collect()]


P1, P2 = "The first paragraph has quite a number of words, so that nobody doubts that it belongs to the text of the page. " * 3, "Another one, also with &amp; some   words\nand a <b>bold</b> part, follows it here and goes on for a while without saying much more. " * 2
T1, T2 = " ".join(P1.split()), " ".join(P2.replace("&amp;", "&").replace("<b>", "").replace("</b>", "").split())


def test_pages(spark, model):
    chrome = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
    pages = {
        f"<html><head><title>no</title><style>p{{}}</style></head><body>{chrome}<article><h1>A title</h1><p>{P1}</p><!-- no --><p>{P2}<p>Short.</article><footer>no</footer>": ["A title", T1, T2, "Short."],
        f"<body><div id=header>no no</div><ul class=menu><li><a>no</a></ul><div class='post-content'><h2>A title</h2><p>{P1}<div class='ad-slot'>Buy it now</div><p>{P2}</div><div id=comments><p>{P1}</p></div>": ["A title", T1, T2],
        f"<div class=cookie-banner><p>{P1}</p></div><main><header><h1>A title</h1><p>by no one</p></header><p>{P2}</p><form><label>no</label><input></form><section class=comments><p>{P1}</section></main><aside>{P1}</aside>": ["A title", T2],
        f"<div><a>One</a> <a>Two</a></div><div>{P1}</div><div>{P2}</div><div><a>no no</a> <a>no</a></div>": [T1, T2],
        f"<article><p hidden>no</p><p style='display: none'>no</p><p>{P1}<template>no</template><script>if (a</b) '</p>'</script><noscript>no</noscript></article>": [T1],
        "<article><p>1 &lt; 2 &copy; &#233; &eacute &am a < b</article>": ["1 < 2 © é é &am a < b"],
        "<article><ul><li>one<li>two <a href=x>with a link</a></ul><table><tr><td>x<td>y<tr><td>z</table><pre>a\n  b</pre>a<br>b": ["one", "two with a link", "x", "y", "z", "a b", "a b"],
        "": [], "   ": [], "<article></article>": [], "<!-- all": [], "<article><p>cut off <a hr": ["cut off"],
    }
    got = text_of(spark, model, *pages)
    for page, text, want in zip(pages, got, pages.values()):
        assert text == "\n\n".join(want), page


def test_held_out_layouts(spark, model):
    """A tree trained without a layout gets most of that layout's blocks right."""
    right = total = 0
    for i in range(0, len(extraction.LAYOUTS), 5):
        others = extraction.LAYOUTS[:i] + extraction.LAYOUTS[i + 1 :]
        keeps = extraction.rule(extraction.trained(spark, extraction.labelled(others, 10)))
        own = spark.createDataFrame(extraction.labelled(extraction.LAYOUTS[i : i + 1], 10), "x array<double>, y double")
        right += own.filter(keeps(own["x"]).cast("double") == own["y"]).count()
        total += own.count()
    assert right >= 0.9 * total


def test_extraction_keeps_columns_and_nulls(spark, model):
    df = spark.createDataFrame([(1, None, "u", 5), (None, "<article><p>x</p></article>", None, None), (None, "<article><p>x</p></article>", None, None)], "page_id int, html string, text string, _row int")
    out = extraction.extracted(df, model)
    assert out.columns == ["page_id", "html", "_row", "text", "n_chars"]
    assert rows(out, "page_id", "_row", "text", "n_chars") == sorted([(1, 5, "", 0), (None, None, "x", 1), (None, None, "x", 1)], key=repr)
    assert extraction.extracted(df.filter("false"), model).count() == 0


@pytest.mark.parametrize("piece", ["<", "<a ", '<a "', "<b>", "<li><div>", "</i>", "<p><b>", "<!-", "<a href='", "<script>", "&", "<td><table>", "<hr><b>", "<span class=ad>", "<div class=ad><p>"])
def test_reading_takes_linear_time(piece):
    page, start = f"<article>{piece * 60_000}", time.perf_counter()
    extraction.described(extraction.blocks(page))
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("name", ["op11", "op12", "op13"])
def test_against_sql(spark, name):
    module = {"op11": negatives, "op12": centroids, "op13": extraction}[name]
    c = duckdb.connect()
    for t in ("embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(getattr(module, f"{name.upper()}_SQL")), getattr(module, name)(spark, DATA)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert rows(got, *order) == sorted((tuple(r[want.columns.index(x)] for x in order) for r in want.fetchall()), key=repr)
