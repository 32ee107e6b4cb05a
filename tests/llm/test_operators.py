"""Each operator against a brute-force version on a small fixture, and on nulls, empty and long texts, ties, repeats, clashing names and empty tables."""

import hashlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from custodia.llm import common, decontaminate, fingerprints, language, lines, minhash, mixing, pages, paragraphs, queries, toxicity, urls
from custodia.llm.common import hashed_below
from custodia.llm import components as components_of
from custodia.llm.components import components
from custodia.llm.shingles import MinMaxHash, banding, overlaps, shingle_set, word_hashes, words_of_all

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, component string"
WORDS = [f"w{k}x" for k in range(400)]


def words(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names clash with internal ones."""
    long = words(1, 40_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, long), (6, long + " tail"), (None, "a b"), (7, "x" * 50_000), (8, words(2, 60)), (9, words(2, 60).upper()), (9, words(3, 60))]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, "i", "c") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_groups(rows, size, percent):
    def cut(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(size, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    sets = [cut(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_is_exact(spark, size, percent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = minhash.minmax_dedup(docs, size=size, percent=percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups([tuple(r) for r in docs.collect()], size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_groups_larger_than_a_block(spark):
    draw, base = np.random.default_rng(5), words(9, 120).split()
    rows = []
    for k in range(90):
        text = list(base)
        for at in draw.integers(0, 120, k % 12):
            text[at] = f"n{draw.integers(1_000_000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "id int, text string")
    got = minhash.near_groups(docs, 3, 85, block=8).collect()
    assert {(r.id, r.n_shingles, r.component) for r in got} == brute_groups(rows, 3, 85)


def test_near_dedup_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.minmax_dedup(odd, size=3, percent=85).collect()]
    assert len(got) == 12 and got.count((4, 1, 4, True)) == 2
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True)} <= set(got)
    assert [r[2] for r in got if r[0] == 6] == [5] and sorted(r[2] for r in got if r[0] == 9) == [8, 9]
    assert minhash.minmax_dedup(none).count() == 0


def test_components(spark):
    links = [(k + 1, k) for k in range(30)] + [(100, 200), (200, 300), (7, 7), (None, 3), (300, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 200: 100, 300: 100}


def test_components_of_hubs_and_paths(spark, monkeypatch):
    """Rounds are written by no more tasks than there are cores, however many shuffle partitions hold the few links; results are those of a plain search."""
    draw = np.random.default_rng(3)
    path, names = draw.permutation(300), draw.permutation(2000) + 1000
    links = [*zip(path[1:], path[:-1], strict=True)] + [(900, 400 + k) for k in range(200)] + [(600, 601 + k) for k in range(200)]  # hubs: largest, smallest
    links += [tuple(draw.choice(names, 2)) for _ in range(1100)] * 2
    links = [(int(a), int(b)) for a, b in links]
    low = {x: x for link in links for x in link if link[0] != link[1]}
    while any(low[a] != low[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    files = []
    write = components_of.cut
    monkeypatch.setattr(components_of, "cut", lambda frame: files.append(len((out := write(frame)).inputFiles())) or out)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(dict(got)) and dict(got) == low
    assert len(files) > 1 and max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_forests_of_some_links_at_a_time(monkeypatch):
    monkeypatch.setattr(components_of, "AT_ONCE", 4)
    some = [len(x) for x in components_of._some(pd.DataFrame({"a": range(n)}) for n in (3, 0, 2, 9, 1, 1))]
    assert some == [5, 9, 2] and not list(components_of._some(iter([pd.DataFrame({"a": []})])))
    a, b = components_of.forest(np.array([5, 4, 9, 3, 9]), np.array([4, 3, 8, 1, 8]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (4, 1), (5, 1), (9, 8)]


def test_signatures_estimate_similarity():
    bands, rows = banding(0.8)
    hasher = MinMaxHash(bands, rows)
    a, b = (np.unique(word_hashes(" ".join(map(str, range(x, x + 900))))) for x in (0, 100))
    low = hasher.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert abs((low[0] == low[1]).mean() - 0.8) < 0.1
    assert overlaps([a, b]).tolist() == [[900, 800], [800, 900]] and overlaps([a, b], 1).tolist() == [[800]]
    assert 1 - (1 - 0.8**rows) ** bands > 1 - 1e-6


def test_very_long_words():
    """Words of many pieces are whole words, alone and between others, wherever the pieces end."""
    for length in ((1 << 20) - 1, 1 << 20, (1 << 20) + 1, 4 << 20):
        word, other = "X" * length, "x" * (length - 1) + "y"
        assert len(shingle_set(word, 3)) == 1 and not set(shingle_set(word, 3)) & set(shingle_set(other, 3))
        alone = word_hashes(word)
        assert (word_hashes(f"a {word} b")[1:2] == alone).all() and len(word_hashes(f"a {word}  {word} b")) == 4
        assert (word_hashes(f"{'w ' * 300_000}{word}\n{other}")[-2:] == [alone[0], word_hashes(other)[0]]).all()


def test_only_wanted_ids_stay(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id * 7 as id", "'t' as text")
    ids = spark.range(50).selectExpr("id * 700 as id")
    few = {r.id for r in minhash.only_wanted(rows, ids, 50).collect()}
    assert {700 * k for k in range(50)} <= few and len(few) < 3_000
    monkeypatch.setattr(minhash, "TABLE_BITS", 15)
    assert minhash.only_wanted(rows, rows.select("id"), 10**12).count() == 20_000
    names = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, text string")
    assert {r.id for r in minhash.only_wanted(names, names.where("id = 'a'").select("id"), 1).collect()} == {"a"}


def test_samples_of_any_share(spark):
    rows = spark.range(200_000)
    assert rows.where(hashed_below(1.0, "id")).count() == 200_000
    assert 150 < rows.where(hashed_below(1e-3, "id")).count() < 260
    assert int(1e-9 * 2.0**63) > 0  # the bound of a share far below one in a million


def test_words():
    texts = ["", "The cat\x0bsat", "é\xa0b\n C", "x" * 2_000_000 + " y"]
    hashes, counts = words_of_all(texts)
    assert counts.tolist() == [0, 3, 2, 2]
    assert (hashes == np.concatenate([word_hashes(t) for t in texts])).all()
    assert (word_hashes("A É") == word_hashes("a É")).all() and (word_hashes("é") != word_hashes("É")).all()
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0


def test_lines(spark):
    line = "A line that is long enough to count for many docs"
    rows = [(k, f"  {line.upper() if k % 2 else line}\t\nown {k}\n") for k in range(5)] + [(9, None), (None, line), (0, f"{line}\nagain"), (7, "short\nshort")]
    got = {}
    for r in lines.drop_repeated_lines(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, pos int, line string")).collect():
        got.setdefault(r.doc_id, []).append((r.text, r["__n_lines"], r["__n_dropped"]))
    assert got[1] == [("own 1\n", 3, 1)] and got[4] == [(rows[4][1], 3, 0)]
    assert got[9] == [("", 1, 0)] and got[None] == [(line, 1, 0)] and got[7] == [("short\nshort", 2, 0)]
    assert sorted(got[0]) == [("again", 2, 1), ("own 0\n", 3, 1)]


def test_lines_of_odd_rows(odd, none):
    assert lines.drop_repeated_lines(odd).count() == 12 and lines.drop_repeated_lines(none).count() == 0


def test_leaks(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, decontaminate.terms(r.text).tolist()) for r in bench.collect()]
    item = max(items, key=lambda x: len(x[1]))
    text = next(r.text for r in bench.collect() if r.item_id == item[0]).split()
    reworded = " ".join(w if k % 6 else "other" for k, w in enumerate(text))
    more = spark.createDataFrame([(10_000, words(4, 200) + " " + reworded + " " + words(5, 200)), (10_001, None), (None, " ".join(text)), (10_002, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs.select("doc_id", "text").unionByName(more), bench).collect()}
    want = set()
    for r in docs.collect():
        held = decontaminate.terms(r.text).tolist()
        want |= {(r.doc_id, i) for i, x in items for k in range(len(held) - len(x) + 1) if held[k] == x[0] and held[k : k + len(x)] == x}
    assert len(want & got) >= 0.9 * len(want) and (10_000, item[0]) in got
    assert len(got - want) <= 2 and not any(d in (10_001, 10_002, None) for d, _ in got)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(more, bench.limit(0)).count() == 0


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    """A'A times a basis as the fit has it, against a matrix of all passages."""
    texts = [words(k, 1 + k % 90) for k in range(3500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame([(1, words(90, 30))], "item_id bigint, text string")
    seen, products = [], decontaminate._products
    monkeypatch.setattr(decontaminate, "_products", lambda *a, **k: seen.append((a[1:], products(*a, **k))) or seen[-1][1])
    decontaminate.find_leaks(docs, bench).count()
    (idf, basis), got = seen[0]
    rows, used = [], np.flatnonzero(idf)
    for t in texts:
        ids = decontaminate.buckets(decontaminate.terms(t))
        for k in range(0, len(ids), decontaminate.PASSAGE):
            row = (np.bincount(ids[k : k + decontaminate.PASSAGE], minlength=len(idf)) * idf)[used]
            rows.append(row / np.linalg.norm(row))
    matrix = np.array(rows)
    assert np.allclose(got[used], matrix.T @ (matrix @ basis[used]), rtol=1e-3, atol=1e-3 * np.abs(got).max())
    (_, basis), got = seen[-1]
    placed = matrix @ basis[used]
    assert np.allclose(got, placed.T @ placed, rtol=1e-3, atol=1e-3 * np.abs(got).max())


def test_lots_hold_all_terms_of_all_passages(spark):
    """The lots as they are read against TF-IDF of every passage; terms that one passage of a lot has come first."""
    texts = [words(k, 1 + k % 90) for k in range(240)] + ["", " .", "one " * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = decontaminate.passage_terms(docs).where("terms is not null").toPandas()
    idf = np.random.default_rng(3).uniform(0.5, 2, 1 << decontaminate.BITS).astype(np.float32)
    got = []
    for distinct, alone, cells, values in decontaminate._lots(rows, idf):
        single = int(alone.sum(dtype=np.int64))
        lot = np.zeros((len(alone), len(idf)))
        lot[np.repeat(np.arange(len(alone)), alone), distinct[:single]] = values[:single]
        bucket, passage = np.divmod(cells, len(alone))
        lot[passage, distinct[single:][bucket]] = values[single:]
        assert len(np.unique(distinct)) == len(distinct) and ((lot > 0).sum(axis=0)[distinct[:single]] == 1).all()
        assert ((lot > 0).sum(axis=0)[distinct[single:]] > 1).all()
        got.append(lot)
    want = []
    for ids in (decontaminate.buckets(decontaminate.terms(t)) for t in texts):
        for k in range(0, len(ids), decontaminate.PASSAGE):
            row = np.bincount(ids[k : k + decontaminate.PASSAGE], minlength=len(idf)) * idf
            want.append(row / np.linalg.norm(row))
    assert len(got) > 3 and np.allclose(np.concatenate(got), np.array(want), atol=1e-6)


def test_vectors_are_made_only_where_an_item_may_be(monkeypatch):
    """Texts without enough of an item's words have no vectors; the cosine of a leak among them is that of its window alone."""
    draw = np.random.default_rng(12)
    space = draw.normal(size=(1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32)
    items = decontaminate.make_items([(1, " ".join(f"i{k}" for k in range(24)))], space)
    blocks, at = items.scales[0][0], 70  # words before the item: whole blocks, so that a window begins with it
    texts = [words(k, 400) for k in range(10)] + [" ".join([*words(20, at // 6 * 6).split(), *(f"i{k}" for k in range(24)), *words(21, 3000).split()])]
    made, real = [], decontaminate.block_sums
    monkeypatch.setattr(decontaminate, "block_sums", lambda *a: made.append(real(*a)) or made[-1])
    hashes, counts = words_of_all(texts, decontaminate.WORD_BYTES)
    got = decontaminate.leaks_in(hashes, counts, items, space)
    assert [(t, i, s) for t, i, _, s in got] == [(10, 1, 1.0)]
    assert 0 < len(made[0][0]) - 1 <= 3 * max(length + 2 * (length // 2) for length, _ in items.scales)
    held, cosines = decontaminate.terms(texts[10]), []
    for begin in range(0, len(held), 6 * max(1, blocks // 3)):
        window = space[decontaminate.buckets(held[begin : begin + 6 * blocks])].sum(axis=0)
        cosines.append(float(window @ items.vectors[0] / np.linalg.norm(window)))
    assert abs(got[0][2] - max(cosines)) < 1e-4


@pytest.mark.parametrize("replaced", [0.0, 0.2, 0.3, 0.45])
def test_every_leak_that_the_checks_accept_is_found(spark, replaced):
    """Items planted word for word and reworded, against checking every region; the latent space is of no use here."""
    draw = np.random.default_rng(8)
    space = draw.normal(size=(1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32)
    rows = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").limit(60).collect()]
    texts = [decontaminate.terms(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 300 and 3000").limit(40).collect()]
    items = decontaminate.make_items(rows, space)
    assert len(items.ids) == 60
    length = {int(k): blocks for blocks, chosen in items.scales for k in chosen}
    planted, want = [], set()
    for k, item in enumerate(items.words):
        item, text = item.copy(), texts[k % len(texts)]
        body = len(item) - len(decontaminate.answer_of(item)) if replaced > 0.3 else len(item)  # many are replaced only before the answer
        away = draw.choice(body, min(body, int(replaced * len(item))), replace=False)
        item[away] = draw.integers(0, 2**63, len(away)).astype(np.uint64)
        at = draw.integers(len(text) + 1)
        planted.append(np.concatenate([text[:at], item, text[at:]]))
        n, half = length[k], length[k] // 2
        regions = [planted[-1][max(0, o - half) * 6 : (o + n + half) * 6] for o in range(0, max(1, -(-len(planted[-1]) // 6) - n + 1), max(1, n // 3))]
        if any(decontaminate.confirmed(items.words[k], region)[1] for region in regions):
            want.add((k, items.ids[k]))
    got = {(t, i) for t, i, _, _ in decontaminate.leaks_in(np.concatenate(planted), np.array([len(x) for x in planted]), items, space)}
    assert len(want) >= 50 and want <= got


def test_texts_without_enough_of_an_item_are_not_compared_by_region(monkeypatch):
    """Regions with an item's rare words are no candidates where the whole text lacks too many of its other words."""
    draw = np.random.default_rng(9)
    space = draw.normal(size=(1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32)
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(40))) for k in range(5)]
    items = decontaminate.make_items(rows, space)
    rare = [f"w{k}x{n}" for k in range(5) for n in range(18)]  # of 40 words, so no leak
    texts = [decontaminate.terms(" ".join(draw.choice(rare, 400))) for _ in range(20)] + [decontaminate.terms(f"{words(3, 50)} {rows[2][1]} {words(4, 50)}")]
    seen, possible = [], decontaminate.possible
    monkeypatch.setattr(decontaminate, "possible", lambda region, *a: seen.append(len(region)) or possible(region, *a))
    got = decontaminate.leaks_in(np.concatenate(texts), np.array([len(x) for x in texts]), items, space)
    assert [(t, i) for t, i, _, _ in got] == [(20, 2)] and sum(seen) < 50


def bag_holds(text, item):
    """Whether a text has enough of an item's words, in any order."""
    answer = decontaminate.answer_of(item)
    share = np.isin(item, text).mean()
    return share >= decontaminate.SHARE or share >= decontaminate.LOWER and np.isin(answer, text).sum() >= decontaminate.ANSWER_SHARE * len(answer)


@pytest.mark.parametrize("common", [1, 4, 1000])
def test_parts_of_texts_hold_items(monkeypatch, common):
    """held_by_texts of parts against counting the words of every part and item, with words that all items or no others have."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    draw, reach = np.random.default_rng(common), 30
    names = [f"t{k}" for k in range(60)]
    items = decontaminate.make_items([(k, " ".join(draw.choice(names, 12))) for k in range(20)], np.zeros((1 << decontaminate.BITS, decontaminate.RANK), np.float32))
    sizes = np.array([1, 29, 30, 31, 60, 61, 90, 200, 3])
    texts = [decontaminate.terms(" ".join(draw.choice(names, n))) for n in sizes]
    parts = decontaminate.Parts.of(sizes, reach)
    owner, word = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
    place = decontaminate.places_of(np.concatenate(texts), items)
    known = np.flatnonzero(place < len(items.vocabulary))
    pieces = parts.first[parts.begins][owner] + word // reach
    got = decontaminate.held_by_texts(place[known], pieces[known], len(sizes), items, parts)
    spans = [(t, reach * k) for t, n in enumerate(sizes) for k in range(max(1, -(-n // reach) - 1))]
    want = [[bag_holds(texts[t][at : at + 2 * reach], item) for item in items.words] for t, at in spans]
    assert got.tolist() == want and 0 < got.sum() < got.size
    for t, n in enumerate(sizes):  # every run of `reach` words lies in the part of its first word
        for at in range(n):
            text, begin = spans[parts.at(np.array([t]), np.array([at]))[0]]
            assert text == t and begin <= at and min(at + reach, n) <= begin + 2 * reach
    none = decontaminate.held_by_texts(place[:0], pieces[:0], len(sizes), items, parts)
    assert not none.any()


def test_short_items_are_asked_of_short_parts():
    """own_parts against counting the words of every short part that lies in a long one with enough; long parts alone would let more through."""
    draw, space = np.random.default_rng(15), np.zeros((1 << decontaminate.BITS, decontaminate.RANK), np.float32)
    names = [f"t{k}" for k in range(60)]
    items = decontaminate.make_items([(1, " ".join(draw.choice(names, 12))), (2, " ".join(draw.choice(names, 60)))], space)
    sizes = np.array([5, 160, 700, 2000])
    texts = [decontaminate.terms(" ".join(draw.choice(names, n))) for n in sizes]
    place, begins = decontaminate.places_of(np.concatenate(texts), items), np.cumsum(sizes) - sizes
    reach = max((length + 2 * (length // 2)) * decontaminate.BLOCK for length, _ in items.scales)
    parts = decontaminate.Parts.of(sizes, reach)
    word = np.concatenate([np.arange(n) for n in sizes])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    known = np.flatnonzero(place < len(items.vocabulary))
    held = decontaminate.held_by_texts(place[known], (parts.first[parts.begins][owner] + word // reach)[known], len(sizes), items, parts)
    got = decontaminate.own_parts(held, parts, begins, sizes, place, items)
    assert [p.reach for p, _ in got] == [(length + 2 * (length // 2)) * decontaminate.BLOCK for length, _ in items.scales]
    short = got[0][0].reach
    spans = [(t, short * k) for t, n in enumerate(sizes) for k in range(max(1, -(-n // short) - 1))]
    item = items.words[items.scales[0][1][0]]
    want = [bag_holds(texts[t][at : at + 2 * short], item) for t, at in spans]
    assert got[0][1][:, 0].tolist() == want and 0 < sum(want) < len(want) and held[:, items.scales[0][1][0]].mean() > np.mean(want)


def test_leaks_need_enough_words_near_each_other(monkeypatch):
    """An item whose words are strewn over a long text costs no comparison of its regions; one that stands together is found there."""
    names = [f"i{k}" for k in range(24)]
    items = decontaminate.make_items([(1, " ".join(names))], np.ones((1 << decontaminate.BITS, decontaminate.RANK), np.float32))
    space = np.ones((1 << decontaminate.BITS, decontaminate.RANK), np.float32)
    strewn = " ".join(f"{x} " + " ".join(f"f{k}" for k in range(60)) for x in names)
    asked = []
    real = decontaminate.possible
    monkeypatch.setattr(decontaminate, "possible", lambda region, *rest: asked.append(len(region)) or real(region, *rest))
    for text, found in ((strewn, 0), (strewn + " " + " ".join(names), 1)):
        asked.clear()
        hashes, counts = words_of_all([text], decontaminate.WORD_BYTES)
        got = decontaminate.leaks_in(hashes, counts, items, space)
        assert len(got) == found and (not found or got[0][1] == 1 and got[0][3] == 1.0)
        assert sum(asked) < 40 if found else not asked


def test_texts_that_hold_an_item_are_never_left_out():
    """held_by_texts against counting the words of every text and item, with repeated words and words that share their leading bits."""
    draw = np.random.default_rng(10)
    space = draw.normal(size=(1 << decontaminate.BITS, decontaminate.RANK)).astype(np.float32)
    items = decontaminate.make_items([(k, " ".join(f"v{n}" for n in draw.integers(0, 60, int(draw.integers(4, 30))))) for k in range(25)], space)
    texts = [decontaminate.terms(" ".join(f"v{n}" for n in draw.integers(0, 90, int(draw.integers(1, 120))))) for _ in range(30)]
    place = decontaminate.places_of(np.concatenate(texts), items)
    assert [items.vocabulary[p] if p < len(items.vocabulary) else None for p in place.tolist()] == [h if h in items.vocabulary else None for h in np.concatenate(texts)]
    got = decontaminate.held_by_texts(place, np.repeat(np.arange(30), [len(t) for t in texts]), 30, items)
    for t, text in enumerate(texts):
        for k, item in enumerate(items.words):
            answer = decontaminate.answer_of(item)
            share = np.isin(item, text).mean()
            assert got[t, k] == (share >= decontaminate.SHARE or share >= decontaminate.LOWER and np.isin(answer, text).sum() >= decontaminate.ANSWER_SHARE * len(answer))


def test_subsequence():
    draw = np.random.default_rng(1)
    for _ in range(30):
        a, b = draw.integers(0, 6, draw.integers(1, 40)).astype(np.uint64), draw.integers(0, 6, draw.integers(0, 60)).astype(np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert decontaminate.subsequence(a, b) == best[-1, -1]


def test_mixing(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).toPandas()
    shares = out.assign(w=out.weight * out.n_tokens).groupby("lang").agg(w=("w", "sum"), n=("n_tokens", "sum"))
    goal = shares.n**mixing.POWER
    assert np.allclose(shares.w / shares.w.sum(), goal / goal.sum(), atol=0.02)
    assert abs(out[out.kept].n_tokens.sum() / out.n_tokens.sum() - mixing.RATE) < 0.12
    assert mixing.mix(odd).count() == 12 and mixing.mix(none).count() == 0


def test_kept_tokens_meet_all_marginals(spark):
    """Expected shares of all three margins, the remainder of values with too few tokens, and the rate; the SQL's cut meets neither."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    got = mixing.shortfall(mixed).toPandas()
    assert set(got.margin) == set(mixing.MARGINS) and (got.wanted <= got.tokens + 1e-6).all()
    assert np.allclose(got.groupby("margin").expected.sum(), mixing.RATE * got.groupby("margin").tokens.sum(), rtol=0.01)
    assert (got.expected - got.wanted).abs().max() < 0.01 * mixing.RATE * got[got.margin == "lang"].tokens.sum()
    out = mixed.toPandas()
    assert out.probability.max() <= 1 and np.allclose(out.probability, mixing.RATE * out.weight)
    cut = mixing.shortfall(mixing.mix(docs, calibrated=False)).toPandas()
    assert (cut.expected - cut.wanted).abs().max() > 0.02 * mixing.RATE * cut[cut.margin == "lang"].tokens.sum()


def test_pages(spark):
    page = """<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><!-- x --><div class="cookie notice">Cookies.</div>
    <article><h1>Head &amp; &lt;more&gt;</h1><p>One   two,\n three.<br>four<p>&eacute;t&eacute; 1 < 2</p><ul><li>a<li>b</ul><form>Name</form></article><div id="comments"><p>First!</p></div><aside>s</aside><footer>&copy;"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "x " * 100_000), (None, "u", "<article>y"), (1, "u", page)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r.text for r in got if r.page_id == 1] == ["Head & <more>\nOne two, three. four\nété 1 < 2\na\nb"] * 2
    by = {r.page_id: r for r in got if r.page_id != 1}
    assert by[2].text == "" and by[3].n_chars == 0 and by[4].n_chars == 199_999 and by[None].text == "y"
    given = spark.read.parquet(f"{DATA}/pages.parquet")
    texts = {r.page_id: r.text for r in pages.extract_pages(given).collect()}
    assert texts and all(0 < len(t) and "©" not in t for t in texts.values())


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and len(got) == docs.count()
    toxic = [got[i].predicted for i in held if truth[i] == 1]
    clean = [got[i].predicted for i in held if truth[i] == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.05
    assert toxicity.judge(odd, labels).count() == 12 and toxicity.judge(none, labels).count() == 0
    assert {r.score for r in toxicity.judge(odd, labels.limit(0)).collect()} == {0.0}


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(3)
    gold = (draw.random(4000) < 0.2).astype(int)
    good = np.where(gold == 1, draw.random(4000) < 0.8, draw.random(4000) < 0.02).astype(float)
    bad = (draw.random(4000) < 0.3).astype(float)
    posterior, accuracy, correlation = toxicity.label_model(np.column_stack([good, good, bad]), gold)
    assert abs(accuracy[0][0] - 0.8) < 0.1 and abs(accuracy[0][2] - accuracy[1][2]) < 0.1 and correlation[0, 1] > 0.9
    assert posterior[gold == 1].mean() > 0.9


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) >= 0.97
    few = language.identify(odd).collect()
    assert len(few) == 12 and {r.lang_pred for r in few if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in few)
    assert language.identify(none).count() == 0


def test_fingerprints(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    chain = sorted(docs.collect(), key=lambda r: -r.doc_id)
    prints = {}
    for r, n in zip(chain, chain[1:] + chain[:1], strict=True):
        third = len(r.text) // 3
        edited = r.text[: len(r.text) - third] + n.text[:third]
        own = got[r.doc_id]
        assert own.n_chars == len(r.text) and own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r.text, own.fingerprint) == own.fingerprint
        for text, value in ((edited, own.near_edited), (n.text, own.near_next)):
            a, b = (set(fingerprints.digests(t).tolist()) for t in (r.text, text))
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert fingerprints.compare(own.fingerprint, own.edited_fingerprint) == pytest.approx(own.near_edited)
        assert fingerprints.compare(own.fingerprint, got[n.doc_id].fingerprint) == pytest.approx(own.near_next)
    few = fingerprints.fingerprint(odd).collect()
    assert len(few) == 12 and sum(r.doc_id is None for r in few) == 1
    assert fingerprints.fingerprint(none).count() == 0 and fingerprints.fingerprint(odd.limit(1)).count() == 1


@pytest.mark.parametrize("size", [0, 1, 500, 1_000, 20_000, 400_000])
def test_fingerprints_alone_tell_the_likeness(size):
    draw = np.random.default_rng(size)
    text = "".join(map(chr, draw.integers(97, 123, size)))
    for other in (text, text[: size - size // 3] + "z" * (size // 3), text[:40], "", "".join(map(chr, draw.integers(97, 123, size * 2)))):
        a, b = (fingerprints.digests(t) for t in (text, other))
        want = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) if len(a) + len(b) else 1.0
        left, right = fingerprints.printed([a, b])
        assert fingerprints.compare(left, right) == pytest.approx(want) and fingerprints.compare(right, left) == pytest.approx(want)
        keys, signs = fingerprints.peel(*fingerprints.read(left)[1:])
        assert sorted(keys.tolist()) == sorted(a.tolist()) and (signs == 1).all()


def test_urls(spark):
    rows = ["http://a.COM/x", "http://example.com/en/1", "https://www.example.com/en/2?q", "https://m.net/es/", "http://net/fr/#a", "http://x.com", "no url", None, "a://casino-win.org?x", "http://notexample.com/en/"]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string"), rules=queries.URL_RULES).collect()}
    assert [got[k].rule for k in range(10)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, "com/"]
    assert [got[k].verdict for k in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[0].host, got[0].path, got[5].path, got[7].host, got[6].path) == ("a.com", "/x", "", "", "")
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    judged = urls.judge_urls(given).collect()
    assert all((r.verdict == "block") == bool(re.search(r"casino|spam|adult|bets|pills|ads-", r.host)) for r in judged)
    assert urls.judge_urls(given.limit(0)).count() == 0


def test_passages(spark, odd, none):
    shared, near = words(20, 60), words(21, 80).split()
    changed = list(near)
    changed[40] = "changed"
    rows = [(1, words(22, 45) + " " + shared + " " + words(23, 33)), (2, shared + " " + words(24, 90)), (3, " ".join(near) + "\nend"), (4, "start\n" + " ".join(changed)), (5, words(25, 200)), (6, None), (None, shared), (7, shared)]
    got = {r.doc_id: r for r in paragraphs.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 7} and got[1].n_removed == got[3].n_removed == 0
    assert got[2].first_docs == [1] and 3 in got[4].first_docs and got[4].n_removed > 0
    assert [(s.kind, s.start, s.words, s.removed) for s in got[1].spans] == [("passage", 45, 60, False)]
    assert [(s.start, s.words) for s in got[2].spans if s.kind == "passage"] == [(0, 60)]
    assert paragraphs.substring_dedup(odd).where("doc_id in (1, 2, 3, 4, 7)").count() == 0 and paragraphs.substring_dedup(none).count() == 0


def test_passages_are_whole(spark, monkeypatch):
    """The spans cover exactly the words of the runs that several documents hold, found by comparing all runs; one run is hot."""
    monkeypatch.setattr(paragraphs, "HOT_ROWS", 2)
    draw, size = np.random.default_rng(5), paragraphs.RUN
    sources = [words(500 + k, n).split() for k, n in enumerate([49, 50, 51, 70, 120, 400])]
    texts = []
    for k in range(60):
        text = words(600 + k, int(draw.integers(0, 60))).split()
        for _ in range(int(draw.integers(0, 4))):
            source = sources[draw.integers(len(sources))]
            begin = int(draw.integers(0, max(1, len(source) - 48)))
            text += source[begin : begin + int(draw.integers(40, 200))] + words(int(draw.integers(1 << 30)), int(draw.integers(0, 30))).split()
        texts.append(text)
    holders = {}
    for k, text in enumerate(texts):
        for s in range(len(text) - size + 1):
            holders.setdefault(tuple(text[s : s + size]), set()).add(k)
    want, gone = set(), set()
    for k, text in enumerate(texts):
        for s in range(len(text) - size + 1):
            held = holders[tuple(text[s : s + size])]
            if len(held) > 1:
                (gone if min(held) != k else want).update((k, w) for w in range(s, s + size))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = paragraphs.repeated_runs(docs).collect()
    cover = lambda removed: {(r.doc_id, w) for r in got if r.removed == removed for w in range(r.start, r.start + r.words)}
    assert want and gone and cover(False) == want and cover(True) == gone
    assert len(got) == len({(r.doc_id, r.removed, r.start) for r in got}) and all(r.words >= size and (r.first != r.doc_id) == r.removed for r in got)


def test_runs_are_joined_across_batches():
    draw = np.random.default_rng(6)
    rows = sorted({(int(draw.integers(3)), bool(draw.integers(2)), int(draw.integers(0, 2000))) for _ in range(120)})
    frame = pd.DataFrame([(*r, int(draw.integers(100))) for r in rows], columns=["doc_id", "removed", "start", "first"])
    want, last = [], None
    for r in frame.itertuples():
        if last and want[-1][:2] == [r.doc_id, r.removed] and r.start < last + paragraphs.RUN:
            want[-1][3], want[-1][4] = r.start - want[-1][2] + paragraphs.RUN, min(want[-1][4], r.first)
        else:
            want.append([r.doc_id, r.removed, r.start, paragraphs.RUN, r.first])
        last = r.start
    for size in (1, 7, 1000):
        batches = [frame.iloc[k : k + size] for k in range(0, len(frame), size)]
        got = pd.concat(list(paragraphs.joined_runs(iter([frame[:0], *batches]))))[["doc_id", "removed", "start", "words", "first"]]
        assert got.values.tolist() == want
    assert not list(paragraphs.joined_runs(iter([])))


def test_equal_stretches_are_compared_once(spark, monkeypatch):
    """The runs of 30 copies in different surroundings cost hardly more rows than those of one, and all copies are found whole."""
    copied = words(50, 400)
    own = [[f"d{k}n{n}" for n in range(60 + k)] for k in range(30)]
    texts = [" ".join([*x[:-30], copied, *x[-30:]]) for x in own]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    rows, real = [], paragraphs.cut

    def counted(frame):
        out = real(frame)
        if "place" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(paragraphs, "cut", counted)
    got = {(r.doc_id, r.start, r.words, r.first, r.removed) for r in paragraphs.repeated_runs(docs).collect()}
    assert got == {(k, 30 + k, 400, 0, k > 0) for k in range(30)}
    assert len(rows) == 1 and rows[0] < 351 + 30 * 4 * paragraphs.REACH < 30 * 351 / 3  # each document has runs of its own at both ends only


def test_places_of_stretches_are_joined_across_batches():
    draw = np.random.default_rng(13)
    rows = sorted({(int(draw.integers(40)), int(draw.integers(20))) for _ in range(400)})
    rows = [(*r, int(draw.integers(2))) for r in rows]
    want = []
    for g, k, first in rows:
        if want and want[-1][0] == g and want[-1][2] == k - 1 and want[-1][3] == first:
            want[-1][2] = k
        else:
            want.append([g, k, k, first])
    mixed = [x for g in range(40) for x in draw.permutation([r for r in rows if r[0] == g] or np.empty((0, 3), int)).tolist()]  # places come in any order
    frame = pd.DataFrame(mixed, columns=["stretch", "place", "first"])
    for size in (1, 7, 1000):
        batches = [frame.iloc[k : k + size] for k in range(0, len(frame), size)]
        got = pd.concat(list(paragraphs.joined_places(iter([frame[:0], *batches]))))
        assert got.values.tolist() == want
    assert not list(paragraphs.joined_places(iter([])))


def test_passages_of_rows_that_lie_within_each_other():
    """Documents that repeat an id may have a row within another; the longer one tells where the passage ends."""
    frame = pd.DataFrame({"doc_id": [1, 1, 1, 2], "removed": [True, True, True, True], "start": [0, 5, 140, 3], "last": [100, 7, 150, 3], "first": [0, 0, 0, 0]})
    for size in (1, 4):
        got = pd.concat(list(paragraphs.joined_runs(iter([frame.iloc[k : k + size] for k in range(0, 4, size)]))))
        assert got[["doc_id", "start", "words"]].values.tolist() == [[1, 0, 200], [2, 3, 50]]


def test_few_unwanted_windows_are_let_through(spark):
    hashes = np.random.default_rng(14).integers(0, 1 << 63, 60_000)
    wanted = spark.createDataFrame(pd.DataFrame({"h": hashes[:20_000]}))
    hit = paragraphs.known(paragraphs.wanted_bits(wanted, 20_000), hashes.view(np.uint64))
    assert hit[:20_000].all() and hit[20_000:].mean() < 0.02


def test_paragraphs_are_told_by_their_words(spark):
    texts = [" ".join(["wordy"] * n) for n in (28, 29, 30, 31)]
    texts += [f" \t{t}\x0b\r" for t in texts] + [t.replace(" ", " \t\x0c") for t in texts] + ["\u00a0".join(["wordy"] * 40), "x" * 500, " " * 500, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.doc_id for r in paragraphs.paragraphs(docs).collect()} == {k for k, t in enumerate(texts) if len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t)) >= 30}


def test_many_cells_are_handed_over_at_once():
    frame = pd.DataFrame({"gid": np.repeat(np.arange(50), 3), "cell": 0, "x": np.arange(150)})
    got = list(common.runs(iter([frame[:70], frame[:0], frame[70:]]), ["gid", "cell"]))
    cells = [part["x"].iloc[a:b].tolist() for part, starts in got for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert cells == [[k, k + 1, k + 2] for k in range(0, 150, 3)] and len(got) == 3


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: sum("shuffle_" in f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(","))
    before = files()
    out = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 7


def test_every_copied_run_of_fifty_words_holds_a_common_window():
    draw = np.random.default_rng(11)
    for k in range(200):
        run = words(1000 + k, 50)
        sets = []
        for _ in range(2):
            w = word_hashes(words(draw.integers(1 << 30), 30) + " " + run + " " + words(draw.integers(1 << 30), 30))
            sets.append({tuple(w[s : s + paragraphs.WINDOW].tolist()) for s in paragraphs.anchors(w) if s + paragraphs.WINDOW <= len(w)})
        assert sets[0] & sets[1]


def test_pipeline(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA).cache()
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {r.doc_id for r in before.collect()}, name
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "near dedup":
            assert ids == {g for _, _, g in brute_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)}
        if name == "mixing":
            weights = {r.doc_id: r.weight for r in mixing.mix(before).collect()}
            assert ids == {i for i, w in weights.items() if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < mixing.RATE * w}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    for rows in (odd.drop("id", "component"), none.drop("id", "component")):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, DATA).cache()
            rows.count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("calibrated", [True, False])
def test_mixing_of_few_cells_equals_sweeps(spark, monkeypatch, calibrated):
    """One task over the cells and a job for each sweep give the same probabilities."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    get = lambda: {r.doc_id: (r.raked, r.probability, r.kept) for r in mixing.mix(docs, calibrated=calibrated).collect()}
    one = get()
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    many = get()
    assert one.keys() == many.keys()
    assert all(abs(one[k][0] - many[k][0]) < 1e-9 * many[k][0] + 1e-12 and abs(one[k][1] - many[k][1]) < 1e-9 and one[k][2] == many[k][2] for k in one)
