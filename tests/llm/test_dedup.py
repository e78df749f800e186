"""Near-duplicates, repeated passages, repeated lines."""

import hashlib
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, components, line_dedup, near_dedup, substring_dedup
from folioflow.llm.common import Powers, shingles_of, tree_hashes, word_hashes
from folioflow.llm.runs import Runs


def _empty(spark):
    return spark.createDataFrame([], cases.DOCS)


# ---------------------------------------------------------------- near-duplicates


@pytest.mark.parametrize("similarity", [(85, 100), (80, 100), (60, 100)])
def test_components_equal_brute_force(spark, similarity):
    rows = cases.hard_documents()
    got = near_dedup.grouped(cases.frame(spark, rows), similarity).select("doc_id", "n_shingles", "component_id").collect()
    want = [(r[0], len(cases.shingle_set(r[1])), k) for r, k in zip(rows, cases.components(rows, *similarity), strict=True)]
    assert cases.ordered(map(tuple, got)) == cases.ordered(want)


def test_chain_of_near_copies(spark):
    texts, rng = [cases.prose(1, 200)], random.Random(5)
    for k in range(30):
        texts.append(cases.edited(texts[-1], rng.randrange(10**6) + k, 1))
    rows = [(100 - k, t, "en", "s", 1) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.grouped(cases.frame(spark, rows), (85, 100)).collect()}
    assert got == {r[0]: k for r, k in zip(rows, cases.components(rows, 85, 100), strict=True)}


def test_families_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    base = cases.prose(4, 120)
    rows = [(k, cases.edited(base, k, k % 6), "en", "s", 1) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.grouped(cases.frame(spark, rows), (85, 100)).collect()}
    assert got == {r[0]: k for r, k in zip(rows, cases.components(rows, 85, 100), strict=True)}


@pytest.mark.parametrize("similarity", [(85, 100), (60, 100), (50, 100)])
def test_borderline_links_are_found_at_any_similarity(spark, similarity):
    num, den = similarity
    rows = []
    for k in range(150):
        words = cases.prose(7000 + k, 200).split()
        cut = -(-196 * 2 * num // (num + den)) + 4  # words from the front that just reach the similarity
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, f"{' '.join(words[:cut])} {cases.prose(9000 + k, 200 - cut)}", "en", "s", 1)]
    got = near_dedup.grouped(cases.frame(spark, rows), similarity).select("doc_id", "component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {r[0]: r[0] // 2 * 2 for r in rows}


def test_similarities_that_samples_would_miss_are_refused(spark):
    for similarity in (0.12, 0.3, 0.5, 0.7, 0.8, 0.85, 1.0):
        rows = near_dedup.rows_of(similarity)
        assert (1 - similarity**rows) ** (96 // rows) <= near_dedup.MISS and (rows == 4) == (similarity >= 0.8)
    with pytest.raises(ValueError):
        near_dedup.grouped(_empty(spark), (10, 100))


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = [r for r in cases.hard_documents() if r[0] is not None and r[0] != 2]
    docs = cases.frame(spark, rows).withColumn("nid", F.lit("x")).withColumn("hi", F.lit(1)).withColumn("bands", F.lit(2))
    got = near_dedup.first_of_each_group(docs, (85, 100))
    assert got.columns == docs.columns
    want = [r[0] for r, k in zip(rows, cases.components(rows, 85, 100), strict=True) if r[0] == k]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_one_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b, c, d = (cases.prose(s, 90) for s in (400, 401, 402, 403))
    rows = [(None, a), (None, a), (None, cases.edited(a, 1, 1)), (7, b), (7, b), (7, cases.edited(b, 2, 1)), (9, b), (None, b), (7, c), (8, c), (None, d), (3, d), (5, None), (5, None), (None, " ")]
    rows = [(i, t, "en", f"s{k % 2}", 1) for k, (i, t) in enumerate(rows)]
    docs = cases.frame(spark, rows)
    got = list(map(tuple, near_dedup.first_of_each_group(docs, (80, 100)).collect()))
    assert not set(got) - set(rows)
    kind = lambda t: next((k for k, x in enumerate((a, b, c, d)) if t and len(cases.shingle_set(t) & cases.shingle_set(x)) > 60), None)
    assert sorted((r[0] or 0, kind(r[1]) if kind(r[1]) is not None else 9) for r in got) == [(0, 0), (0, 9), (3, 3), (5, 9), (5, 9), (7, 1), (7, 2)]
    assert cases.ordered(got) == cases.ordered(map(tuple, near_dedup.first_of_each_group(cases.frame(spark, rows[::-1], parts=2), (80, 100)).collect()))


def test_near_dedup_of_nothing(spark):
    assert near_dedup.grouped(_empty(spark)).count() == 0
    assert near_dedup.first_of_each_group(_empty(spark)).count() == 0
    assert near_dedup.grouped(cases.frame(spark, [(1, None, None, None, None), (None, "", "", "", 0)])).select("component_id").orderBy("component_id").collect() == [(None,), (1,)]


@pytest.mark.parametrize("share,off", [(0.5, 0.12), (0.8, 0.08), (0.85, 0.07), (0.9, 0.06), (0.95, 0.05), (1.0, 0.0)])
def test_odd_sketches_estimate_similarity(share, off):
    rng = np.random.default_rng(int(100 * share))
    for size in (300, 3000):
        seen = []
        for _ in range(25):
            own = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            other = own.copy()
            cut = round(size * (1 - share) / (1 + share))
            other[:cut] = rng.integers(0, 1 << 63, cut, dtype=np.uint64)
            a, b = (np.frombuffer(near_dedup.odd_sketch(x), np.uint64) for x in (own, other))
            seen.append(int(np.bitwise_count(a ^ b).sum()))
        estimates = near_dedup.estimated(np.array(seen))
        assert abs(estimates - share).max() <= off and abs(estimates.mean() - share) <= off / 3
        if share >= 0.85:
            assert max(seen) <= near_dedup.most_differing(0.85)


def test_odd_sketches_rule_out_what_is_far():
    assert 0.73 < near_dedup.estimated(near_dedup.most_differing(0.85)) < 0.85
    assert 0.65 < near_dedup.estimated(near_dedup.most_differing(0.80)) < 0.80


def test_a_large_family_is_compared_with_its_leader(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 64)
    base, rng = cases.prose(4, 300).split(), random.Random(8)
    rows = []
    for k in range(3000):
        words = list(base)
        words[rng.randrange(300)] = f"w{k}"  # all members are near the base, and so one component
        rows.append((k, " ".join(words), "en", "s", 1))
    seen = []
    real = near_dedup.compared_with_leaders
    monkeypatch.setattr(near_dedup, "compared_with_leaders", lambda *given: seen.append(real(*given)) or seen[0])
    monkeypatch.setattr(near_dedup, "discard", lambda *frames: None)
    got = near_dedup.grouped(cases.frame(spark, rows, parts=6), (85, 100)).select("component_id").distinct().collect()
    assert got == [(0,)] and seen[0].count() < 20 * len(rows)


@pytest.mark.parametrize("block", [8, 1024])
def test_families_of_several_components(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)
    base = cases.prose(14, 300).split()
    rows, rng = [], random.Random(9)
    for k in range(120):  # members drift away from the base, some beyond the similarity
        words = list(base)
        for at in rng.sample(range(300), k // 12):
            words[at] = f"x{k % 7}"
        rows.append((k, " ".join(words), "en", "s", 1))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.grouped(cases.frame(spark, rows), (85, 100)).collect()}
    want = {r[0]: k for r, k in zip(rows, cases.components(rows, 85, 100), strict=True)}
    assert got == want and 2 < len(set(want.values())) < 100


def test_near_dedup_with_other_ids(spark):
    rows = cases.hard_documents()
    names = {r[0]: f"id {r[0]:06d}" if r[0] is not None else None for r in rows}
    docs = cases.frame(spark, [(names[r[0]], *r[1:]) for r in rows], cases.DOCS.replace("doc_id long", "doc_id string"))
    got = near_dedup.grouped(docs, (85, 100)).select("doc_id", "n_shingles", "component_id").collect()
    want = [(names[r[0]], len(cases.shingle_set(r[1])), names[k]) for r, k in zip(rows, cases.components(rows, 85, 100), strict=True)]
    assert cases.ordered(map(tuple, got)) == cases.ordered(want)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1030)] + [(7000, 7000)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1030)}, 7000: 7000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_the_sets():
    powers = Powers()
    for text in (b"", b"a", b"a b c", b"a b c d e", b"a a a a a a a", b"x y " * 50, cases.prose(3, 500).encode().lower()):
        assert len(shingles_of(word_hashes(text), powers)) == len(cases.shingle_set(text.decode()))


# ---------------------------------------------------------------- repeated passages


def brute_substrings(rows, width):
    seen = {}
    for r in rows:
        w = cases.split(r[1])
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for r in rows:
        w = cases.split(r[1])
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("width,gram,batches", [(35, 12, 4), (8, 3, 2), (5, 5, 1)])
def test_substrings_equal_brute_force(spark, width, gram, batches):
    rows = cases.hard_documents()
    got = substring_dedup.deduplicated(cases.frame(spark, rows), width, gram, batches).drop("kept_text").collect()
    assert cases.ordered(map(tuple, got)) == cases.ordered(brute_substrings(rows, width))


@pytest.mark.parametrize("width,gram,batches", [(35, 12, 2), (8, 3, 1)])
def test_substrings_of_later_calls_meet_the_index(spark, width, gram, batches):
    rows = cases.hard_documents()
    rows = rows[::3] + rows[1::3] + rows[2::3]
    index, seen = Runs(spark, ["name"], fanout=2, prefix="history"), []
    n, alone, stored = len(rows) // 4, 0, 0
    for k, part in enumerate((rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], [], rows[3 * n :])):
        got = substring_dedup.deduplicated(cases.frame(spark, part), width, gram, batches, index, f"batch {k}").drop("kept_text")
        state = index.state()
        if k == 2:  # a session that doesn't know the tables registers them again
            for name in index.tables:
                spark.sql(f"DROP TABLE {name}")
        index = Runs.resume(spark, state)
        seen += part
        want = brute_substrings(seen, width)[len(seen) - len(part) :]
        assert cases.ordered(map(tuple, got.collect())) == cases.ordered(want)
        alone += sum(a[2] > b[2] for a, b in zip(want, brute_substrings(part, width), strict=True))
        stored += len({tuple(w[i : i + width]) for w in (cases.split(r[1]) for r in part) for i in range(len(w) - width + 1)})
    assert alone > 0  # rows that lose words to history only
    assert sum(spark.table(t).count() for t in index.tables) == stored
    index.drop()


def test_a_batch_given_again_equals_brute_force(spark):
    """A failure behind a call, the same batch once more, changed rows under its name, and others between."""
    passage, other, alone = (cases.prose(500 + k, 60) for k in range(3))
    index = Runs(spark, ["name"], fanout=2, prefix="again")

    def call(name, rows, history):
        got = substring_dedup.deduplicated(cases.frame(spark, [(*r, "en", "s", 1) for r in rows]), index=index, batch=name).drop("kept_text")
        want = brute_substrings([*history, *rows], 35)[len(history) :]
        assert cases.ordered(map(tuple, got.collect())) == cases.ordered(want)
        return [r[2] for r in sorted(want)]

    first, second = [(1, passage)], [(2, passage), (3, alone), (4, other)]
    assert call("one", first, []) == [0]
    for _ in range(3):
        assert call("two", second, first) == [60, 0, 0]
    assert call("one", first, second) == [60]  # now the second batch is history
    assert call("three", [(5, alone)], [*first, *second]) == [60]
    assert call("two", second[:1], [*first, (5, alone)]) == [60]  # its two other texts are gone
    assert call("four", [(6, other), (7, alone)], [*first, second[0], (5, alone)]) == [0, 60]
    with pytest.raises(ValueError):
        substring_dedup.deduplicated(cases.frame(spark, []), index=index)
    index.drop()


def _text_shuffled_whole(df) -> bool:
    """Whether some exchange of rows with a text has no filter of names below it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for x in lines[k + 1 :]:
                if len(x) - len(x.lstrip(" :+-*(0123456789)")) <= depth:
                    break
                below.append(x)
            whole = "\n".join(below)
            if "ReadSchema" in whole and "text:" in whole and "ArrowEvalPython" not in whole:
                return True
    return False


def test_texts_move_behind_the_filter(spark, sf, tmp_path, monkeypatch):
    """Only rows that a filter of names lets through are shuffled with their text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for module in (substring_dedup, near_dedup, line_dedup):
        real = module.map_rows
        monkeypatch.setattr(module, "map_rows", lambda df, *a, _real=real, **k: seen.append(_text_shuffled_whole(df)) or _real(df, *a, **k))
    substring_dedup.deduplicated(docs)
    line_dedup.deduplicated(docs)
    kept = near_dedup.first_of_each_group(docs, (80, 100))
    assert len(seen) > 5 and not any(seen) and not _text_shuffled_whole(kept)
    assert _text_shuffled_whole(docs.repartition(3, "doc_id"))


def test_the_filter_loses_no_row(spark):
    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE cast(id AS STRING) END AS name")
    wanted = rows.where("id % 7 = 0")
    here = rows.where(common.maybe_among([F.col("id"), F.col("name")], wanted))
    assert wanted.exceptAll(here).count() == 0 and here.count() < 600
    assert rows.where(common.maybe_among([F.col("id")], wanted.select("id").where("false"))).count() == 0


def thue_morse(n, swapped=False):
    return " ".join("ab"[(k.bit_count() + swapped) % 2] for k in range(n))


@pytest.mark.parametrize("width,gram", [(35, 12), (8, 3)])
def test_patterned_texts_are_told_apart(spark, width, gram):
    plain = cases.prose(12, 10)
    rows = [(1, f"{plain} {thue_morse(1024)}"), (2, f"{plain} {thue_morse(1024, True)}"), (3, f"{thue_morse(2048)} {plain}"), (4, f"{thue_morse(2048, True)} {plain}"), (5, "a b " * 30), (6, "b a " * 30 + "c")]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    got = substring_dedup.deduplicated(cases.frame(spark, rows), width, gram).drop("kept_text").collect()
    assert cases.ordered(map(tuple, got)) == cases.ordered(brute_substrings(rows, width))


def test_patterns_do_not_cancel_out():
    a, b = (word_hashes(thue_morse(4096, swapped).encode()) for swapped in (False, True))
    assert Powers().windows(a, 4096)[0] == Powers().windows(b, 4096)[0]  # sums of powers do
    assert tree_hashes(a, 4096, 1)[0] != tree_hashes(b, 4096, 1)[0]
    short = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64)
    for width in (1, 2, 3, 5, 8, 9):
        got = tree_hashes(short, width, 7).tolist()
        want = [tuple(short[k : k + width]) for k in range(len(short) - width + 1)]
        assert len(got) == len(want) and all((x == y) == (v == w) for x, v in zip(got, want, strict=True) for y, w in zip(got, want, strict=True))


def test_words_are_told_apart():
    rng = random.Random(3)
    for _ in range(100):
        words = [bytes(rng.choices(b"abXY\xc3\xa9", k=rng.choice([1, 2, 5, 63, 64, 65, 300]))) for _ in range(12)]
        text = b"".join(rng.choice([b" ", b"\n\n", b" \t\x0b\x0c\r"]) + w for w in words)
        got = word_hashes(text)
        assert all((x == y) == (v == w) for x, v in zip(got, words, strict=True) for y, w in zip(got, words, strict=True))
    assert len(word_hashes(b" \n")) == len(word_hashes(None)) == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = cases.prose(5, 4000).encode() + b" " + b"x" * 5000 + b" end"
    whole = word_hashes(text)
    monkeypatch.setattr("folioflow.llm.common._PIECE", 100)
    assert (word_hashes(text) == whole).all() and len(whole) == len(text.split())


def test_substrings_with_other_ids_and_columns(spark):
    rows = [*cases.hard_documents(), (300, cases.prose(301, 30_000), "en", "s", 1), (302, f"{cases.prose(303, 3)} {cases.prose(301, 30_000)}", "en", "s", 1)]
    docs = cases.frame(spark, [(f"id-{r[0]}" if r[0] is not None else None, *r[1:]) for r in rows], cases.DOCS.replace("doc_id long", "doc_id string"))
    docs = docs.withColumns({c: F.lit("own") for c in ("nid", "th", "hi", "lo", "sha", "once", "names", "copies", "at", "one", "two", "starts")})
    want = [(f"id-{i}" if i is not None else None, *rest) for i, *rest in brute_substrings(rows, 35)]
    assert cases.ordered(map(tuple, substring_dedup.deduplicated(docs).drop("kept_text").collect())) == cases.ordered(want)


def test_kept_text_has_its_digest(spark):
    rows = substring_dedup.deduplicated(cases.frame(spark, cases.hard_documents())).where("kept_text IS NOT NULL").collect()
    assert rows and all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def test_substrings_of_nothing(spark):
    assert substring_dedup.deduplicated(_empty(spark)).count() == 0


def test_names_are_shared_by_equal_windows():
    w = substring_dedup.Windows(35, 12)
    words = cases.prose(1, 300).encode().split()
    a, b = w.grams(word_hashes(b" ".join(words))), w.grams(word_hashes(b" ".join(words[100:])))
    names = w.names(a)
    assert len(names) == len(words) - 34 and (names[100:] == w.names(b)).all()
    assert names[0] == a[:24].min() and names[-1] == a[-24:].min()


# ---------------------------------------------------------------- repeated lines


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(upper)
    place = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), 2**63), place(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= 10 and first[key(x)] < place(r[0]))]
        out.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines_equal_brute_force(spark, batches):
    rows = cases.hard_documents()
    got = line_dedup.deduplicated(cases.frame(spark, rows), batches=batches).collect()
    assert cases.ordered(map(tuple, got)) == cases.ordered(brute_lines(rows))


def test_lines_of_later_batches_meet_the_index(spark):
    index = Runs(spark, ["hi", "lo"], fanout=2, prefix="test")
    rows = sorted((r for r in cases.hard_documents() if r[0] is not None), key=lambda r: r[0])
    got = []
    for part in (rows[:15], rows[15:25], rows[25:]):
        got += line_dedup.deduplicated(cases.frame(spark, part), batches=1, runs=index).collect()
    index = Runs.resume(spark, index.state())
    assert len(index.tables) < 3 + 1
    assert cases.ordered(map(tuple, got)) == cases.ordered(brute_lines(rows))
    index.drop()


def test_lines_with_other_ids_and_columns(spark):
    rows = cases.hard_documents()
    names = {r[0]: f"id {r[0] or 0:06d}" if r[0] is not None else None for r in rows}
    docs = cases.frame(spark, [(names[r[0]], *r[1:]) for r in rows], cases.DOCS.replace("doc_id long", "doc_id string"))
    docs = docs.withColumns({c: F.lit(1) for c in ("owner", "row", "hi", "lo", "keys", "holder", "own")})
    want = [(names[r[0]], *r[1:]) for r in brute_lines(rows)]
    assert cases.ordered(map(tuple, line_dedup.deduplicated(docs).collect())) == cases.ordered(want)


def test_lines_of_rows_without_id(spark):
    common, rare = "a line that all of them hold", "a line that only rows without id hold"
    rows = [(None, f"{common}\n{rare} \nown {k % 3}", "en", "s", 1) for k in range(9)]
    assert {tuple(r) for r in line_dedup.deduplicated(cases.frame(spark, rows)).collect()} == {(None, 3, 0, r[1]) for r in rows}
    got = line_dedup.deduplicated(cases.frame(spark, [*rows, (4, common.upper(), "en", "s", 1)])).collect()
    assert {tuple(r) for r in got} == {(4, 1, 0, common.upper()), *((None, 3, 1, f"{rare} \nown {k}") for k in range(3))}
    index = Runs(spark, ["hi", "lo"], prefix="unnamed")
    for k, dropped in enumerate((0, 2, 0)):
        part = [(None if k != 1 else 1, rows[0][1].replace("own 0", "own"), "en", "s", 1)]
        assert [r["n_dropped"] for r in line_dedup.deduplicated(cases.frame(spark, part), runs=index).collect()] == [dropped]
    index.drop()


def test_lines_of_nothing(spark):
    assert line_dedup.deduplicated(_empty(spark)).count() == 0


def test_runs_compact_by_level(spark):
    runs = Runs(spark, ["h"], fanout=2, buckets=2, prefix="levels")
    for k in range(5):
        batch = spark.range(10 * k, 10 * k + 15).withColumnRenamed("id", "h")
        new = runs.absent(batch)
        runs.add(new)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r["h"] for t in runs.tables for r in spark.table(t).collect()) == list(range(55))
    assert runs.present(spark.createDataFrame([(3,), (99,)], "h long")).count() == 1
    plan = runs.absent(runs.dealt(spark.range(5).withColumnRenamed("id", "h")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1
    runs.drop()
