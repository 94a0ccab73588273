"""Near duplicates, repeated passages and fuzzy lines against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHES, Groups, no_documents, odd_documents, odd_texts, shingles, split
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import line_dedup, near_duplicates as nd, similar, words


def key_order(k):
    return (k is None, k if k is not None else 0)


def expected_components(texts, width, percent):
    sets = [shingles(t, width) for _, t in texts]
    groups = Groups(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and texts[i][0] is not None and texts[j][0] is not None:
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    groups.join(i, j)
    low = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            low[groups.root(i)] = min(low.get(groups.root(i), k), k)
    return Counter((k, len(s), low[groups.root(i)] if k is not None else None, k is None or low[groups.root(i)] == k) for i, ((k, _), s) in enumerate(zip(texts, sets)))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    texts = odd_texts()
    got = Counter(map(tuple, nd.near_duplicates(odd_documents(spark), width=width, percent=percent).collect()))
    assert got == expected_components(texts, width, percent)


def test_near_duplicates_in_tiles_and_stars(spark, monkeypatch):
    """A family beyond a task's limit is compared block by block; long runs of a key are stars."""
    monkeypatch.setattr(nd, "TASK_SHINGLES", 6_000)
    monkeypatch.setattr(nd, "meet", lambda entries: similar.meet(entries, 4))
    monkeypatch.setattr(nd, "by_bucket", lambda keys, ids, bits: similar.by_bucket(keys, ids, bits, 3))
    got = Counter(map(tuple, nd.near_duplicates(odd_documents(spark, 8), width=3, percent=85).collect()))
    assert got == expected_components(odd_texts(8), 3, 85)


def test_signature_distance_is_never_missed():
    """Every pair within the allowed distance shares a key: one chunk has one error at most."""
    for percent in (80, 85, 95):
        allowed = nd.allowed_distance(percent)
        chunks = np.array_split(np.arange(nd.SYMBOLS), (allowed + 1) // 2)
        assert 2 * len(chunks) > allowed
        rng = np.random.default_rng(percent)
        for _ in range(200):
            wrong = set(rng.choice(nd.SYMBOLS, allowed, replace=False).tolist())
            assert min(len(wrong & set(c.tolist())) for c in chunks) <= 1


def test_empty_tables(spark):
    from llm.substring_dedup import remove_repeats
    none = no_documents(spark)
    assert nd.near_duplicates(none).count() == 0
    assert remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def expected_repeats(texts, width):
    lists = [split(t) for _, t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in lists for i in range(len(w) - width + 1))
    out = Counter()
    for (k, _), w in zip(texts, lists):
        covered = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                covered[i:i + width] = [True] * width
        out[k, len(w), sum(covered), " ".join(x for x, c in zip(w, covered) if not c)] += 1
    return out


@pytest.mark.parametrize("width", [35, 6])
def test_repeated_passages(spark, width, monkeypatch):
    from llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 20_000)  # several chunks
    got = Counter(map(tuple, substring_dedup.remove_repeats(odd_documents(spark), width=width).collect()))
    assert got == expected_repeats(odd_texts(), width)


def expected_lines(texts, percent):
    """The same signatures, compared all with all: what the tables, stars, families and tiles must not lose. What the signatures lose is in test_line_recall."""
    distinct = {(k, t): None for k, t in texts}
    lines, signs = {}, {}
    for k, t in distinct:
        data = np.frombuffer((t or "").encode(), np.uint8)
        found = line_dedup.HashedLines(data, np.array([0, len(data)]))
        for n, raw in enumerate((t or "").split("\n")):
            normal = line_dedup.normal_line(raw.encode())
            lines[k, t, n] = normal
            signs.setdefault(normal, (int(found.sign[n]), int(found.sign2[n])))
    classes = [x for x in signs if x]
    groups, at = Groups(len(classes)), {x: i for i, x in enumerate(classes)}
    for i, a in enumerate(classes):
        for j in range(i):
            apart, apart2 = (x ^ y for x, y in zip(signs[a], signs[classes[j]]))
            blocks = sum(not apart & int(mask) for mask in line_dedup._MASKS)
            bits = apart.bit_count(), (apart2 >> 16).bit_count()
            if blocks >= 2 and (bits[0] <= line_dedup.SURE_DISTANCE or sum(bits) <= line_dedup.BOTH_DISTANCE) and line_dedup.similar_lines(a, classes[j], percent):
                groups.join(i, j)
    marks = {}
    for k, t in distinct:
        marks[k, t] = MARK[k, t]
    first = {}
    for (k, t, n), normal in lines.items():
        if normal:
            g = groups.root(at[normal])
            place = (key_order(k), marks[k, t], n)
            first[g] = min(first.get(g, place), place)
    out = Counter()
    for k, t in texts:
        if t is None:
            out[k, None, 0, 0] += 1
            continue
        kept, some, gone = [], 0, 0
        for n, raw in enumerate(t.split("\n")):
            normal = lines[k, t, n]
            some += bool(normal)
            if normal and first[groups.root(at[normal])] != (key_order(k), marks[k, t], n):
                gone += 1
            else:
                kept.append(raw)
        out[k, "\n".join(kept), some, gone] += 1
    return out


MARK: dict = {}


@pytest.mark.parametrize("tiles", [False, True])
def test_fuzzy_lines(spark, tiles, monkeypatch):
    from pyspark.sql import functions as F
    docs = odd_documents(spark)
    MARK.update({(r.doc_id, r.text): r.m for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("m")).collect()})
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", 20_000)
    if tiles:
        monkeypatch.setattr(line_dedup, "TASK_CHARS", 2_000)
        monkeypatch.setattr(line_dedup, "SENT_RUN", 2)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect())
    assert got == expected_lines(odd_texts(), 80)
    assert all(r[c] == "x" for r in out.select(*CLASHES).collect() for c in CLASHES)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc é", max_size=20), st.text("abc é", max_size=20))
def test_edit_distance(a, b):
    assert line_dedup.edit_distance(a, b) == plain_distance(a, b) <= line_dedup.distance_bound(a, b, 2)
    assert all(line_dedup.within_distance(a, b, k) == (plain_distance(a, b) <= k) for k in range(0, 21, 3))
    longest = max(len(a), len(b))
    assert line_dedup.similar_lines(a, b, 80) == (plain_distance(a, b) <= 20 * longest // 100)


def test_searches_that_end_early():
    """Long lines, shuffled or with some characters changed, at limits around their distance."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = "".join(rng.choice(list("abcde "), rng.integers(60, 300)))
        b = list(a)
        for k in rng.integers(0, len(b), rng.integers(1, 60)):
            b[k] = str(rng.choice(list("abcde ")))
        b = "".join(b) if rng.random() < 0.7 else "".join(rng.permutation(b))
        true = line_dedup.edit_distance(a, b)
        for most in (true - 20, true - 1, true, true + 1, true + 30):
            assert line_dedup.within_distance(a, b, most) == (true <= most)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \t\n\x0b éx.", max_size=30)), max_size=8))
def test_words_of_slices(texts):
    got = []
    for at, end, data, bounds in words.slices(pa.array(texts, pa.string()), 16):
        starts, ends, first = words.find_words(data, bounds)
        for i in range(end - at):
            got.append([data[s:e].tobytes().decode() for s, e in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])])
    assert got == [split(t) for t in texts]


def test_hashes_follow_words_not_places():
    """Equal words have equal hashes wherever they stand, and windows follow their words."""
    text = "b a b c a b c dd é dd " * 50
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words.find_words(data, np.array([0, len(data)]))
    names = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    for block in (1 << 20, 7):
        hashes = words.hash_spans(data, starts, ends, block=block)
        by = defaultdict(set)
        for n, h in zip(names, hashes):
            by[n].add(int(h))
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    for width in (3, 9):
        windows = defaultdict(set)
        for i, h in enumerate(words.hash_windows(hashes, width)):
            windows[tuple(names[i:i + width])].add(int(h))
        assert all(len(v) == 1 for v in windows.values()) and len(set.union(*windows.values())) == len(windows)
