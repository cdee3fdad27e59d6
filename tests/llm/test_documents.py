"""The operators on documents against plain versions, on texts of every odd kind."""

import hashlib
import re
from collections import Counter

import pytest

from tests.llm.conftest import edge_rows, prose
from tessera.llm import components, decontaminate, linededup, minhash, recompression
from tessera.llm.common import Tables

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if i is not None and j is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, s in sets:
        c = None if i is None else (find(i) if s else i)
        out.append((i, len(s), c, True if c is None else i == c))
    return Counter(out)


@pytest.mark.parametrize("small", [1, 96])
def test_near_duplicates(docs, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    for k in (4, 5):
        got = Counter(map(tuple, minhash.near_duplicates(docs, words=k).collect()))
        assert got == plain_components(edge_rows(), k, 80)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies around one text, of which some are linked only to each other."""
    import random

    r = random.Random(5)
    base = prose(9, 100).split()
    rows = []
    other = base[:70] + prose(10, 30).split()
    for i in range(90):
        w = list(base if i % 3 else other)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(100)] = f"new{r.randrange(9)}"
        rows.append((i, " ".join(w[: r.choice([100, 100, 100, 85, 70])])))
    monkeypatch.setattr(minhash, "SMALL", 3)
    got = Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()))
    assert got == plain_components(rows, 4, 80)


@pytest.mark.parametrize("percent", [30, 50, 60, 70, 95, 100])
def test_near_duplicates_at_other_thresholds(spark, percent):
    import random

    r = random.Random(percent)
    rows = [(900, "solo"), (901, "solo solo"), (902, "x y z w"), (903, "x y z w v")]
    for i in range(40):
        base = prose(1000 + i, r.choice([6, 30, 90])).split()
        cut = [w if r.random() > 0.3 * (1 - percent / 100) else "other" + str(r.randrange(9)) for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(cut[: r.randrange(len(cut) // 2, len(cut)) + 1] if i % 2 else cut))]
    got = Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=percent).collect()))
    assert got == plain_components(rows, 3, percent)


def test_thresholds():
    assert (minhash.band_rows(80), minhash.sketch_most(80)) == (4, 44)
    with pytest.raises(ValueError):
        minhash.near_duplicates(None, percent=0)


def test_short_texts_are_told_apart(spark):
    """A NUL is part of a word."""
    got = [r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([(1, "a\0b c"), (2, "a b\0c"), (3, "a b\0c ")], "doc_id bigint, text string"), words=4).orderBy("doc_id").collect()]
    assert got == [1, 2, 2]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (1, 2)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), Tables(spark)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


@pytest.mark.parametrize("window", [5, 35])
def test_remove_repeats(docs, window):
    rows = edge_rows()
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    want = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    assert Counter(map(tuple, recompression.remove_repeats(docs, window=window).collect())) == want


def textbook_diff(a, b, at=0, of=0):
    """Places of aligned lines, by the textbook: ends first, then the piles of lines that stand once in both, then between them."""
    if a and b and a[0] == b[0]:
        return [(at, of), *textbook_diff(a[1:], b[1:], at + 1, of + 1)]
    if a and b and a[-1] == b[-1]:
        return [*textbook_diff(a[:-1], b[:-1], at, of), (at + len(a) - 1, of + len(b) - 1)]
    once = [(a.index(x), j) for j, x in enumerate(b) if a.count(x) == b.count(x) == 1]
    piles, under = [], {}
    for card in once:
        k = next((k for k, p in enumerate(piles) if p[-1][0] > card[0]), len(piles))
        under[card] = piles[k - 1][-1] if k else None
        piles[k : k + 1] = [[*(piles[k] if k < len(piles) else []), card]]
    chosen, card = [], piles[-1][-1] if piles else None
    while card:
        chosen.insert(0, card)
        card = under[card]
    out, i0, j0 = [], 0, 0
    for i, j in [*chosen, (len(a), len(b))] if chosen else []:
        out += textbook_diff(a[i0:i], b[j0:j], at + i0, of + j0)
        out += [(at + i, of + j)] * (i < len(a))
        i0, j0 = i + 1, j + 1
    return out


def textbook_lines(t):
    return [x.strip() for x in (t or "").split("\n") if x.strip()]


def taken(mine, theirs, least):
    """Places of ``mine`` in blocks of ``least`` characters that both have."""
    gone, block = set(), []
    for i, j in [*sorted(textbook_diff(mine, theirs)), (None, None)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(len(mine[k]) for k, _ in block) >= least:
                gone |= {k for k, _ in block}
            block = []
        block.append((i, j))
    return gone


def plain_line_dedup(rows, rare, least):
    """Rows (doc_id, n_lines, n_deleted, text)."""
    docs = [(i, textbook_lines(t)) for i, t in rows if i is not None and t is not None]
    holders, kinds = {}, {}
    for i, lines in docs:
        for x in set(lines):
            holders.setdefault(x, set()).add(i)
    kind = lambda lines: re.sub("(0,)+", "0,", "".join(f"{hash(x)}," if len(holders[x]) > 1 else "0," for x in lines))
    for _, lines in docs:
        for x in set(lines):
            kinds.setdefault(x, set()).add(kind(lines))
    out = Counter()
    for i, t in rows:
        mine = textbook_lines(t)
        gone = set()
        if i is not None:
            for j, theirs in docs:
                if j < i and (kind(mine) == kind(theirs) or any(len(kinds[x]) <= rare for x in set(mine) & set(theirs))):
                    gone |= taken(mine, theirs, least)
            gone |= {k for k, x in enumerate(mine) if len(kinds[x]) > rare and min(holders[x]) < i and len(x) >= least}
        raw = [] if t is None else t.split("\n")
        full = [k for k, x in enumerate(raw) if x.strip()]
        drop = {full[k] for k in gone}
        out[i, len(full), len(gone), None if t is None else "\n".join(x for k, x in enumerate(raw) if k not in drop)] += 1
    return out


@pytest.mark.parametrize(("rare", "least"), [(1, 1), (3, 1), (16, 20), (1000, 1)])
def test_line_dedup(docs, rare, least):
    got = Counter(map(tuple, linededup.remove_common_lines(docs, rare=rare, least_chars=least).collect()))
    assert got == plain_line_dedup(edge_rows(), rare, least)


def test_diff_against_textbook():
    import random

    r = random.Random(4)
    for _ in range(500):
        a, b = ([r.randrange(7) for _ in range(r.randrange(12))] for _ in range(2))
        blocks = linededup.common_blocks(a, b)
        assert sorted((i + k, j + k) for i, j, n in blocks for k in range(n)) == sorted(textbook_diff(a, b)), (a, b)


def test_copy_goes_though_a_document_between_scatters_its_lines(spark):
    lines = [prose(60 + k, 4) for k in range(3)]
    rows = [(1, "\n".join(lines)), (2, f"own a\n{lines[2]}\nown b\n{lines[0]}\nown c\n{lines[1]}"), (3, "\n".join(lines))]
    got = {r["doc_id"]: r["n_deleted"] for r in linededup.remove_common_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), least_chars=40).collect()}
    assert got == {1: 0, 2: 0, 3: 3}


def test_line_dedup_of_its_own_output(spark, docs):
    once = linededup.without_common_lines(docs)
    twice = linededup.without_common_lines(once)
    assert twice.columns == once.columns
    want = plain_line_dedup([(r["doc_id"], r["text"]) for r in once.collect()], 16, 1)
    assert Counter((r["doc_id"], r["__n_lines"], r["__n_deleted"], r["text"]) for r in twice.collect()) == want
    odd = docs.withColumnsRenamed({"id": "__id", "h": "__h", "n": "__gone", "key": "__id0"})
    assert linededup.without_common_lines(odd).columns == [*odd.columns, "__n_lines", "__n_deleted"]
    assert linededup.without_common_lines(odd).count() == docs.count()


def test_patience_blocks():
    assert linededup.common_blocks([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1, 3), (4, 4, 1)]
    assert linededup.common_blocks([], [1]) == []
    assert linededup.common_blocks([5, 5, 5], [5, 5]) == [(0, 0, 2)]


def test_line_dedup_keeps_columns(docs):
    out = linededup.without_common_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_deleted"]
    assert out.count() == docs.count()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_decontamination(spark):
    item = prose(30, 12)
    edited = item.replace("a", "A", 1)[:-3] + "x" + item[-3:]
    rows = [(9, "so short a pessage here"), (1, "before " + item + " after"), (2, prose(31, 60)), (3, edited.replace(" ", "\n")), (4, None), (5, ""), (6, item[: len(item) // 2]), (7, "aa tiny bb"), (1, item), (8, prose(32, 30) + item[:40] + "zz" + item[41:]), (None, item)]
    items = [(18, "a short a passage"), (17, "short a passage"), (1, item), (2, "tiny"), (3, None), (4, "  "), (None, item), (5, item)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert Counter((r[0], r[1]) for r in found) == Counter([(d, i) for d in (1, 1, 3, 8, None) for i in (1, 5)] + [(7, 2), (9, 17)])
    for r in found:
        texts = [t for i, t in rows if i == r[0] and t]
        want = decontaminate.plain(dict((i, t) for i, t in items if i)[r[1]])
        assert any(distance(want, decontaminate.plain(t)[r[3] : r[4]]) == r[2] for t in texts)


def least_distance(item, text):
    """Of the item to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_every_item_that_occurs_is_found(spark, monkeypatch, block):
    """Items of 3 to 90 characters with 0 to one more edits than they may have, against the full table."""
    import random

    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    r = random.Random(11)
    items = [(k, prose(600 + k, 14)[: r.choice([3, 9, 13, 20, 30, 60, 90])].strip()) for k in range(25)]
    rows = []
    for d in range(40):
        parts = []
        for _, item in r.sample(items, 3):
            w = list(item)
            for _ in range(r.randrange(int(0.08 * len(w)) + 2)):
                at, what = r.randrange(len(w) + 1), r.choice(["", "x", "yz"])
                w[at : at + r.randrange(2)] = what
            parts += [prose(700 + d, 3), "".join(w).upper()]
        rows.append((d, "\t".join(parts)))
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(d, i): n for d, t in rows for i, p in items if (n := least_distance(decontaminate.plain(p), decontaminate.plain(t))) <= int(0.08 * len(p))}
    assert {(x["doc_id"], x["item_id"]): x["distance"] for x in found} == want and len(found) == len(want)


def test_myers_against_plain():
    import random

    r = random.Random(2)
    for _ in range(200):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randrange(1, n))) for n in (30, 60))
        best = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, min(len(t), i + 2 * len(p)) + 1))
        found = decontaminate.Pattern(p, max(1, len(p))).find(t)
        assert found[0] == best and distance(p, t[found[1] : found[2]]) == best


def test_empty_tables(spark, no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    assert recompression.remove_repeats(no_docs).collect() == []
    assert linededup.remove_common_lines(no_docs).collect() == []
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(no_docs, none).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("rare", [2, 5, 1000])
@pytest.mark.parametrize("least", [1, 20])
def test_line_dedup_of_mixed_lines(spark, rare, least):
    """Lines in crossing order or twice in their holders, or split over two; ``rare`` 1000 aligns all pairs."""
    import random

    r = random.Random(8)
    pool = [prose(200 + i, 1 + i % 6) for i in range(9)] + [x * 2 for x in ("}", "return x;", "All rights reserved. ")]
    one, two = pool[4], pool[5]
    rows = [(1, f"{one}\nown a\n{two}"), (2, f"{two}\nown b\n{one}"), (3, f"{one}\nown c\n{one}"), (4, f"own d\n{two}\nown e\n{two}"), (5, f"{one}\nown f\n{two}")]
    rows += [(r.randrange(6, 80), "\n".join(r.choice([*pool, f"own {k}", "own x", " "]) for _ in range(r.randrange(9)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = linededup.remove_common_lines(docs, rare=rare, least_chars=least).collect()
    assert Counter(map(tuple, got)) == plain_line_dedup(rows, rare, least)


def test_line_dedup_takes_short_lines(spark):
    """Blocks have no least size unless one is asked for."""
    rows = [(k, f"{prose(300 + k, 30)}\nAll rights reserved.\n{prose(400 + k, 30)}") for k in range(5)]
    got = linededup.remove_common_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_lines", "n_deleted").collect()
    assert Counter(map(tuple, got)) == Counter([(k, 3, int(k > 0)) for k in range(5)])


def test_line_dedup_of_the_tables(spark):
    """The registered query on the smallest tables, against the textbook."""
    import sys

    from tests.conftest import SF
    from tessera.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        plain = plain_line_dedup(rows, 16, 1)
    finally:
        sys.setrecursionlimit(limit)
    want = Counter((i, n, gone, hashlib.sha256(t.encode()).hexdigest() if t is not None else None) for (i, n, gone, t), times in plain.items() for _ in range(times))
    assert Counter(map(tuple, QUERIES["op2_patience_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_deleted", "kept_sha256").collect())) == want
    assert sum(gone for _, _, gone, _ in want) > 0
