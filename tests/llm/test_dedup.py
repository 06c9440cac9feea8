import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm import arrowtext as at
from ledgerlight.llm import blocks, components, content_sort, ngram_join, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("sampled", [64, 1])
def test_content_sort_brute_force(frame, prose, monkeypatch, sampled):
    monkeypatch.setattr(content_sort, "SAMPLED", sampled)
    monkeypatch.setattr(content_sort, "LEAST", 1 if sampled == 1 else 8)  # every group is cut into runs
    groups = defaultdict(list)
    for d, t in prose:
        groups[strip(t)].append((-len(t or ""), d))
    got = content_sort.deduplicate(frame(prose)).collect()
    assert len(got) == len(prose)
    digest = {hashlib.sha256(c.encode()).hexdigest(): g for c, g in groups.items()}
    for r in got:
        g = digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(g)[1], len(g))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("sampled", [64, 1])
def test_content_sort_edges(frame, monkeypatch, sampled):
    monkeypatch.setattr(content_sort, "SAMPLED", sampled)
    monkeypatch.setattr(content_sort, "LEAST", 1 if sampled == 1 else 8)
    assert content_sort.deduplicate(frame([])).collect() == []
    rows = [(None, "a b"), (3, "ab"), (2, "ab"), (2, "ab"), (5, None), (4, " ")]
    got = {(r.doc_id, r.kept, r.keep_id, r.group_size) for r in content_sort.deduplicate(frame(rows)).collect()}
    assert (None, True, None, 4) in got and (4, True, 4, 2) in got and (5, False, 4, 2) in got
    kept = content_sort.survivors(frame(rows + [(4, " ")]))
    assert kept.columns == frame([]).columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b"), (4, " ")]


def sets_of(rows):
    out = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def joined(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("block_bytes", "direct"), [(1 << 23, 9), (3000, 99), (2000, 3)])
def test_ngram_join_brute_force(frame, prose, monkeypatch, block_bytes, direct):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(blocks, "DIRECT", direct)
    if direct == 3:  # every shingle of more than one posting is hot
        monkeypatch.setattr(ngram_join, "FEW", 1)
        monkeypatch.setattr(ngram_join, "HOT", 10**9)
    sets = sets_of(prose)
    want = joined(sets)
    got = ngram_join.near_duplicates(frame(prose)).collect()
    assert len(got) == len(prose)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), want[d]) for d, s in sets.items()}
    assert any(r.doc_id != r.component_id for r in got)


def test_ngram_join_families_need_every_link(frame):
    """Chains whose ends share little, and bridges between groups of near copies."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for step in range(30):
        rows.append((100 - step, " ".join(base[: 60 - step] + [f"v{i}" for i in range(step)])))
    for k in range(30):
        rows.append((200 + k, " ".join([*base[:10], f"k{k}", *base[11:]])))
    sets = sets_of(rows)
    want = joined(sets)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame(rows)).collect()}
    assert got == want


def test_ngram_join_edges(frame):
    assert ngram_join.near_duplicates(frame([])).collect() == []
    t = "a b c d e f g h"
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame([(None, t), (9, t), (9, "q r"), (1, "Q  R"), (4, None), (5, "")])).collect()}
    # row 9 holds two texts, so it joins both groups
    assert got == {(None, 4, 1), (9, 4, 1), (9, 1, 1), (1, 1, 1), (4, 0, 4), (5, 0, 5)}
    kept = ngram_join.keep_first(frame([(2, t), (3, t + " i"), (4, None)]))
    assert kept.columns == frame([]).columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_choose_asks_for_more_where_candidates_are_many():
    import numpy as np

    assert ngram_join.choose(np.array([0, 0, 0, 0, 0]), 2) == 0
    assert ngram_join.choose(np.array([0, 1, 900, 900, 900]), 2) == 1
    assert ngram_join.choose(np.array([900, 900, 900, 900, 900]), 2) > 1


@pytest.mark.parametrize(("block_bytes", "direct"), [(1 << 23, 9), (3000, 99), (2000, 3)])
def test_repeats_brute_force(frame, prose, monkeypatch, block_bytes, direct):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(blocks, "DIRECT", direct)
    first = {}
    for d, t in prose:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    want = set()
    for d, t in prose:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.add((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = repeats.remove_repeats(frame(prose)).collect()
    assert len(got) == len(prose) and {tuple(r) for r in got} == want
    assert sum(r.n_removed for r in got) > 100
    assert repeats.remove_repeats(frame([])).collect() == []


def test_pieces_of_the_exchange(frame, prose, monkeypatch):
    """By cells, pieces grow as blocks * sqrt(blocks), and no more are made than planned."""
    assert blocks.plan(3000).pieces == 3000 * 1000 and not blocks.plan(3000).wide
    for n in (20_000, 1_000_000, 20_000_000):
        p, q = blocks.plan(n), blocks.plan(4 * n)
        assert p.ranges % p.wide == 0 and n / 3 <= p.ranges < n / 3 * 1.05 and q.pieces < 8.5 * p.pieces and p.pieces < 2.2 * n * (n / 3) ** 0.5
    counts = []
    for direct in (99, 2):
        monkeypatch.setattr(blocks, "DIRECT", direct)
        p = blocks.plan(36)
        asks = repeats.written(repeats.ask_blocks(frame(prose), p, np.zeros(0, np.uint64), 64))
        fine = blocks.up(asks, repeats.KINDS, p)
        for kind in (repeats.NAMES, repeats.INTERIORS):
            n = asks.filter(f"kind = {kind}").count() + (fine.filter(f"kind = {kind}").count() if p.wide else 0)
            assert n <= p.pieces
            counts.append(n)
    assert counts[2] < counts[0] and counts[3] < counts[1]


def test_repeats_names_anew_what_clashes(frame, prose):
    """With names of few bits, words, runs and pairs clash all over; the rounds are repeated until none does."""
    want = {tuple(r) for r in repeats.remove_repeats(frame(prose)).collect()}
    assert {tuple(r) for r in repeats.remove_repeats(frame(prose), bits=10).collect()} == want


def test_repeats_symbols_spell_their_windows():
    """Windows are equal where their symbols are, wherever they stand; runs at their ends included."""
    rng = np.random.default_rng(9)
    words = [" ".join(f"w{x}" for x in rng.choice(4, 60, p=[0.7, 0.1, 0.1, 0.1])) for _ in range(60)]
    (b, _), = repeats.parts(pa.table({"doc_id": list(range(60)), "text": words}), np.zeros(0, np.uint64), 64, checked=True)
    split = [t.split() for t in words]
    window = [tuple(split[d][i : i + 13]) for d in range(60) for i in range(48)]
    symbols = list(zip(b.spelled(np.arange(len(b.at))).tolist(), b.spelled(np.arange(len(b.at)), at.HASH_B).tolist(), b.interiors().tolist(), strict=True))
    assert len(window) == len(symbols) and len(set(window)) < len(window)
    assert len(set(zip(window, symbols, strict=True))) == len(set(window)) == len({s[:2] for s in symbols})


def test_repeats_null_identifier_is_the_largest(frame):
    t = " ".join(f"w{i}" for i in range(13))
    got = {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(frame([(None, t), (1, t), (2, "w0 " + t)])).collect()}
    assert got == {(None, 13), (1, 0), (2, 13)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
