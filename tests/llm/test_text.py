import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import exp, lgamma, log, log10, pi

import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm import blocks, byte_bpe, chat, ctw, decontam, langid, pii, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# context-tree weighting


class Tree:
    """The textbook recursion: every node weighs its own estimate against its children."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(Counter)

    def see(self, context, byte):
        for bits in range(8):
            node = (bits, byte >> (8 - bits))
            for d in range(self.depth + 1):
                self.counts[node, context[len(context) - d :]][byte >> (7 - bits) & 1] += 1

    @staticmethod
    def block(c):
        return lgamma(c[0] + 0.5) + lgamma(c[1] + 0.5) - log(pi) - lgamma(c[0] + c[1] + 1)

    def weighted(self, node, context):
        if (node, context) not in self.counts:
            return 0.0
        own = self.block(self.counts[node, context])
        if len(context) == self.depth:
            return own
        below = sum(self.weighted(node, bytes([b]) + context) for b in range(256) if (node, bytes([b]) + context) in self.counts)
        return log(0.5) + max(own, below) + log(exp(own - max(own, below)) + exp(below - max(own, below)))

    def probability(self, node, context, bit):
        """Mixture of the estimates of all suffixes of `context`, from the ratio of own to children's weight."""

        def at(d):
            s = context[len(context) - d :]
            if (node, s) not in self.counts:
                return 0.5
            c = self.counts[node, s]
            kt = (c[bit] + 0.5) / (c[0] + c[1] + 1)
            if d == self.depth:
                return kt
            own = self.block(c)
            share = exp(own + log(0.5) - self.weighted(node, s))
            return share * kt + (1 - share) * at(d + 1)

        return at(0)


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 3, 7.9, 8, 100.5, 1e7])
    assert np.allclose(ctw.lgamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


@pytest.mark.parametrize(("block_bytes", "direct", "part_codes", "depth"), [(1 << 23, 9, 1 << 20, 2), (60, 9, 5, 3), (10, 1, 1, 2)])
def test_ctw_brute_force(frame, monkeypatch, block_bytes, direct, part_codes, depth):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(blocks, "DIRECT", direct)
    monkeypatch.setattr(ctw, "PART_CODES", part_codes)
    rows = [(i, t) for i, t in enumerate(["ab ab", "Abba é", None, "", "aab b\n", "c", "ab ab", "zz ab", "abc abd"])] + [(3, "ba ba"), (None, "ab")]
    learns = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    tree, counts = Tree(depth), Counter()
    coded = lambda t: bytes([255] * depth) + lower(t).encode() + bytes([255])
    for d, t in rows:
        if learns(d):
            counts.update([*WORD.findall(lower(t)), ""])
            b = coded(t)
            for i in range(depth, len(b)):
                tree.see(b[i - depth : i], b[i])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        b, score = coded(t), 0.0
        for i in range(depth, len(b)):
            for bits in range(8):
                score += log10(tree.probability((bits, b[i] >> (8 - bits)), b[i - depth : i], b[i] >> (7 - bits) & 1))
        tokens = [*WORD.findall(lower(t)), ""]
        base = sum(log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        want.append((str(d), not learns(d), len(tokens), sum(w in counts for w in tokens), total, round(base, 7), round(score, 4)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 4)) for r in ctw.score(frame(rows), depth).collect()]
    assert [g[:6] for g in sorted(got)] == [w[:6] for w in sorted(want)]
    assert [g[6] for g in sorted(got)] == pytest.approx([w[6] for w in sorted(want)], rel=1e-5)
    assert any(w[1] for w in want)


def test_ctw_edges(frame):
    assert ctw.score(frame([])).collect() == []


def test_ctw_depth_helps(frame, prose):
    bits = [sum(r.score for r in ctw.score(frame(prose), d).collect()) for d in (2, 4)]
    assert bits[1] > bits[0]


# chat


def test_chat_round_trip(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "user", "\\<\\s>[INST\\]"), (1, 3, "assistant", None),
        (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, "[TURN] [/TURN]"), (3, 4, "tool [/ROLE]", "<<SYS>> <</SYS>>"),
        (None, 1, "user", ""), (4, 1, "system", "é😀"), (4, 2, "user", "[/INST"), (4, 3, "assistant", "a" * 50_000 + "<"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as loss", "1 as turn_no")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for c in (1, 2, 3, 4, None):
        turns = sorted(((t if t is not None else -1), r or "", x or "") for i, t, r, x in rows if i == c)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].order_ok for c in (1, 2, 3, 4, None)] == [True, False, False, True, True]
    assert (got[2].first_bad_turn, got[1].first_bad_turn) == (0, None)
    out = chat.segments(df).collect()
    for c in got:
        mine = sorted((s for s in out if s.conv_id == c), key=lambda s: (s.turn_no, s.segment_no))
        assert sum(len(s.text) for s in mine) == got[c].formatted_chars
        for s in mine:
            for w in chat.TEMPLATE.controls if s.segment_no == 1 else ():
                assert w not in s.text
    assert chat.digests(df.limit(0)).collect() == []


def test_chat_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("aba ", " x!", False)}, {})


# WARC


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, None), (8, "u\r\nx y", ""), (4, "http://é", "é\r\n\r\nWARC/1.0\r\n"), (6, "z", "x" * 3_000_000), (6, "z2", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as archive", "2 as offset")
    got = {(r.page_id, r.payload_digest): r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        r = got[page, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(raw), "response" if page == first else "revisit", None if page == first else first)
    index, files = warc.archive(df, f"{tmp_path}/w")
    some = warc.read(index.filter("page_id = 4"), files, payloads=True).collect()
    assert [bytes(r.payload).decode() for r in some] == ["é\r\n\r\nWARC/1.0\r\n"]
    assert warc.round_trip(df.limit(0)).collect() == []
    twice = warc.round_trip(df.filter("page_id = 5").union(df.filter("page_id = 5"))).collect()
    assert [r.record_type for r in twice] == ["response", "response"]


def test_warc_spreads_what_shares_an_identifier(spark, tmp_path):
    """Rows without a page_id, or with one and the same, go to different archives; a payload that all share has one response."""
    rows = [(None if i % 2 else 7, f"http://x/{i}", "shared" if i % 3 else f"own {i}") for i in range(60)]
    index, files = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    assert index.filter("page_id is null").select("archive").distinct().count() > 2 and index.filter("page_id = 7").select("archive").distinct().count() > 2
    got = warc.read(index, files).collect()
    assert len(got) == 60 and {r.refers_to for r in got if r.record_type == "revisit"} == {7}
    assert sum(r.record_type == "response" for r in got) == sum(1 for p, _, h in rows if p == 7 or h != "shared")


# language identification


def test_langid(spark, frame):
    letters = {"aa": "abcde", "bb": "vwxyzé", "cc": "мнопр"}
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        lang = sorted(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(30)), lang))
    odd = [(1000, None, "aa"), (1001, "12 !? \n", "aa"), (1002, "", None), (1003, rows[0][1], None), (1003, rows[0][1], None), (1004, "é", "bb"), (None, rows[1][1] * 300, "bb")]
    got = langid.identify(spark, frame(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == lang for d, _, lang in rows)
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    assert [by[d].lang_pred for d in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.accepted(frame(rows + odd))
    assert kept.columns == frame([]).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*range(300), 1003, 1003, 1004, -1])
    assert langid.identify(spark, frame([])).collect() == []
    assert [r.lang_pred for r in langid.identify(spark, frame([(1, "abc", None)])).collect()] == ["und"]


def test_langid_many_languages(spark, frame):
    rng = np.random.default_rng(6)
    letters = [chr(0x4E00 + 8 * i + j) for i in range(130) for j in range(6)]
    rows = [(4 * i + j, " ".join("".join(rng.choice(letters[6 * i : 6 * i + 6], 4)) for _ in range(30)), f"l{i:03}") for i in range(130) for j in range(4)]
    rows = [(8 * d + k, text, lang) for d, text, lang in rows for k in range(2)]
    by = {r.doc_id: r.lang_pred for r in langid.identify(spark, frame(rows)).collect()}
    assert by == {d: lang for d, _, lang in rows}
    assert langid.accepted(frame(rows)).count() == len(rows)


def test_langid_filters_hold_every_ngram():
    text = "Ab cd é12 f"
    raw, offsets = at_buffers([text, "", "x"])
    code, own = langid.grams(raw, offsets)
    assert [int(c).to_bytes(5, "big") for c in code[own == 0]] == plain_grams(text)
    assert [int(c).to_bytes(5, "big") for c in code[own == 2]] == [b" x   ", b"x    "] and not (own == 1).any()


def plain_grams(text):
    folded = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()) + b" " * 4
    return [folded[i : i + 5] for i in range(len(folded) - 4) if folded[i : i + 5].strip()]


def test_langid_against_brute_force(spark, frame):
    """Plain filters (sets of slots), n-gram by n-gram: every language that was taught an n-gram has it; counts, correction and decision follow."""
    from ledgerlight.llm import arrowtext as at

    rng = np.random.default_rng(7)
    words = {lang: ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(60)] for lang in ("a1", "b2", "c3")}
    common = ["abc", "de", "éa"]
    rows = [(i, " ".join(rng.choice(words[lang] + common, rng.integers(0, 40))) + ("!" if i % 5 else ""), lang) for i in range(240) for lang in [sorted(words)[i % 3]]]
    rows += [(500, "zzzz qqqq", None), (501, None, "a1"), (None, "only null teaches this", "c3"), (502, "teaches", "b2"), (502, "teaches", "b2")]
    place = lambda g: [int(at.fmix(np.array([int.from_bytes(g)], np.uint64) + s)[0] >> np.uint64(20)) % langid.SLOTS for s in langid._SEEDS]
    filters = {lang: set() for lang in words}
    for d, t, lang in rows:
        if lang and t is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            for g in set(plain_grams(t)):
                filters[lang].update(place(g))
    wrong = {lang: (len(f) / langid.SLOTS) ** 3 for lang, f in filters.items()}
    want = Counter()
    for d, t, _ in rows:
        grams = plain_grams(t or "")
        right = {lang: max(0, (sum(all(p in f for p in place(g)) for g in grams) - len(grams) * wrong[lang]) / (1 - wrong[lang])) for lang, f in filters.items()}
        best = min(right, key=lambda lang: (-right[lang], lang))
        letters = any(c.isalpha() for c in t or "")
        score = right[best] / sum(right.values()) if letters and sum(right.values()) else 0.0
        want[d, best if letters else "und", round(score, 9)] += 1
    got = langid.identify(spark, frame(rows)).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == want
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_langid_rejects_what_no_language_holds(spark, frame):
    rng = np.random.default_rng(11)
    words = {lang: ["".join(rng.choice(list(signs), 5)) for _ in range(80)] for lang, signs in (("aa", "abcdefg"), ("bb", "hijklmn"))}
    rows = [(i, " ".join(rng.choice(words[lang], 20)), lang) for i in range(400) for lang in [sorted(words)[i % 2]]]
    strange = [(1000 + i, " ".join("".join(rng.choice(list("opqrstuvw"), 5)) for _ in range(20)) + " " + words["aa"][i], None) for i in range(20)]
    kept = {r.doc_id for r in langid.accepted(frame(rows + strange)).collect()}
    assert kept == set(range(400))


def test_langid_learns_from_every_labelled_text(spark, frame):
    """Beyond any number of texts that a sample would hold: exact counts of texts say which n-grams a language holds."""
    from ledgerlight.llm import arrowtext as at

    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(6000)]
    rows = [(i, f"{words[i % 5000]} {words[int(rng.integers(4000, 6000))]} {words[i % 5000]}", "aa") for i in range(9000)] + [(9000 + i, f"zz {words[i]}", "bb") for i in range(60)]
    place = lambda g: [int(at.fmix(np.array([int.from_bytes(g)], np.uint64) + s)[0] >> np.uint64(20)) % langid.SLOTS for s in langid._SEEDS]
    counts = {"aa": Counter(), "bb": Counter()}
    for _, t, lang in rows:
        counts[lang].update(set(plain_grams(t)))
    want = [{p for g, n in counts[lang].items() if n >= least for p in place(g)} for lang, least in (("aa", 9000 // langid.FEW), ("bb", 1))]
    assert 1 in counts["aa"].values()
    languages, filters, _ = langid.fit(frame(rows))
    assert languages == ["aa", "bb"]
    assert [set(np.flatnonzero(filters[0] >> np.uint64(i) & np.uint64(1)).tolist()) for i in (0, 1)] == want
    model = languages, filters, np.zeros(2)
    known = {"aa": [], "bb": []}
    for d, t, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 == 2:
            grams = plain_grams(t)
            known[lang].append(max(sum(all(p in w for p in place(g)) for g in grams) for w in want) / len(grams))
    steps = sorted((int(k * langid.STEPS), 1 / len(each)) for each in known.values() for k in each)
    at_least = next(s for i, (s, _) in enumerate(steps) if sum(w for _, w in steps[: i + 1]) >= 2 * langid.STRAY / 1000)
    assert langid.floor(frame(rows), model) == pytest.approx(langid.REJECT_SHARE * at_least / langid.STEPS, abs=2e-5)


def at_buffers(texts):
    from ledgerlight.llm import arrowtext

    return arrowtext.buffers(pa.array(texts))


# byte-level BPE


def test_bpe_like_the_library(spark, frame):
    import random

    import public_tokenizers
    import tiktoken

    c = byte_bpe.codec(byte_bpe.rank_file())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(2)
    signs = ["'", "'s", "'re", " ", "  ", "\n", "a", "B", "é", "1", "٣", "!", "中", "😀", "'ll", "x" * 40, "\x1c", "\x85", "Ⅷ", "́", "﻿", "<|endoftext|>"]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randrange(25)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "ab" * 4000), (502, "ab" * 4000), (None, "x  ")]
    got = byte_bpe.digests(spark, frame(rows)).collect()
    want = Counter()
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    encoded = byte_bpe.encode(spark, frame(rows))
    texts = Counter((x.doc_id, x.text) for x in byte_bpe.decode(spark, encoded).collect())
    assert texts == Counter((d, t or "") for d, t in rows)
    one = next(x for x in encoded.collect() if x.doc_id == 502)
    assert one.token_starts == np.append(0, np.cumsum([len(c.tokens[i]) for i in one.ids]))[:-1].tolist()
    assert byte_bpe.digests(spark, frame([])).collect() == []


# decontamination


def plain_alignment(item, words):
    h, best = np.zeros((len(item) + 1, len(words) + 1), int), 0
    for i, x in enumerate(item):
        for j, y in enumerate(words):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


def test_decontamination_brute_force(spark, frame):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}é" for i in range(300)]
    text = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, " ".join(text(30))) for i in range(8)] + [(50, None), (51, "too short"), (52, "")]
    rows = []
    for i in range(60):
        words = text(200)
        if i % 3 == 0:
            passage = items[i % 8][1].split()
            for k in range(i % 9):
                passage[(k * 7) % 30] = "edited"
            words[50:50] = [w.upper() + "," for w in passage]
        if i % 10 == 0:
            words += items[(i + 1) % 8][1].split()[: 8 + i // 3]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(spark, frame(rows), bench).collect()}
    fold = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {}
    for d, t in rows:
        for i, s in items:
            if len(fold(s)) >= 3 and (score := plain_alignment(fold(s), fold(t)) / (2 * len(fold(s)))) >= 0.5:
                want[d, i] = score
    assert len(want) > 15 and got == pytest.approx(want)
    assert decontam.leaks(spark, frame([]), bench).collect() == []
    assert decontam.leaks(spark, frame(rows), bench.limit(0)).collect() == []


def test_decontamination_finds_repetitive_items(spark, frame):
    items = [(1, " ".join(["one line said thirteen times"] * 13)), (2, " ".join(["0000000012"] * 400)), (3, "plain words of another item altogether")]
    rows = [(i, f"before {i} {items[i - 1][1]} behind it") for i in (1, 2)] + [(10 + i, f"other document number {i}") for i in range(20)]
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(spark, frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0}


def test_decontamination_does_not_depend_on_counts(spark, frame):
    """A passage that half of all documents hold is 21 of an item's 40 words."""
    passage = [f"hot{i}" for i in range(21)]
    item = " ".join(passage + [f"own{i}" for i in range(19)])
    for n in (6, 6000):
        rows = [(i, f"number {i} of {n} " + (" ".join(passage) if i % 2 else "has none of it") + f" ends {i}") for i in range(n)]
        got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(spark, frame(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
        assert got == pytest.approx({(i, 1): 0.525 for i in range(1, n, 2)})


def test_decontamination_finds_dense_edits(spark, frame):
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(40)]
    items = [(i, [str(w) for w in rng.choice(words, 24)]) for i in range(4)]
    put = lambda w, step: [x for k, v in enumerate(w) for x in ([v, f"put{k}"] if k % step == step - 1 else [v])]
    rows = []
    for i, w in items:
        edited = [put(w, 1), put(w, 2), [f"new{k}" if k % 3 == 2 else v for k, v in enumerate(w)], [v for k, v in enumerate(w) if k % 3], [v for k, v in enumerate(w) if k % 2], put(w[:12], 1)]
        rows += [(10 * i + k, "before it " + " ".join(e) + " behind it") for k, e in enumerate(edited)]
    rows += [(100 + i, " ".join(rng.choice(words, 120))) for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(spark, frame(rows), bench).collect()}
    want = {(d, i): score for d, t in rows for i, w in items if (score := plain_alignment(w, t.split()) / (2 * len(w))) >= 0.5}
    assert {want[10 * i + 1, i] for i in range(4)} == {0.75 + 1 / 48} and want[2, 0] >= 0.5 and got == pytest.approx(want)


def test_decontamination_folds_all_scripts(spark, frame):
    items = [(1, "東京の人口は何人ですか"), (2, "ประเทศไทย"), (3, "КАКАЯ СТОЛИЦА У ΕΛΛΆΣ"), (4, "what\u2014is \u201cthe capital\u201d of\u00a0France"), (5, "42"), (6, "New York"), (7, "\u2026!"), (8, None)]
    rows = [
        (1, "問題:東京の人口は何人ですか。答えてください"), (2, "ใน" + items[1][1] + "มี"), (3, "так какая столица у ελλάς теперь"), (4, "so: What is the CAPITAL of france?"),
        (5, "it is 42\u2019"), (6, "in new\u2013york, new york"), (7, "new 421 york"), (8, "東京に行きました"), (9, "\u2026!"), (10, None),
    ]
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in decontam.leaks(spark, frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (1.0, 2, 13), (2, 2): (1.0, 2, 11), (3, 3): (1.0, 1, 5), (4, 4): (1.0, 1, 7), (5, 5): (1.0, 2, 3), (6, 6): (1.0, 1, 3)}


# personal data


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_brute_force(frame):
    import random

    r = random.Random(4)
    bits = ["a@b.c", "_x@d.e", "@", "user.name+1@mail-x.example.org", ".", "-", " ", "é😀", "1.2.3.4", "256.1.1.1", "0255.0.0.1", ".5", "4785380592391139", "4785 3805 9239 1139", "1", "+49 (30) 123-4567", "+1", "(", "\n", "12", "x"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(14)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "a" * 60_000), (403, "1 " * 3000), (404, "4785380592391139," * 700), (404, "4785380592391139," * 700)]
    got = pii.find(frame(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    for d, t in rows:
        base = base_spans(t or "")
        for x in by[d]:
            assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
            assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
            assert set(base) <= set(filter(None, x.spans.split(",")))
    assert pii.find(frame([])).collect() == []


def test_pii_model_adds_what_looks_right(frame):
    """A card that the fixed pattern swallows with a neighbouring number is found by the trees; other numbers aren't."""
    rng = np.random.default_rng(8)

    def card():
        while True:
            d = "".join(map(str, rng.integers(0, 10, 16)))
            if luhn(d):
                return d

    def other():
        while True:
            d = "".join(map(str, rng.integers(0, 10, 16)))
            if not luhn(d):
                return d

    rows = [(i, f"word card {card()} word {other()} end") for i in range(400)]
    rows += [(400 + i, f"word tel {'+49 30 ' if i % 2 else '030 '}{5550000 + i} and order {80000000 + i} end, 10.0.{i}.7 of 1.2.{i}.4.5") for i in range(200)]
    rows += [(800 + i, f"ask name{i} [at] host{i} [dot] org or other{i}@host.org") for i in range(50)]
    hidden = card()
    rows.append((1000, f"word card {hidden}/77 end {other()}"))
    rows.append((1001, f"word card 12 {hidden} end"))
    rows.append((1002, f"word card {hidden}\n{other()}/8.8.8.8 end"))
    got = {r.doc_id: r for r in pii.find(frame(rows)).collect()}
    assert all(got[i].n_card == 1 and got[i].n_added == 0 for i in range(400))
    assert got[1001].n_card == 0 and got[1001].spans == "card:13:29" and got[1001].n_added == 1
    for i in range(200):
        t = rows[400 + i][1]
        phone = t.index("+49") if i % 2 else t.index("030")
        spans = set(got[400 + i].spans.split(","))
        assert f"phone:{phone}:{t.index(' and order')}" in spans, t
        assert not any(s.startswith(("phone", "card")) and int(s.split(":")[1]) >= t.index("order") for s in spans)
    assert all(got[800 + i].n_email == 1 and got[800 + i].spans.count("email") == 2 for i in range(50))


def test_pii_calibration_against_brute_force():
    """Pooled by margin, the isotonic fit is the least-squares one: its value is the min-max of averages."""
    r = np.random.default_rng(5)
    for _ in range(60):
        rows = [((int(k), int(r.integers(3))) + (0,) * (len(pii.FEATURES) - 2), int(a), int(b)) for k in range(2) for a, b in r.integers(0, 6, (7, 2))]
        tree = pii.Tree(0.0, 1, 0, pii.Tree(-1.0), pii.Tree(0.0, 1, 1, pii.Tree(0.5), pii.Tree(2.0)))
        model = pii.calibrate(pii.Model(0.0, (tree,), ()), rows)
        for kind in range(2):
            by = defaultdict(lambda: [0, 0])
            for x, a, b in rows:
                if x[0] == kind:
                    by[tree.of(x)][0] += a
                    by[tree.of(x)][1] += a + b
            steps = [(m, a, n) for m, (a, n) in sorted(by.items()) if n]
            share = lambda lo, hi: sum(s[1] for s in steps[lo : hi + 1]) / sum(s[2] for s in steps[lo : hi + 1])
            fitted = [max(min(share(lo, hi) for hi in range(i, len(steps))) for lo in range(i + 1)) for i in range(len(steps))]
            good = [m for (m, _, _), f in zip(steps, fitted, strict=True) if f >= pii.TARGET - 1e-12]
            assert {m for m, _, _ in steps if m >= model.thresholds[kind]} == set(good)


def test_pii_new_spans_against_brute_force(frame):
    """Every proposal scored in Python, then chosen greedily, gives the operator's added spans."""
    import random

    r = random.Random(6)
    bits = ["4785380592391139", "+49 30 1234567", "tel ", "1.2.3.4", ".", "-", "/", " 12 ", "030 5551234", ", ", "x", "a@b.org ", "a [at] b [dot] org ", "99"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(9)))) for i in range(300)]
    marked = pii.written(pii.marked(frame(rows)))
    proposed = pii.written(pii.proposals(marked))
    model = pii.fit(proposed)
    texts, every = dict(rows), defaultdict(list)
    known = {m.row: m.doc_id for m in marked.collect()}
    for p in proposed.collect():
        x = tuple(p[f] for f in pii.FEATURES)
        if p.free and (m := model.margin(x)) >= model.thresholds[p.kind]:
            every[known[p.row]].append((-round(m, 9), p["at"] - p["to"], p["at"], p["to"], p.kind))
    added = 0
    for x in pii.find(frame(rows)).collect():
        base = [(k.split(":")[0], *map(int, k.split(":")[1:])) for k in base_spans(texts[x.doc_id])]
        new = []
        for _, _, a, b, k in sorted(every[x.doc_id]):
            if all(b <= c or d <= a for c, d, _ in new):
                new.append((a, b, k))
        emails = [(c, d) for k, c, d in base if k == "email"]
        new = [(a, b, k) for a, b, k in new if all(b <= c or d <= a for c, d in ([(c, d) for _, c, d in base] if k == 0 else emails))]
        mails = [(a, b) for a, b, k in new if k == 0]
        new = [(a, b, k) for a, b, k in new if k == 0 or all(b <= c or d <= a for c, d in mails)]
        want = Counter(f"{k}:{a}:{b}" for k, a, b in base) + Counter(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in new)
        added += len(new)
        assert Counter(filter(None, x.spans.split(","))) == want and x.n_added == len(new), texts[x.doc_id]
    assert added > 50


def test_pii_trees_say_the_same_in_sql(spark):
    rows = [((k % 4, k % 19, k % 7, k % 5, k % 2, k % 6, k % 5, k % 3, k % 2, k % 17, k % 2), k % 3 == 0, k % 3 != 0) for k in range(200)]
    model = pii.boost([(x, int(a), int(b)) for x, a, b in rows])
    df = spark.createDataFrame([x for x, _, _ in rows], ", ".join(f"{f} int" for f in pii.FEATURES)).selectExpr(f"named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, {f}' for f in pii.FEATURES)}) as c")
    margin = " + ".join([f"{model.start!r}D", *(t.sql("c") for t in model.trees)])
    got = [r.m for r in df.selectExpr(f"{margin} as m").collect()]
    assert got == pytest.approx([model.margin(x) for x, _, _ in rows])
    fitted = pii.calibrate(model, [(x, int(a), int(b)) for x, a, b in rows])
    assert len(fitted.thresholds) == len(pii.KINDS)
