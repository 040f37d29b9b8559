"""Vector codes, dominance packing and spelling variants against brute force; odd inputs for each."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapse.llm import dominance, orchard, queries, variants

from .test_llm import docs, none, odd, out  # noqa: F401


# 11 vector codes (whole results are held against SQL in test_llm)
@pytest.mark.parametrize("spread", [2, 40, 4000])
def test_orchard_equals_trying_all(spread):
    draw = np.random.default_rng(spread)
    for size in (1, 2, 9, 256):
        entries = draw.integers(-spread, spread, (size, 5))
        entries[size // 2] = entries[0]
        points = draw.integers(-2 * spread, 2 * spread, (700, 5))
        entry, d = orchard.Orchard(entries).search(points)
        full = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def plain_codes(rows, rounds=4, entries=256):
    kept = sorted(((i, v) for i, v, _ in rows), key=lambda r: r[0])
    v = np.array([x for _, x in kept], np.int64).reshape(len(kept), 4, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((v[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        best = d.argmin(axis=2)
        if r < rounds:
            for p, e in itertools.product(range(4), range(books.shape[1])):
                mine = v[best[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    return {i: ("".join(f"{e:02x}" for e in b), int(m)) for (i, _), b, m in zip(kept, best, d.min(axis=2).sum(axis=1))}, books


def test_codes_against_plain(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(400, 8)).astype(np.float32)
    x[5] = x[4]
    table = spark.createDataFrame([(i, v.tolist(), i % 3 if i % 5 else None) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    coded, books = orchard.compress(table.repartition(7), entries=30)
    want, want_books = plain_codes([(i, np.floor(v.astype(float) * 1024), 0) for i, v in enumerate(x)], entries=30)
    assert (books == want_books).all()
    rows = orchard.label_errors(coded).collect()
    assert {r.id: (r.code, r.error) for r in rows} == want
    totals = defaultdict(int)
    for r in rows:
        totals[r.label] += r.error
    assert all(r.label_error == totals[r.label] for r in rows) and None in totals


def test_codes_odd(spark):
    vectors = [None, [], [1.0] * 4, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf")] * 4, [0.5] * 3, [2.0] * 8, [-3e38] * 4, [0.0] * 4, [0.0] * 4]
    rows = [(None if i == 9 else i, v, None, 5, "x") for i, v in enumerate(vectors)] + [(2, [1.0] * 4, 1, 5, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int, code string")
    coded, books = orchard.compress(table)
    got = sorted((-1 if r.id is None else r.id, r.code) for r in coded.collect())
    assert [i for i, _ in got] == [-1, 2, 2, 8, 10] and books.shape == (4, 4, 1)
    assert got[0][1] == got[4][1]
    assert orchard.label_errors(coded).count() == 5
    for empty in (table.where("false"), table.where("vec_id is null"), table.where("vec_id = 0")):
        coded, books = orchard.compress(empty)
        assert orchard.label_errors(coded).count() == 0 and orchard.digest(books)


# 12 dominance packing
def fewest(lengths, window):
    """Fewest windows, by trying all packings."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1:])
        place(i + 1, rooms + [window - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8), st.integers(20, 26))
def test_reduction_keeps_the_optimum(lengths, window):
    lengths = sorted(lengths, reverse=True)
    histogram = np.bincount(lengths, minlength=window + 1)
    fixed, left = dominance.reduce(histogram, window)
    rest = [n for n in range(window, 0, -1) for _ in range(left[n])]
    assert sum(k for _, k in fixed) + (fewest(rest, window) if rest else 0) == fewest(lengths, window)
    assert dominance.lower_bound(histogram, window) <= fewest(lengths, window)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_best_fit_equals_plain(lengths):
    window = 64
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    got = dominance.best_fit(np.bincount(lengths, minlength=window + 1), window)
    assert sorted(window - sum(row) for row, k in got for _ in range(k)) == sorted(rooms)
    used = Counter()
    for row, k in got:
        for n in row:
            used[n] += k
    assert used == Counter(lengths)


def test_plan_is_near_the_bound():
    draw = np.random.default_rng(12)
    for lengths in (draw.integers(1, 2049, 20000), np.minimum(2048, draw.lognormal(6, 1, 20000).astype(int) + 1)):
        histogram = np.bincount(lengths, minlength=2049)
        rows, _ = dominance.plan(histogram)
        assert sum(k for _, k in rows) <= dominance.lower_bound(histogram, 2048) * 1.005 + 1


def check_pieces(pieces, texts):
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.id].append(p)
        seqs[p.sequence_id].append(p)
    for key, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(k, a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in by_doc[key]) == want
    for seq in seqs.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and {p.sequence_tokens for p in seq} == {at} and len({p.fixed for p in seq}) == 1
    return len(seqs)


def test_dominance_packing_is_whole_and_tight(spark, sf_dir, docs):  # noqa: F811
    rows = out(spark, sf_dir, "op12_dominance_packing").withColumnRenamed("doc_id", "id").collect()
    n = check_pieces(rows, {d.doc_id: d.text for d in docs})
    histogram = np.bincount([r.length for r in rows], minlength=2049)
    assert n <= dominance.lower_bound(histogram, 2048) * 1.01 + 1


def test_dominance_packing_odd(odd, none):  # noqa: F811
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(dominance.pack(rows, queries.WORD_TOKENIZER).collect(), {r.doc_id: r.text for r in rows.collect()})
    assert dominance.pack(odd, queries.WORD_TOKENIZER).where("start = 0").count() == odd.count()
    assert dominance.pack(none, queries.WORD_TOKENIZER).count() == 0


def test_encoder_equals_library(docs):  # noqa: F811
    plain, encode = Tokenizer.from_file(queries.WORD_TOKENIZER), dominance.WordEncoder(queries.WORD_TOKENIZER)
    assert encode.merges
    texts = ["a  b", "\n a", "it's 'S it's", "<|endoftext|> x<|startoftext|>y <|endoftext", "ΣΑΣ ΌΔΟΣ İI", "é ́e ́", "a\x0bb\x0cc\x1cd\x85e　f g",
             "", "한국 한 ᄒ ᅡ", "x" * 3000, "A\x00b 12 345", "\U0001f600 ‍", "tab\tnew\r\n'll 've've",
             "x<|endoftext|>y z", "².5³ ¼½ ª º µ ¨´ «a» €5 ‘q’ – …", "ÀÉÎõÿ ŁÓDŹ Œuvre ſ ŉ ĿL", "!'s ''s 'sofa 'LL'd'", "é́ x", "a\x85b c\u2028d\x1ce", " ", "'", "\u00ad-\u00ad"]
    texts += ["".join(map(chr, range(low, low + 64))) for low in range(0, 0x300, 64)] + [d.text or "" for d in docs]
    for text in texts * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]
    encode.merges = None
    assert np.frombuffer(encode("One two"), "<u4").tolist() == plain.encode("One two", add_special_tokens=False).ids


# 13 spelling variants (whole results are held against SQL in test_llm)
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(c, key=lambda x: (-n[x], x)) for w, c in close.items() if c}
    form = {w: x for w, x in best.items() if n[x] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n}


def test_variants_against_all_pairs(spark, sf_dir, docs):  # noqa: F811
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out(spark, sf_dir, "op13_spelling_variants").collect()}
    assert got == plain_variants([(d.doc_id, d.text) for d in docs])


def test_chains_ties_and_odd(spark, odd, none):  # noqa: F811
    said = {"colours": 150, "colour": 30, "colourz": 150, "colous": 6, "màison": 40, "maison": 200, "abcdefgh": 25, "abcdefg": 5, "ab" * 900: 40, "ab" * 900 + "c": 5}
    rows = [(None, " ".join([w] * k), 1) for w, k in said.items()] + [(7, "COLOURS, Maison-Ünïque×é", 2), (8, None, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, word int").withColumn("n", F.lit(1))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(table).collect()}
    assert got == plain_variants([r[:2] for r in rows]) and got["colous"][:2] == ("colours", "colours")
    assert {r.word for r in variants.spelling_variants(odd).collect()} == set(plain_variants([(r.doc_id, r.text) for r in odd.collect()]))
    assert variants.spelling_variants(none).count() == 0


def test_hot_halves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(variants, "HALF_LETTERS", 200)
    monkeypatch.setattr(variants, "BLOCK_LETTERS", 150)
    draw = np.random.default_rng(13)
    words = {"prefix" + "".join(draw.choice(list("abé"), draw.integers(1, 5))) for _ in range(400)} | {"".join(draw.choice(list("abc"), 7)) for _ in range(400)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    rows = [(r.word, r.near) for r in variants.near_words(table).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a in words for b in words if near(a, b)}
