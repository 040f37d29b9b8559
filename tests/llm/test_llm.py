"""Corpus operators against brute force, exact round trips and held-out accuracy; odd inputs for each."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import check_queries as C
import corpus_pipeline
from lapse.llm import chat, decontaminate, dom, host_rules, langid, lines, packing, pii, queries, resample, simhash

ODD = [None, "", " \t\n", "a", "word " * 5000, "Ünï ’’ 　x", "a\x00b \\ ### </turn>", "x" * 30_000, "the same text here", "the same text here"]
# Extra columns with the names that operators use inside.
EXTRA = {"id": "int", "fp": "string", "words": "int", "hi": "int", "key": "string", "length": "int", "node": "int", "_key": "int", "rows": "int",
         "n": "int", "_kept": "int", "row": "int", "spans": "string", "removed": "int", "word": "int", "label": "int", "n_chars_": "int"}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 7 else i, t, None if i % 3 else "en", None if i % 2 else "s", None) for i, t in enumerate(ODD)]
    rows.append(rows[-1])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in EXTRA.items()])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def out(spark, sf_dir, name):
    return contract.queries()[name](spark, sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    df = out(spark, sf_dir, name)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    a, b = C._rows(df.collect(), df.columns), C._rows(cursor.fetchall(), names)
    assert sorted(df.columns) == sorted(names) and len(a) == len(b)
    assert all(C._same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


# 1 packing
def check_packing(pieces, texts):
    tok = Tokenizer.from_file(queries.TOKENIZER)
    tok.encode_special_tokens = True
    by_row, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p.id].append(p)
        seqs[p.sequence_id].append(p)
    for key, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_row[key], key=lambda p: p.start):
            part = np.array(ids[p.start:p.start + p.length], "<u4")
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += p.length
        assert at == len(ids)
    padding = 0
    for seq in seqs.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048 and {p.sequence_tokens for p in seq} == {at}
        assert {p.padding for p in seq} == {0 if at & (at - 1) == 0 else 2048 - at}
        padding += seq[0].padding
    return padding, sum(p.length for p in pieces)


def test_packing_is_whole_and_tight(spark, sf_dir, docs):
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.TOKENIZER).collect()
    padding, total = check_packing(pieces, {d.doc_id: d.text for d in docs})
    assert padding < 0.03 * total


def test_packing_odd(odd, none):
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(rows, queries.TOKENIZER).collect(), {r.doc_id: r.text for r in rows.collect()})
    assert packing.pack(odd, queries.TOKENIZER).where("start = 0").count() == odd.count()
    assert packing.pack(none, queries.TOKENIZER).count() == 0


def test_encoder_equals_tokenizer():
    encode = packing.Encoder(queries.TOKENIZER)
    assert encode.ranked
    for text in ["a  b", "\n a", "it's 's <|endoftext|>", "a\t b 　c", "é" * 99, "", "12 345\n\n\n x", "\U0001f600 \x00", " " * 1_500_000 + "x"]:
        want = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == want


def test_encoder_equals_unchanged_tokenizer():
    plain, encode = Tokenizer.from_file(queries.TOKENIZER), packing.Encoder(queries.TOKENIZER)
    for text in ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "no added token"]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == want


def test_plan_uses_each_piece_once():
    h = np.zeros(65, np.int64)
    for n in np.random.default_rng(1).integers(1, 65, 3000):
        h[n] += 1
    rows = packing.plan(h, 64)
    used = Counter()
    for row, k in rows:
        assert sum(row) <= 64
        for n in row:
            used[n] += k
    assert all(used[n] == h[n] for n in range(65))


# 2 leaks
def test_leaks_against_all_pairs(spark, sf_dir, docs):
    got = {(r.doc_id, r.item_id): r for r in out(spark, sf_dir, "op2_decontamination").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = lambda t: [w.decode() for w in decontaminate.words_of((t or "").lower().encode())]
    exact = {(d.doc_id, i) for d in docs for i, t in items.items() if f" {' '.join(plain(t))} " in f" {' '.join(plain(d.text))} "}
    assert exact and exact <= set(got)
    for (d, i), r in got.items():
        assert r.n_common >= 0.7 * len(plain(items[i]))


def test_common_subsequence():
    draw = np.random.default_rng(2)
    for _ in range(50):
        a, b = draw.integers(0, 5, 12).tolist(), draw.integers(0, 5, 15).tolist()
        table = np.zeros((13, 16), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        masks = defaultdict(int)
        for i, x in enumerate(a):
            masks[x] |= 1 << i
        assert decontaminate.common_subsequence(dict(masks), 12, b) == table[12, 15]


def test_leaks_odd(spark, odd, none):
    item = "seven green rivers cross the quiet valley before reaching an old harbour town near dunes"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    near = item.replace("green", "wide").replace("old", "ancient")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "intro words " + near + " and more"), (51, "x " * 70000 + item)], "doc_id long, text string"))
    assert {r.id for r in decontaminate.leaks(docs, bench).collect()} == {50, 51}
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.where("false")).count() == 0


def test_leaks_wherever_they_start(spark):
    words = [f"item{i}" for i in range(64)]
    part = [w for i, w in enumerate(words) if i % 10 not in (2, 5, 8)][:45]
    # 45 words of 64 in order over 96 words, at every place of a window.
    spread = [part[0]] + [x for i, w in enumerate(part[1:]) for x in ([f"z{i}", f"y{i}"] if i < 7 else [f"z{i}"]) + [w]]
    bench = spark.createDataFrame([(1, " ".join(words), part[20])], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(k, " ".join([f"lead{j}" for j in range(k)] + spread + ["end"] * 40)) for k in range(40)], "doc_id long, text string")
    assert len(spread) == 96
    assert {r.id for r in decontaminate.leaks(docs, bench, answer_col="answer").collect()} == set(range(40))
    # The whole search finds the same, and without it nothing is found but by the cosine.
    assert {r.id for r in decontaminate.leaks(docs, bench, answer_col="answer", cosine=2.0, exact=True).collect()} == set(range(40))
    assert decontaminate.leaks(docs, bench, answer_col="answer", cosine=2.0).count() == 0


def test_recall_on_paraphrases(spark, docs):
    """Items of the benchmark with a share of their words changed, dropped or moved apart, inside other texts."""
    rng = np.random.default_rng(7)
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()}
    other = " ".join(d.text or "" for d in docs[:60]).split()
    made = []
    for k, (item, text) in enumerate(items.items()):
        words = text.split()
        for share in (0.1, 0.2, 0.3):
            out = []
            for w in words:
                u = rng.random()
                if u < share / 2:
                    out.append(str(rng.choice(other)))
                elif u >= share:
                    out.append(w)
                if rng.random() < share / 2:
                    out.append(str(rng.choice(other)))
            at = int(rng.integers(0, len(other) - 400))
            made.append((len(made), item, " ".join(other[at:at + 150] + out + other[at + 200:at + 300])))
    frame = spark.createDataFrame(made, "doc_id long, item long, text string").repartition(8)
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    whole = {(r.id, r.item_id) for r in decontaminate.leaks(frame, bench, exact=True).collect()}
    found = {(r.id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert found <= whole and len(whole) > 0.5 * len(made)
    print(f"paraphrases: {len(whole)} leaks, recall of the cosine step {len(found) / len(whole):.4f}")
    assert len(found) >= 0.99 * len(whole)


# 3 resampling
def test_resample(spark, sf_dir, docs, odd, none):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in out(spark, sf_dir, "op3_quality_sample").collect()}
    good = {d for d, r in labels.items() if r.quality == 1 and not r.toxic}
    bad = {d for d, r in labels.items() if r.quality == 0}
    assert len(kept) == round(len(docs) * len(good) / len(labels))
    assert len(kept & good) / len(good) > 0.85 and len(kept & bad) / len(bad) < 0.2
    ids = spark.createDataFrame([(3,), (None,)], "d long")
    assert resample.resample(odd, ids, 1.0).count() == odd.count()
    assert resample.resample(none, ids, 0.5).count() == 0


def test_weights_against_plain_counts(spark, docs):
    """Log ratios of the hashed word and pair counts of the target and of all texts, summed over a text's n-grams."""
    from lapse.llm.common import mix, word_hashes

    texts = {d.doc_id: d.text or "" for d in docs[:120]}
    chosen = set(list(texts)[::3])

    def grams(text):
        out = []
        h, _ = word_hashes([text.encode().lower()])
        for i, x in enumerate(h.tolist()):
            out.append(x % 65536)
            if i:
                out.append(int(mix(np.array([(h[i - 1] * np.uint64(3) + h[i])], np.uint64))[0]) % 65536)
        return out

    with np.errstate(over="ignore"):
        each = {d: grams(t) for d, t in texts.items()}
    raw = Counter(g for gs in each.values() for g in gs)
    target = Counter(g for d in chosen for g in each[d])
    scale = sum(target.values()) / sum(raw.values())
    want = {d: sum(np.log(target[g] + 1) - np.log(raw[g] * scale + 1) for g in gs) for d, gs in each.items()}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.id: r for r in resample.resample(table, spark.createDataFrame([(d,) for d in chosen], "d long"), 1.0).collect()}
    assert all(abs(got[d].log_weight - want[d]) < 1e-6 * max(1, abs(want[d])) and got[d].n_grams == len(each[d]) for d in texts)


def test_top_k(spark):
    values = np.random.default_rng(3).normal(size=2000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (0, 1, 700, 2000):
        got = sorted((r.key for r in resample.top_k(df, k).collect()), reverse=True)
        want = sorted(values, reverse=True)
        assert got == ([] if k == 0 else [v for v in want if v >= want[k - 1]])


# 4 language
def test_language(spark, odd, none):
    got = out(spark, "/root/testdata/sf0.01", "op4_language")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(known, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)
    for r in got.join(known, "doc_id").collect():
        assert (r.lang_pred == "und") == (not regex.search(r"\p{L}", r.text or "")) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    model = langid.train(odd, F.lit(True))
    assert model is not None
    assert langid.predict(odd, model).count() == odd.count()
    assert langid.train(none, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs, ~langid.held_out())
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。",
        "qxzv wkjh plmq zzxw kkjq vbnm wqrt ppkl xzcv qwrt hjkq zxqv"]
    got = langid.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in got)
    clean = langid.predict(docs.where(langid.held_out() & F.col("lang").isNotNull()), model)
    assert clean.agg(F.avg(F.col("rejected").cast("double"))).first()[0] < 0.004
    assert model.least_score < 1 and np.isfinite(model.least_usual)


def test_more_languages_than_a_model_holds(spark):
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.train(many, F.lit(True))


# 5 host rules (counts and verdicts are held against SQL above)
def test_host_rules_odd(odd, none):
    rows = host_rules.host_rules(odd).collect()
    assert len(rows) == odd.count()
    by = {r.id: r for r in rows if r.id is not None}
    assert by[0].n_words == 0 and by[0].base_failed and by[4].n_repeat_words == 5000 and not by[4].kept
    assert host_rules.host_rules(none).count() == 0


# 6 personal data
def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_against_plain_patterns(docs):
    made = ["a@b.c@d.e", "@x.y a@b", "a@b.c-d.e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111-1111 1111 1", "+49 (30) 123-4567 +1((", "é@x.yz a+b@é.de",
            "..@a.b x@y.z@", "0001.2.3.4 1.2.3", "12 3456-7890 1234 5678 4111111111111111", "a@-.-", "a@@b.c d@e.f"]
    for text in made + [d.text or "" for d in docs]:
        assert pii.base_spans(text) == plain_base(text), text[:80]


def test_personal_data(spark, sf_dir, docs, odd, none):
    got = {r.doc_id: r for r in out(spark, sf_dir, "op6_personal_data").collect()}
    added = 0
    for d in docs:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(d.text or ""))
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    larger = "/root/testdata/sf0.01"
    spans = {r.doc_id: r.spans.split(",") for r in out(spark, larger, "op6_personal_data").collect()}
    for d in spark.read.parquet(f"{larger}/documents.parquet").where("text like '%token = %'").collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', d.text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans[d.doc_id]
            added += 1
    assert added
    assert pii.personal_spans(odd).count() == odd.count() and pii.personal_spans(none).count() == 0
    assert pii.redact("ab cd ef", [("ip", 3, 5), ("card", 4, 6)]) == "ab [IP]ef"


def test_recall_of_added_spans(spark):
    """Planted data of every added kind among harmless look-alikes."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))

    def iban():
        body = "".join(map(str, rng.integers(0, 10, 18)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check:02d}{body}"

    kinds = {
        "secret": lambda: ("token = \"{}\"", "".join(rng.choice(list("0123456789abcdef"), 40))),
        "iban": lambda: ("bitte auf IBAN {} zahlen", iban()),
        "national_id": lambda: ("ssn: {}", f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"),
        "account": lambda: ("account number: {}", "".join(map(str, rng.integers(1, 10, 10)))),
        "user": lambda: ("twitter {} wrote", "@" + "".join(rng.choice(list("abcdefgh"), 6)) + "_" + str(rng.integers(10, 99))),
    }
    rows, spans = [], {}
    for i in range(600):
        kind = list(kinds)[i % 5]
        frame, value = kinds[kind]()
        lead = " ".join("".join(rng.choice(letters[:26], rng.integers(2, 8))) for _ in range(20)) + "\n"
        text = lead + frame.format(value) + "\nend of it"
        at = text.index(value)
        spans[i] = f"{kind}:{at}:{at + len(value)}"
        rows.append((i, text))
    harmless = ["version 20240101", "isbn 9781234567", "commit sha 0123456789012345678901234567890123456789", "path/to/some/module_name/file_01", "the_quick_brown_fox_jumps"]
    rows += [(1000 + i, f"plain words\n{harmless[i % 5]}\nmore") for i in range(300)]
    found = {r.id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_kind = {k: np.mean([spans[i] in found[i] for i in spans if spans[i].startswith(k)]) for k in kinds}
    clean = np.mean([not found[i] for i, _ in rows if i >= 1000])
    print("recall of planted data", by_kind, "harmless left alone", clean)
    # Masking too much is the lesser harm: a hash after "commit sha" and the like are taken for secrets in this mixture.
    assert min(by_kind.values()) >= 0.9 and clean >= 0.5


def test_long_and_wide_candidates():
    key = ("a1B2" * 150)[:512] + "+" + "c3D4" * 30
    assert ("secret", 7, 7 + len(key)) in {c[:3] for c in pii.candidates(f'key = "{key}"', [])}
    run = next(str(n) for n in range(12345698765432, 12345698765532) if pii.luhn(str(n)))
    text = f"iban GB82WEST{run} x"
    assert [s[0] for s in pii.base_spans(text)] == ["card"]
    assert ("iban", 5, 5 + 8 + len(run)) in {c[:3] for c in pii.candidates(text, pii.base_spans(text))}


# 7 lines (whole results are held against SQL above)
def test_lines_odd_and_cut(spark, odd, none):
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"{line}\nx", 5), (2, f"y\n{line.upper()}!\nz", 6), (3, None, 7), (None, line, 8)], "doc_id long, text string, start int")
    gone = lines.repeated_units(docs)
    whole = {r.id: r for r in lines.deduplicated(docs).collect()}
    assert {(i, r.n_lines, r.n_removed, r.text) for i, r in whole.items()} == {
        (1, 2, 0, f"{line}\nx"), (2, 3, 1, "y\nz"), (3, 1, 0, ""), (None, 1, 1, "")}
    # Different texts under one id, null ids too, are different documents; adjoining lines are one passage.
    poem = "\n".join(" ".join(f"w{i}_{j}" for j in range(9)) for i in range(8))
    same = spark.createDataFrame([(None, "p\n" + poem), (None, poem + "\nq"), (4, "a"), (4, "b")], "doc_id long, text string")
    rows = sorted((r.n_removed, r.n_passages, r.text) for r in lines.deduplicated(same).collect())
    assert [r[:2] for r in rows] == [(0, 0)] * 3 + [(8, 1)] and rows[-1][2] == "p\n"
    assert lines.deduplicated(odd).count() == odd.count() and lines.deduplicated(none).count() == 0
    assert lines.without_units(odd, lines.repeated_units(odd)).columns == odd.columns
    assert {(r.id, r.start, r.first_id) for r in gone.collect()} == {(2, 2, 1), (None, 0, 1)}
    cut = {r.doc_id: r.text for r in lines.without_units(docs, gone).collect()}
    assert cut == {1: f"{line}\nx", 2: "y\nz", 3: None, None: ""}
    assert lines.repeated_units(odd, unit="paragraph").count() >= 0 and lines.repeated_units(none).count() == 0


# 8 main text
PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header class="site-header"><a href="/">Home</a>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav></header><div class="cookie-notice">We use cookies on this site.</div>
<div id="content"><article><h1>A  title</h1><p>First &amp; <b>bold</b>
text of the article, long enough to be one.<p>Second paragraph of it, which goes on for a while.<ul><li>Point</ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, thanks.</p></div></section></div>
<aside class="sidebar"><h3>Related</h3><a href="/c">Other</a></aside><form class="search"><label>Find</label><input></form>
<footer>&copy; 2024 all rights reserved</footer></body></html>"""


def test_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    trees = dom.fit(pages)
    assert dom.main_text(PAGE, trees).split("\n") == [
        "A title", "First & bold text of the article, long enough to be one.", "Second paragraph of it, which goes on for a while.", "Point"]
    got = {r.page_id: r for r in out(spark, sf_dir, "op8_main_text").collect()}
    for p in pages.collect():
        inside = re.search("<article>(.*)</article>", p.html, re.S)[1]
        want = [" ".join(dom.html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[p.page_id].text == "\n".join(x for x in want if x) and got[p.page_id].n_chars == len(got[p.page_id].text)
    odd = ["", None, "plain", "<", "<p", "<!-- x", "<div><p>a", "</p></div>", "<script>x", "<a href='>", "&#x;&#0;&amp", "<table><tr><td>a<td>b</table>", "<p>" * 3000]
    rows = spark.createDataFrame(list(enumerate(odd)), "page_id int, html string")
    assert dom.extract(rows, trees).count() == len(odd)
    assert dom.extract(rows.where("false"), trees).count() == 0


def test_raw_text_ends_where_lower_case_is_longer():
    page = PAGE.replace("<title>T", "<TITLE>\u0130stanbul").replace("First &amp;", "First <math><mi>x</mi></math> &amp;")
    nodes = dom.dom(page)
    assert [n.tag for n in nodes] == [n.tag for n in dom.dom(page.replace("\u0130", "I"))] and "article" in {n.tag for n in nodes}
    assert any(b.startswith("First x") for b in dom.blocks(nodes, [n.tag not in dom.UNSEEN for n in nodes]))


def test_kept_nodes_have_kept_ancestors():
    nodes = dom.dom(PAGE)
    keep = dom.decode(nodes, np.random.default_rng(8).normal(size=len(nodes)))
    assert all(keep[n.parent] for n, k in zip(nodes[1:], keep[1:]) if k)


# 9 near duplicates
def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_all_pairs(spark, sf_dir, docs):
    got = {r.doc_id: r for r in out(spark, sf_dir, "op9_near_duplicates").collect()}
    fp = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for d in ids:
        assert got[d].fingerprint == f"{fp[d]:016x}" and got[d].component_id == find(d)


def test_tree_search_and_components(spark):
    draw = np.random.default_rng(9)
    points = np.unique(np.concatenate([draw.integers(0, 2**63, 300, np.int64).view(np.uint64), np.arange(300, dtype=np.uint64)]))
    tree = simhash.BKTree(points)
    got = {(int(a), int(b)) for x, y in tree.search(points, 2) for a, b in zip(x, y)}
    want = {(a, b) for a in range(len(points)) for b in range(len(points)) if (int(points[a]) ^ int(points[b])).bit_count() <= 2}
    assert got == want
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (100, 95), (7, 7)], "u long, v long")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and roots[100] == roots[95] == 90
    assert simhash.components(links.where("false")).count() == 0


def test_near_duplicates_odd(odd, none):
    rows = simhash.near_duplicate_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.id in (0, 1, 2)} == {0} and {r.component_id for r in rows if r.id in (8, 9)} == {8}
    assert simhash.near_duplicate_components(none).count() == 0


# 10 chat
def test_chat_round_trip_and_fold(spark):
    said = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\\\</turn>\n### x\\"), ("a: b:", None), (None, "<\\/turn> #\\#\\#"), ("assistant", "")]
    turns = spark.createDataFrame([(1, i, r, t, 9) for i, (r, t) in enumerate(said)] + [(2, None, "user", "u", 9)], "conv_id long, turn long, role string, text string, m int")
    got = {r.conv_id: r for r in chat.formatted_conversations(turns).select(
        "conv_id", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("mask")).alias("m")).collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(r or "", t or "") for r, t in said]
    assert got[1].m == [said[1][1], ""] and len(got[2].t) == 1
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "a"), (1, 2, "delta", 1, None, "b"), (1, 3, "regenerate", 1, None, None),
           (1, 4, "delta", 1, None, "c"), (1, 6, "delta", 1, None, "d"), (1, 5, "edit", 0, None, "hello"), (1, 7, "other", 1, None, "z")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    final = sorted((r.place, r.role, r.text) for r in chat.fold_events(events).collect())
    assert final == [(0, "user", "hello"), (1, "assistant", "cd")]
    # Events without an id are messages of their own, equal ones too.
    again = spark.createDataFrame([(1, 0, r, t) for r, t in [("user", "u")] * 3 + [("user", "v"), (None, None), (None, None)]], "conv_id long, turn long, role string, text string")
    row = chat.formatted_conversations(again).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [(x.role, x.text) for x in row.t] == [("", "")] * 2 + [("user", "u")] * 3 + [("user", "v")]
    assert chat.formatted_conversations(turns.where("false")).count() == 0


def test_no_control_string_is_left_in_a_body(spark):
    texts = ["#" * k for k in range(9)] + ["\\#" * 4, "#\\##\\###", "</turn></turn>###</turn>", "##</turn>##", "a#### b##### \\\\##"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert "###" not in r.e and "##" not in r.e and "</turn>" not in r.e and r.back == r.t


# pipeline
def jaccard(a, b):
    x, y = ({" ".join(t.encode().lower().decode().split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pipeline_stages(spark, sf_dir, docs, odd):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.language(spark, frame, sf_dir).count() >= 0.97 * len(docs)
    base = " ".join(f"w{i}" for i in range(200))
    near = [(1, base), (2, base), (3, base.replace("w100", "q")), (4, "other text that is by itself " * 3), (5, base.replace("w20 ", "").replace("w150", "v")), (1, base)]
    small = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near], frame.schema)
    kept = corpus_pipeline.near_dups(spark, small, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4]
    left = corpus_pipeline.near_dups(spark, frame, sf_dir).collect()
    ids = {r.doc_id for r in left}
    texts = {d.doc_id: d.text for d in docs}
    assert len({t for t in texts.values()}) >= len(ids)
    for d, t in texts.items():  # whatever went has a similar or equal text, and nothing that stayed has
        if d not in ids:
            assert any(o != d and jaccard(t, u) >= 0.8 for o, u in texts.items())
    assert not [(a, b) for a in ids for b in ids if a < b and abs(len(texts[a]) - len(texts[b])) < 0.3 * len(texts[a]) and jaccard(texts[a], texts[b]) >= 0.8]
    redacted = corpus_pipeline.personal(spark, frame, sf_dir)
    assert redacted.columns == frame.columns and redacted.count() == len(docs)
    assert not [r for r in redacted.collect() if plain_base(r.text or "")]
    leaked = {r.doc_id for r in out(spark, sf_dir, "op2_decontamination").collect()}
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, frame, sf_dir).collect()} == {d.doc_id for d in docs} - leaked
    wide = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
        assert stage(spark, odd.where("false").select(wide), sf_dir).count() == 0, name


def test_pipeline_runs(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def apart_in_all_buckets():
    """Two texts of a Jaccard similarity over 0.8 that share no bucket of the near-duplicate search."""
    rng = np.random.default_rng(5)
    while True:
        w = [f"w{i}" for i in rng.integers(0, 10**9, 66)]
        a, b = " ".join(w[:60]), " ".join(w[:54] + w[60:])
        h, g = (simhash.shingle_hashes(t.encode(), 5) for t in (a, b))
        far = (simhash.majority(h) ^ simhash.majority(g)) & (1 << 64) - 1
        if far.bit_count() > 8 and not any(x == y for x, y in zip(simhash.sample_prints(np.unique(h)), simhash.sample_prints(np.unique(g)))):
            return a, b


def test_similar_groups_without_a_shared_bucket(spark):
    a, b = apart_in_all_buckets()
    assert jaccard(a, b) >= 0.8
    shared = [f"p{i}" for i in range(80)]  # texts around a common passage, a Jaccard similarity of 0.7 among strangers
    strangers = [" ".join(shared + [f"s{k}_{i}" for i in range(14)]) for k in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([a, b, *strangers, " ", "\n"])], "doc_id long, text string")
    number = {r.node: r.doc_id for r in frame.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    assert sorted(sorted((number[r.node], number[r.root])) for r in simhash.similar_groups(frame).collect()) == [[0, 1], [42, 43]]


def test_prefix_pairs_of_a_family(spark, monkeypatch):
    """Many texts that are nearly similar enough: few pairs come to the check on whole sets, none that is similar is missing."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(80):
        words = list(base)
        for at in rng.choice(150, rng.choice((1, 2, 2, 2, 3)), replace=False):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("node"), "text")
    sets = {r.node: set(simhash.shingle_hashes(r.text.encode(), 5).tolist()) for r in frame.collect()}
    nodes = sorted(sets)
    alike = {(b, a) for i, a in enumerate(nodes) for b in nodes[i + 1:] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    prefixes = simhash._prefixes(frame, 5, 0.8)
    prefixes = spark.createDataFrame(prefixes.collect(), prefixes.schema)
    none = spark.createDataFrame([], "node long, root long")
    for rows in (simhash.LIST_ROWS, 5):  # whole lists, and lists cut into cells
        monkeypatch.setattr(simhash, "LIST_ROWS", rows)
        pairs = {(r.a, r.b) for r in simhash._prefix_pairs(prefixes, none, 0.8).collect()}
        assert alike <= pairs and len(alike) > 100 and len(pairs) < len(alike) + 0.3 * (80 * 79 / 2 - len(alike)), (len(alike), len(pairs))
    main = spark.createDataFrame([(n, nodes[0]) for n in nodes[:40]], "node long, root long")
    pairs = {(r.a, r.b) for r in simhash._prefix_pairs(prefixes, main, 0.8).collect()}
    assert {(a, b) for a, b in alike if not {a, b} <= set(nodes[:40])} <= pairs and not any({a, b} <= set(nodes[:40]) for a, b in pairs)


def test_sets_of_wanted_texts_only(spark):
    """Sets of exactly the texts in pairs, also of those that share a place of the bitmap with a wanted one."""
    step = simhash.SLOTS * 64
    texts = spark.createDataFrame([(5, "a b"), (5 + step, "c d"), (-3, "e f"), (-3 + step, "g h"), (9, "i j"), (9, "i j")], "node long, text string")
    pairs = spark.createDataFrame([(5, -3), (9, 5)], "a long, b long")
    got = {r.node: r.shingles for r in simhash._sets(texts, pairs, 5).collect()}
    assert set(got) == {5, -3, 9} and all(len(x) == 1 for x in got.values())
    assert simhash._sets(texts, pairs.limit(0), 5).count() == 0
