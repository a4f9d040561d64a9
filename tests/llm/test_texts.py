"""Tokenizer, lengths, quality, pseudonyms and licenses against plain Python."""

import datetime
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weftline.llm import lengths, licenses, pieces, pseudonyms, quality, settings
from weftline.llm.settings import tokenizer

TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "\ta\nb\r\n c ", "▁x ▁", "x▁y", "日本語 テスト", "naïve Ünïcode 🎉🎉 end", "a\x00b", "word " * 3000,
    "x" * 20000, "one two three four five six\none two three four five six\n\n  \nseven", "1 2 3 4 5 6 7 8 9 10 11", "#*$ %&| <>", "THE THE",
]
SCHEMA = "doc_id long, text string, lang string, source string, ids string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], "s", "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9], (None, "no id here", None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_pieces_equal_the_library(spark, docs, real):
    model = tokenizer(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for frame in (docs.select("doc_id", "text", "kept"), real.select("doc_id", "text")):
        found = pieces.decode(pieces.encode(frame, model).withColumn("again", F.col("ids")), model).collect()
        assert len(found) == frame.count()
        for row in found:
            expected = sp.encode(row["text"] or "", add_bos=True, add_eos=True)
            assert row["again"] == expected
            assert row["n_tokens"] == len(expected)
            assert row["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
            assert row["decoded"] == sp.decode(expected)


def test_decode_takes_any_ids(spark):
    model = tokenizer(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(0, 32000, 40).tolist()) for k in range(60)] + [(60, []), (61, None), (62, [0]), (63, [28705, 28705]), (64, [195, 1, 172])]
    found = pieces.decode(spark.createDataFrame(rows, "k int, ids array<int>"), model).collect()
    for row in found:
        ids = rows[row["k"]][1]
        assert row["decoded"] == (None if ids is None else sp.decode(ids))


def test_lengths_answer_every_limit(spark, real):
    model = tokenizer(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    sizes = sorted(len(sp.encode(r["text"], add_bos=True, add_eos=True)) for r in real.collect())
    sums = lengths.suffix_sums(lengths.length_histogram(real, model))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert Counter(sizes) == {k: r["n_docs"] for k, r in rows.items()}
    for k, r in rows.items():
        assert r["docs_over"] == sum(s > k for s in sizes)
        assert r["tokens_over"] == sum(s for s in sizes if s > k)
        assert r["truncated_total"] == sum(min(s, k) for s in sizes)
    limits = [1, 100, 777, 2048, 10**6]
    assert {r["context"]: r["total"] for r in lengths.truncated_totals(sums, limits).collect()} == {n: sum(min(s, n) for s in sizes) for n in limits}
    found = {r["share"]: r["n_tokens"] for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    odd = spark.createDataFrame([(None, "x"), (None, "x"), ("", "x"), ("a", "x"), ("a", "x")], "text string, n_tokens string")
    assert {r["n_tokens"]: r["n_docs"] for r in lengths.length_histogram(odd, model).collect()} == {2: 3, 3: 2}
    none = lengths.suffix_sums(lengths.length_histogram(odd.limit(0), model))
    assert lengths.quantiles(none, [0.5]).count() == 0
    assert [r["total"] for r in lengths.truncated_totals(none, [7]).collect()] == [0]
    assert found == {q: next(s for k, s in enumerate(sizes, 1) if k >= q * len(sizes)) for q in (0.1, 0.5, 1.0)}


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs, real):
    for frame in (docs, real):
        rows = quality.quality(frame).collect()
        assert len(rows) == frame.count()
        for r in rows:
            expected = base(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
            assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
            far = (r["char_distance"] or 0) > 0.17 or (r["word_distance"] or 0) > 0.33
            assert r["kept"] == (not r["base_failed"] and not far)


def test_quality_distance(spark):
    reference = quality.REFERENCES["en"]
    text = ("of the and to a in is that for it was with " + "stone river cloud garden window table " * 2) * 10
    row = quality.quality(spark.createDataFrame([(text, "en")], "text string, lang string")).first()
    words = text.split()
    p = np.array([words.count(w) / len(words) for w in reference.words])
    p = np.append(p, 1 - p.sum())
    q = np.array([*reference.words.values(), 1 - sum(reference.words.values())])
    m = (p + q) / 2
    js = sum(x * np.log2(x / y) for x, y in zip([*p, *q], [*m, *m], strict=True) if x > 0) / 2
    assert row["word_distance"] == pytest.approx(np.sqrt(js))


def test_quality_keeps_labelled_good_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.quality(docs).filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    shares = {r["quality"]: r["share"] for r in rows}
    assert shares[1] > 0.98
    assert shares[0] < 0.05


def test_pseudonyms_keep_format_and_links(spark):
    f = pseudonyms.Feistel(b"key")
    for size in (1, 2, 7, 1000):
        assert sorted(f.permute(k, size, "d") for k in range(size)) == list(range(size))
    text = "Mail ann.b7@x.example.org, call +1 (152) 555-8590 or (212) 555-0100, card 4111 1111 1111 1111, not 4111 1111 1111 1112, ssn 123-45-6789, ip 10.0.0.7 not 300.1.1.1, on 2024-02-29 not 2023-02-29, 31.12.1999, 02/28/2000, DE89 3704 0044 0532 0130 00, version 2.0."
    rows = [(1, text, "c"), (2, text, "c"), (3, None, "c"), (4, "", "c"), (5, "y" * 50000, "c")]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, n_private string"), "key").collect()}
    assert out[1]["text"] == out[2]["text"] != text
    assert (out[3]["text"], out[4]["text"], out[5]["text"]) == (None, "", "y" * 50000)
    new = out[1]["text"]
    kinds = [s["kind"] for s in out[1]["private_spans"]]
    assert Counter(kinds) == {"email": 1, "phone": 2, "card": 1, "social": 1, "ipv4": 1, "date": 3, "iban": 1}
    assert out[1]["n_private"] == len(kinds)
    for s in out[1]["private_spans"]:
        assert text[s["start"] : s["end"]] not in new
    for kept in ("@x.example.org", "4111 1111 1111 1112", "300.1.1.1", "2023-02-29", "version 2.0."):
        assert kept in new
    assert pseudonyms.luhn(re.search(r"card ([\d ]+),", new)[1].replace(" ", ""))
    mail = re.search(r"Mail (\S+)@", new)[1]
    assert len(mail) == 6 and mail[3] == "." and mail == mail.lower()
    datetime.date.fromisoformat(re.search(r"on (\d{4}-\d\d-\d\d) not", new)[1])
    iban = re.search(r"DE[\d ]+\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    other = pseudonyms.pseudonymise(spark.createDataFrame(rows[:1], "doc_id long, text string, n_private string"), "other").first()["text"]
    assert other != new


def test_pseudonyms_equal_brute_force(spark):
    """Values are found, validated and replaced one after another by rules written out for each kind."""
    f = pseudonyms.Feistel(hashlib.sha256(b"k").digest())

    def iso(m):
        try:
            day = datetime.date.fromisoformat(m[0]).toordinal()
        except ValueError:
            return m[0]
        first = datetime.date(1900, 1, 1).toordinal()
        size = datetime.date(2099, 12, 31).toordinal() - first + 1
        return datetime.date.fromordinal(first + f.permute(day - first, size, "date")).isoformat() if 0 <= day - first < size else m[0]

    def octets(m):
        parts = [int(x) for x in m[0].split(".")]
        number = sum(x << 8 * (3 - k) for k, x in enumerate(parts))
        return ".".join(str(f.permute(number, 2**32, "ipv4") >> 8 * (3 - k) & 255) for k in range(4)) if max(parts) < 256 else m[0]

    def social(m):
        def valid(n):
            s = f"{n:09d}"
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        n = int(m[0].replace("-", ""))
        if not valid(n):
            return m[0]
        while not valid(n := f.permute(n, 10**9, "social")):
            pass
        return f"{n:09d}"[:3] + "-" + f"{n:09d}"[3:5] + "-" + f"{n:09d}"[5:]

    rng = np.random.default_rng(8)
    made = [lambda: f"{rng.integers(1890, 2110)}-{rng.integers(0, 14):02d}-{rng.integers(0, 33):02d}", lambda: ".".join(str(rng.integers(0, 300)) for _ in range(4)), lambda: f"{rng.integers(0, 1000):03d}-{rng.integers(0, 4):02d}-{rng.integers(0, 9999):04d}", lambda: "word"]
    texts = [" ; ".join(made[rng.integers(4)]() for _ in range(40)) for _ in range(50)]
    found = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    for r in found:
        expected = re.sub(r"\b\d{4}-\d\d-\d\d\b", iso, texts[r["doc_id"]])
        expected = re.sub(r"(?<!\S)\d+(\.\d+){3}(?!\S)", octets, expected)
        assert r["text"] == re.sub(r"(?<!\S)\d{3}-\d\d-\d{4}(?!\S)", social, expected)
        assert r["n_private"] == sum(a != b for a, b in zip(texts[r["doc_id"]].split(), r["text"].split(), strict=True))


def test_the_key_is_the_sessions_own(spark):
    spark.conf.unset(settings.KEY)
    key = settings.pseudonym_key(spark)
    assert len(key) == 64 and settings.pseudonym_key(spark) == key
    spark.conf.set(settings.KEY, "mine")
    assert settings.pseudonym_key(spark) == "mine"
    spark.conf.unset(settings.KEY)


def scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, base_labels, labels, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        base_labels |= {label} if found else set()
    lines = (text or "").lower().split("\n")
    for k in range(len(lines)):
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ".join(lines[k : k + 4])))
        for label, sentence in licenses.TEMPLATES:
            want = set(sentence.split())
            if len(have & want) >= 0.8 * len(want) - 1e-9:
                labels.add(label)
                best = max(best, len(have & want) / len(want))
    score = best or (1.0 if at else 0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score


def test_licenses_equal_a_full_comparison(spark, docs, real):
    more = [
        (100, "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files."),
        (101, "licensed under the apache license, version 3"), (102, "Mit license mit LICENSE ümit license"), (103, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
        (103, "licensed under cc by\nnc 4 0"),
        (105, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\n\nsoftware and associated documentation files"), (106, "Redistribution and use in source\nand\n\n\nbinary forms\n"), (104, "under license " * 5000),
    ]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    for frame in (docs, real, extra):
        rows = frame.select("doc_id", "text").collect()
        found = licenses.scan_licenses(frame).collect()
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in found) == Counter((r["doc_id"], *scan(r["text"])) for r in rows)


def test_licenses_count_places_from_the_first_word(spark):
    texts = ["# MIT License", "(c) MIT License, or the Apache License", "\n mit license", "mit license", " x ", "", None, "...the General Public License. MIT License!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(frame).collect()}
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [tuple(found[k][n] for n in names) for k in range(len(texts))] == [scan(t) for t in texts]
    assert (found[0]["first_word"], found[1]["first_word"], found[1]["last_word"]) == (0, 1, 5)


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    model = tokenizer(spark)
    assert pieces.encode(empty, model).count() == 0
    assert quality.quality(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert pseudonyms.pseudonymise(empty, "k").count() == 0
    assert lengths.suffix_sums(lengths.length_histogram(empty, model)).count() == 0


def test_short_local_parts_all_move_and_none_meet():
    f = pseudonyms.Feistel(b"k" * 32)
    for domain in ("a.com", "example.org"):
        for names in (list(pseudonyms.ALPHABET), [a + b for a in pseudonyms.ALPHABET for b in pseudonyms.ALPHABET[:3]]):
            new = [pseudonyms.email(f, f"{n}@{domain}") for n in names]
            assert len(set(new)) == len(names) and all(x != f"{n}@{domain}" and len(x) == len(f"{n}@{domain}") for x, n in zip(new, names, strict=True))
    assert pseudonyms.email(f, "A@x.org").isascii() and pseudonyms.email(f, "A@x.org").lower() == pseudonyms.email(f, "a@x.org")


def test_octets_with_leading_zeros_are_no_address():
    f = pseudonyms.Feistel(b"k" * 32)
    assert pseudonyms.ipv4(f, "010.001.002.003") is None and pseudonyms.ipv4(f, "10.1.2.300") is None
    assert pseudonyms.ipv4(f, "10.1.2.3") != "10.1.2.3" and pseudonyms.ipv4(f, "0.0.0.0").count(".") == 3
