"""Fill-in-middle, personal data and resampling against brute force, planted cases and odd inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from evalweave.llm import common, fim, pii, resample

ODD = ["", None, "a", "a  x", "<P>", "a <S> b", "x<M", "<<P", "日本語 テスト 😀😀", "x" * 30_000, "1 2 " * 10_000, "a@b" + ".c" * 5000, "\x01\x02 <", "same text", "same text"]


def odd_docs(spark):
    """Clashing names, null and repeated ids."""
    rows = [(i, t, "x", 1, 1.0) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1, 1.0), (3, "a  x", "x", 1, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n int, score double")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# 11


def fim_brute(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim_odd(spark):
    made = fim.fill_in_middle(odd_docs(spark)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, made.collect()), key=str)
    given = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    assert got == sorted(((k, *fim_brute(k, t), t or "") for k, t in given), key=str)
    assert fim.fill_in_middle(empty_docs(spark)).count() == 0


def test_fim_at_lane_ends():
    """Units, sentinels and cuts over the ends of lanes; ids don't matter here."""
    rng = np.random.default_rng(0)
    texts = ["x" * n for n in (510, 511, 512, 513, 1023, 1024)] + ["é" * 256 + "<M>", "<S" * 300, "😀" * 1000, "a" * 510 + "<S>", "a" * 511 + "é<P", "<<P>", "<P<P>"]
    texts += ["".join(rng.choice(list("ab<PSM>é日😀\n"), size=int(rng.integers(0, 3000)))) for _ in range(300)]
    h = [rng.integers(0, 2**32, len(texts)) for _ in range(4)]
    h[2][:] = 0
    n, form, prefix, middle, output = fim.formed(pa.array(texts), h)
    for i, t in enumerate(texts):
        a, b = sorted(int(h[k][i]) % (len(t) + 1) for k in range(2))
        plain = not t or any(s in t for s in ("<P>", "<S>", "<M>"))
        want = t if plain else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if h[3][i] % 100 < 20 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
        assert (n[i].as_py(), output[i].as_py()) == (len(t), want)


def test_fim_bytes_that_are_no_utf8():
    raw = [b"ab\xff\xfec", b"\xe2\x82", b"ok", b"\xed\xa0\x80x", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"x" * 511 + b"\x80"]
    column = pa.Array.from_buffers(pa.string(), len(raw), pa.array(raw, pa.binary()).buffers())
    scan = fim.Scan(column)
    assert [bool(e) for e in scan.errors] == [True, True, False, True, True, True, True]
    n, _, _, _, output = fim.formed(column, [np.zeros(len(raw), np.int64)] * 2 + [np.full(len(raw), 95), np.zeros(len(raw), np.int64)])
    assert output.to_pylist() == [x.decode("utf-8", "replace") for x in raw] and n.to_pylist() == [len(x) for x in output.to_pylist()]


# 12

BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_brute(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if k == 1 and max(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m.group().split(".")) or k == 2 and not (14 <= len(d) <= 19 and luhn) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in spans)


def cut_spans(df):
    return sorted(((r.doc_id, [(s.start, s.kind, s.end, s.base) for s in r.spans or []]) for r in df.collect()), key=str)


def test_pii_base_as_brute_force(spark):
    docs = common.table(spark, SMALL, "documents")
    got = sorted(map(tuple, pii.op12_pii(spark, SMALL).collect()))
    want = []
    for r in docs.collect():
        b = base_brute(r.text)
        want.append((r.doc_id, *(sum(k == i for _, k, _ in b) for i in range(4)), hashlib.sha256(named(b).encode()).hexdigest(), named(b)))
    assert got == sorted(want) and any(w[-1] for w in want)


def test_pii_base_of_hostile_texts(spark):
    rng = np.random.default_rng(1)
    texts = ["a@b.com_x@c.de", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.256 0001.02.3.4 1.2.3.99999999999", "+1 (743) 555-3824+49 30 1234567 8", "4111 1111 1111 1111 4111-1111-1111-1112", "é😀 x@y.z é", "@@a@b.c"]
    texts += ["".join(rng.choice(list("aB1 59-+.@()é_%"), size=int(rng.integers(0, 120)))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: [s[:3] for s in spans if s[3]] for k, spans in cut_spans(pii.spans_of(docs))}
    assert got == {i: base_brute(t) for i, t in enumerate(texts)}


def planted(spark):
    """Phones after one pattern, with two unseen forms; and numbers after a common pair of words, which are none."""
    texts = [f"please call me on +1 (743) 555-{1000 + i} today, thanks a lot" for i in range(9)]
    texts += ["you may call me on 555-0199. or later", "call me on 5550188, it is late", "so call me on friday"]
    texts += [f"all of the +1 (743) 555-{2000 + i} x" for i in range(4)] + ["one of the 12345 things"]
    texts += [f"because of the {w} x" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()]
    texts += [f"mail: user{i}@mail.example.com ok" for i in range(5)] + ["mail: admin@localhost ok"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


@pytest.mark.parametrize("first", [1, 64])
def test_pii_finds_planted_identifiers(spark, monkeypatch, first):
    monkeypatch.setattr(pii, "FIRST_TEXTS", first)
    docs, texts = planted(spark)
    got = dict(cut_spans(pii.spans_of(docs)))
    added = {(texts[k][a:e], pii.KINDS[kind]) for k, spans in got.items() for a, kind, e, base in spans if not base}
    # "call me on": 9 phones, 2 unknown, 1 plain word; "of the": 4 phones, 1 unknown, 10 plain words
    assert added == {("555-0199", "phone"), ("5550188", "phone"), ("admin@localhost", "email")}
    assert {k: [s[:3] for s in spans if s[3]] for k, spans in got.items()} == {i: base_brute(t) for i, t in enumerate(texts)}


def test_pii_scores_as_brute_force(spark):
    """The same turns over the planted graph, by hand: all scores of patterns and identifiers."""
    docs, texts = planted(spark)
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.concat(*(F.coalesce(pii.mentions(F.col("text"), k), F.array().cast(pii._MENTIONS)) for k in range(5))).alias("mentions"))
    patterns, edges = pii.graph(common.written(pii.placed(common.written(found, "m")), "s"))
    sure, values = pii.confident(patterns, edges, pii.plain_followers(docs, patterns.select("context").distinct()))
    # phone pattern: 9 base and 2 unknown of 12; email pattern: 5 base and 1 unknown of 6
    scores = []
    for base, unknown, everything in ((9, 2, 12), (5, 1, 6)):
        p = base / everything
        for _ in range(pii.ROUNDS - 1):
            p = (base + unknown * p) / everything
        scores.append(round(p, 6))
    assert sorted(round(r.confidence, 6) for r in sure.collect()) == sorted(scores)
    assert sorted(round(r.confidence, 6) for r in values.collect()) == sorted([scores[0], scores[0], scores[1]])


def test_pii_odd(spark):
    got = cut_spans(pii.spans_of(odd_docs(spark)))
    assert len(got) == len(ODD) + 2
    given = sorted(((r.doc_id, base_brute(r.text)) for r in odd_docs(spark).collect()), key=str)
    assert [(k, [s[:3] for s in spans]) for k, spans in got] == given
    assert pii.spans_of(empty_docs(spark)).count() == 0


def test_pii_plan_is_native(spark):
    plan = pii.op12_pii(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 13

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def resample_brute(docs, target):
    cut = [(k, *features(t)) for k, t in docs]
    s, t = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    for _, f, _ in cut:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, features(text)[0], 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1.0) * (S + 10_000) / ((int(a) + 1.0) * (T + 10_000)))) for a, b in zip(s, t)]
    out = []
    for k, f, n in cut:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(eligible[: 5 * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("rows", [4, 8192])
def test_resample_as_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(resample, "RANGE_ROWS", rows)
    monkeypatch.setattr(resample, "BLOCK_ROWS", rows)
    folder = SMALL.replace("0.001", "0.01")
    got = sorted(map(tuple, resample.op13_resample(spark, folder).collect()), key=str)
    docs = [(r.doc_id, r.text) for r in common.table(spark, folder, "documents").collect()]
    assert got == resample_brute(docs, [r.text for r in common.table(spark, folder, "benchmark").collect()])
    assert sum(r[4] is not None for r in got) > 30


def test_resample_of_equal_rows(spark, monkeypatch):
    """One row 600 times, null ids among others: ranks are complete, equal scores go by id."""
    monkeypatch.setattr(resample, "RANGE_ROWS", 10)
    monkeypatch.setattr(resample, "RUN_ROWS", 64)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 16)
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(7, text)] * 600 + [(None, text)] * 50 + [(i, text) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("one two three",)], "text string")
    got = sorted(map(tuple, resample.resample(df, target, percent=90).collect()), key=str)
    drawn = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in drawn] == list(range(1, 90 * 750 // 100 + 1))
    order = [(-r[3], math.inf if r[0] is None else r[0]) for r in drawn]
    assert order == sorted(order)
    rest = [(-r[3], math.inf if r[0] is None else r[0]) for r in got if r[4] is None]
    assert min(rest) >= max(order)


def test_resample_odd(spark):
    target = spark.createDataFrame([(None, 1), ("a x", 2)], "text string, bucket int")
    got = sorted(map(tuple, resample.resample(odd_docs(spark), target).collect()), key=str)
    assert got == resample_brute([(r.doc_id, r.text) for r in odd_docs(spark).collect()], ["a x"])
    assert resample.resample(empty_docs(spark), target).count() == 0
    assert resample.resample(odd_docs(spark), target.limit(0)).count() == len(ODD) + 2


def test_resample_cuts_long_texts(monkeypatch):
    """Parts of any size give the features of the whole text; words longer than a part and than the shift tables too."""
    text = " ".join(["alpha", "β" * 90, "c", "Delta-e", "x" * 300, "f9"] * 40)
    for size in (1, 7, 100, 1 << 20):
        buckets = sorted(b for _, _, _, bucket, _ in resample.buckets_of(pa.array([text, "k"]).slice(0, 1), size) for b in bucket.tolist())
        assert buckets == sorted(features(text)[0])


def test_tournament():
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 3, 7, 40):
        runs = [sorted((int(a), int(b)) for a, b in rng.integers(0, 9, (int(rng.integers(0, 30)), 2))) for _ in range(k)]
        everything = sorted(x for r in runs for x in r)
        for most in (0, 1, 10, len(everything) + 5):
            assert list(resample.tournament(runs, most)) == everything[:most]
