"""Personal data, periodic runs and spelling variants against plain Python, and on odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from weblens.llm import exactdup, langid, periodic, pii, spelling
from weblens.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def some_words(rng):
    n, k = rng.choice([5, 30, 60, 150, 400]), rng.choice([1, 2, 3, 10, 100])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, end = rng.randrange(n), rng.randrange(n) + 1
        p = rng.randint(1, max(1, (n - a) // 2))
        for i in range(a, end):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("short,rounds", [(64, 12), (4, 12), (8, 1)])
def test_runs_of_any_lag(monkeypatch, short, rounds):
    """Lags scanned whole or by blocks, segments split at once or one by one: all runs are found."""
    monkeypatch.setattr(periodic, "SHORT", short)
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(short)
    for _ in range(300):
        words = np.array(some_words(rng))
        parts = periodic.segments(words, np.zeros(len(words), np.int64))
        assert all((np.unique(words[a:b], return_counts=True)[1] > 1).all() for a, b in parts)
        got = sorted((a + s, n, p) for a, b in parts for s, n, p in periodic.runs_of(words[a:b]))
        assert got == plain_runs(words.tolist())


def test_runs_of_a_long_text():
    whole = np.tile(np.random.default_rng(0).integers(0, 50, 60_000), 5)
    assert periodic.runs_of(whole)[0] == (0, 300_000, 60_000) or (0, 300_000, 60_000) in periodic.runs_of(whole)


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "a " * 20, 1), (4, "a " * 20, 2), (None, "x y " * 6 + "z", 0), (5, "\x1ca b\x85 " * 6, 0), (6, "one two", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()))
    assert got == [
        (0, [(0, 12, 2)], "x y z"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 20, 1)], "a"), (4, [(0, 20, 1)], "a"),
        (5, [(0, 12, 2)], "\x1ca b\x85"), (6, [], "one two"),
    ]
    assert periodic.find_runs(docs.limit(0)).count() == 0


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) - len(y) == 1 and any(x[:k] + x[k + 1 :] == y for k in range(len(x)))


def plain_variants(words, times=10):
    out = {}
    for w in words:
        others = [x for x in words if x != w and near(x, w)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= times * words[w] else None, len(others))
    return out


def test_composition_accepts_the_pairs_one_edit_apart():
    rng = random.Random(2)
    for t in range(300):
        letters = "ab" if t % 3 == 0 else "abcé"
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(t % 3, 6))) for _ in range(rng.choice([1, 2, 10, 60]))})
        x, y = spelling.near_pairs(words)
        got = sorted(tuple(sorted(p)) for p in zip(x.tolist(), y.tolist()))
        assert got == [(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if near(words[a], words[b])]


@pytest.mark.parametrize("most", [spelling.PART, 3])
def test_variants_of_large_parts(spark, most):
    """Parts beyond their bound, those with all words too, are dealt anew, and no pair is lost."""
    rng = random.Random(5)
    words = {}
    while len(words) < 150:
        w = "".join(rng.choice("ab") for _ in range(rng.randint(7, 9)))
        words[w] = rng.choice([2, 3, 30, 400])
    words |= {"aaa" + w: 2 for w in list(words)[:60]}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), most=most).collect()}
    want = plain_variants(words)
    assert got.keys() == words.keys()
    for w, (form, n_near) in want.items():
        root = w
        while want[root][0]:
            root = want[root][0]
        assert tuple(got[w]) == (w, form, root, words[w], n_near, words.get(form))


def test_words_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "1234567"), (4, "Abcdefg ABCDEFG abcdefgÉ"), (None, "abcdefgÉ short"), (4, "once-only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, spelling.count_words(docs).collect())) == [("abcdefg", 2), ("abcdefgÉ", 2)]
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0
    assert Q.typo(3, "abcdefgh") == "abcdefgh" or len(Q.typo(3, "abcdefgh")) == 7


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_base(text):
    out = []
    for k, (kind, form) in enumerate(BASE):
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if (kind != "ip" or all(int(x) <= 255 for x in m.group().split("."))) and (kind != "card" or 14 <= len(digits) <= 19 and doubled % 10 == 0) and (kind != "phone" or 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    bits = ["a.b@c-d.e.f", "x@y", "@", "q%+@a..b@c.de", "10.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "0", "+1 (499) 555-6503", "+49", "--", ".", " ", "  ", "word", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice(["", "", " ", ". "]) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_base(text), text


def test_contexts_lead_to_unseen_identifiers(spark):
    known = [(k, f"Please write to my mailbox: user{k}@host{k}.example.org today, thanks.") for k in range(30)]
    unseen = [(100, "Please write to my mailbox: jane.roe [at] web [dot] example today, thanks."), (101, "They meet at home. Look at it [at] noon."), (102, None), (103, ""), (104, "version 4 [at] best [dot] none")]
    merged = [(200 + k, f"Call +1 (5{k}) 555-01{k} now") for k in range(10, 40)] + [(300, "Call +1 (578) 555-6437 4918187128635271 now")]
    docs = spark.createDataFrame(known + unseen + merged, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert len(got) == docs.count()
    text = dict(unseen + merged)
    shown = lambda i: [(text[i][s["start"] : s["end"]], s["kind"]) for s in got[i]["spans"]]
    assert shown(100) == [("jane.roe [at] web [dot] example", 0)]
    assert got[101]["spans"] == got[102]["spans"] == got[103]["spans"] == got[104]["spans"] == []
    assert ("+1 (578) 555-6437", 3) in shown(300) and got[300]["base"] == []
    assert all(set(r["base"]) <= set(r["spans"]) for r in got.values())
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_op11_base(spark, sf_dir):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op11_pii(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_base(text)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(got[i]["spans"].split(",")) and got[i]["n_base"] == len(shown)


def test_op11_counts_the_fixed_forms(spark, tmp_path):
    """Spans that the method adds are in ``spans`` alone; the counts are those of ``base_sha256``."""
    rows = [(k, f"Please write to my mailbox: user{k}@host{k}.example.org today, thanks.") for k in range(30)]
    rows += [(100, "Please write to my mailbox: jane.roe [at] web [dot] example today, thanks."), (101, None), (102, "10.0.0.1 and a@b.cd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.op11_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = [k for _, k, _ in plain_base(text or "")]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [base.count(n) for n in range(4)], i
    assert (got[100]["n_email"], got[100]["n_spans"], got[100]["n_base"]) == (0, 1, 0) and got[100]["spans"].startswith("email:28:")


def test_language_does_not_hang_on_the_batch(spark):
    train = spark.createDataFrame([("en", "the quick brown fox and the dog " * 5 + "a"), ("de", "der schnelle braune fuchs und der hund " * 5)] * 3, "lang string, text string")
    train = train.withColumn("text", train["text"]).union(spark.createDataFrame([(f"l{k}", f"word{k} " * 9) for k in range(300)], "lang string, text string"))
    model = langid.learn_languages(train)  # 302 languages
    texts = ["a", "é", "ab", "the dog", "7", "", "x\x00y", "der hund"]
    alone = [model.predict([t])[0] for t in texts]
    assert [a[0] == "und" for a in alone] == [False, False, False, False, True, True, False, False]
    for k in range(len(texts)):
        turned = texts[k:] + texts[:k]
        assert model.predict(turned) == alone[k:] + alone[:k]
    assert model.predict(["a"] * 6) == [alone[0]] * 6


@pytest.mark.parametrize("large", [2000, 3])
def test_long_copies_in_groups(spark, monkeypatch, large):
    monkeypatch.setattr(exactdup, "LARGE", large)
    rows = [(k, f"{k // 2:05d}" * 15_000) for k in range(12)] + [(100 + k, "same " * 20_000) for k in range(9)] + [(200 + k, "short") for k in range(7)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (k // 2 * 2, 2) for k in range(12)} | {100 + k: (100, 9) for k in range(9)} | {200 + k: (200, 7) for k in range(7)}
