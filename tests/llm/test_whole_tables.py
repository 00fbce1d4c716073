"""Each numbered query over whole tables, against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests_llm_brute import brute_components
from weblens.llm import queries as Q

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def text(r):
    return r["text"] or ""


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(spark, sf_dir, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in Q.op1_token_counts(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, r in docs.items():
        n = len(model.encode(text(r)))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text(r).encode()), n, n > 4096)


def test_op2(spark, sf_dir, docs):
    got = Q.op2_source_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    size = {i: len(WORD.findall(text(r))) for i, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s))
    own = Counter()
    for i, r in docs.items():
        own[r["source"]] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(own.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * own[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * own[s] for s in full}
        left -= sum(2 * own[s] for s in full)
        free -= full
    taken = Counter()
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, r in docs.items() if r["source"] == s)
    again = {(r["doc_id"], r["taken"]) for r in Q.op2_source_mixing(spark, sf_dir).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_op3(spark, sf_dir, docs):
    key = lambda line: line.strip(WS).translate(LOWER)
    holders = defaultdict(set)
    for i, r in docs.items():
        for line in text(r).split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    assert common
    got = {r["doc_id"]: r for r in Q.op3_line_dedup(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, r in docs.items():
        lines = text(r).split("\n")
        kept = [x for x in lines if common.get(key(x), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))


def test_op4(spark, sf_dir, docs):
    want = brute_components({i: text(r) for i, r in docs.items()}, 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op4_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert len(Q.oracle_sql()) == 6
    for name, sql in Q.oracle_sql().items():
        df = Q.queries()[name](spark, sf_dir)
        columns = sorted(df.columns)
        found = con.execute(sql)
        place = {c[0]: k for k, c in enumerate(found.description)}
        want = sorted((tuple(r[place[c]] for c in columns) for r in found.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_op5(spark, sf_dir):
    chats = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        chats[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    chats[-1] = [(0, "user", Q.PROBE), (1, "assistant", Q.PROBE)]
    got = {r["conv_id"]: r for r in Q.op5_chat_formatting(spark, sf_dir).collect()}
    assert got.keys() == chats.keys()
    for i, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))
        assert tuple(got[i])[1:5] == want
        assert got[i]["formatted_chars"] >= sum(len(t) for _, _, t in turns)


def test_op6(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in Q.op6_packing(spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert pieces.keys() == docs.keys()
    import numpy as np

    for i, r in docs.items():
        ids = np.array([*model.encode(text(r), add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0 or at == 4096
    assert sum(sum(p["length"] for p in own) < 4096 for own in windows.values()) <= 12 * 8


def test_op7(spark, sf_dir, docs):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    got = {r["doc_id"]: r for r in Q.op7_merkle_fingerprints(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    by_text = defaultdict(set)
    for i, r in docs.items():
        t, nxt = text(r), text(docs[after[i]])
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited))
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
        by_text[t].add(got[i]["fingerprint"])
        by_text[edited].add(got[i]["edited_fingerprint"])
        assert (got[i]["near_next"] == 1) == (t == nxt)
    assert all(len(x) == 1 for x in by_text.values())
    assert len({x for s in by_text.values() for x in s}) == len(by_text)
    long = [r for r in got.values() if r["n_chars"] > 1000]
    assert sum(r["near_edited"] > 0.3 for r in long) > 0.95 * len(long)


def test_op8(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in Q.op8_language_id(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    assert all(got[i]["held_out"] == held(i) for i in docs)
    for i, r in docs.items():
        if not any(c.isalpha() for c in text(r)):
            assert got[i]["lang_pred"] == "und"
    tested = [i for i, r in docs.items() if held(i) and r["lang"] and any(c.isalpha() for c in text(r))]
    right = sum(got[i]["lang_pred"] == docs[i]["lang"] for i in tested)
    print("language accuracy", right / len(tested), [(i, docs[i]["lang"], got[i]["lang_pred"], text(docs[i])[:60]) for i in tested if got[i]["lang_pred"] != docs[i]["lang"]][:10])
    assert right >= 0.97 * len(tested)


def test_op9(spark, sf_dir, docs):
    groups = defaultdict(list)
    for i, r in docs.items():
        groups[text(r).translate({ord(c): None for c in WS})].append(i)
    got = {r["doc_id"]: r for r in Q.op9_exact_dedup(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for norm, members in groups.items():
        keep = min(members, key=lambda i: (-len(text(docs[i])), i))
        for i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(members), i == keep, sha(norm))


def test_op10(spark):
    """Held-out labels of every language, at the size where each language has toxic ones to test on."""
    large = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "lang").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op10_toxicity(spark, large).collect()}
    assert got.keys() == docs.keys()
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 and r["held_out"] == held(i) for i, r in got.items())
    for lang in ("en", "de", "fr", "es", None):
        pairs = [(got[i]["score"], labels[i]) for i in docs if held(i) and labels.get(i) is not None and docs[i] and lang in (None, docs[i])]
        good, bad = [s for s, y in pairs if not y], [s for s, y in pairs if y]
        auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
        print("toxicity", lang, len(good), len(bad), round(auc, 3), "recall", sum(b >= 0.3 for b in bad) / len(bad), "of clean", sum(g >= 0.3 for g in good) / len(good))
        assert auc > 0.9
        assert sum(b >= 0.3 for b in bad) >= 0.6 * len(bad) and sum(g >= 0.3 for g in good) <= 0.12 * len(good)
